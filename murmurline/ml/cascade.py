"""Cascades of classifiers (M4-M6).

Every stage scores only the rows above the gate: the filter comes before the
models in the plan, and the rest joins by union with zero scores. The first
score is written to the shared folder before the rows part ways, so that no
branch and no pushed-down filter runs the first model a second time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.functions.scores import ALCOHOL_CHAIN, TOBACCO_CHAIN, with_marginals
from murmurline.functions.text import has_keyword, mentions_shisha, plain_ascii
from murmurline.functions.vocabulary import ALCOHOL_KEYWORDS
from murmurline.ml.classifiers import probability
from murmurline.operators.joins import outer_union
from murmurline.session import cut_lineage


def scored(model: PipelineModel, df: DataFrame, names: list[str | None]) -> DataFrame:
    """Class probabilities as named columns; ``None`` skips a class.

    One-vs-rest models give raw margins, which become normalised sigmoids.
    """
    out = model.transform(df)
    if "probability" not in out.columns:
        from pyspark.ml.functions import vector_to_array
        raw = F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-v)))
        total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
        shares = F.transform(raw, lambda v: v / total)
        out = out.withColumns({n: shares[i] for i, n in enumerate(names) if n})
    else:
        out = out.withColumns({n: probability(of=i) for i, n in enumerate(names) if n})
    return out.select(*df.columns, *[n for n in names if n])


def with_features(models: list[PipelineModel], df: DataFrame) -> tuple[DataFrame, list[PipelineModel], str | None]:
    """``df`` with the features that all the models share, what is left of the models, and the name of that column.

    Models of one training set differ only in their last stage; others stay as they are, and the name is null.
    """
    shared = {tuple(s.uid for s in m.stages[:-1]) for m in models}
    if len(shared) > 1 or not all(shared):
        return df, models, None
    name = models[0].stages[-1].getFeaturesCol()
    ready = PipelineModel(models[0].stages[:-1]).transform(df).select(*df.columns, name)
    return ready, [PipelineModel(m.stages[-1:]) for m in models], name


def _kept_where(df: DataFrame, name: str | None, condition) -> DataFrame:
    """Features stay only with the rows that later models score."""
    return df if name is None else df.withColumn(name, F.when(condition, F.col(name)))


class AlcoholCascade:
    """Alcohol, then first person and its level where alcohol is likely (M4)."""

    def __init__(self, alcohol: PipelineModel, first_person: PipelineModel, level: PipelineModel):
        self.alcohol, self.first_person, self.level = alcohol, first_person, level

    def __call__(self, df: DataFrame, threshold: float = 0.75) -> DataFrame:
        ready, (alcohol, first_person, level), features = with_features([self.alcohol, self.first_person, self.level], df)
        base = _kept_where(scored(alcohol, ready, [None, "predict_alc"]), features, F.col("predict_alc") > threshold)
        base = cut_lineage(base, "alcohol-scores")
        likely = base.where(F.col("predict_alc") > threshold)
        likely = scored(first_person, likely, [None, "predict_fpa_given_alc"])
        likely = scored(level, likely, ["predict_present_given_fpa", "predict_future_given_fpa", "predict_past_given_fpa"])
        rest = base.where(F.col("predict_alc") <= threshold)
        conditional = [c for _, c, _ in ALCOHOL_CHAIN]
        both = likely.unionByName(rest.withColumns({c: F.lit(0.0) for c in conditional}))
        return with_marginals(both if features is None else both.drop(features), "predict_alc", threshold, ALCOHOL_CHAIN)


class TobaccoCascade:
    """Tobacco and the combined class for all, the rest where tobacco is likely (M5)."""

    def __init__(self, tobacco: PipelineModel, first_person: PipelineModel, present: PipelineModel,
                 current: PipelineModel, combined: PipelineModel):
        self.tobacco, self.first_person, self.present = tobacco, first_person, present
        self.current, self.combined = current, combined

    def __call__(self, df: DataFrame, threshold: float = 0.2) -> DataFrame:
        ready, (tobacco, combined, first_person, current, present), features = with_features(
            [self.tobacco, self.combined, self.first_person, self.current, self.present], df)
        base = scored(combined, scored(tobacco, ready, [None, "predict_tob"]), [None, "predict_com"])
        base = cut_lineage(_kept_where(base, features, F.col("predict_tob") > threshold), "tobacco-scores")
        likely = base.where(F.col("predict_tob") > threshold)
        likely = scored(first_person, likely, [None, "predict_fp_given_tob"])
        likely = scored(current, likely, ["predict_not_cur_given_fp", "predict_cur_given_fp"])
        likely = scored(present, likely, ["predict_not_present_given_fp", "predict_present_given_fp"])
        rest = base.where(F.col("predict_tob") <= threshold)
        conditional = [c for _, c, _ in TOBACCO_CHAIN]
        both = likely.unionByName(rest.withColumns({c: F.lit(0.0) for c in conditional}))
        return with_marginals(both if features is None else both.drop(features), "predict_tob", threshold, TOBACCO_CHAIN)


def score_alcohol(tweets: DataFrame, cascade: AlcoholCascade, threshold: float = 0.5,
                  keywords: Iterable[str] = ALCOHOL_KEYWORDS) -> DataFrame:
    """Complete rows, keyword flag, cascade on keyword rows only, all rows back (M6)."""
    flagged = tweets.dropna("any").withColumn("alc_key", has_keyword(F.col("text"), keywords))
    return outer_union(flagged.where("NOT alc_key"), cascade(flagged.where("alc_key"), threshold))


def score_tobacco(tweets: DataFrame, cascade: TobaccoCascade, threshold: float = 0.2) -> DataFrame:
    """Complete rows, cleaned text, cascade, water-pipe flag (M6)."""
    cleaned = tweets.dropna("any").withColumn("text", plain_ascii(F.col("text")))
    return cascade(cleaned, threshold).withColumn("shisha", mentions_shisha(F.col("text")))
