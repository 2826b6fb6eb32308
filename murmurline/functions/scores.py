"""Thresholds, ratios, marginals and label recodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(score: str | Column, threshold: float) -> Column:
    """1 where the score is strictly above the threshold, else 0; null counts 0."""
    c = F.col(score) if isinstance(score, str) else score
    return F.coalesce((c > F.lit(threshold)).cast("int"), F.lit(0))


# Thresholds of the two hourly counting jobs.
ALCOHOL_THRESHOLDS = {
    "casual": ("predict_present", 0.6),
    "looking": ("predict_future", 0.6),
    "reflecting": ("predict_past", 0.6),
    "alc": ("predict_alc", 0.5),
    "fpa": ("predict_fpa", 0.75),
}
TOBACCO_THRESHOLDS = {
    "present": ("predict_present", 0.5),
    "tob": ("predict_tob", 0.5),
    "fp": ("predict_fp", 0.5),
    "cur": ("predict_cur", 0.5),
    "com": ("predict_com", 0.5),
}


def alcohol_flags() -> dict[str, Column]:
    """Flags of the alcohol job (P10) plus the keyword flag counted with them."""
    out = {name: flag(score, limit) for name, (score, limit) in ALCOHOL_THRESHOLDS.items()}
    out["alc_key"] = F.coalesce(F.col("alc_key").cast("int"), F.lit(0))
    return out


def tobacco_flags() -> dict[str, Column]:
    """Flags of the tobacco job, with current-and-water-pipe as ``psh``."""
    out = {name: flag(score, limit) for name, (score, limit) in TOBACCO_THRESHOLDS.items()}
    out["psh"] = flag("predict_cur", 0.5) * F.coalesce(F.col("shisha").cast("int"), F.lit(0))
    return out


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num/den with 0 for 0/0 and for nulls."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def gated(parent: Column, threshold: float, conditional: Column) -> Column:
    """Conditional score where its parent passes the gate, else 0."""
    return F.when(parent > threshold, conditional).otherwise(F.lit(0.0))


def with_marginals(df: DataFrame, gate: str, threshold: float, chain: list[tuple[str, str, str]]) -> DataFrame:
    """Product rule along a chain of conditional scores.

    ``chain`` lists (parent, conditional, marginal); every conditional is zero
    unless ``gate`` exceeds ``threshold``, and marginal = parent x conditional.
    """
    for parent, conditional, marginal in chain:
        df = df.withColumn(conditional, F.coalesce(gated(F.col(gate), threshold, F.col(conditional)), F.lit(0.0)))
        df = df.withColumn(marginal, F.col(parent) * F.col(conditional))
    return df


ALCOHOL_CHAIN = [
    ("predict_alc", "predict_fpa_given_alc", "predict_fpa"),
    ("predict_fpa", "predict_present_given_fpa", "predict_present"),
    ("predict_fpa", "predict_future_given_fpa", "predict_future"),
    ("predict_fpa", "predict_past_given_fpa", "predict_past"),
]
TOBACCO_CHAIN = [
    ("predict_tob", "predict_fp_given_tob", "predict_fp"),
    ("predict_fp", "predict_not_cur_given_fp", "predict_not_cur"),
    ("predict_fp", "predict_cur_given_fp", "predict_cur"),
    ("predict_fp", "predict_not_present_given_fp", "predict_not_present"),
    ("predict_fp", "predict_present_given_fp", "predict_present"),
]


def recode(label: Column, negative: str) -> Column:
    """0 for the negative label, 1 for any other."""
    return F.when(label == negative, 0).otherwise(1)


def fold_heavy(level: Column) -> Column:
    """Level 3 (heavy) folded into level 0."""
    return F.when(level == 3, 0).otherwise(level)


def proportion_error(count: Column, total: Column) -> Column:
    """Standard error of a proportion count/total (A10)."""
    p = count / total
    return F.sqrt(p - p * p) / F.sqrt(total)
