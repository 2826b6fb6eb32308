"""Evaluation from labels and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurline.operators.ranking import in_order
from murmurline.session import cut_lineage


def confusion_counts(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(y, yhat, n, share of the true class) (A15); at most classes squared rows."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def class_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("pred_n"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("pred_n"),
                 F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("true_n", "pred_n", "hit")])
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hit", "pred_n"), zero)
    recall = F.coalesce(F.try_divide("hit", "true_n"), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("true_n") + F.col("pred_n")), zero)
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
                       F.col("true_n").alias("support"))


def overall_scores(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, one row."""
    report = class_report(df, y, yhat)
    n = F.sum("support")
    return report.agg((F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"),
                      *[(F.sum(F.col(c) * F.col("support")) / n).alias(f"weighted_{c}")
                        for c in ("precision", "recall", "f1")], n.alias("support"))


def cohen_kappa(df: DataFrame, a: str = "y", b: str = "yhat") -> DataFrame:
    """Chance-corrected agreement of two raters, one row."""
    counts = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = counts.select("n", F.col("a").alias("l"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("hit"),
                          F.lit(1).alias("first")).unionByName(
            counts.select("n", F.col("b").alias("l"), F.lit(0).cast("long").alias("hit"), F.lit(0).alias("first")))
    per = sides.groupBy("l").agg(F.sum(F.col("n") * F.col("first")).alias("na"),
                                 F.sum(F.col("n") * (1 - F.col("first"))).alias("nb"), F.sum("hit").alias("hit"))
    return per.agg(F.sum("na").alias("n"), (F.sum("hit") / F.sum("na")).alias("observed"),
                   (F.sum(F.col("na") * F.col("nb")) / (F.sum("na") * F.sum("na"))).alias("expected")).select(
        "n", "observed", "expected", ((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def _counted(df: DataFrame, score: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., score, p, n): positive and negative rows of every score; ties and copies collapse here."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))


def _curves(counts: DataFrame, by: tuple[str, ...] = (), previous: bool = False) -> DataFrame:
    """``counts`` with tp and fp, the positives and negatives at this score or above, for all curves in one ordered pass."""
    placed = in_order(counts, [F.col("score").desc()], by, ("p", "n"), ("p", "n") if previous else ())
    return placed.select(*[c for c in placed.columns if not c.endswith("_before")],
                         (F.col("p_before") + F.col("p")).alias("tp"), (F.col("n_before") + F.col("n")).alias("fp"))


def roc_points(df: DataFrame, score: str = "score", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative true and false positives at every distinct score (M10), of each curve ``by``.

    Scores are counted first; the ordered sums run per range of scores, and
    what higher ranges hold is added.
    """
    return _curves(_counted(df, score, y, by), by)


def roc_rates(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """False and true positive rates of :func:`roc_points`."""
    whole = points.groupBy(*by).agg(F.max("tp").alias("_p"), F.max("fp").alias("_n"))
    joined = points.join(whole, list(by)) if by else points.join(F.broadcast(whole))  # one row
    return joined.select(*by, "score", (F.col("fp") / F.col("_n")).alias("fpr"), (F.col("tp") / F.col("_p")).alias("tpr"))


def roc_auc(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve by trapezoids, one row (M10) or one of each curve.

    Each step adds n x (tp - p / 2): no neighbour has to be looked up.
    """
    return points.groupBy(*by).agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("n") * F.sum("p"))).alias("auc"))


def roc_by_class(df: DataFrame, scores: dict[int, str], y: str = "y") -> DataFrame:
    """(curve, auc) per class, micro and macro.

    Each class is one against the rest. The micro curve pools the rows of all
    classes; the macro curve averages the class curves, interpolated at every
    false positive rate that any of them reaches. The class is a key: the
    number of passes does not depend on the number of classes.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(str(c)).alias("curve"), F.col(s).alias("score"), (F.col(y) == c).cast("int").alias("y"))
        for c, s in scores.items()])).alias("e")).select("e.*")
    counts = cut_lineage(_counted(long, "score", "y", ("curve",)), "score-counts")
    micro = counts.groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).select(F.lit("micro").alias("curve"), "score", "p", "n")
    points = cut_lineage(_curves(counts.unionByName(micro), ("curve",), previous=True), "curves")
    macro = _macro_auc(points.where("curve <> 'micro'"), len(scores)).select(F.lit("macro").alias("curve"), "auc")
    return roc_auc(points, ("curve",)).unionByName(macro)


def _corners(points: DataFrame) -> DataFrame:
    """(curve, fpr, low, high): lowest and highest true positive rate at each false positive rate where a curve bends.

    A curve starts in (0, 0); points inside straight stretches are left out: a
    row hands on the point before it if its own step differs.
    """
    whole = points.groupBy("curve").agg(F.max("tp").alias("_p"), F.max("fp").alias("_n"))
    here, back = F.struct("tp", "fp"), F.struct((F.col("tp") - F.col("p")).alias("tp"), (F.col("fp") - F.col("n")).alias("fp"))
    start = F.col("p_previous").isNull()
    bend = (F.col("p_previous") != F.col("p")) | (F.col("n_previous") != F.col("n"))
    last = (F.col("tp") == F.col("_p")) & (F.col("fp") == F.col("_n"))
    kept = points.join(whole, "curve").select("curve", "_p", "_n", F.explode(F.array_compact(F.array(
        F.when(start | bend, back), F.when(start | last, here)))).alias("c"))
    rates = kept.select("curve", (F.col("c.fp") / F.col("_n")).alias("fpr"), (F.col("c.tp") / F.col("_p")).alias("tpr"))
    return rates.groupBy("curve", "fpr").agg(F.min("tpr").alias("low"), F.max("tpr").alias("high"))


def _macro_auc(points: DataFrame, classes: int) -> DataFrame:
    """Area of the averaged curve.

    Grid points are all rates of all classes. Between two of its own points a
    class runs straight from the upper value of the left one to the lower value
    of the right one; at its own points the upper value counts. The area of an
    average is the average of areas, and a class's area over the grid is that
    of its own straight stretches plus, before each rise, a triangle as wide as
    the gap to the grid point before: neighbours are all that has to be known.
    """
    corners = cut_lineage(_corners(points), "corners")
    grid = in_order(corners.select("fpr").distinct(), [F.col("fpr")], previous=("fpr",)).select("fpr", F.col("fpr_previous").alias("g"))
    own = in_order(corners, [F.col("fpr")], ("curve",), previous=("fpr", "high"))
    rows = own.where("fpr_previous IS NOT NULL").join(grid, "fpr")
    straight = (F.col("fpr") - F.col("fpr_previous")) * (F.col("high_previous") + F.col("low")) / 2
    rise = (F.col("fpr") - F.col("g")) * (F.col("high") - F.col("low")) / 2
    return rows.agg((F.sum(straight + rise) / F.lit(float(classes))).alias("auc"))
