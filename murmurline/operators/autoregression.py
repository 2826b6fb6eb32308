"""Autoregression and stationarity.

A solve never sees more than one segment (a week of hours) or a handful of
autocorrelations; Spark distributes the segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurline.operators.correlation import acf_arrays, durbin
from murmurline.operators.ranking import stable_hash
from murmurline.operators.series import lag_matrix
from murmurline.session import cut_lineage

def yule_walker(series: DataFrame, order_max: int = 25) -> DataFrame:
    """Order by AIC, coefficients padded with zeros to ``order_max``, innovation variance.

    One fold over a row's autocorrelations: every order's solution comes from
    the one before, and the order of least AIC so far is carried along.
    """
    n, c0 = F.col("n").cast("double"), F.col("variance")
    none = F.array().cast("array<double>")
    first = F.struct((n * F.ln(c0)).alias("aic"), F.lit(0).alias("order"), none.alias("phi"), F.lit(1.0).alias("err"))

    def better(best, m, phi, err):
        aic = n * F.ln(c0 * err) + 2 * m
        return F.when(aic < best["aic"], F.struct(aic.alias("aic"), m.alias("order"), phi.alias("phi"), err.alias("err"))).otherwise(best)

    fitted = durbin(F.col("acf"), order_max, {"best": (first, better)})["best"]
    rows = acf_arrays(series, order_max).select("series_id", "n", "variance", fitted.alias("f"))
    padded = F.concat(F.col("f.phi"), F.array_repeat(F.lit(0.0), F.lit(order_max) - F.col("f.order")))
    return rows.select("series_id", "n", F.col("f.order").alias("order"), padded.alias("coefficients"),
                       (F.col("variance") * F.col("f.err") * F.col("n") / (F.col("n") - F.col("f.order") - 1)).alias("variance"))


def default_order(n: int) -> int:
    """Largest order tried when none is given."""
    return min(n - 1, int(10 * math.log10(n)))


def pacf_weights(max_lag: int = 25, p: float = 0.9) -> list[float]:
    """Geometric weights p(1-p)^k of the PACF distance."""
    return [p * (1 - p) ** k for k in range(1, max_lag + 1)]


def lasso_path(gram: np.ndarray, target: np.ndarray, steps: int) -> list[np.ndarray]:
    """Lasso solutions at the first breakpoints of the path, by the homotopy in the active set."""
    p = len(target)
    beta, corr = np.zeros(p), target.astype(float).copy()
    active: list[int] = []
    path, blocked = [beta.copy()], -1
    while len(path) <= steps:
        level = np.abs(corr).max() if not active else np.abs(corr[active]).mean()
        if level < 1e-12:
            break
        if not active or blocked < 0:
            rest = [j for j in range(p) if j not in active]
            if rest:
                active.append(max(rest, key=lambda j: abs(corr[j])))
        sign = np.sign(corr[active])
        move = np.linalg.solve(gram[np.ix_(active, active)], sign)
        slope = gram[:, active] @ move
        reach = level
        for j in set(range(p)) - set(active):
            for cand in ((level - corr[j]) / (1 - slope[j]) if abs(1 - slope[j]) > 1e-14 else np.inf,
                         (level + corr[j]) / (1 + slope[j]) if abs(1 + slope[j]) > 1e-14 else np.inf):
                if 1e-12 < cand < reach and j != blocked:
                    reach = cand
        blocked = -1
        with np.errstate(divide="ignore", invalid="ignore"):
            crossing = -beta[active] / move
        for i, c in enumerate(crossing):
            if 1e-12 < c < reach:
                reach, blocked = c, active[i]
        beta[active] += reach * move
        corr = corr - reach * slope
        if blocked >= 0:
            beta[blocked] = 0.0
            active.remove(blocked)
        path.append(beta.copy())
    return path


def _path_point(path: list[np.ndarray], step: int | None, fraction: float | None) -> np.ndarray:
    """The solution at a breakpoint (from 1), or at a share of the largest L1 norm."""
    if step is not None:
        return path[min(step, len(path)) - 1]
    sizes = np.array([np.abs(b).sum() for b in path])
    want = fraction * sizes[-1]
    k = min(int(np.searchsorted(sizes, want)), len(path) - 1)
    low, gap = path[max(k - 1, 0)], sizes[k] - sizes[max(k - 1, 0)]
    return low + (path[k] - low) * ((want - sizes[max(k - 1, 0)]) / gap if gap > 0 else 0.0)


def _centred(products: np.ndarray) -> np.ndarray:
    """Sums of products about the means, from sums of products (..., p, p) of columns of which the last is 1."""
    n, total = products[..., -1, -1], products[..., -1, :-1]
    return products[..., :-1, :-1] - total[..., :, None] * total[..., None, :] / n[..., None, None]


def lasso_autoregression(lines: DataFrame, lags: int = 50, step: int | None = 4, fraction: float | None = None) -> DataFrame:
    """Lasso coefficients of the lag matrix of each series, oldest lag first.

    ``step`` numbers the breakpoints of the path, the empty model being step 1;
    ``fraction`` takes the solution whose L1 norm is that share of the largest.
    Spark sums the products of the lag columns; a solve sees the sums alone.
    """
    if (step is None) == (fraction is None):
        raise ValueError("give either step or fraction")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        z = _centred(pdf.sort_values("at")["product"].to_numpy(float).reshape(lags + 2, lags + 2))
        path = lasso_path(z[:lags, :lags], z[:lags, lags], step - 1 if step is not None else 8 * lags)
        return pd.DataFrame({"series_id": [pdf["key"].iloc[0]], "coefficients": [_path_point(path, step, fraction)]})

    return summed_products(lag_matrix(lines, lags), "series_id").groupBy("key").applyInPandas(solve, "series_id string, coefficients array<double>")


_SCORED = "fold int, step int, penalty double, mse double, intercept double, coefficients array<double>"


def row_folds(lagged: DataFrame, folds: int, seed: int = 1) -> DataFrame:
    """``lagged`` with ``fold``, 1 to ``folds``, by a hash of series and row."""
    at = stable_hash(F.concat_ws("|", "series_id", F.col("row").cast("string")), seed)
    return lagged.withColumn("fold", (F.pmod(at, F.lit(folds)) + 1).cast("int"))


def summed_products(rows: DataFrame, key: str, kind: str = "string") -> DataFrame:
    """(key, at, product): sums over each key's rows of the products of all pairs of (features..., y, 1), row by row.

    Tasks sum their own rows; Spark adds the tasks' sums.
    """
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for value, part in batch.groupby("key"):
                z = np.column_stack([np.stack(part["features"].to_numpy()), part["y"], np.ones(len(part))]).astype(float)
                held[value] = held.get(value, 0.0) + z.T @ z
        for value, m in held.items():
            yield pd.DataFrame({"key": [value] * m.size, "at": np.arange(m.size, dtype="int32"), "product": m.ravel()})

    wanted = rows.where("y IS NOT NULL").select(F.col(key).cast(kind).alias("key"), "features", "y")
    return wanted.mapInPandas(products, f"key {kind}, at int, product double").groupBy("key", "at").agg(F.sum("product").alias("product"))


def _score_path(pdf: pd.DataFrame) -> pd.DataFrame:
    """Every step of the path over the training rows of a fold, with its mean squared error on the held rows."""
    pdf = pdf.sort_values("at")
    p = math.isqrt(len(pdf)) - 2
    train, held = (pdf[c].to_numpy(float).reshape(p + 2, p + 2) for c in ("train", "held"))
    n, mean, centred = train[-1, -1], train[-1, :-1] / train[-1, -1], _centred(train)
    gram, target = centred[:p, :p], centred[:p, p]
    rows = []
    for step, beta in enumerate(lasso_path(gram, target, 8 * p), 1):
        off = mean[p] - mean[:p] @ beta
        v = np.concatenate([beta, [-1.0, off]])
        rows.append((step, np.abs(target - gram @ beta).max() / n, v @ held @ v / held[-1, -1], off, beta))
    out = pd.DataFrame(rows, columns=["step", "penalty", "mse", "intercept", "coefficients"])
    out.insert(0, "fold", pdf["fold"].iloc[0])
    return out


def lasso_cross_validation(lagged: DataFrame, folds: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pooled lasso over the lags: every step of the path with k-fold validation.

    Returns (step, penalty, mse, mse_error) rows, and (step, penalty, intercept, coefficients) of the step with the least
    error. Steps and penalties are those of the path over all rows, the empty model being step 1; the error is the mean
    over the folds of that step of the fold's own path (its last one, if that path is shorter). Lags are not scaled.
    Spark sums the products of each fold; a solve sees the sums of one fold.
    """
    sums = summed_products(row_folds(lagged, folds, seed), "fold", "int").select(F.col("key").alias("fold"), "at", F.col("product").alias("held"))
    rest = sums.withColumn("train", F.sum("held").over(Window.partitionBy("at")) - F.col("held"))
    whole = sums.groupBy("at").agg(F.sum("held").alias("held")).select(F.lit(0).alias("fold"), "at", "held", F.col("held").alias("train"))
    paths = cut_lineage(rest.unionByName(whole).groupBy("fold").applyInPandas(_score_path, _SCORED), "paths")
    path = paths.where("fold = 0").select("step", "penalty", "intercept", "coefficients")
    ends = paths.where("fold > 0").groupBy("fold").agg(F.max("step").alias("_end"))
    at = path.select("step", "penalty").crossJoin(ends).withColumn("_at", F.least("step", "_end"))
    errors = at.join(paths.select("fold", F.col("step").alias("_at"), "mse"), ["fold", "_at"])
    scores = errors.groupBy("step", "penalty").agg(
        F.avg("mse").alias("mse"), F.sqrt(F.var_samp("mse") / F.count("*")).alias("mse_error"))
    best = path.join(scores.orderBy("mse", "step").limit(1).select("step"), "step")
    return scores, best


# Level-stationarity quantiles of the KPSS statistic.
KPSS_TABLE = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]


def short_lag(n: int) -> int:
    return int(4 * (n / 100) ** 0.25)


def kpss(series: DataFrame, lags: int) -> DataFrame:
    """Level-stationarity statistic and interpolated p-value per series."""
    key = Window.partitionBy("series_id")
    w = key.orderBy("t")
    rows = series.select("series_id", "t", (F.col("x") - F.avg("x").over(key)).alias("e"))
    moved = [(F.lag("e", j).over(w) * F.col("e")).alias(f"_c{j}") for j in range(1, lags + 1)]
    rows = rows.select("series_id", "e", F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), *moved)
    n = F.count("*")
    long_run = F.sum(F.col("e") * F.col("e")) / n
    for j in range(1, lags + 1):
        long_run = long_run + F.lit(2.0 * (1 - j / (lags + 1))) * F.sum(f"_c{j}") / n
    out = rows.groupBy("series_id").agg(((F.sum(F.col("s") * F.col("s")) / (n * n)) / long_run).alias("statistic"))
    p = F.lit(KPSS_TABLE[-1][1])
    for (x0, p0), (x1, p1) in reversed(list(zip(KPSS_TABLE, KPSS_TABLE[1:]))):
        p = F.when(F.col("statistic") < x1, F.lit(p0) + (F.col("statistic") - x0) * ((p1 - p0) / (x1 - x0))).otherwise(p)
    return out.withColumn("p_value", F.least(p, F.lit(KPSS_TABLE[0][1])))


# Dickey-Fuller quantiles with constant and trend, by sample size and probability.
DF_SIZES = [25, 50, 100, 250, 500, 100_000]
DF_PROBS = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
DF_TABLE = [
    [-4.38, -4.15, -4.04, -3.99, -3.98, -3.96],
    [-3.95, -3.80, -3.73, -3.69, -3.68, -3.66],
    [-3.60, -3.50, -3.45, -3.43, -3.42, -3.41],
    [-3.24, -3.18, -3.15, -3.13, -3.13, -3.12],
    [-1.14, -1.19, -1.22, -1.23, -1.24, -1.25],
    [-0.80, -0.87, -0.90, -0.92, -0.93, -0.94],
    [-0.50, -0.58, -0.62, -0.64, -0.65, -0.66],
    [-0.15, -0.24, -0.28, -0.31, -0.32, -0.33],
]


def unit_root_statistics(products: np.ndarray) -> np.ndarray:
    """t values of the first column of many regressions with a constant, from their sums of products (series, p, p) of the
    columns (regressors..., y, 1); one stacked solve."""
    z = _centred(products)
    gram, target, total = z[:, :-1, :-1], z[:, :-1, -1], z[:, -1, -1]
    inverse = np.linalg.pinv(gram, rcond=1e-13, hermitian=True)
    beta = (inverse @ target[:, :, None])[:, :, 0]
    rest = total - (beta * target).sum(1)
    sigma = rest / (products[:, -1, -1] - gram.shape[1] - 1)
    return beta[:, 0] / np.sqrt(sigma * inverse[:, 0, 0])


def unit_root_rows(lines: DataFrame, k: int | None = None) -> DataFrame:
    """(series_id, n, lags, features, y): the regression of each step on the level before it, the trend and ``lags`` earlier steps."""
    w = Window.partitionBy("series_id").orderBy("t")
    steps = lines.select("series_id", "t", "x", F.count("*").over(Window.partitionBy("series_id")).alias("n"), F.row_number().over(w).alias("_t"),
                         F.lag("x").over(w).alias("_level")).withColumn("_d", F.col("x") - F.col("_level"))
    if k is None:  # the cube root of n - 1; the frame of the window is that of the longest series
        wanted = F.floor(F.pow((F.col("n") - 1).cast("double"), F.lit(1 / 3)) + 1e-9).cast("int")
        longest = lines.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        most = int((longest - 1) ** (1 / 3) + 1e-9)
    else:
        wanted, most = F.lit(k), k
    past = F.collect_list("_d").over(w.rowsBetween(-most, -1)) if most else F.array().cast("array<double>")
    rows = steps.select("series_id", "n", wanted.alias("lags"), "_level", "_t", "_d", past.alias("_past"))
    rows = rows.where((F.col("_t") > F.col("lags") + 1) & (F.size("_past") >= F.col("lags")))
    latest = F.slice("_past", F.size("_past") - F.col("lags") + 1, F.col("lags")) if most else F.col("_past")
    return rows.select("series_id", "n", "lags", F.concat(F.array("_level", F.col("_t").cast("double")), F.reverse(latest)).alias("features"),
                       F.col("_d").alias("y"))


def adf(lines: DataFrame, k: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller statistic and interpolated p-value per series.

    ``k`` lagged differences; by default the cube root of n - 1. Spark sums the
    products of the lag columns; all series of one size are solved together.
    """
    @F.pandas_udf("statistic double, p_value double")
    def test(sums: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=sums.index, columns=["statistic", "p_value"])
        sizes = sums.map(len)
        for size in sizes.unique():
            mine, p = sizes.index[sizes == size], math.isqrt(size)
            out.loc[mine, "statistic"] = unit_root_statistics(np.stack(sums[mine].to_numpy()).astype(float).reshape(-1, p, p))
        for i in out.index:
            quantiles = [np.interp(n[i] - 1, DF_SIZES, row) for row in DF_TABLE]
            out.loc[i, "p_value"] = np.interp(out.loc[i, "statistic"], quantiles, DF_PROBS)
        return out

    rows = unit_root_rows(lines, k)
    packed = summed_products(rows, "series_id").groupBy(F.col("key").alias("series_id")).agg(
        F.array_sort(F.collect_list(F.struct("at", "product"))).alias("_p"))
    sizes = rows.groupBy("series_id").agg(F.first("n").alias("n"), F.first("lags").alias("lags"))
    return packed.join(sizes, "series_id").select("series_id", "lags", test(F.col("_p.product"), "n").alias("r")).select(
        "series_id", "r.statistic", "lags", "r.p_value")
