"""Auto-, partial and cross-correlation, and their tests."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lag_products(df: DataFrame, left: Column, right: Column, lags: list[int], scale: Column) -> DataFrame:
    """Sums of left[t + k] x right[t] per lag, from one ordered window per series."""
    w = Window.partitionBy("series_id").orderBy("t")

    def moved(k: int) -> Column:
        return (F.lead("_a", k) if k >= 0 else F.lag("_a", -k)).over(w)

    rows = df.select("series_id", "t", left.alias("_a"), right.alias("_b"))
    rows = rows.select("series_id", "_a", "_b", *[(moved(k) * F.col("_b")).alias(f"_p{i}") for i, k in enumerate(lags)])
    sums = rows.groupBy("series_id").agg(F.count("*").alias("n"), scale.alias("_s"),
                                         *[F.coalesce(F.sum(f"_p{i}"), F.lit(0.0)).alias(f"_p{i}") for i in range(len(lags))])
    entries = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_p{i}") / F.col("_s")).alias("r")) for i, k in enumerate(lags)])
    return sums.select("series_id", "n", "_s", F.explode(entries).alias("e")).select(
        "series_id", "n", F.col("_s").alias("scale"), "e.lag", "e.r")


def _centered(name: str) -> Column:
    return F.col(name) - F.avg(name).over(Window.partitionBy("series_id"))


def acf(series: DataFrame, max_lag: int = 30) -> DataFrame:
    """(series_id, n, lag, acf) for lags 0..max_lag, 1/n normalised."""
    rows = series.select("series_id", "t", _centered("x").alias("d"))
    out = _lag_products(rows, F.col("d"), F.col("d"), list(range(max_lag + 1)), F.sum(F.col("_a") * F.col("_a")))
    return out.select("series_id", "n", "lag", F.col("r").alias("acf"), (F.col("scale") / F.col("n")).alias("variance"))


def ccf(pairs: DataFrame, max_lag: int = 24) -> DataFrame:
    """(series_id, lag, ccf) of columns xa, xb: lag k relates xa[t + k] to xb[t]."""
    rows = pairs.select("series_id", "t", _centered("xa").alias("a"), _centered("xb").alias("b"))
    scale = F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b")))
    out = _lag_products(rows, F.col("a"), F.col("b"), list(range(-max_lag, max_lag + 1)), scale)
    return out.select("series_id", "lag", F.col("r").alias("ccf"))


def acf_arrays(series: DataFrame, max_lag: int) -> DataFrame:
    """One row per series with acf of lags 0..max_lag as an array."""
    return (acf(series, max_lag).groupBy("series_id", "n", "variance")
            .agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_p"))
            .select("series_id", "n", "variance", F.col("_p.acf").alias("acf")))


def durbin(acf: Column, orders: int, keep: dict[str, tuple[Column, Callable]] | None = None) -> Column:
    """Durbin's recursion over an array of autocorrelations (lag 0 first), as a fold of array expressions.

    The result is a struct of ``phi`` (coefficients of the last order), ``err`` (its share of the variance) and
    ``reflections`` (the last coefficient of every order, the partial autocorrelations). ``keep`` adds fields: a first
    value, and a function of (the field so far, order, phi, err) for its next one.
    """
    keep = keep or {}
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), F.lit(1.0).alias("err"), none.alias("reflections"), *[v.alias(k) for k, (v, _) in keep.items()])

    def bound(value: Column, then: Callable[[Column], Column]) -> Column:
        """then(value), with the value computed once."""
        return F.transform(F.array(value), then)[0]

    def step(state: Column, m: Column) -> Column:
        known = state["phi"]
        past = F.reverse(F.slice(acf, F.lit(2), m - 1))
        dot = F.aggregate(F.zip_with(known, past, lambda p, r: p * r), F.lit(0.0), lambda s, v: s + v)

        def with_reflection(k: Column) -> Column:
            phi = F.concat(F.zip_with(known, F.reverse(known), lambda p, q: p - k * q), F.array(k))
            err = state["err"] * (F.lit(1.0) - k * k)
            return bound(F.struct(phi.alias("phi"), err.alias("err")), lambda new: F.struct(
                new["phi"].alias("phi"), new["err"].alias("err"), F.concat(state["reflections"], F.array(k)).alias("reflections"),
                *[then(state[name], m, new["phi"], new["err"]).alias(name) for name, (_, then) in keep.items()]))

        return bound((F.element_at(acf, m + 1) - dot) / state["err"], with_reflection)

    return F.aggregate(F.sequence(F.lit(1), F.lit(orders)), start, step)


def pacf_arrays(series: DataFrame, max_lag: int = 48) -> DataFrame:
    """(series_id, pacf) with lags 1..max_lag (W16); the recursion sees only max_lag + 1 numbers a series."""
    return acf_arrays(series, max_lag).select("series_id", durbin(F.col("acf"), max_lag)["reflections"].alias("pacf"))


def pacf(series: DataFrame, max_lag: int = 48) -> DataFrame:
    return pacf_arrays(series, max_lag).select("series_id", F.posexplode("pacf").alias("lag", "pacf")).withColumn(
        "lag", F.col("lag") + 1)


def ljung_box(series: DataFrame, lags: int = 48) -> DataFrame:
    """Portmanteau statistic and its chi-square tail (N18); the number of lags is even."""
    if lags % 2:
        raise ValueError("the closed tail form needs an even number of lags")
    stat = F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))
    out = acf(series, lags).where("lag > 0").groupBy("series_id").agg(stat.alias("statistic"))
    half = F.col("statistic") / 2
    terms = [F.exp(F.lit(float(j)) * F.ln(half) - half - F.lit(math.lgamma(j + 1))) for j in range(lags // 2)]
    tail = terms[0]
    for term in terms[1:]:
        tail = tail + term
    return out.withColumn("p_value", F.least(tail, F.lit(1.0)))


def _beta_tail(t: np.ndarray, dof: np.ndarray, steps: int = 200) -> np.ndarray:
    """Two-sided Student tail by the continued fraction of the incomplete beta."""
    x = dof / (dof + t * t)
    a, b = dof / 2.0, np.full_like(dof, 0.5)
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x)) / a
    f, c, d = np.ones_like(x), np.ones_like(x), np.zeros_like(x)
    for i in range(steps):
        m = i // 2
        if i == 0:
            num = np.ones_like(x)
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / np.where(np.abs(1 + num * d) < 1e-300, 1e-300, 1 + num * d)
        c = np.where(np.abs(1 + num / c) < 1e-300, 1e-300, 1 + num / c)
        f = f * c * d
    share = front * (f - 1)
    return np.clip(np.where(swap, 1 - share, share), 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def student_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(_beta_tail(t.to_numpy(float), dof.to_numpy(float)))


def pearson(pairs: DataFrame) -> DataFrame:
    """(series_id, n, r, t, p_value) of columns xa, xb."""
    out = pairs.groupBy("series_id").agg(F.count("*").alias("n"), F.corr("xa", "xb").alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return out.withColumn("t", t).withColumn("p_value", student_tail("t", (F.col("n") - 2).cast("double")))
