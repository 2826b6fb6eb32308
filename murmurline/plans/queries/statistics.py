"""N and W15-W17: spectra, correlations, distances, tests, wavelets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from murmurline.operators import autoregression as AR
from murmurline.operators import correction, correlation, distance, series, spectral, wavelets
from murmurline.plans import bindings as B
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.registry import query

_PI2 = f"{2 * math.pi!r}::DOUBLE"


def share(spark, sf):
    return B.alc_share(spark, sf).select("series_id", "t", "x")


def days(spark, sf):
    return series.split_segments(share(spark, sf), 24)


def weeks(spark, sf):
    return series.split_segments(share(spark, sf), 168)


def week_series(spark, sf):
    """Each week as a series of its own, log-shares made stationary by weekly differences."""
    st = series.seasonal_log_difference(share(spark, sf), shift=0.01)
    return spectral.segments_as_series(series.split_segments(st, 168))




_STAT_SQL = B.SHARE_SQL + """, st AS (SELECT series_id, t - 168 AS t, d AS x FROM (
   SELECT *, ln(x + 0.01) - lag(ln(x + 0.01), 168) OVER (PARTITION BY series_id ORDER BY t) AS d FROM share) WHERE t > 168),
  wk AS (SELECT series_id || '#' || CAST((t - 1) // 168 + 1 AS VARCHAR) AS series_id, (t - 1) % 168 + 1 AS t, x FROM st),
  ce AS (SELECT series_id, t, x - avg(x) OVER (PARTITION BY series_id) AS d, count(*) OVER (PARTITION BY series_id) AS n FROM wk)"""


def _acf_sql(lags: int) -> str:
    return _STAT_SQL + f""", ac AS (SELECT a.series_id, l.lag, any_value(a.n) AS n,
    coalesce(sum(a.d * b.d), 0) / any_value(c.c0) AS acf FROM ce a
    CROSS JOIN (SELECT unnest(range(0, {lags + 1})) AS lag) l
    JOIN (SELECT series_id, sum(d * d) AS c0 FROM ce GROUP BY ALL) c ON c.series_id = a.series_id
    LEFT JOIN ce b ON b.series_id = a.series_id AND b.t = a.t + l.lag GROUP BY a.series_id, l.lag)"""


@query("w15_acf", sql(_acf_sql(30), f"SELECT series_id, CAST(lag AS INTEGER) AS lag, {sql6('acf')} AS acf FROM ac"))
def w15(spark, sf):
    return correlation.acf(week_series(spark, sf), 30).select("series_id", "lag", r6("acf").alias("acf"))


def _durbin_sql(lags: int) -> str:
    """lv (series_id, n, variance, m, phi, err, k): Durbin's recursion on the autocorrelations, one order after another."""
    base = _acf_sql(lags).replace("tweets AS (", "RECURSIVE tweets AS (", 1)
    return base + f""", ra AS (SELECT a.series_id, any_value(a.n) AS n, any_value(v.variance) AS variance, list(acf ORDER BY lag) AS r FROM ac a
    JOIN (SELECT series_id, sum(d * d) / count(*) AS variance FROM ce GROUP BY ALL) v ON v.series_id = a.series_id GROUP BY a.series_id),
  lv AS (SELECT series_id, 0 AS m, CAST([] AS DOUBLE[]) AS phi, 1.0::DOUBLE AS err, NULL::DOUBLE AS k FROM ra
    UNION ALL SELECT series_id, m + 1, list_append(list_transform(range(1, m + 1), lambda j: phi[j] - q * phi[m + 1 - j]), q), err * (1 - q * q), q
    FROM (SELECT lv.*, (r[m + 2] - coalesce(list_sum(list_transform(range(1, m + 1), lambda j: phi[j] * r[m + 2 - j])), 0)) / err AS q
          FROM lv JOIN ra ON ra.series_id = lv.series_id WHERE m < {lags}))"""


def _order_sql(lags: int) -> str:
    """yw (series_id, n, ord, phi, variance): the order of least AIC, the first of equal ones."""
    return _durbin_sql(lags) + """, yw AS (SELECT series_id, n, m AS ord, phi, variance * err * n / (n - m - 1) AS variance FROM (
    SELECT lv.*, ra.n, ra.variance, row_number() OVER (PARTITION BY lv.series_id ORDER BY ra.n * ln(ra.variance * err) + 2 * m, m) AS best
    FROM lv JOIN ra ON ra.series_id = lv.series_id) WHERE best = 1)"""


@query("w16_pacf", sql(_durbin_sql(48), f"SELECT series_id, CAST(m AS INTEGER) AS lag, {sql6('k')} AS pacf FROM lv WHERE m > 0"))
def w16(spark, sf):
    return correlation.pacf(week_series(spark, sf), 48).withColumn("pacf", r6("pacf"))


_PAIR_SQL = B.WEEKS_SQL + """, pr AS (SELECT a.seg, a.pos AS t, a.x AS xa, b.x AS xb FROM weeks a JOIN weeks b
   ON a.seg = b.seg AND a.pos = b.pos WHERE a.series_id = 'click' AND b.series_id = 'view'),
  pc AS (SELECT seg, t, xa - avg(xa) OVER (PARTITION BY seg) AS a, xb - avg(xb) OVER (PARTITION BY seg) AS b FROM pr)"""


def week_pairs(spark, sf):
    w = weeks(spark, sf)
    a = B.month(w, B.MONTH_A).select("seg", "pos", F.col("x").alias("xa"))
    b = B.month(w, B.MONTH_B).select("seg", "pos", F.col("x").alias("xb"))
    return a.join(b, ["seg", "pos"]).select(F.col("seg").cast("string").alias("series_id"), F.col("pos").alias("t"), "xa", "xb")


@query("w17_ccf", sql(_PAIR_SQL, f"""SELECT CAST(y.seg AS VARCHAR) AS series_id, CAST(l.lag AS INTEGER) AS lag,
  {sql6("coalesce(sum(x.a * y.b), 0) / any_value(s.s)")} AS ccf FROM pc y CROSS JOIN (SELECT unnest(range(-24, 25)) AS lag) l
  JOIN (SELECT seg, sqrt(sum(a * a) * sum(b * b)) AS s FROM pc GROUP BY seg) s ON s.seg = y.seg
  LEFT JOIN pc x ON x.seg = y.seg AND x.t = y.t + l.lag GROUP BY y.seg, l.lag"""))
def w17(spark, sf):
    return correlation.ccf(week_pairs(spark, sf), 24).withColumn("ccf", r6("ccf"))


@query("n1_l2_normalise", sql(B.WEEKS_SQL, f"""SELECT series_id, seg, pos,
  {sql6("x / sqrt(sum(x * x) OVER (PARTITION BY series_id, seg))")} AS x FROM weeks"""))
def n1(spark, sf):
    return spectral.l2_normalise(weeks(spark, sf), ("series_id", "seg")).withColumn("x", r6("x"))


def dft_sql(ks: str, source: str = "share") -> str:
    return f""", ft AS (SELECT series_id, f.k, sum(x * cos({_PI2} * ((f.k * (t - 1)) % n) / n)) AS re,
    -sum(x * sin({_PI2} * ((f.k * (t - 1)) % n) / n)) AS im
    FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM {source})
    CROSS JOIN (SELECT unnest({ks}) AS k) f GROUP BY series_id, f.k)"""


@query("n2_dft_coefficients", sql(B.SHARE_SQL + dft_sql("[1, 4, 8, 28, 56, 84]"),
                                  f"SELECT series_id, k, {sql6('re')} AS re, {sql6('im')} AS im FROM ft"))
def n2(spark, sf):
    out = spectral.dft(share(spark, sf), [1, 4, 8, 28, 56, 84])
    return out.select("series_id", "k", r6("re").alias("re"), r6("im").alias("im"))


_POWER = f"SELECT series_id, CAST(k AS INTEGER) AS k, {sql6('re * re + im * im')} AS power FROM ft"


@query("n3_periodogram", sql(B.SHARE_SQL + dft_sql("range(1, 300)"), _POWER))
def n3(spark, sf):
    return spectral.periodogram(share(spark, sf), list(range(1, 300))).withColumn("power", r6("power"))


@query("n4_phase_distance", sql(B.SHARE_SQL + dft_sql("[4, 28]"), f"""SELECT a.k, {sql6(
    f"abs(atan2(a.im * b.re - a.re * b.im, a.re * b.re + a.im * b.im)) / {_PI2}")} AS shift
  FROM ft a JOIN ft b ON a.k = b.k WHERE a.series_id = 'click' AND b.series_id = 'view'"""))
def n4(spark, sf):
    s = share(spark, sf)
    out = spectral.phase_shift(B.month(s, B.MONTH_A, "s"), B.month(s, B.MONTH_B, "s"), [4, 28])
    return out.select("k", r6("shift").alias("shift"))


@query("n4_phase_argument", sql(B.SHARE_SQL + dft_sql("[1, 4, 28]"), f"SELECT series_id, k, {sql6('atan2(im, re)')} AS arg FROM ft"))
def n4_arg(spark, sf):
    return spectral.phase(share(spark, sf), [1, 4, 28]).withColumn("arg", r6("arg"))


@query("n5_extract_band", sql(B.SHARE_SQL + dft_sql("[28]"), f"""SELECT s.series_id, CAST(t AS INTEGER) AS t, {sql6(
    f"sqrt(pow(1 + re * cos({_PI2} * ((28 * (t - 1)) % 672) / 672) - im * sin({_PI2} * ((28 * (t - 1)) % 672) / 672), 2)"
    f" + pow(re * sin({_PI2} * ((28 * (t - 1)) % 672) / 672) + im * cos({_PI2} * ((28 * (t - 1)) % 672) / 672), 2))")} AS x
  FROM share s JOIN ft ON s.series_id = ft.series_id"""))
def n5(spark, sf):
    return spectral.extract_band(share(spark, sf), 28).withColumn("x", r6("x"))


def day_arrays(spark, sf):
    return series.segment_arrays(days(spark, sf))


_DAYS_FT = B.DAYS_SQL + f""", ft AS (SELECT series_id, seg, sum(x * cos({_PI2} * pos / 24)) AS re, -sum(x * sin({_PI2} * pos / 24)) AS im
  FROM days GROUP BY ALL)"""


@query("n6_phase_dissimilarity", sql(_DAYS_FT, f"""SELECT a.series_id AS group_id, a.seg AS a, b.seg AS b, {sql6(
    f"abs(atan2(a.im * b.re - a.re * b.im, a.re * b.re + a.im * b.im)) / {_PI2}")} AS d
  FROM ft a JOIN ft b ON a.series_id = b.series_id AND a.seg < b.seg"""))
def n6(spark, sf):
    return distance.distances(day_arrays(spark, sf), distance.phase_distance(1)).withColumn("d", r6("d"))


_EUCL = """SELECT a.series_id AS group_id, a.seg AS a, b.seg AS b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS d
  FROM {0} a JOIN {0} b ON a.series_id = b.series_id AND a.pos = b.pos AND a.seg < b.seg GROUP BY ALL"""


@query("n7_euclidean_dissimilarity", sql(B.DAYS_SQL, _EUCL.format("days")))
def n7(spark, sf):
    return distance.distances(day_arrays(spark, sf), distance.euclidean).withColumn("d", r6("d"))


@query("n8_dtw_dissimilarity")
def n8(spark, sf):
    return distance.distances(day_arrays(spark, sf), distance.warping).withColumn("d", r6("d"))


_WSER = B.WEEKS_SQL + ", ws AS (SELECT series_id || '#' || CAST(seg AS VARCHAR) AS series_id, pos + 1 AS t, x FROM weeks)"


@query("n9_periodogram_dissimilarity", sql(_WSER + dft_sql("range(1, 84)", "ws"), f"""SELECT split_part(a.series_id, '#', 1) AS group_id,
  CAST(split_part(a.series_id, '#', 2) AS INTEGER) AS a, CAST(split_part(b.series_id, '#', 2) AS INTEGER) AS b,
  {sql6("sqrt(sum(pow(a.re * a.re + a.im * a.im - b.re * b.re - b.im * b.im, 2)))")} AS d FROM ft a JOIN ft b ON a.k = b.k
  AND split_part(a.series_id, '#', 1) = split_part(b.series_id, '#', 1)
  AND split_part(a.series_id, '#', 2) < split_part(b.series_id, '#', 2) GROUP BY a.series_id, b.series_id"""))
def n9(spark, sf):
    power = spectral.periodogram(spectral.segments_as_series(weeks(spark, sf)), list(range(1, 84)))
    segs = spectral.coefficient_segments(power, "power", "k")
    return distance.distances(segs, distance.euclidean).withColumn("d", r6("d"))


def _week_coefficients(fitted, column):
    key = F.split("series_id", "#")
    return fitted.select(key[0].alias("series_id"), key[1].cast("int").alias("seg"), F.col(column).alias("xs"))


_PAIRED = """SELECT split_part(a.series_id, '#', 1) AS group_id, CAST(split_part(a.series_id, '#', 2) AS INTEGER) AS a,
  CAST(split_part(b.series_id, '#', 2) AS INTEGER) AS b, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) + 0.0::DOUBLE AS d FROM vs a JOIN vs b
  ON a.i = b.i AND split_part(a.series_id, '#', 1) = split_part(b.series_id, '#', 1)
  AND split_part(a.series_id, '#', 2) < split_part(b.series_id, '#', 2) GROUP BY a.series_id, b.series_id"""


@query("n10_ar_pic_dissimilarity", sql(_order_sql(AR.default_order(168)) + f""", vs AS (SELECT series_id, i, CASE WHEN i <= ord THEN phi[i] ELSE 0 END AS v
  FROM yw CROSS JOIN (SELECT unnest(range(1, {AR.default_order(168) + 1})) AS i))""", _PAIRED))
def n10(spark, sf):
    fit = AR.yule_walker(week_series(spark, sf), AR.default_order(168))
    return distance.distances(_week_coefficients(fit, "coefficients"), distance.euclidean).withColumn("d", r6("d"))


@query("n11_pacf_dissimilarity", sql(_durbin_sql(25) + """, vs AS (SELECT series_id, m AS i, k * sqrt(0.9::DOUBLE * pow(0.1::DOUBLE, m)) AS v
  FROM lv WHERE m > 0)""", _PAIRED))
def n11(spark, sf):
    p = correlation.pacf_arrays(week_series(spark, sf), 25)
    roots = F.array(*[F.lit(math.sqrt(w)) for w in AR.pacf_weights()])
    scaled = p.withColumn("pacf", F.zip_with("pacf", roots, lambda a, w: a * w))
    return distance.distances(_week_coefficients(scaled, "pacf"), distance.euclidean).withColumn("d", r6("d"))


@query("n12_pearson", sql(_PAIR_SQL, f"""SELECT CAST(seg AS VARCHAR) AS series_id, count(*) AS n, {sql6("corr(xa, xb)")} AS r,
  {sql6("corr(xa, xb) * sqrt((count(*) - 2) / (1 - corr(xa, xb) * corr(xa, xb)))")} AS t FROM pr GROUP BY seg"""))
def n12(spark, sf):
    return correlation.pearson(week_pairs(spark, sf)).select("series_id", "n", r6("r").alias("r"), r6("t").alias("t"))


@query("n12_pearson_p_value")
def n12p(spark, sf):
    return correlation.pearson(week_pairs(spark, sf)).withColumn("p_value", r6("p_value"))


(_A, _B), (_C, _D) = correction.ALCOHOL_CONFUSION_LARGE
_DET = _A * _D - _B * _C


@query("n13_unconfuse", sql(B.CLEAN_SQL + f""", co AS (SELECT series_id, t, total,
   (x * {_A!r}::DOUBLE - (total - x) * {_B!r}::DOUBLE) / {_DET!r}::DOUBLE AS p FROM clean),
  sh AS (SELECT *, p - min(p) OVER (PARTITION BY series_id) AS q FROM co)""",
  f"SELECT series_id, t, {sql6('q')} AS x, {sql6('total - q')} AS negative FROM sh"))
def n13(spark, sf):
    out = correction.corrected(B.alc_clean(spark, sf), correction.ALCOHOL_CONFUSION_LARGE)
    return out.select("series_id", "t", r6("x").alias("x"), r6("negative").alias("negative"))


@query("n14_yule_walker", sql(_order_sql(25), f"""SELECT series_id, CAST(ord AS INTEGER) AS "order", {sql6('variance')} AS variance,
  CAST(i AS INTEGER) AS pos, CASE WHEN i <= ord THEN {sql6('phi[i]')} ELSE 0.0::DOUBLE END AS coefficient
  FROM yw CROSS JOIN (SELECT unnest(range(1, 26)) AS i)"""))
def n14(spark, sf):
    fit = AR.yule_walker(week_series(spark, sf), 25)
    rows = fit.select("series_id", "order", r6("variance").alias("variance"), F.posexplode("coefficients").alias("pos", "coefficient"))
    return rows.select("series_id", "order", "variance", (F.col("pos") + 1).alias("pos"), r6("coefficient").alias("coefficient"))


@query("n15_lasso_ar_step")
def n15(spark, sf):
    out = AR.lasso_autoregression(week_series(spark, sf), 50, step=4)
    return out.select("series_id", F.posexplode("coefficients").alias("pos", "coefficient")).withColumn(
        "coefficient", r6("coefficient"))


@query("n15_lasso_ar_fraction")
def n15f(spark, sf):
    out = AR.lasso_autoregression(week_series(spark, sf), 50, step=None, fraction=0.18)
    return out.select("series_id", F.posexplode("coefficients").alias("pos", "coefficient")).withColumn(
        "coefficient", r6("coefficient"))


@query("n15_lasso_ar_cross_validation")
def n15cv(spark, sf):
    st = series.seasonal_log_difference(share(spark, sf), shift=0.01)
    scores, _ = AR.lasso_cross_validation(series.lag_matrix(st, 50), folds=10)
    return scores


_L = AR.short_lag(168)
_KPSS_SQL = _STAT_SQL + """, cs AS (SELECT series_id, d, n, sum(d) OVER w AS s, """ + ", ".join(
    f"lag(d, {j}) OVER w * d AS c{j}" for j in range(1, _L + 1)) + """ FROM ce WINDOW w AS (PARTITION BY series_id ORDER BY t)),
  kp AS (SELECT series_id, sum(s * s) / (count(*) * count(*)) / (sum(d * d) / count(*) + """ + " + ".join(
    f"2.0 * (1 - {j} / {_L + 1}) * sum(c{j}) / count(*)" for j in range(1, _L + 1)) + ") AS k FROM cs GROUP BY series_id)"


@query("n16_kpss", sql(_KPSS_SQL, f"""SELECT series_id, {sql6("k")} AS statistic, {sql6(
    "CASE WHEN k <= 0.347 THEN 0.10 WHEN k < 0.463 THEN 0.10 + (k - 0.347) * (0.05 - 0.10) / (0.463 - 0.347) "
    "WHEN k < 0.574 THEN 0.05 + (k - 0.463) * (0.025 - 0.05) / (0.574 - 0.463) "
    "WHEN k < 0.739 THEN 0.025 + (k - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END")} AS p_value FROM kp"""))
def n16(spark, sf):
    out = AR.kpss(week_series(spark, sf), AR.short_lag(168))
    return out.select("series_id", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"))


def _adf_sql(k: int) -> str:
    """rs (series_id, t): the t value of the level, after Gauss-Jordan steps on the centred products of level, trend, lags and y."""
    p = k + 2
    quantiles = [(q, p_) for q, p_ in zip([f"{a + (b - a) * (167 - 100) / 150!r}" for a, b in ((row[2], row[3]) for row in AR.DF_TABLE)], AR.DF_PROBS)]
    steps = "".join(f" WHEN t < {q1} THEN {p0} + (t - ({q0})) * ({p1 - p0!r}::DOUBLE) / ({q1} - ({q0}))" for (q0, p0), (q1, p1) in zip(quantiles, quantiles[1:]))
    lags = ", ".join(f"lag(d, {j}) OVER w" for j in range(1, k + 1))
    return _STAT_SQL.replace("tweets AS (", "RECURSIVE tweets AS (", 1) + f""",
  dx AS (SELECT series_id, t, x, lag(x) OVER w AS level, x - lag(x) OVER w AS d FROM wk WINDOW w AS (PARTITION BY series_id ORDER BY t)),
  zs AS (SELECT series_id, t, [level, t::DOUBLE, {lags}, d] AS z FROM dx WINDOW w AS (PARTITION BY series_id ORDER BY t)),
  zr AS (SELECT series_id, t, unnest(z) AS v, unnest(range(1, {p + 2})) AS i FROM zs WHERE t > {k + 1}),
  zc AS (SELECT series_id, t, i, v - avg(v) OVER (PARTITION BY series_id, i) AS v FROM zr),
  gm AS (SELECT a.series_id, a.i, b.i AS j, sum(a.v * b.v) AS s, count(*) AS n FROM zc a JOIN zc b ON a.series_id = b.series_id AND a.t = b.t
    GROUP BY a.series_id, a.i, b.i),
  gr AS (SELECT series_id, i, list(s ORDER BY j) AS r, any_value(n) AS n FROM gm GROUP BY series_id, i),
  gj AS (SELECT series_id, 0 AS m, list(r ORDER BY i) AS a, any_value(n) AS n FROM gr GROUP BY series_id
    UNION ALL SELECT series_id, m + 1, list_transform(range(1, {p + 2}), lambda i: list_transform(range(1, {p + 2}), lambda j:
      CASE WHEN i = m + 1 AND j = m + 1 THEN 1 / a[m + 1][m + 1] WHEN i = m + 1 THEN a[i][j] / a[m + 1][m + 1]
           WHEN j = m + 1 THEN -a[i][j] / a[m + 1][m + 1] ELSE a[i][j] - a[i][m + 1] * a[m + 1][j] / a[m + 1][m + 1] END)), n FROM gj WHERE m < {p}),
  rs AS (SELECT series_id, a[1][{p + 1}] / sqrt(a[{p + 1}][{p + 1}] / (n - {p} - 1) * a[1][1]) AS t FROM gj WHERE m = {p}),
  pv AS (SELECT series_id, t, CASE WHEN t < {quantiles[0][0]} THEN {quantiles[0][1]}{steps} ELSE {quantiles[-1][1]} END AS p_value FROM rs)"""


def _adf_rows(k: int) -> str:
    return f"SELECT series_id, {sql6('t')} AS statistic, {k} AS lags, {sql6('p_value')} AS p_value FROM pv"


@query("n17_adf", sql(_adf_sql(5), _adf_rows(5)))
def n17(spark, sf):
    return AR.adf(week_series(spark, sf)).withColumn("statistic", r6("statistic")).withColumn("p_value", r6("p_value"))


@query("n17_adf_k24", sql(_adf_sql(24), _adf_rows(24)))
def n17k(spark, sf):
    return AR.adf(week_series(spark, sf), k=24).withColumn("statistic", r6("statistic")).withColumn("p_value", r6("p_value"))


@query("n18_ljung_box", sql(_acf_sql(48), f"""SELECT series_id,
  {sql6("any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) FILTER (WHERE lag > 0)")} AS statistic FROM ac GROUP BY series_id"""))
def n18(spark, sf):
    return correlation.ljung_box(week_series(spark, sf), 48).select("series_id", r6("statistic").alias("statistic"))


@query("n18_ljung_box_p_value", sql(_acf_sql(48) + """, lb AS (SELECT series_id,
   any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) FILTER (WHERE lag > 0) / 2 AS h FROM ac GROUP BY series_id)""",
  f"""SELECT series_id, {sql6("least(sum(exp(j * ln(h) - h - lgamma(j + 1))), 1)")} AS p_value
  FROM lb CROSS JOIN (SELECT unnest(range(0, 24)) AS j) GROUP BY series_id"""))
def n18p(spark, sf):
    return correlation.ljung_box(week_series(spark, sf), 48).select("series_id", r6("p_value").alias("p_value"))


_N19_SQL = B.SHARE_SQL + dft_sql("range(0, 672)") + f""", sc AS (SELECT j, 24 * 0.05::DOUBLE * pow(7 / 0.05::DOUBLE, (j - 1) / 799::DOUBLE) AS s FROM (SELECT unnest(range(1, 801)) AS j)),
  pw AS (SELECT series_id, {_PI2} * least(k, 672 - k) / 672 AS w, re * re + im * im AS p FROM ft)"""


@query("n19_cwt_gaussian2", sql(_N19_SQL, f"""SELECT series_id, CAST(j AS INTEGER) AS scale_no, round(sum(
  p * s * 8.0 / 3.0 * sqrt(pi()) * pow(w * s, 4) * exp(-pow(w * s, 2))) / 672, 4) AS energy FROM pw CROSS JOIN sc GROUP BY ALL"""))
def n19(spark, sf):
    """All 800 scales of every series; the energy of a scale follows from the spectrum alone."""
    out = wavelets.cwt(share(spark, sf), list(range(1, 801)), wavelets.even_scale, wavelets.gaussian2_response)
    return out.groupBy("series_id", "scale_no").agg(F.round(F.sum(F.col("re") * F.col("re")), 4).alias("energy"))


_MORLET_SQL = B.SHARE_SQL + dft_sql("range(0, 337)") + f""", rs AS (SELECT series_id, k, exp(-0.5 * pow({_PI2} * k / 672 * pow(2, 3 + 2 / 20::DOUBLE) - {_PI2}, 2)) AS g, re, im FROM ft WHERE k < 336)"""


@query("n20_cwt_morlet", sql(_MORLET_SQL, f"""SELECT s.series_id, CAST(s.t AS INTEGER) AS t,
  {sql6(f"sum(g * (re * cos({_PI2} * ((k * (s.t - 1)) % 672) / 672) - im * sin({_PI2} * ((k * (s.t - 1)) % 672) / 672))) / 672")} AS re,
  {sql6(f"sum(g * (re * sin({_PI2} * ((k * (s.t - 1)) % 672) / 672) + im * cos({_PI2} * ((k * (s.t - 1)) % 672) / 672))) / 672")} AS im
  FROM share s JOIN rs ON rs.series_id = s.series_id GROUP BY s.series_id, s.t"""))
def n20(spark, sf):
    out = wavelets.cwt(share(spark, sf), [43], wavelets.octave_scale, wavelets.morlet_response)
    return out.select("series_id", "t", r6("re").alias("re"), r6("im").alias("im"))


def _dwt_sql() -> str:
    taps = len(wavelets.DAUBECHIES_8)
    values = {"V": wavelets.DAUBECHIES_8, "W": [(-1) ** i * wavelets.DAUBECHIES_8[taps - 1 - i] for i in range(taps)]}
    text = B.SHARE_SQL + ", v0 AS (SELECT series_id, t - 1 AS pos, x AS value FROM share)"
    n = 672
    for level in range(1, 7):
        for band, filt in (("w", values["W"]), ("v", values["V"])):
            rows = ", ".join(f"({i}, {h!r}::DOUBLE)" for i, h in enumerate(filt))
            text += f""", {band}{level} AS (SELECT v.series_id, u.pos, sum(f.h * v.value) AS value FROM (SELECT unnest(range(0, {n // 2})) AS pos) u
              CROSS JOIN (VALUES {rows}) f(l, h) JOIN v{level - 1} v ON v.pos = (2 * u.pos + 1 - f.l + {n}) % {n} GROUP BY ALL)"""
        n //= 2
    return text


@query("n21_dwt_d8", sql(_dwt_sql(), " UNION ALL ".join(
    f"SELECT series_id, '{b}' AS band, {i} AS level, CAST(pos AS INTEGER) AS pos, {sql6('value')} AS value FROM {b.lower()}{i}"
    for i in range(1, 7) for b in ("W", "V"))))
def n21(spark, sf):
    return wavelets.dwt(series.series_arrays(share(spark, sf))).withColumn("value", r6("value"))
