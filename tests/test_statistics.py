import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurline.operators import autoregression, bootstrap, clustering, correction, correlation, distance, wavelets


def test_levinson_solves_yule_walker(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    x = x - x.mean()
    r = np.array([(x[k:] * x[:len(x) - k]).sum() for k in range(9)]) / (x @ x)
    toeplitz = np.array([[r[abs(i - j)] for j in range(8)] for i in range(8)])
    acf = spark.createDataFrame([(r.tolist(),)], "r array<double>").select(correlation.durbin(F.col("r"), 8).alias("f")).first()["f"]
    assert np.allclose(acf["phi"], np.linalg.solve(toeplitz, r[1:9])) and len(acf["reflections"]) == 8
    for m in range(1, 9):
        assert np.isclose(acf["reflections"][m - 1], np.linalg.solve(toeplitz[:m, :m], r[1:m + 1])[-1])
    assert np.isclose(acf["err"], 1 - np.array(acf["phi"]) @ r[1:9])


def test_order_of_least_aic(spark):
    """Every order fitted on its own; the one of least AIC is kept, with its coefficients and variance."""
    rng = np.random.default_rng(2)
    rows, series = [], {}
    for name, coef in (("a", [0.6]), ("b", [0.2, 0.5]), ("noise", [])):
        x = [0.0] * len(coef)
        for _ in range(300):
            x.append(sum(c * v for c, v in zip(coef, x[::-1])) + rng.normal())
        series[name] = np.array(x)
        rows += [(name, i + 1, float(v)) for i, v in enumerate(x)]
    fits = {r["series_id"]: r for r in autoregression.yule_walker(spark.createDataFrame(rows, "series_id string, t int, x double"), 6).collect()}
    for name, x in series.items():
        n, d = len(x), x - x.mean()
        c = np.array([(d[k:] * d[:n - k]).sum() / n for k in range(7)])
        tried = [(n * np.log(c[0]), np.zeros(0), c[0])]
        for m in range(1, 7):
            phi = np.linalg.solve([[c[abs(i - j)] for j in range(m)] for i in range(m)], c[1:m + 1])
            tried.append((n * np.log(c[0] - phi @ c[1:m + 1]) + 2 * m, phi, c[0] - phi @ c[1:m + 1]))
        best = int(np.argmin([t[0] for t in tried]))
        assert fits[name]["order"] == best and np.allclose(fits[name]["coefficients"], np.pad(tried[best][1], (0, 6 - best)))
        assert np.isclose(fits[name]["variance"], tried[best][2] * n / (n - best - 1))


def test_student_tail_against_closed_forms():
    """One and three degrees of freedom have elementary tails."""
    t = np.array([0.1, 0.5, 2.0, 12.7])
    one = 1 - 2 / np.pi * np.arctan(t)
    u = t / np.sqrt(3)
    three = 1 - 2 / np.pi * (u / (1 + u * u) + np.arctan(u))
    assert np.allclose(correlation._beta_tail(t, np.full(4, 1.0)), one, atol=1e-9)
    assert np.allclose(correlation._beta_tail(t, np.full(4, 3.0)), three, atol=1e-9)


def test_autoregression_is_recovered(spark):
    rng = np.random.default_rng(3)
    x = [0.0]
    for _ in range(2000):
        x.append(0.7 * x[-1] + rng.normal())
    df = spark.createDataFrame([("s", i + 1, float(v)) for i, v in enumerate(x)], "series_id string, t int, x double")
    fit = autoregression.yule_walker(df, 10).first()
    assert abs(fit["coefficients"][0] - 0.7) < 0.06 and fit["order"] >= 1


def test_lasso_path_meets_its_conditions():
    rng = np.random.default_rng(4)
    a, y = rng.normal(size=(60, 8)), rng.normal(size=60)
    for beta in autoregression.lasso_path(a.T @ a, a.T @ y, 6)[1:]:
        c = a.T @ (y - a @ beta)
        level = np.abs(c).max()
        active = np.abs(beta) > 1e-9
        assert np.allclose(c[active], level * np.sign(beta[active]), atol=1e-8)
        assert (np.abs(c) <= level + 1e-8).all()


def test_cross_validation_scores_every_step_of_the_path(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(120, 6))
    y = 3 + a @ [2.0, 0, -1, 0, 0.3, 0] + rng.normal(size=120)
    df = spark.createDataFrame([("s", i, [float(v) for v in a[i]], float(y[i])) for i in range(120)],
                               "series_id string, row int, features array<double>, y double").repartition(3)
    fold = {r["row"]: r["fold"] for r in autoregression.row_folds(df, 4).collect()}
    fold = np.array([fold[i] for i in range(120)])

    def path(x, t):
        x0, t0 = x.mean(axis=0), t.mean()
        return [(t0 - x0 @ b, b) for b in autoregression.lasso_path((x - x0).T @ (x - x0), (x - x0).T @ (t - t0), 48)]

    whole, errors = path(a, y), []
    for k in range(1, 5):
        held, own = fold == k, path(a[fold != k], y[fold != k])
        own += own[-1:] * (len(whole) - len(own))
        errors.append([np.mean((y[held] - off - a[held] @ b) ** 2) for off, b in own[:len(whole)]])
    scores, best = autoregression.lasso_cross_validation(df, folds=4)
    got = sorted(scores.collect(), key=lambda r: r["step"])
    assert [r["step"] for r in got] == list(range(1, len(whole) + 1)) and len(whole) >= 7
    assert np.allclose([r["mse"] for r in got], np.mean(errors, axis=0))
    assert np.allclose([r["mse_error"] for r in got], np.std(errors, axis=0, ddof=1) / 2)
    chosen = int(np.argmin(np.mean(errors, axis=0)))
    (row,) = best.collect()
    assert row["step"] == chosen + 1 and np.allclose(row["coefficients"], whole[chosen][1]) and np.isclose(row["intercept"], whole[chosen][0])


def test_full_lasso_path_ends_in_least_squares():
    rng = np.random.default_rng(5)
    a, y = rng.normal(size=(50, 6)), rng.normal(size=50)
    assert np.allclose(autoregression.lasso_path(a.T @ a, a.T @ y, 60)[-1], np.linalg.lstsq(a, y, rcond=None)[0])


def unit_root(x, k):
    """t value of the lagged level by least squares on the rows."""
    dx = np.diff(x)
    rows = len(dx) - k
    design = np.column_stack([x[k:k + rows], np.ones(rows), np.arange(rows), *[dx[k - j:k - j + rows] for j in range(1, k + 1)]])
    beta, rest, *_ = np.linalg.lstsq(design, dx[k:], rcond=None)
    return beta[0] / math.sqrt(rest[0] / (rows - k - 3) * np.linalg.inv(design.T @ design)[0, 0])


def test_unit_root_statistics(spark):
    rng = np.random.default_rng(6)
    held = {"noise": rng.normal(size=168), "walk": np.cumsum(rng.normal(size=168)), "short": rng.normal(size=60)}
    df = spark.createDataFrame([(n, i + 1, float(v)) for n, x in held.items() for i, v in enumerate(x)], "series_id string, t int, x double").repartition(3)
    for k in (None, 3, 0):
        got = {r["series_id"]: r for r in autoregression.adf(df, k).collect()}
        for name, x in held.items():
            lags = k if k is not None else {168: 5, 60: 3}[len(x)]
            assert got[name]["lags"] == lags and np.isclose(got[name]["statistic"], unit_root(x, lags))
        assert got["noise"]["statistic"] < -4 < got["walk"]["statistic"] and got["noise"]["p_value"] == 0.01 < got["walk"]["p_value"]


def test_lasso_of_series_from_summed_products(spark):
    rng = np.random.default_rng(7)
    held = {n: np.cumsum(rng.normal(size=90)) for n in "ab"}
    df = spark.createDataFrame([(n, i + 1, float(v)) for n, x in held.items() for i, v in enumerate(x)], "series_id string, t int, x double").repartition(4)
    step = {r["series_id"]: r["coefficients"] for r in autoregression.lasso_autoregression(df, 6, step=3).collect()}
    part = {r["series_id"]: r["coefficients"] for r in autoregression.lasso_autoregression(df, 6, step=None, fraction=0.4).collect()}
    for name, x in held.items():
        a, y = np.lib.stride_tricks.sliding_window_view(x, 6)[:-1], x[6:]
        a, y = a - a.mean(0), y - y.mean()
        path = autoregression.lasso_path(a.T @ a, a.T @ y, 48)
        assert np.allclose(step[name], path[2])
        sizes = [np.abs(b).sum() for b in path]
        assert np.isclose(np.abs(part[name]).sum(), 0.4 * sizes[-1])


def brute_dtw(a, b):
    best = np.full((len(a), len(b)), np.inf)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        c = abs(a[i] - b[j])
        options = [c] if i == j == 0 else []
        if i:
            options.append(best[i - 1, j] + c)
        if j:
            options.append(best[i, j - 1] + c)
        if i and j:
            options.append(best[i - 1, j - 1] + 2 * c)
        best[i, j] = min(options)
    return best[-1, -1]


def test_warping(spark):
    rng = np.random.default_rng(7)
    rows = {i: rng.random(6).tolist() for i in (1, 2, 3)}
    df = spark.createDataFrame([("g", i, v) for i, v in rows.items()], "series_id string, seg int, xs array<double>")
    for r in distance.distances(df, distance.warping).collect():
        assert abs(r["d"] - brute_dtw(rows[r["a"]], rows[r["b"]])) < 1e-9


def test_distances_are_symmetric(spark):
    df = spark.createDataFrame([("g", i, [float(i), i * i / 2, 1.0]) for i in range(1, 5)], "series_id string, seg int, xs array<double>")
    full = {(r["a"], r["b"]): r["d"] for r in distance.distances(df, distance.euclidean, full=True).collect()}
    assert len(full) == 16 and all(full[(i, i)] == 0 and full[(i, j)] == full[(j, i)] for i, j in full)
    half = {(r["a"], r["b"]): r["d"] for r in distance.distances(df, distance.euclidean).collect()}
    assert half == {k: v for k, v in full.items() if k[0] < k[1]}


def test_segment_numbers_are_bounded(spark):
    df = spark.createDataFrame([("g", 99, [1.0]), ("g", 1, [2.0])], "series_id string, seg int, xs array<double>")
    with pytest.raises(Exception, match="segment numbers"):
        distance.distances(df, distance.euclidean).collect()


def edges_of(spark, points, group="g"):
    rows = [(group, i, j, abs(points[i] - points[j])) for i in points for j in points if i < j]
    return spark.createDataFrame(rows, "group_id string, a int, b int, d double")


def test_linkage_cut_and_medoids(spark):
    points = {1: 0.0, 2: 1.0, 3: 10.0, 4: 11.5, 5: 30.0}
    edges = edges_of(spark, points)
    merges = clustering.average_linkage(edges)
    assert [round(r["height"], 6) for r in merges.orderBy("step").collect()] == [1.0, 1.5, 10.25, 24.375]
    cut = {r["item"]: r["cluster"] for r in clustering.cut_tree(merges, 3).collect()}
    assert cut[1] == cut[2] != cut[3] == cut[4] != cut[5] and len(set(cut.values())) == 3
    med = clustering.k_medoids(edges, 2).collect()
    cost = sum(abs(points[r["item"]] - points[r["medoid"]]) for r in med)
    best = min(sum(min(abs(points[i] - points[m]) for m in pair) for i in points) for pair in itertools.combinations(points, 2))
    assert abs(cost - best) < 1e-9
    same = clustering.tree_correlation(merges, merges).first()
    assert abs(same["baker"] - 1) < 1e-9 and abs(same["cophenetic"] - 1) < 1e-9


def test_correction_inverts_the_confusion(spark):
    m = correction.ALCOHOL_CONFUSION
    truth = [(80.0, 20.0), (55.0, 45.0)]
    rows = [("s", i, t0 * m[0][1] + t1 * m[1][1], t0 + t1) for i, (t0, t1) in enumerate(truth)]
    df = spark.createDataFrame(rows, "series_id string, t int, x double, total double")
    got = sorted((r["t"], round(r["negative"], 6), round(r["x"], 6)) for r in correction.corrected(df, m, shift=False).collect())
    assert got == [(0, 80.0, 20.0), (1, 55.0, 45.0)]


def test_dwt_keeps_energy(spark):
    x = np.random.default_rng(8).random(64)
    df = spark.createDataFrame([("s", x.tolist())], "series_id string, xs array<double>")
    rows = wavelets.dwt(df, levels=3).collect()
    energy = sum(r["value"] ** 2 for r in rows if r["band"] == "W" or r["level"] == 3)
    assert abs(energy - (x @ x)) < 1e-9


def test_cwt_against_direct_sum(spark):
    x = np.random.default_rng(9).random(48)
    df = spark.createDataFrame([("s", i + 1, float(v)) for i, v in enumerate(x)], "series_id string, t int, x double")
    scale = 3.0
    got = [r["re"] for r in wavelets.cwt(df, [3], lambda i: i.cast("double"), wavelets.gaussian2_response).orderBy("t").collect()]
    u = np.arange(-480, 481)
    kernel = 2 / (math.sqrt(3) * math.pi ** 0.25) * (1 - (u / scale) ** 2) * np.exp(-0.5 * (u / scale) ** 2) / math.sqrt(scale)
    direct = [sum(w * x[(t + k) % 48] for k, w in zip(u, kernel)) for t in range(48)]
    assert np.allclose(got, direct, atol=1e-8)


@pytest.mark.parametrize("n", [47, 48])
def test_cwt_against_products_of_spectra(spark, n):
    """Every scale, real and complex, against the inverse transform of the products."""
    rng = np.random.default_rng(n)
    held = {"a": rng.normal(size=n), "b": rng.random(size=n)}
    df = spark.createDataFrame([(k, i + 1, float(v)) for k, x in held.items() for i, v in enumerate(x)], "series_id string, t int, x double")
    omega = 2 * np.pi * np.fft.fftfreq(n)
    scales = [2.0 ** (1 + (i - 1) / 20) for i in range(1, 141)]
    gauss = lambda s: np.sqrt(s) * np.sqrt(8 / 3) * np.pi ** 0.25 * (omega * s) ** 2 * np.exp(-0.5 * (omega * s) ** 2)
    morlet = lambda s: np.where(omega >= 0, np.exp(-0.5 * (omega * s - 2 * np.pi) ** 2), 0.0)
    for response, direct in ((wavelets.gaussian2_response, gauss), (wavelets.morlet_response, morlet)):
        got = {(r["series_id"], r["scale_no"], r["t"]): complex(r["re"], r["im"]) for r in
               wavelets.cwt(df, [1, 43, 100, 140], wavelets.octave_scale, response).collect()}
        for name, x in held.items():
            for no in (1, 43, 100, 140):
                want = np.fft.ifft(np.fft.fft(x) * direct(scales[no - 1]))
                assert np.allclose([got[(name, no, t)] for t in range(1, n + 1)], want, atol=1e-9)


def test_scales_are_days_in_hours(spark):
    got = [r[0] for r in spark.range(1, 801).select(wavelets.even_scale(F.col("id"))).collect()]
    assert np.allclose(sorted(got), 24 * np.geomspace(0.05, 7.0, 800))


def test_bootstrap_is_repeatable_and_whole(spark):
    rows = [("s", d, h, (d * h) % 5, 20) for d in range(1, 31) for h in range(24)]
    df = spark.createDataFrame(rows, "series_id string, day int, hour int, sum long, len long")
    a = bootstrap.draw(df, [50], samples=2, seed=1).orderBy("sample", "day", "hour").collect()
    b = bootstrap.draw(df, [50], samples=2, seed=1).orderBy("sample", "day", "hour").collect()
    assert a == b and sum(r["len"] for r in a) == 2 * 30 * 24 * 10
    assert a[:720] != a[720:] and all(0 <= r["sum"] <= r["len"] for r in a)


def test_series_side_by_side(spark):
    from murmurline.plans import jobs
    rows = [(s, t + 1, float((t * k) % 7)) for s, k in (("a", 2), ("b", 3)) for t in range(12)]
    df = spark.createDataFrame(rows, "series_id string, t int, x double")
    merges = jobs.cluster_segments(df, 4, {"a": 1, "b": 2}, per_series=3, leave_out=[5]).collect()
    assert sorted(set().union(*[m["left"] + m["right"] for m in merges])) == [1, 2, 3, 4, 6]
    with pytest.raises(Exception, match="more than 2 segments"):
        jobs.cluster_segments(df, 4, {"a": 1, "b": 2}, per_series=2).collect()
