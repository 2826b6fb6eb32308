"""Registered queries ask for the whole job, not for a part of it."""

import inspect

import pytest

import __spark_entry__ as entry
from murmurline.ml import classifiers
from murmurline.operators import bootstrap

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    """Ends a query at the call whose arguments a test looks at."""


def asked_of(monkeypatch, module, name, query, spark):
    """The arguments with which the query calls module.name."""
    seen = []

    def stop(*args, **kwargs):
        seen.append((args, kwargs))
        raise Asked

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Asked):
        entry.queries()[query](spark, SF)
    return seen[0]


def test_stability_sweep_is_the_reference_sweep(spark, monkeypatch):
    _, asked = asked_of(monkeypatch, bootstrap, "stability", "c6_stability_sweep", spark)
    assert asked["percents"] == list(range(11, 101)) and asked["samples"] == 100


def test_tfidf_classifier_fits_to_the_end(spark, monkeypatch):
    (estimator, *_), _ = asked_of(monkeypatch, classifiers, "tfidf_pipeline", "m1_tfidf_classifier", spark)
    assert estimator.getMaxIter() == 100


def test_learning_curve_has_all_sizes_and_iterations(spark, monkeypatch):
    curve = inspect.signature(classifiers.learning_curve)
    args, kwargs = asked_of(monkeypatch, classifiers, "learning_curve", "m15_learning_curve", spark)
    bound = curve.bind(*args, **kwargs)
    bound.apply_defaults()
    assert bound.arguments["pieces"] == 10 and bound.arguments["folds"] == 5 and bound.arguments["iterations"] == 100


def test_learning_curve_ends_with_every_size(spark):
    got = {(round(r["size"], 1), r["part"]): r for r in entry.queries()["m15_learning_curve"](spark, SF).collect()}
    assert set(got) == {(i / 10, p) for i in range(1, 8) for p in ("train", "test")}
    assert all(0 <= r["mean"] <= 1 and r["rows"] > 0 for r in got.values())
    assert got[(0.7, "train")]["rows"] > got[(0.1, "train")]["rows"]


def test_stability_sweep_ends_with_every_fraction(spark):
    got = entry.queries()["c6_stability_sweep"](spark, SF).collect()
    assert {(r["dend"], r["pct"]) for r in got} == {(d, p) for d in ("phase", "euclidean") for p in range(11, 101)}
    assert all(r["n"] == 100 and -1 <= r["q_low"] <= r["q_high"] <= 1 for r in got)
