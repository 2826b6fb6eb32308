"""Joins that recombine scored subsets with all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def outer_union(unscored: DataFrame, scored: DataFrame) -> DataFrame:
    """Outer merge of two frames whose rows are disjoint: a union, no shuffle."""
    return unscored.unionByName(scored, allowMissingColumns=True)


def keyed_scores(rows: DataFrame, part: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Scores of a subset joined back by key, 0 elsewhere.

    Where the score can be written as an expression, ``scores.gated`` gives the
    same without a join.
    """
    return rows.join(part.select(key, *columns), key, "left").fillna(0, columns)
