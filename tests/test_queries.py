import os
import re
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
CHECKED = ["a1_hourly_counts", "a3_merge_partials", "w3_hour_grid", "w4_clean_series", "k2_month_share", "x16_tfidf",
           "x13_token_alignment", "n7_euclidean_dissimilarity", "m10_roc_auc", "m11_multiclass_roc", "s8_write_summary_per_class",
           "s13_keyed_update", "e1_stream_hourly_summary", "t3_sample_per_source", "t7_sorted_vocabulary", "c4_silhouette"]


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(str, zip(*[table.column(n).to_pylist() for n in names])))


def test_inventory_is_covered():
    have = {m.group(1) for n in entry.queries() if (m := re.match(r"([a-z]+\d+)_", n))}
    want = ([f"s{i}" for i in range(1, 17)] + [f"p{i}" for i in range(1, 21)] + [f"j{i}" for i in range(1, 12)]
            + [f"a{i}" for i in range(1, 19)] + [f"w{i}" for i in range(1, 21)] + [f"t{i}" for i in range(1, 11)]
            + [f"u{i}" for i in range(1, 6)] + [f"x{i}" for i in range(1, 21)] + [f"n{i}" for i in range(1, 23)]
            + [f"m{i}" for i in range(1, 18)] + [f"c{i}" for i in range(1, 9)] + [f"k{i}" for i in range(1, 11)])
    assert not set(want) - have


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SF).toArrow()) == rows(con.execute(entry.oracle_sql()[name]).to_arrow_table())
