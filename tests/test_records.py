"""Quoted CSV files in many splits, against one reader of the whole file."""

import bz2
import csv
import gzip
import io
import os
import random

import pytest
from pyspark.sql import types as T

from murmurline.session import scratch_path
from murmurline.sources import readers, records

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("place", T.StringType())])


def folder(spark, **files):
    path = scratch_path(spark, "csv").removeprefix("file://")
    os.makedirs(path)
    for name, content in files.items():
        with open(f"{path}/{name.replace('__', '.')}", "wb") as f:
            f.write(content)
    return path


def written(rows, header=True, eol="\n"):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=eol)
    if header:
        w.writerow(["id", "text", "place"])
    w.writerows(rows)
    return out.getvalue().encode()


def texts(rng, n):
    bits = ["a", "é", '"', '""', ",", "\n", "\n\n", "x y", '",', '\n"', "日本", " "]
    for i in range(n):
        yield i, "".join(rng.choice(bits) for _ in range(rng.randrange(12))) or "-", rng.choice(["here", 'th"ere', "far, away", None])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def whole_file_reader(spark, path, header=True):
    return spark.read.schema(ROW).option("header", header).option("multiLine", True).option("escape", '"').csv(path)


@pytest.mark.parametrize("seed", range(4))
def test_rows_equal_those_of_a_whole_file_reader(spark, small_splits, seed):
    rng = random.Random(seed)
    data = [list(texts(rng, 400)), list(texts(rng, 300)), list(texts(rng, 5))]
    path = folder(spark, **{f"f{i}__csv": written(d) for i, d in enumerate(data)})
    assert records._lines(spark, path).rdd.getNumPartitions() > 10
    got = rows(readers.read_csv_folder(spark, path, ROW))
    assert got == rows(whole_file_reader(spark, path))
    assert len(got) == 705
    for few in (0, 1_000_000):  # states joined by a shuffle, or sent to the tasks
        assert records.records(spark, path, few_blocks=few).count() == 705


def test_one_field_over_many_blocks(spark, small_splits):
    long = "\n".join(f'line {i} "quoted" , and more' for i in range(300))
    data = [(1, "before", "a"), (2, long, "b"), (3, "after\n" * 400, "c"), (4, "end", "d")]
    path = folder(spark, a__csv=written(data))
    assert rows(readers.read_csv_folder(spark, path, ROW)) == sorted(data, key=str)


def test_quotes_inside_plain_fields(spark, small_splits):
    """A quote that does not start a field opens nothing; what follows a closing quote belongs to the field."""
    lines = ['1,5" pipe,a', '2,"x"y,b', '3,"two\nlines",c', '4, "z",d', '5,"",e', '6,,f', '7,a"b"c,"g"', '8,"p""q",h'] * 60
    path = folder(spark, a__csv="\n".join(lines).encode())
    assert rows(readers.read_csv_folder(spark, path, ROW, header=False)) == rows(whole_file_reader(spark, path, header=False))


def test_line_ends_blank_lines_and_headers(spark, small_splits):
    data = list(texts(random.Random(7), 200))
    crlf = folder(spark, a__csv=written(data, eol="\r\n"))
    assert rows(readers.read_csv_folder(spark, crlf, ROW)) == rows(whole_file_reader(spark, crlf))
    blank = folder(spark, a__csv=b"\n\nid,text,place\n1,a,b\n\n\n2,c,d", b__csv=b"", c__csv=b"id,text,place\n")
    assert rows(readers.read_csv_folder(spark, blank, ROW)) == [(1, "a", "b"), (2, "c", "d")]
    odd = folder(spark, a__csv=b'"i\nd",text,place\n1,a,b\n')
    assert rows(readers.read_csv_folder(spark, odd, ROW)) == [(1, "a", "b")]


def test_states_of_lines():
    states = records.LineStates()
    assert [states.after(x, 0) for x in ["", "a,b", 'a,"b', '"a","b"', '"a""', '"a"",', 'a"b', '"a"b"c', '"', '""', '"""']] == [
        0, 0, 1, 0, 1, 1, 0, 0, 1, 0, 1]
    assert [states.after(x, 1) for x in ["", "a", 'a"', 'a",b', 'a",', 'a","b', '"",', '""",x', 'a"b,"c']] == [1, 1, 0, 0, 0, 1, 1, 0, 1]


def test_state_scan_equals_a_fold(spark):
    rng = random.Random(3)
    data, want = [], []
    for file in range(30):
        state, mine = 0, []
        for start in range(rng.randrange(1, 12)):
            to = rng.choice([(0, 1), (1, 0), (0, 0), (1, 1)])
            mine.append((file, start, state))
            data.append((file, start, *to))
            state = to[state]
        want += [(*m, state) for m in mine]
    got = records.block_states(spark.createDataFrame(data, "file long, start long, to0 int, to1 int").repartition(4))
    assert rows(got) == sorted(want, key=str)


def test_bad_files_are_listed_and_skipped(spark):
    good = written([(1, "a\nb", "x"), (2, "c", "y")])
    big = written([(i, f"text {i} " * 20, "p") for i in range(2000)])
    path = folder(spark, a__csv=good, b__csv=good + b'3,"never closed,z\n4,q,r\n', c__csv__gz=gzip.compress(big)[:-2000],
                  d__csv__gz=gzip.compress(written([(7, "g", "h")])), e__csv__bz2=bz2.compress(written([(8, "i", "j")])),
                  f__csv=b"id,text,place\nnine,k,l\n10,m,n\n", g__csv=b"")
    ok, bad, files = readers.read_with_quarantine(spark, path, ROW)
    assert rows(ok) == sorted([(1, "a\nb", "x"), (2, "c", "y"), (7, "g", "h"), (8, "i", "j"), (10, "m", "n")], key=str)
    assert rows(bad) == [("nine,k,l", "f.csv")]
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in files.collect()} == {
        "a.csv": "read", "b.csv": "open field", "c.csv.gz": "damaged", "d.csv.gz": "read", "e.csv.bz2": "read", "f.csv": "read"}  # an empty file has no entry
