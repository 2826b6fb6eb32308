"""Readers (S1-S6, S15). Every read carries its schema."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurline import schemas
from murmurline.session import cut_lineage
from murmurline.sources import records

_CORRUPT = "_corrupt_record"
#: Bytes of a compressed file that are unpacked at once.
_STEP = 1 << 20


def _parsed(schema: T.StructType, **options):
    """The record as a struct of the schema's fields."""
    return F.from_csv("record", schema.toDDL(), {"escape": '"', "multiLine": "true", **options})


def read_csv_folder(spark: SparkSession, path: str, schema: T.StructType = schemas.TWEETS,
                    header: bool = True) -> DataFrame:
    """Folder of CSV files, one schema, quoted line breaks allowed, any number of tasks a file."""
    return records.records(spark, path, header).select(_parsed(schema).alias("_r")).select("_r.*")


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled text; whatever the header says, columns are ``labels, text`` (S3)."""
    return read_csv_folder(spark, path, schemas.TRAINING)


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hourly summary with the two-level (day, hour) key as leading columns."""
    return spark.read.schema(schemas.SUMMARY).option("header", True).csv(path)


def read_summary_tree(spark: SparkSession, path: str) -> DataFrame:
    """All classes of a summary written with ``partitionBy("class")``."""
    schema = T.StructType(schemas.SUMMARY.fields + [T.StructField("class", T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path)


def summary_series(summary: DataFrame, value: str = "sum", total: str = "len") -> DataFrame:
    """The (day, hour, value) and total columns a series is made of, by name."""
    return summary.select("day", "hour", F.col(value).alias("sum"), F.col(total).alias("len"))


def file_states(spark: SparkSession, path: str, blocks: DataFrame, most: int = 1 << 30) -> DataFrame:
    """file (a hash), path and status of every file that is not empty.

    ``open field``: the file ends inside a quoted field. ``damaged``: a compressed file that is cut off or broken;
    ``unchecked``: a compressed file of more than ``most`` bytes, which is read as far as it goes. Else ``read``.
    """
    listed = spark.read.format("binaryFile").load(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("length"), "content")
    packed = F.lower(F.regexp_extract("path", r"\.(gz|bz2)$", 1))
    checked = (listed.where((packed != "") & (F.col("length") <= most)).select("file", packed.alias("kind"), "content")
               .mapInArrow(_unpacks, "file bigint, whole boolean"))
    ends = blocks.groupBy("file").agg(F.max("last").alias("last"))
    status = (F.when(F.col("whole").isNull() & (packed != ""), "unchecked").when(~F.col("whole"), "damaged")
              .when(F.col("last") == 1, "open field").otherwise("read"))
    return listed.select("file", "path").join(checked, "file", "left").join(ends, "file", "left").select("file", "path", status.alias("status"))


def _unpacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the content of a compressed file can be read to its end."""
    for batch in batches:
        whole = []
        for kind, content in zip(batch.column("kind").to_pylist(), batch.column("content")):
            raw, ok = memoryview(content.as_buffer()), len(content.as_buffer()) > 0
            while ok and len(raw):  # a file may hold several members
                one = zlib.decompressobj(wbits=31) if kind == "gz" else bz2.BZ2Decompressor()
                try:
                    for at in range(0, len(raw), _STEP):
                        one.decompress(raw[at:at + _STEP])
                        if one.eof:
                            break
                    ok = one.eof
                    raw = raw[min(at + _STEP, len(raw)) - len(one.unused_data):]
                except (zlib.error, OSError, EOFError):
                    ok = False
            whole.append(ok)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(whole, pa.bool_())], names=["file", "whole"])


def read_with_quarantine(spark: SparkSession, path: str, schema: T.StructType,
                         header: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows, unparsable rows and the files of a CSV folder.

    A file that ends inside a quoted field, or that is compressed and cut off, is skipped as a whole; the third frame
    (path, status) lists every file and says which ones were. An unparsable row keeps its text and file name. A row
    counts as bad for a fault in any of its fields.
    """
    wide = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    blocks = records.scan(spark, path)
    files = cut_lineage(file_states(spark, path, blocks), "files")
    skipped = files.where(F.col("status").isin("damaged", "open field")).select("file")
    rows = records.records(spark, path, header, blocks=blocks).join(skipped, "file", "left_anti")
    parsed = rows.select("file", _parsed(wide, columnNameOfCorruptRecord=_CORRUPT).alias("_r"))
    good = parsed.where(F.col(f"_r.{_CORRUPT}").isNull()).select(*[F.col(f"_r.{c}").alias(c) for c in schema.fieldNames()])
    names = files.select("file", F.substring_index("path", "/", -1).alias("name"))
    bad = parsed.where(F.col(f"_r.{_CORRUPT}").isNotNull()).join(names, "file").select(
        F.col(f"_r.{_CORRUPT}").alias("line"), F.col("name").alias("file"))
    return good, bad, files.select("path", "status")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
