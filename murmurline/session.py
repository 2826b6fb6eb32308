"""Session creation and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "murmurline", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark.

    On a cluster the session comes from ``spark-submit``; nothing in the
    library depends on these settings except UTC as the session time zone.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent the session must be a local one; a folder of
    its own is then made once and remembered in the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("murmurline.scratch", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="murmurline-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("murmurline.scratch", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder; nothing is ever overwritten there."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, name: str = "stage"):
    """Write ``df`` to the shared folder and read it back.

    Used where an iterative job would otherwise recompute a growing plan. The
    written table survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remove_scratch(*tables) -> None:
    """Delete tables of :func:`cut_lineage`, given as they came from there, once all that reads them has been written itself."""
    for df in tables:
        remove(df.sparkSession, df._scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the scratch folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def spread(df):
    """Round-robin a frame that has fewer partitions than the session has cores.

    A table of one small file would otherwise be tokenised in one task; a large
    table already has more splits than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
