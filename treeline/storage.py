"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one partition of a narrow table (a few numbers a row) may hold.
NARROW = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) that has none gets a temporary one, kept in its settings so that later calls use
    the same. On a cluster a folder of this machine would be no use to the others, so there it has to be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("treeline.scratch.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("treeline.scratch.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, below the shared one."""
    return f"{shared_dir(spark)}/treeline-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder, once its results are written elsewhere: tables
    that were read from it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks it ran, and what was written is read by every later
    step instead of being computed once more.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow_parts(rows: int) -> int:
    """Partitions for a narrow table of so many rows."""
    return max(1, -(-rows // NARROW))


def materialize_narrow(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``materialize`` for a table of a few numbers a row: as many partitions as its rows need, not as many as the
    last shuffle had. ``rows`` is a bound of their number; without it they are counted. One partition needs no
    exchange later on."""
    if rows is None:
        df = materialize(df, name)
        return df.coalesce(narrow_parts(df.count()))
    k = narrow_parts(rows)
    return materialize(df.coalesce(k), name).coalesce(k)
