"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, materialize_narrow, narrow_parts, shared_path

__all__ = ["SPACE", "WORD", "components", "materialize", "materialize_narrow", "narrow_parts", "release", "shared_path", "table"]

#: White space of a word boundary, as a regular-expression class: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and those that
    wait would keep what their largest batch took."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Returns ``node, label`` where
    label is the least node of the component. Nodes without an edge are absent.

    Alternates "large star" and "small star" steps (Kiveris et al. 2014): each hangs the
    neighbours of a node on the least of them. The number of edges never grows, a step is one
    aggregation and one join, a hub's neighbours are only ever reduced to a minimum, and the
    number of rounds is logarithmic in practice. The rounds run on as many partitions as the edges
    need. No fixed point after ``rounds`` is an error.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))).coalesce(parts)
        m = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(m, "u")
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b"))).coalesce(parts)
        return out.filter("a > b").distinct()

    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    rows = e.count()
    parts = narrow_parts(2 * rows)
    e = e.coalesce(parts)
    seen = None
    for _ in range(rounds if rows else 0):
        e = materialize_narrow(star(star(e, True), False), name, 2 * rows)
        n = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == tuple(n):
            break
        seen = tuple(n)
    else:
        if rows:
            raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
