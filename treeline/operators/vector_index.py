"""Inverted lists of vectors: exact top-k by cosine that reads a part of the lists.

Centroids are fitted on a bounded sample; every vector goes to the list of its nearest one, and a list keeps the largest angle
of its members. The angle is a metric, so no member of a list is nearer to a query than the query's angle to the centroid
less that radius. A search reads lists by this bound, twice as many each time, until the k-th best found is
nearer than the bound of all that are left. With clustered vectors few lists are read; without structure, most.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cosine_distance

#: Vectors that centroids are fitted on, at most, and the rounds that takes.
SAMPLE, ROUNDS = 4096, 8
#: Angles are compared with this much room for rounding.
ROOM = 1e-6
ROWS = "entry_id string, chunk_position int, chunk_text string, embedding array<float>"


def fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids by spherical k-means, beginning with points far from one another."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    c, near = [x[0]], x @ x[0]
    while len(c) < min(lists, len(x)):
        far = int(np.argmin(near))
        c.append(x[far])
        near = np.maximum(near, x @ x[far])
    c = np.array(c)
    for _ in range(ROUNDS):
        owner = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, owner, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def write(vectors: DataFrame, folder: str, lists: int | None = None) -> None:
    """The lists of ``entry_id, chunk_position, chunk_text, embedding`` below ``folder``.

    The length of most vectors is that of the index; others, and zero or null ones, have a list of their own (-1) that every search
    reads. ``lists`` is about the root of the rows unless given. A list that gets a large share of the rows is
    dealt to several files. The sample is taken by a hash of the row, so that reruns agree.
    """
    spark = vectors.sparkSession
    v = vectors.select("entry_id", "chunk_position", "chunk_text", F.col("embedding").cast("array<float>").alias("embedding"))
    some = F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e18)), F.lit(True)) & F.exists("embedding", lambda x: F.abs(x) > 1e-18)
    of = v.filter(some).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (of.dim, of.n) if of else (0, 0)
    sample = v.filter(some & (F.size("embedding") == dim)).select("embedding").orderBy(F.xxhash64("embedding", "entry_id", "chunk_position")).limit(SAMPLE).collect()
    c = fit(np.array([r.embedding for r in sample], np.float64), lists or max(1, math.isqrt(n))) if sample else np.zeros((0, dim))

    def place(embedding: pd.Series) -> pd.DataFrame:
        x = np.stack(embedding.to_numpy()).astype(np.float64)
        cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ c.T
        best = cos.argmax(1)
        return pd.DataFrame({"list": best.astype(np.int32), "angle": np.arccos(np.clip(cos[np.arange(len(x)), best], -1, 1))})

    fits = F.coalesce(some & (F.size("embedding") == dim), F.lit(False))
    placed = v.filter(fits).withColumn("p", F.pandas_udf(place, "list int, angle double")("embedding")).select("*", "p.*").drop("p")
    rest = v.filter(~fits).withColumns({"list": F.lit(-1), "angle": F.lit(0.0)})
    rows = placed.unionByName(rest).withColumn("_deal", F.pmod(F.xxhash64("entry_id", "chunk_position"), F.lit(4)))
    rows.repartition("list", "_deal").drop("_deal").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")
    back = spark.read.schema(f"{ROWS}, angle double, list int").parquet(f"{folder}/lists")
    told = back.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    at = spark.createDataFrame([(k, json.dumps(x.tolist())) for k, x in enumerate(c)], "list int, centroid string")
    told.join(at, "list", "left").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")


def search(spark: SparkSession, folder: str, vector: Sequence[float], k: int = 10, first: int = 4) -> tuple[DataFrame, int]:
    """``entry_id, chunk_text, distance`` of the ``k`` entries whose best chunk is nearest, ties by id, as a search of all rows
    gives them; and how many rows were read for it. A zero query finds nothing."""
    lists = spark.read.parquet(f"{folder}/centroids").collect()  # a row a list, about the root of the rows
    q = np.array(vector, np.float64)
    rows = spark.read.schema(f"{ROWS}, angle double, list int").parquet(f"{folder}/lists")
    lit = F.array(*[F.lit(float(x)) for x in vector])

    def best(of: list[int]) -> DataFrame:
        d = rows.filter(F.col("list").isin(of)).select("entry_id", "chunk_position", "chunk_text", cosine_distance(F.col("embedding"), lit).alias("distance")).filter("distance is not null")
        b = d.groupBy("entry_id").agg(F.min(F.struct("distance", "chunk_position", "chunk_text")).alias("b"))
        return b.select("entry_id", "b.chunk_text", "b.distance").orderBy("distance", "entry_id").limit(k)

    bound = {}
    for r in lists:
        c = np.array(json.loads(r.centroid)) if r.centroid else None
        fits = c is not None and len(c) == len(q) and np.linalg.norm(q) > 0
        bound[r.list] = math.acos(max(-1.0, min(1.0, float(c @ q / np.linalg.norm(q))))) - r.radius if fits else -math.inf
    order = sorted(bound, key=lambda x: (bound[x], x))
    size = {r.list: r.n for r in lists}
    m = min(len(order), max(first, sum(bound[x] == -math.inf for x in order)))
    while True:
        found = best(order[:m])
        hits = found.collect()
        reach = math.acos(max(-1.0, min(1.0, 1 - hits[-1].distance))) if len(hits) == k else math.inf
        if m == len(order) or bound[order[m]] > reach + ROOM:
            return spark.createDataFrame(hits, found.schema), sum(size[x] for x in order[:m])
        # All lists that may still hold a nearer one, if they are known, or twice as many.
        m = min(len(order), max(2 * m, 1) if reach == math.inf else max(m + 1, min(2 * m, sum(bound[x] <= reach + ROOM for x in order))))
