"""Approximate nearest neighbours with a hash-prefix forest.

Every tree hashes a vector to a string of ``BITS`` bits (signs of random projections, drawn by a
fixed generator) and keeps the strings sorted, so that all vectors sharing a prefix lie next to each other.
A query descends every tree to its longest matching prefix and then ascends all trees in step, one
bit at a time, until the matches hold at least ``share`` of the rows (and ``LEAST`` times as many as are asked for). Those
candidates are ranked by their true cosine. Vectors are divided by a power of two first, so that no square is too large or small.

Rows are spread over shards of about ``SHARD_ROWS`` by a hash of their id, each with a forest of
its own. A shard's rows come first and then the queries, sorted, so its forest is built once and the
queries stream through it, ``QUERY_BLOCK`` at a time; a task holds one shard, whatever is common in the
data. Only where there are fewer shards than ``TASKS`` several tasks build the same one. The best of
every shard are merged per query. Nothing is fitted, every row is indexed.

How many rows must be looked at depends on the data. Vectors without structure have neighbours that
are hardly nearer than the rest, and only a large share of the rows holds them; with clusters,
a small ``share`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

TREES = 192
BITS = 32
SHARE = 0.35
LEAST = 8
SHARD_ROWS = 8192
QUERY_BLOCK = 256
TASKS = 12
SEED = 11


def planes(dim: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * bits)).astype(np.float32)


def strings(x: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """The hash string of every vector in every tree, as numbers: (trees, rows). Up to 32 bits."""
    p = planes(x.shape[1], trees, bits)
    out = np.empty((trees, len(x)), np.int64)
    for at in range(0, len(x), 512):
        signs = (x[at : at + 512].astype(np.float32) @ p > 0).reshape(-1, trees, bits)
        packed = np.packbits(signs, axis=2)
        for k in range(packed.shape[2]):
            out[:, at : at + 512] = packed[:, :, k].T + (out[:, at : at + 512] << 8 if k else 0)
    return out >> (-bits % 8)


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.n, self.trees, self.bits = len(x), trees, bits
        s = strings(x, trees, bits)
        self.order = np.argsort(s, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(s, self.order, 1)

    def candidates(self, q: np.ndarray, want: int):
        """For each row of ``q`` the indices of its candidates: at least ``want``, or all rows."""
        s = strings(q, self.trees, self.bits)
        # lo, hi: the run of each tree that shares the first `level` bits with each query; held: with repeats over trees.
        # Longer prefixes hold less, so those beyond the first level at which no query has enough aren't looked up.
        lo, hi, held = [], [], []
        for level in range(self.bits + 1):
            cut = self.bits - level
            prefix = s >> cut
            lo.append(np.stack([np.searchsorted(self.sorted[t], prefix[t] << cut) for t in range(self.trees)]))
            hi.append(np.stack([np.searchsorted(self.sorted[t], (prefix[t] + 1) << cut) for t in range(self.trees)]))
            held.append((hi[-1] - lo[-1]).sum(0))
            if (held[-1] < min(want, self.n)).all():
                break
        for k in range(len(q)):
            hit = np.zeros(self.n, bool)
            # No level below this one can hold enough, so the ascent needs no look at them.
            level = max((x for x, n in enumerate(held) if n[k] >= min(want, self.n)), default=0)
            while True:
                for order, a, b in zip(self.order, lo[level][:, k].tolist(), hi[level][:, k].tolist(), strict=True):
                    hit[order[a:b]] = True
                if level == 0 or hit.sum() >= want:
                    break
                level -= 1
            yield np.flatnonzero(hit)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


class Shard:
    """Rows of one length and their forest."""

    def __init__(self, parts: list[pd.DataFrame], trees: int, bits: int) -> None:
        self.ids = np.concatenate([p["id"].to_numpy() for p in parts])
        self.x = _scaled(np.concatenate([np.stack(p["v"].to_numpy()) for p in parts]).astype(np.float64))
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.forest = Forest(self.x / self.norm[:, None], trees, bits)

    def nearest(self, queries: pd.DataFrame, k: int, share: float) -> pd.DataFrame:
        out: list[tuple] = []
        x, norm, ids = self.x, self.norm, self.ids
        q = _scaled(np.stack(queries["v"].to_numpy()).astype(np.float64))
        found = self.forest.candidates(q / np.sqrt((q * q).sum(1))[:, None], max(LEAST * k, int(np.ceil(share * len(x)))))
        for qid, v, c in zip(queries["id"].to_numpy(), q, found, strict=True):
            c = c[ids[c] != qid]
            rough = x[c] @ v / (norm[c] * np.sqrt((v * v).sum()))
            if len(c) > k:  # leave out what is worse by more than rounding
                c = c[rough >= np.partition(rough, -k)[-k] - 1e-9]
            # summed in one fixed order, so that equal vectors tie
            score = (x[c] * v).sum(1) / (norm[c] * np.sqrt((v * v).sum()))
            best = np.lexsort((ids[c], -score))[:k]
            out += [(qid, ids[c[b]], score[b]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


KEYS = ["dim", "shard", "block"]


def _search(k: int, share: float, trees: int, bits: int, many: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches are sorted by ``KEYS``, rows before queries."""
        key, parts, shard = None, [], None
        for batch in batches:
            for name, part in batch.groupby(KEYS):
                if name != key:
                    key, parts, shard = name, [], None
                rows, queries = part[~part["asks"]], part[part["asks"]]
                if len(rows):
                    parts.append(rows)
                for at in range(0, len(queries) if parts else 0, many):
                    shard = shard or Shard(parts, trees, bits)
                    yield shard.nearest(queries[at : at + many], k, share)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE, trees: int = TREES, bits: int = BITS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` of ``vectors`` with the largest cosine found for
    each of ``queries`` (same columns), ties to the smaller id. Fewer candidates: all of them.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows without an id. A query meets vectors of its own length only, and never a row with its own
    id; a query id given twice is answered for its least vector. Rows of one id given twice count
    twice.
    """

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("v")
        fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & fine).withColumn("dim", F.size("v"))

    rows, qs = valid(vectors), valid(queries).groupBy("dim", "id").agg(F.min("v").alias("v"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-TASKS // shards))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("block", every(blocks)).withColumn("asks", F.lit(False))
    qs = qs.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("shard", every(shards)).withColumn("asks", F.lit(True))
    both = rows.unionByName(qs).repartition(shards * blocks, *KEYS).sortWithinPartitions(*KEYS, "asks")
    best = both.mapInPandas(_search(k, share, trees, bits, QUERY_BLOCK), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.filter("vec_id % 50 = 0"))
