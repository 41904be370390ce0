"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often the mix takes it on average. Among all rates that give each
source its target number of tokens, those nearest to 1 in relative entropy, and at most ``CAP``,
are ``min(CAP, exp(lambda_s * size))``, with one multiplier per source (sizes are taken relative
to the source's mean size). The multipliers solve the convex dual. Its gradient for a source,
tokens of the mix less the target, needs only how many documents of each size the source has. So
documents are first counted by (source, size), and Newton's steps run on these counts: a join with
the multipliers and one aggregation with a map-side part for each step, however large a source is.

Rates are then rounded into whole copies so that no source drifts. First each (source, size) gets a
whole number of copies: sizes are walked from large to small and what rounding leaves over at one
size is carried to the next, so a source comes as near to its target as whole copies of its documents, from large to small, can.
The walk sees one row for each size of a source, at most the root of twice its tokens. Then the
copies of a size are dealt to its documents: those of least hash get one more than the others. Their
rank is a prefix sum, over shards of the hash range and over groups of shards, so that a size that
most documents have is no single task's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize, materialize_narrow, narrow_parts, table

#: No document is taken more often than this; it also caps a source's target.
CAP = 2
#: Shares of the sources, in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Size of the mix, as a share of all tokens.
SHARE = 1.5
#: Newton's steps stop when every source's rates give its target to this relative error.
#: More than ``MAX_STEPS`` of them are an error.
TOLERANCE = 1e-4
MAX_STEPS = 100
#: Documents of one source and size are ranked in shards of about this many, and shards in groups of ``GROUP``.
SHARD = 256
GROUP = 1024


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    # Words end where a non-space is followed by a space or the end; replacing all else counts them.
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), f"[{SPACE}]+", "")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key of a source whose order is by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``skey, source_size`` in, ``skey, source_size, target`` out, one row a source.

    Sources in the order of ``skey`` weigh ``weights``, repeating, and share ``share`` of all
    tokens; a target stops at ``cap`` times its source's size and the excess is shared again among
    the others by weight, until none is above. With no tokens all targets are 0. Every round is
    one aggregation to two numbers.
    """
    spark = sizes.sparkSession
    sizes = materialize_narrow(sizes, "sources")
    # Rank in a global order: sorted partitions, then their offsets. Few sources are one partition.
    k = narrow_parts(sizes.count())
    dealt = sizes if k == 1 else sizes.repartitionByRange(k, "skey")
    ordered = materialize(dealt.withColumn("part", F.spark_partition_id()), "sources")
    counts = sorted((r.part, r["count"]) for r in ordered.groupBy("part").count().collect())  # a row a partition
    offsets, n = [], 0
    for part, count in counts:
        offsets.append((part, n))
        n += count
    offsets = spark.createDataFrame(offsets, "part int, first long")
    rank = F.row_number().over(W.partitionBy("part").orderBy("skey")) - 1 + F.col("first")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = materialize(ordered.join(F.broadcast(offsets), "part").select("skey", "source_size", weight.alias("weight")), "sources").coalesce(k)
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > cap * F.col("source_size")
        r = s.agg(F.sum(F.when(full, cap * F.col("source_size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        new = (share * total - float(r.held or 0)) / r.open if r.open else level
        if new <= level:
            break
        level = new
    return s.select("skey", "source_size", F.least(F.col("weight") * F.lit(level), cap * F.col("source_size").cast("double")).alias("target"))


def solve_rates(hist: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """``skey, size, n`` (documents by size) and ``targets`` in; adds ``rate``, by Newton's method.

    The gradient is increasing in the multiplier, so each source keeps a bracket and a step that
    leaves it is replaced by its middle. Sources whose target is the cap, or nothing, need none.
    No solution within ``MAX_STEPS`` is an error.
    """
    rows = hist.count()
    x = F.col("size") / F.col("mean")
    stats = hist.filter("size > 0").groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    stats = materialize_narrow(stats, "mix-means", rows)
    base = materialize_narrow(hist.filter("size > 0").join(stats, "skey").select("skey", "n", x.alias("x")), "mix-sizes", rows)
    n = stats.count()
    # From this multiplier on even the smallest document is at the cap.
    top = F.lit(float(cap)) * F.col("mean") / F.col("least") + 1
    state = materialize_narrow(
        targets.join(stats, "skey").select("skey", (F.col("target") / F.col("mean")).alias("goal"), F.lit(0.0).alias("l"), (-700 * F.col("mean") / F.col("least")).alias("lo"), top.alias("hi"), F.lit(0.0).alias("miss"), (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full")),
        "mix-state",
        n,
    )

    def exact(x: Column) -> Column:
        # a sum that doesn't depend on the order of rows, so that reruns agree
        return F.sum(x.cast("decimal(30,9)")).cast("double")

    miss, steps = 1.0, 0
    while n and miss > TOLERANCE:
        if steps == MAX_STEPS:
            raise RuntimeError(f"mixing: no solution after {steps} steps, off by {miss:.2g}")
        steps += 1
        w = F.exp(F.least(F.col("l") * F.col("x"), F.lit(700.0)))
        sums = (
            base.join(state.filter("not full"), "skey")
            .groupBy("skey")
            .agg(exact(F.col("n") * F.col("x") * F.least(w, F.lit(float(cap)))).alias("have"), exact(F.when(w < cap, F.col("n") * F.col("x") * F.col("x") * w).otherwise(0.0)).alias("slope"))
        )
        off = F.coalesce(F.col("have") - F.col("goal"), F.lit(0.0))
        lo, hi = F.when(off < 0, F.col("l")).otherwise(F.col("lo")), F.when(off > 0, F.col("l")).otherwise(F.col("hi"))
        step = F.col("l") - off / F.when(F.col("slope") > 0, F.col("slope"))
        state = materialize_narrow(
            state.join(sums, "skey", "left")
            .select("skey", "goal", "l", "full", lo.alias("lo"), hi.alias("hi"), F.when(F.col("goal") > 0, F.abs(off) / F.col("goal")).otherwise(0.0).alias("miss"), step.alias("step"))
            .select("skey", "goal", F.when(F.col("miss") <= TOLERANCE, F.col("l")).when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("l"), "lo", "hi", "miss", "full"),
            "mix-state",
            n,
        )
        miss = state.agg(F.max("miss")).first()[0]
    found = state.select("skey", "l", "full").join(stats, "skey")
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.exp(F.least(F.col("l") * x, F.lit(700.0))), F.lit(float(cap))))
    return hist.join(found, "skey", "left").select("skey", "size", "n", F.coalesce(F.when(F.col("size") > 0, F.round(rate, 10)), F.lit(1.0)).alias("rate"))


def _walk(cap: int):
    def copies(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole copies for each size of a source; the rest is carried down the sizes."""
        pdf = pdf.sort_values("size", ascending=False)
        out, carry = [], 0.0
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            want = n * rate * size + carry
            k = min(max(round(want / size), 0), cap * n) if size else n
            carry = want - k * size if size else carry
            out.append(k)
        return pdf.assign(copies=out)[["skey", "size", "n", "rate", "copies"]]

    return copies


def ranks(d: DataFrame, shards: DataFrame) -> DataFrame:
    """``d`` (``skey, size, row_hash, id``) with ``place``, from 1: its rank by hash among the documents of
    its source and size. ``shards`` says in how many hash ranges they are ranked."""
    # A hash's share of the hash space, times the number of shards: shards follow each other in hash order.
    share = (F.shiftrightunsigned("row_hash", 33)) / F.lit(float(1 << 31))
    d = d.join(shards, ["skey", "size"]).withColumn("shard", F.least(F.floor(share * F.col("shards")), F.col("shards") - 1)).withColumn("grp", F.floor(F.col("shard") / GROUP))
    d = materialize(d.drop("shards"), "mix-docs")
    key = ["skey", "size", "grp"]
    counts = materialize(d.groupBy(*key, "shard").agg(F.count("*").alias("held")), "mix-shards")
    before = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = counts.withColumn("within", before(W.partitionBy(*key).orderBy("shard")))
    groups = counts.groupBy(*key).agg(F.sum("held").alias("held")).withColumn("above", before(W.partitionBy("skey", "size").orderBy("grp"))).drop("held")
    offset = materialize(within.join(groups, key).select(*key, "shard", (F.col("within") + F.col("above")).alias("offset")), "mix-offsets")
    nth = F.row_number().over(W.partitionBy(*key, "shard").orderBy(F.shiftrightunsigned("row_hash", 33), "row_hash", "id"))
    return d.withColumn("nth", nth).join(offset, [*key, "shard"]).withColumn("place", F.col("nth") + F.col("offset")).drop("nth", "offset", "grp", "shard")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """All documents with ``size, source_size, target, rate, copies``: rows of ``docs``' id and key.

    Returns ``id, row_hash, skey, size, source_size, target, rate, copies``: one row for each row of
    ``docs``. A null text has size 0, as one without words; such rows are taken once and count for
    nothing. A null source is a source of its own, last in order. Rows repeated in full share a
    hash; which of them gets a copy more is then arbitrary, but how many do isn't. An empty table
    gives an empty result. Hashes make reruns agree.
    """
    # The row's place splits repeated rows; it depends on the files alone.
    d = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("skey"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_hash"))
    d = materialize(d, "mix-docs")
    hist = materialize_narrow(d.groupBy("skey", "size").agg(F.count("*").alias("n")), "mix-hist")
    rows = hist.count()
    sizes = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = materialize_narrow(source_targets(sizes, weights, share, cap), "mix-targets", rows)
    plan = solve_rates(hist, targets, cap).groupBy("skey").applyInPandas(_walk(cap), "skey string, size long, n long, rate double, copies long")
    plan = materialize_narrow(plan.join(targets, "skey"), "mix-plan", rows)
    ranked = ranks(d, plan.select("skey", "size", F.ceil(F.col("n") / SHARD).alias("shards")))
    more = (F.col("place") <= F.col("copies") % F.col("n")).cast("int")
    return ranked.join(plan, ["skey", "size"]).select("id", "row_hash", "skey", "size", "source_size", "target", "rate", (F.floor(F.col("copies") / F.col("n")) + more).cast("int").alias("copies"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "rate", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``."""
    m = mix(docs).groupBy(F.col("id").alias("_mix_id"), F.col("row_hash").alias("_mix_hash")).agg(F.sum("copies").alias("_mix_total"), F.count("*").alias("_mix_rows"), F.max("copies").alias("_mix_most"))
    # Rows repeated in full can't be told apart; each takes the rounded-down mean, and the rest is
    # spread by a running number that the few repeats of one row share.
    keyed = docs.withColumn("_mix_key", F.xxhash64("doc_id", "text"))
    joined = keyed.join(m, (F.col("doc_id").eqNullSafe(F.col("_mix_id"))) & (F.col("_mix_key") == F.col("_mix_hash")))
    once = joined.filter("_mix_rows = 1").withColumn("_mix_n", F.col("_mix_total"))
    nth = F.row_number().over(W.partitionBy("doc_id", "_mix_key").orderBy("_mix_key"))
    more = joined.filter("_mix_rows > 1").withColumn("_mix_n", F.floor(F.col("_mix_total") / F.col("_mix_rows")) + (nth <= F.col("_mix_total") % F.col("_mix_rows")).cast("int"))
    both = once.unionByName(more).filter("_mix_n > 0")
    return both.withColumn("_mix_i", F.explode(F.sequence(F.lit(1), F.col("_mix_n").cast("int")))).select(*docs.columns)

