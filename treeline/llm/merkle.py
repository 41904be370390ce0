"""Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

A tree has ``ARITY`` children a node; its leaves are in order, and a level's last run may be shorter. It is
cut into aligned blocks, complete subtrees of ``HEIGHT`` levels above their leaves, and the roots of
the blocks are the leaves of the next layer of blocks, until one is left. A block is one row of the manifest: its
digests in van Emde Boas order, that is, the subtree is split at half its height, the top part is
stored first, then the bottom parts one after another, each laid out in the same way. Where a node lies
follows from its depth and index alone (``address``), for building and for finding siblings.

A source with a third of all rows is many blocks. Leaves get their place in their source's order by
a sort over ranges and the number of leaves in the ranges before, so no source is gathered in one
task. What is broadcast has a row for each range at most.

Digests are of the hex digits of what lies below them, concatenated (``H``); a run of one is hashed as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, table

ARITY = 3
#: Levels of a block above its leaves: 6561 leaves, 315 kB of digests.
HEIGHT = 8
#: Leaves that one sorted range holds, about.
RANGE_ROWS = 100_000
PATH = "array<struct<left:string,right:string>>"


def n_nodes(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def height(n: int) -> int:
    """Levels above ``n`` leaves, up to the level of one node."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth (0: the root) lie in a tree of so many levels."""
    index = np.asarray(index, np.int64)
    at = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = ARITY ** (depth - top)
        at = at + n_nodes(top) + index // below * n_nodes(levels - top)
        levels, depth, index = levels - top, depth - top, index % below
    return at


def node(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Block:
    """The subtree over ``n`` leaves. ``nodes`` has 32 bytes a node; those without leaves are zero."""

    def __init__(self, n: int, nodes: np.ndarray) -> None:
        self.n, self.height, self.nodes = n, height(n), nodes

    @classmethod
    def build(cls, leaves: list[str]) -> Block:
        b = cls(len(leaves), np.zeros((n_nodes(height(len(leaves)) + 1), 32), np.uint8))
        level = leaves
        for k in range(b.height + 1):
            b.nodes[b.places(k)] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
            if k < b.height:
                level = b.level(k)
                level = [node(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]
        return b

    def width(self, k: int) -> int:
        """Nodes of level k, counted from the leaves."""
        return -(-self.n // ARITY**k)

    def places(self, k: int) -> np.ndarray:
        return address(self.height + 1, self.height - k, np.arange(self.width(k)))

    def level(self, k: int) -> list[str]:
        text = self.nodes[self.places(k)].tobytes().hex()
        return [text[i : i + 64] for i in range(0, len(text), 64)]

    @property
    def root(self) -> str:
        return self.nodes[0].tobytes().hex()

    def siblings(self) -> list[list[tuple[str, str]]]:
        """For every level below the root and each of its nodes, what stands left and right of it in its run."""
        out = []
        for k in range(self.height):
            level = self.level(k)
            runs = (level[i : i + ARITY] for i in range(0, len(level), ARITY))
            out.append([("".join(run[:j]), "".join(run[j + 1 :])) for run in runs for j in range(len(run))])
        return out


def leaf(*columns: Column) -> Column:
    """Digest of a row: of each value its length in UTF-8 and itself, ``-`` for null."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def number(leaves: DataFrame, name: str) -> DataFrame:
    """``leaves`` (``tree, key, digest`` and others) with ``rank``, from 0: the place in its tree by key
    (null first), then digest. Rows that agree in both are in any order, as their digests are the same."""
    d = materialize(leaves.withColumn("place", F.monotonically_increasing_id()), name)
    order = ["tree", "key", "digest", "place"]
    ranges = max(1, -(-d.count() // RANGE_ROWS))
    d = d.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()).drop("place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for b in batches:
            at = []
            for t in b.column("tree").to_pylist():
                n = n + 1 if t == last else 0
                last = t
                at.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], [*b.schema.names, "at"])

    d = materialize(d.mapInArrow(count, ", ".join(f"`{c}` {t}" for c, t in d.dtypes) + ", at long"), name)
    per = d.groupBy("pid", "tree").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("tree").orderBy("pid").rowsBetween(W.unboundedPreceding, -1))
    # Only a range's first tree can have begun before it: one row a range at most.
    began = per.select(F.col("pid").alias("p"), F.col("tree").alias("t"), before.alias("before")).filter("before > 0")
    rank = F.col("at") + F.when(F.col("tree").eqNullSafe(F.col("t")), F.coalesce("before", F.lit(0))).otherwise(0)
    return d.join(F.broadcast(began), F.col("pid") == F.col("p"), "left").withColumn("rank", rank).drop("pid", "at", "p", "t", "before")


def _placed(d: DataFrame) -> DataFrame:
    size = F.lit(ARITY**HEIGHT).cast("long")
    return d.withColumn("block", F.floor(F.col("rank") / size)).withColumn("slot", (F.col("rank") % size).cast("int"))


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key, columns) for rows of equal key that follow each other; a group may come in several pieces."""
    for b in batches:
        cols = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)}
        names = list(zip(*(cols[k] for k in keys), strict=True))
        start = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[start]:
                yield names[start], {c: v[start:i] for c, v in cols.items()}
                start = i


BLOCK = "tree string, block long, n int, height int, root string, nodes binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, leaves, out = None, [], []

    def rows(found) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], BLOCK.replace(",", "").split()[::2])

    def done():
        b = Block.build(leaves)
        out.append((*key, b.n, b.height, b.root, b.nodes.tobytes()))

    for name, cols in _runs(batches, ("tree", "block")):
        if name != key:
            if leaves:
                done()
            key, leaves = name, []
        leaves += cols["digest"]
        if sum(len(r[-1]) for r in out) > 8 << 20:
            yield rows(out)
            out.clear()
    if leaves:
        done()
    if out:
        yield rows(out)


@dataclass(frozen=True)
class Tree:
    """Trees of one kind: ``layers`` of blocks and the ``leaves`` below each; ``roots`` (``tree, root, layer``)."""

    layers: list[DataFrame]
    leaves: list[DataFrame]
    roots: DataFrame


def grow(ranked: DataFrame, name: str) -> Tree:
    """The trees over ``tree, rank, digest``."""
    at, layers, below, roots = ranked, [], [], []
    while True:
        at = _placed(at)
        sorted_ = at.select("tree", "block", "slot", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "slot")
        blocks = materialize(sorted_.mapInArrow(_build, BLOCK), f"{name}-blocks")
        layers.append(blocks)
        below.append(at)
        small = blocks.drop("nodes")
        last = small.groupBy(F.col("tree").alias("t")).agg(F.max("block").alias("last"))
        told = small.join(last, F.col("tree").eqNullSafe(F.col("t"))).drop("t")
        roots.append(told.filter("last = 0").select("tree", "root", F.lit(len(layers) - 1).alias("layer")))
        # A block with others beside it is as high as they are.
        lift = F.lit(HEIGHT) - F.col("height")
        raised = F.when(lift > 0, F.aggregate(F.sequence(F.lit(1), lift), F.col("root"), lambda a, _: F.sha2(a.cast("binary"), 256))).otherwise(F.col("root"))
        at = materialize(told.filter("last > 0").select("tree", F.col("block").alias("rank"), raised.alias("digest"), lift.alias("lift")), f"{name}-roots")
        if at.isEmpty():
            break
    every = roots[0]
    for r in roots[1:]:
        every = every.unionByName(r)
    return Tree(layers, below, materialize(every, f"{name}-tops"))


def _walk(audit: bool, held: dict[str, pa.DataType]):
    """For each leaf its path to the root, or what follows from it. A block's rows come as: what stands above it,
    its nodes, its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, top, block, beside = [], (None, None), None, []
        outside = ""
        for _, c in _runs(batches, ("tree", "block", "kind")):
            if c["kind"][0] == 0:
                above = [(s["left"], s["right"]) for s in c["path"][0]]
                top = (c["subroot"][0], c["root"][0])
                outside = "".join(a + b for a, b in above)
                continue
            if c["kind"][0] == 1:
                block = Block(c["n"][0], np.frombuffer(c["nodes"][0], np.uint8).reshape(-1, 32))
                beside = block.siblings()
                continue
            n = len(c["slot"])
            out: dict[str, list] = {k: c[k] for k in held}
            out["subroot"], out["root"] = [top[0]] * n, [top[1]] * n
            paths = ([level[slot // ARITY**k] for k, level in enumerate(beside)] for slot in c["slot"])
            if not audit:
                out["path"] = [[{"left": a, "right": b} for a, b in [*own, *above]] for own in paths]
                yield batch(out)
                continue
            proofs, folded = [], []
            for own, good, now in zip(paths, c["digest"], c["now"], strict=True):
                proofs.append(hashlib.sha256(("".join(a + b for a, b in own) + outside).encode()).hexdigest())
                x = good if now is None else now
                for a, b in own:
                    x = hashlib.sha256(f"{a}{x}{b}".encode()).hexdigest()
                for a, b in above:
                    x = hashlib.sha256(f"{a}{x}{b}".encode()).hexdigest()
                folded.append(x)
            out["proof_sha256"], out["folded_root"] = proofs, folded
            yield batch(out)

    def batch(out: dict) -> pa.RecordBatch:
        known = held | {"path": pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))}
        return pa.RecordBatch.from_arrays([pa.array(v, known.get(k, pa.string())) for k, v in out.items()], list(out))

    return run


def _paths(heads: DataFrame, blocks: DataFrame, leaves: DataFrame, held: tuple[str, ...], audit: bool) -> DataFrame:
    h = heads.select("tree", "block", F.lit(0).alias("kind"), "path", "subroot", "root")
    b = blocks.select("tree", "block", F.lit(1).alias("kind"), "n", "nodes")
    x = leaves.select("tree", "block", F.lit(2).alias("kind"), "slot", "digest", *[c for c in (*held, "now") if c not in ("tree", "digest") and c in leaves.columns])
    rows = h.unionByName(b, allowMissingColumns=True).unionByName(x, allowMissingColumns=True)
    rows = rows if "now" in rows.columns else rows.withColumn("now", F.lit(None).cast("string"))
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "slot")
    types = dict(leaves.dtypes)
    schema = [*[f"`{c}` {types[c]}" for c in held], "subroot string", "root string", *(["proof_sha256 string", "folded_root string"] if audit else [f"path {PATH}"])]
    return rows.mapInArrow(_walk(audit, {c: to_arrow_type(leaves.schema[c].dataType) for c in held}), ", ".join(schema))


def descend(t: Tree, tops: DataFrame, held: tuple[str, ...], audit: bool, name: str) -> DataFrame:
    """For every leaf the columns ``held``, ``subroot, root`` and its path, or proof and folded root. ``tops``:
    ``tree, path, subroot, root`` of each tree's root."""
    tops = tops.select(F.col("tree").alias("t"), "path", "subroot", F.col("root").alias("top"))
    heads = None
    for k in range(len(t.layers) - 1, -1, -1):
        ended = t.roots.filter(F.col("layer") == k).select("tree").join(tops, F.col("tree").eqNullSafe(F.col("t")))
        ended = ended.select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", F.col("top").alias("root"))
        heads = ended if heads is None else ended.unionByName(heads)
        if k == 0:
            return _paths(heads, t.layers[0], t.leaves[0], held, audit)
        up = _paths(heads, t.layers[k], t.leaves[k].withColumn("n_lift", F.col("lift").cast("string")), ("tree", "rank", "n_lift"), False)
        alone = F.struct(F.lit("").alias("left"), F.lit("").alias("right"))
        path = F.concat(F.array_repeat(alone, F.col("n_lift").cast("int")), F.col("path"))
        heads = materialize(up.select("tree", F.col("rank").alias("block"), path.alias("path"), "subroot", "root"), f"{name}-heads")
    raise AssertionError


@dataclass(frozen=True)
class Manifest:
    """``sources``: the trees of the sources (``key`` and ``digest`` of their leaves); ``top``: the tree
    over their roots. ``heads`` has ``tree, path, subroot, root`` of every source."""

    sources: Tree
    top: Tree
    heads: DataFrame

    def prove(self) -> DataFrame:
        """``key, digest, subroot, root, path``: for each leaf what stands left and right of it in its run, level by
        level up to the root. ``fold`` leads from a leaf along its path to the root."""
        return descend(self.sources, self.heads, ("key", "digest"), False, "merkle")

    def audit(self) -> DataFrame:
        """``key, digest, subroot, root, proof_sha256, folded_root``: the digest of all siblings and the root
        that follows from ``now``, if that isn't null, or else from the leaf."""
        return descend(self.sources, self.heads, ("key", "digest"), True, "merkle")


def fold(digest: Column, path: Column) -> Column:
    return F.aggregate(path, digest, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]).cast("binary"), 256))


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``tree`` (string), ``key``, ``digest`` and perhaps ``now`` (a digest to be checked).

    A null tree is a tree of its own, before the others, which are in order of their UTF-8 bytes. Leaves
    ascend by key, null first, then by digest; repeated rows are leaves of their own. A lone leaf is its tree's root,
    a lone tree's root that of all. No rows: no blocks.
    """
    sources = grow(number(leaves, "merkle-leaves"), "merkle")
    over = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest"))
    top = grow(number(over, "merkle-sources"), "merkle-top")
    none = F.array().cast(PATH)
    tops = top.roots.select("tree", none.alias("path"), F.col("root").alias("subroot"), "root")
    found = descend(top, tops, ("key", "digest"), False, "merkle-top")
    heads = materialize(found.select(F.col("key").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-heads")
    return Manifest(sources, top, heads)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # A null id isn't tampered with.
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf(*[F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS])
    now = F.when(hit & F.contains("text", F.lit("\n")), changed)
    m = build(d.select(F.col("source").alias("tree"), F.col("doc_id").alias("key"), leaf(*map(F.col, COLUMNS)).alias("digest"), now.alias("now")))
    return m.audit().select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_sql() -> str:
    def trees(name: str, leaves: str, key: str) -> str:
        """All nodes of all levels, and the sibling strings of each."""
        return f"""
        {name}_nodes AS (
          SELECT {key} AS t, 0 AS lv, i, h, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves}
          UNION ALL
          SELECT t, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), max((n + 2) // 3) FROM {name}_nodes WHERE n > 1 GROUP BY t, lv, i // 3),
        {name}_steps AS (
          SELECT a.t, a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
          FROM {name}_nodes a LEFT JOIN {name}_nodes b ON a.t = b.t AND a.lv = b.lv AND a.i // 3 = b.i // 3 AND a.i <> b.i WHERE a.n > 1 GROUP BY a.t, a.lv, a.i)"""

    def value(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def digest(text: str) -> str:
        return f"sha256({value('doc_id')} || {value('source')} || {value('lang')} || {value('n_chars')} || {value(text)})"

    crc = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_prepend(ord(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)"
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS t, {digest("text")} AS h,
        CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {digest("replace(text, chr(10), '')")} END AS now FROM documents),
      leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, h) - 1 AS i FROM d),
      {trees("s", "leaves", "t")},
      subs AS MATERIALIZED (SELECT t AS s, h, row_number() OVER (ORDER BY t) - 1 AS i FROM s_nodes WHERE n = 1),
      {trees("r", "(SELECT *, '' AS one FROM subs)", "one")},
      above AS (SELECT s, subs.h AS subroot, coalesce(list(struct_pack(l, r) ORDER BY lv) FILTER (l IS NOT NULL), []) AS path
        FROM subs LEFT JOIN r_steps x ON x.i = subs.i // (3 ** x.lv)::BIGINT GROUP BY ALL),
      own AS (SELECT doc_id, a.t, a.i, a.h, now, coalesce(list(struct_pack(l, r) ORDER BY lv) FILTER (l IS NOT NULL), []) AS path
        FROM leaves a LEFT JOIN s_steps x ON a.t = x.t AND x.i = a.i // (3 ** x.lv)::BIGINT GROUP BY ALL),
      every AS (SELECT doc_id, h, coalesce(now, h) AS x, subroot, own.path || above.path AS path, (SELECT h FROM r_nodes WHERE n = 1) AS root FROM own JOIN above ON s = t),
      f AS (SELECT *, list_reduce(list_prepend(x, list_transform(path, lambda p: p.l || '-' || p.r)), lambda a, s: sha256(split_part(s, '-', 1) || a || split_part(s, '-', 2))) AS folded FROM every)
    SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f"""
