"""Vectors as short codes: one codebook entry for each part of a vector, found by exact integer k-means.

Components become integers, floor(``SCALE`` * x), and a vector is cut into ``PARTS`` consecutive parts. Rounds of
assigning parts to the nearest entry and averaging run over trees of balls (an anchors hierarchy, Moore 2000), one
for each part of each shard of rows. A tree is built from the middle out: about the root of n points become
anchors, each the point farthest from its own anchor so far, which takes over what lies nearer to it; anchors
are joined pair by pair, the smallest ball first, up to the root, and each is divided downward in the same way.

A ball caches the number and sum of its points. A round goes down with the list of entries that may be
nearest to one of them: an entry is struck off where another is nearer to the whole ball,

    d(c, j)^2 - d(c, i)^2 > 2 r |i - j|     (centre c, radius r),

and children inherit what is left. A ball with one entry left gives its cached sums to it; only points of leaves
are looked at. All but that test is integer arithmetic, and the test leaves a margin for rounding, so the result
is that of comparing all points with all entries.

Trees are built once, by the tasks that read the rows, and written to the shared folder; a round reads them and returns
a row for each entry and component. Codebooks are all that passes through the driver.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, release, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A shard has this many components at most (and one vector at least); a leaf this many points.
SHARD_VALUES, LEAF = 1 << 18, 48
#: Components from this on have no place in 64 bits. Up to ``SMALL`` squares of distances fit.
LARGEST, SMALL = 2.0**50, 1 << 26
#: Labels' errors are broadcast up to this many; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _far(a, b) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def _exact(x: np.ndarray) -> np.ndarray:
    """Integers of 64 bits, or of any size where squares wouldn't fit."""
    x = np.asarray(x)
    return x.astype(np.int64 if not x.size or max(abs(int(x.min())), abs(int(x.max()))) <= SMALL else object)


@dataclass
class Balls:
    """Nodes of a tree. The points of node i are ``order[lo[i]:hi[i]]``; ``left`` is -1 for a leaf."""

    order: np.ndarray
    centre: np.ndarray
    radius2: np.ndarray
    sums: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray


def anchors(x: np.ndarray, want: int) -> np.ndarray:
    """The anchor of each point, numbered from 0: up to ``want``, fewer if points repeat."""
    d, owner, pivots = _far(x, x[0]), np.zeros(len(x), np.int64), [0]
    while len(pivots) < want:
        new = int(np.argmax(d))
        if d[new] == 0:
            break
        # Nearer to its anchor than half the way to the new one: it stays.
        gap = _far(x[pivots], x[new])
        may = np.flatnonzero(4 * d > gap[owner])
        near = _far(x[may], x[new])
        taken = near < d[may]
        d[may[taken]], owner[may[taken]] = near[taken], len(pivots)
        pivots.append(new)
    return np.unique(owner, return_inverse=True)[1]


def build(x: np.ndarray, leaf: int = LEAF) -> Balls:
    """The tree over the points ``x`` (rows of integers of one type)."""
    nodes: list[list] = []  # points, left, right

    def divide(points: np.ndarray) -> int:
        if len(points) <= leaf or not _far(x[points], x[points[0]]).any():
            nodes.append([points, -1, -1])
            return len(nodes) - 1
        owner = anchors(x[points], max(2, int(len(points) ** 0.5)))
        return join([divide(points[owner == k]) for k in range(owner.max() + 1)])

    def join(found: list[int]) -> int:
        """Pairs whose common ball is smallest first."""
        c = np.array([x[nodes[k][0]].mean(0) for k in found], np.float64)
        n = np.array([len(nodes[k][0]) for k in found], np.float64)
        r = np.array([float(_far(x[nodes[k][0]].astype(np.float64), ci).max()) ** 0.5 for k, ci in zip(found, c, strict=True)])

        def size(i):
            """Radius of a ball around i and each other, about their common centre."""
            mid = (c[i] * n[i] + c * n[:, None]) / (n[i] + n)[:, None]
            s = np.maximum(np.sqrt(_far(c[i], mid)) + r[i], np.sqrt(_far(c, mid)) + r)
            s[i] = np.inf
            return s

        found, cost = list(found), np.array([size(i) for i in range(len(found))])
        i = 0
        for _ in range(len(found) - 1):
            i, j = divmod(int(np.argmin(cost)), len(found))
            radius = cost[i, j]
            nodes.append([np.concatenate([nodes[found[i]][0], nodes[found[j]][0]]), found[i], found[j]])
            c[i], n[i], r[i], found[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j]), n[i] + n[j], radius, len(nodes) - 1
            gone = np.isinf(cost).all(1)
            gone[j] = True
            cost[i] = np.where(gone, np.inf, size(i))
            cost[:, i] = cost[i]
            cost[j], cost[:, j] = np.inf, np.inf
        return int(found[i])

    root = divide(np.arange(len(x)))
    # Points in the order of the leaves from left to right, so that those of a node follow each other.
    order, lo, hi, stack, at = [], np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), [(root, False)], 0
    while stack:
        k, seen = stack.pop()
        points, left, right = nodes[k]
        if seen:
            hi[k] = at
        elif left < 0:
            order.append(points)
            lo[k], at = at, at + len(points)
            hi[k] = at
        else:
            lo[k] = at
            stack += [(k, True), (right, False), (left, False)]
    sums = np.array([x[p].sum(0) for p, *_ in nodes], x.dtype)
    centre = sums // np.array([len(p) for p, *_ in nodes]).astype(x.dtype)[:, None]
    radius2 = np.array([_far(x[p], c).max() for (p, *_), c in zip(nodes, centre, strict=True)], x.dtype)
    swap = [*range(len(nodes))]
    swap[0], swap[root] = root, 0  # the root is node 0
    moved = lambda v: np.array([swap[k] if k >= 0 else -1 for k in v], np.int64)
    return Balls(np.concatenate(order), centre[swap], radius2[swap], sums[swap], lo[swap], hi[swap], moved([nodes[k][1] for k in swap]), moved([nodes[k][2] for k in swap]))


def descend(t: Balls, x: np.ndarray, book: np.ndarray):
    """(balls, their entries) that are owned whole, and (points, their entries) of the rest."""
    gap = _far(book[:, None], book[None]).astype(np.float64)
    at, may = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    balls, owners, points, nearest = [], [], [], []
    while len(at):
        d = _far(t.centre[at][:, None], book[None])
        d = np.where(may, d, d.max() + 1)
        best = np.argmin(d, 1)
        more = (d - d[np.arange(len(at)), best][:, None]).astype(np.float64)
        reach = 2 * np.sqrt(t.radius2[at].astype(np.float64))[:, None] * np.sqrt(gap[best])
        may &= more <= reach * (1 + 1e-9)
        alone = may.sum(1) == 1
        balls.append(at[alone])
        owners.append(best[alone])
        ends = ~alone & (t.left[at] < 0)
        for k, left in zip(at[ends], may[ends], strict=True):
            p = t.order[t.lo[k] : t.hi[k]]
            e = np.flatnonzero(left)
            points.append(p)
            nearest.append(e[np.argmin(_far(x[p][:, None], book[e][None]), 1)])  # ties to the lower entry
        on = ~alone & ~ends
        at, may = np.concatenate([t.left[at[on]], t.right[at[on]]]), np.concatenate([may[on], may[on]])
    both = lambda v: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)
    return (both(balls), both(owners)), (both(points), both(nearest))


def totals(t: Balls, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points of each entry."""
    (balls, owners), (points, nearest) = descend(t, x, book)
    n, s = np.zeros(len(book), np.int64), np.zeros(book.shape, x.dtype)
    np.add.at(n, owners, t.hi[balls] - t.lo[balls])
    np.add.at(s, owners, t.sums[balls])
    np.add.at(n, nearest, 1)
    np.add.at(s, nearest, x[points])
    return n, s


def labels(t: Balls, x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entry of each point."""
    (balls, owners), (points, nearest) = descend(t, x, book)
    out = np.empty(len(x), np.int64)
    for k, e in zip(balls, owners, strict=True):
        out[t.order[t.lo[k] : t.hi[k]]] = e
    out[points] = nearest
    return out


def _packed(t: Balls, x: np.ndarray) -> bytes:
    """Points and tree, in the least type that holds them; integers over 64 bits as text."""
    out = io.BytesIO()
    for a in (x, *vars(t).values()):
        a = a.astype(str) if a.dtype == object else a.astype(np.result_type(*(np.min_scalar_type(int(v)) for v in (a.min(), a.max()))))
        np.lib.format.write_array(out, a, allow_pickle=False)
    return out.getvalue()


def _unpacked(raw: bytes) -> tuple[Balls, np.ndarray]:
    src, out = io.BytesIO(raw), []
    for _ in range(1 + len(Balls.__dataclass_fields__)):
        a = np.lib.format.read_array(src, allow_pickle=False)
        out.append(np.array([int(v) for v in a.ravel()], object).reshape(a.shape) if a.dtype.kind == "U" else a.astype(np.int64))
    x, t = out[0], Balls(*out[1:])
    if object in (x.dtype, t.sums.dtype, t.radius2.dtype, t.centre.dtype):
        x, t.centre, t.sums, t.radius2 = (a.astype(object) for a in (x, t.centre, t.sums, t.radius2))
    return t, x


def _book(x: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Points and entries in one type."""
    b = _exact(np.array(book, object))
    return (x.astype(object), b.astype(object)) if object in (x.dtype, b.dtype) else (x, b)


def _shards(id_type: pa.DataType, label_type: pa.DataType):
    """Rows as they come, by length, so many to a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def shard(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            x = _exact(np.floor(SCALE * np.array([v for *_, v in rows], np.float64)).astype(np.int64))
            width = dim // PARTS
            parts = [np.ascontiguousarray(x[:, p * width : (p + 1) * width]) for p in range(PARTS)]
            trees = [_packed(build(p), p) for p in parts]
            cols = [pa.array([dim], pa.int32()), pa.array([[r[0] for r in rows]], pa.list_(id_type)), pa.array([[r[1] for r in rows]], pa.list_(label_type)), pa.array([trees], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, ["dim", "ids", "labels", "trees"])

        for b in batches:
            for i, label, v in zip(*(b.column(c).to_pylist() for c in ("id", "label", "v")), strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((i, label, v))
                if (len(rows) + 1) * len(v) > SHARD_VALUES:
                    yield shard(len(v))
        for dim in list(held):
            yield shard(dim)
        release()

    return run


def _round(books: dict[int, list]):
    """One row for each entry that has points and each of its components. ``n`` stands with the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, trees in zip(b.column("dim").to_pylist(), b.column("trees"), strict=True):
                rows = []
                for p, raw in enumerate(trees.as_py()):
                    t, x = _unpacked(raw)
                    x, book = _book(x, books[dim][p])
                    n, s = totals(t, x, book)
                    rows += [(dim, p, e, c, int(n[e]) if c == 0 else 0, str(v)) for e in np.flatnonzero(n) for c, v in enumerate(s[e].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32()] * 4 + [pa.int64(), pa.string()])], ["dim", "part", "entry", "c", "n", "s"])
        release()

    return run


def _encode(books: dict[int, list], id_type: pa.DataType, label_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, tags, trees in zip(b.column("dim").to_pylist(), b.column("ids"), b.column("labels"), b.column("trees"), strict=True):
                found, error = [], 0
                for p, raw in enumerate(trees.as_py()):
                    t, x = _unpacked(raw)
                    x, book = _book(x, books[dim][p])
                    e = labels(t, x, book)
                    found.append(e)
                    error = error + _far(x, book[e])
                codes = [bytes(c).hex() for c in np.stack(found, 1).astype(np.uint8)]
                fits = [int(v) if int(v) < 1 << 63 else None for v in error]
                cols = [ids.values, tags.values, pa.array([dim] * len(codes), pa.int32()), pa.array(codes, pa.string()), pa.array(fits, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "label", "dim", "code", "error"])
        release()

    return run


def digest(book: list) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for entry in part for v in entry).encode()).hexdigest()


@dataclass(frozen=True)
class Codes:
    """``rows``: ``id, label, dim, code, error`` of every vector; ``books``: for each length its codebooks,
    integers by part, entry and component."""

    rows: DataFrame
    books: dict[int, list]


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> Codes:
    """Codes of all vectors, after so many rounds from the ``ENTRIES`` smallest ids.

    Vectors that are null or hold null or non-finite components take no part, nor do those with a component of
    2^50 or more, or of a length that ``PARTS`` doesn't divide, or empty ones. Vectors of each length have
    codebooks of their own. Fewer vectors than entries: fewer entries. Of equal ids the least vector comes first, null
    ids come last; repeated rows all count. An error over 64 bits is null. Other columns are ignored.
    """
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)) & (F.size(v) > 0) & (F.size(v) % PARTS == 0)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")).filter(fine)
    kinds = [kept.schema[c].dataType for c in ("id", "label")]
    arrow = [to_arrow_type(t) for t in kinds]
    trees = kept.mapInArrow(_shards(*arrow), f"dim int, ids array<{kinds[0].simpleString()}>, labels array<{kinds[1].simpleString()}>, trees array<binary>")
    trees = materialize(trees, "codes-trees")

    first = F.row_number().over(W.partitionBy(F.size(v)).orderBy(F.asc_nulls_last("id"), v))
    books: dict[int, list] = {}
    for r in kept.withColumn("k", first).filter(F.col("k") <= ENTRIES).orderBy("k").select("v").toLocalIterator():
        width = len(r.v) // PARTS
        ints = np.floor(SCALE * np.array(r.v)).astype(np.int64).tolist()
        for p, part in enumerate(books.setdefault(len(r.v), [[] for _ in range(PARTS)])):
            part.append(ints[p * width : (p + 1) * width])
    for _ in range(rounds if books else 0):
        sums = trees.select("dim", "trees").mapInArrow(_round(books), "dim int, part int, entry int, c int, n long, s string")
        total = sums.groupBy("dim", "part", "entry", "c").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        n, s = {}, {}
        for r in total.collect():  # as many rows as the codebooks have numbers
            s[r.dim, r.part, r.entry, r.c] = int(r.s)
            if r.c == 0:
                n[r.dim, r.part, r.entry] = r.n
        for dim, book in books.items():
            for p, part in enumerate(book):
                for e in range(len(part)):
                    if (dim, p, e) in n:
                        part[e] = [s[dim, p, e, c] // n[dim, p, e] for c in range(dim // PARTS)]
    rows = trees.mapInArrow(_encode(books, *arrow), f"id {kinds[0].simpleString()}, label {kinds[1].simpleString()}, dim int, code string, error long")
    return Codes(materialize(rows, "codes"), books)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(table(spark, sf_dir, "embeddings"))
    d = found.rows
    # A sum over 64 bits is null, too.
    total = F.when(F.count("error") == F.count("*"), F.try_sum("error"))
    by = materialize(d.groupBy(F.col("label").alias("l")).agg(total.alias("label_error")), "codes-labels")
    by = F.broadcast(by) if by.count() <= BROADCAST_ROWS else by
    book = F.lit(None).cast("string")
    for dim, b in found.books.items():
        book = F.when(F.col("dim") == dim, F.lit(digest(b))).otherwise(book)
    d = d.join(by, F.col("label").eqNullSafe(F.col("l")), "left")
    return d.select(F.col("id").alias("vec_id"), "code", "error", "label_error", book.alias("codebooks_sha256"))


def op12_sql() -> str:
    """For vectors of one length."""
    out = [
        "WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS k, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT k, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) r(p))",
        f"b0 AS MATERIALIZED (SELECT p, k AS e, v FROM x WHERE k < {ENTRIES})",
    ]
    near = "SELECT k, p, any_value(x.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS m FROM x JOIN b{} b USING (p) GROUP BY k, p"
    for r in range(ROUNDS):
        out.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        out.append(f"c{r} AS (SELECT p, m.e AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL)")
        out.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(w, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM c{r} GROUP BY p, e) USING (p, e))")
    out.append(f"z AS MATERIALIZED ({near.format(ROUNDS)})")
    out.append("codes AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM z JOIN kept USING (k) GROUP BY k, vec_id, label)")
    out.append(f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    return ",\n".join(out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes, digest"
