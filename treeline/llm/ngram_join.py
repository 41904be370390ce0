"""Exact Jaccard self-join of documents on word n-grams, with prefix trees.

A document's set holds its distinct 5-word shingles. Two documents link when the Jaccard similarity
of their sets is at least 0.8. The result is, for every document, the size of its set and the
component of the link graph that it is in; no link between different components is missed.

1. Each text becomes a set of 64-bit shingle hashes, with a 64-bit signature. Equal sets are one
   class from here on, however many documents it has.
2. A document with a partner shares at least 80 % of its shingles with other classes. First a part
   of the hash space (``PART``) is counted: who has too few shared shingles there, even if all the
   others are shared, is out. Only the rest is counted in full. Counting is by hash range. What
   several sets of a chunk of texts hold is sent once a chunk, so a shingle that a third of all
   documents have is one entry a chunk and not one a document.
3. Shingles in a global order, rarest first: two linked classes share one of their first
   ``n - ceil(0.8 n) + 1``, their prefix. All links come from prefix trees (tries) over that order
   (frequent first, so that common parts are shared): a class traverses a trie, overlap is counted
   once for a shared path, and a subtree is left as soon as its lengths and the shingles that remain
   can't reach the threshold.
4. First tries of pivots: each prefix shingle names the most central class that has it, and each
   class traverses the tries that hold the pivots of its own shingles. A group of near copies of any
   size is joined by one traversal for each class and pivot.
5. Then, for each prefix shingle that classes of different components still share, the trie of
   those classes; subtrees that are of the traversing class's own component are left. Shingles whose
   least class is the same share a trie. A large one is split by length (``BANDS``) and into blocks.
6. The links found give the components.

Hashes: two different sets collide with probability 2^-64 a pair, two shingles of the sets that a trie
compares with 2^-56.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, materialize, materialize_narrow, release, table

WORDS = 5
#: Similarity in percent.
PERCENT = 80
#: Share of the hash space that is counted first, in 256ths. Must be above 100 - PERCENT percent.
PART = 96
#: Shingles that one counting task holds at a time, and the least number of hash ranges.
BUCKET = 2_000_000
RANGES = 32
#: Bytes of text turned into shingles at once.
CHUNK = 1 << 20
#: Pivots in one trie; classes in one of a group; classes that traverse one in one task.
PIVOTS = 64
BLOCK = 256
PROBES = 2048
#: Lengths of a band differ by this factor at most; only a group of over ``PROBES`` classes is split so.
BANDS = 1.25
#: Ids are broadcast up to this many; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public SplitMix64 generator."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _odd(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd numbers."""
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are runs of anything but space and
    U+0009 to U+000D, with A-Z lower-cased; fewer than ``words`` of them count as one shingle; null
    or none: empty."""
    raw = [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass").lower() for t in texts]
    a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[a]
    before = np.empty(len(a), bool)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(starts):
        return [np.empty(0, _U) for _ in texts]
    length = ends - starts
    inside = ~space
    place = np.arange(len(a)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(a)]])))
    letters = _odd(256, 1)[a[inside]] * _odd(1 << int(length.max()).bit_length(), 2)[place[inside]]
    word = _mix(np.add.reduceat(letters, np.cumsum(length) - length) + length.astype(_U))
    ends_at = np.cumsum([len(r) + 1 for r in raw])
    cut = np.searchsorted(starts, ends_at)
    factors = _odd(words, 3)
    rolled = np.zeros(max(0, len(word) - words + 1), _U)
    for k in range(words if len(rolled) else 0):
        rolled += word[k : k + len(rolled)] * factors[k]
    rolled = _mix(rolled)
    out, lo = [], 0
    for hi in cut.tolist():
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            out.append(_mix((word[lo:hi] * factors[: hi - lo]).sum(keepdims=True) + _U(hi - lo)))
        else:
            out.append(np.empty(0, _U))
        lo = hi
    return out


def signature(s: np.ndarray) -> int:
    """Of a set, as a signed 64-bit number."""
    return int(_mix(_mix(s ^ _U(0xD6E8FEB86659FD93)).sum(keepdims=True) + _U(len(s)))[0].astype(np.int64))


def _chunks(texts: list) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < CHUNK):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def document_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``rid, id, n, sig`` of every row; sig is null for the empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in _chunks(texts):
                sets = shingle_sets(texts[lo:hi], words)
                sig = pd.array([signature(s) if len(s) else None for s in sets], dtype="Int64")
                yield pd.DataFrame({"rid": pdf["rid"].to_numpy()[lo:hi], "id": pdf["id"].to_numpy()[lo:hi], "n": [len(s) for s in sets], "sig": sig})
            release()

    d = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return d.mapInPandas(run, "rid long, id string, n long, sig long").withColumn("id", F.col("id").cast("long"))


def _sets(texts: list, words: int, seen: set[int]) -> tuple[list[np.ndarray], list[int]]:
    """The sets of texts that aren't ``seen`` yet, and their signatures."""
    sets, sigs = [], []
    for s in shingle_sets(texts, words):
        if len(s) and (g := signature(s)) not in seen:
            if len(seen) < 200_000:  # repeats that slip through only make shingles look shared
                seen.add(g)
            sets.append(s)
            sigs.append(g)
    return sets, sigs


def _ranges(h: np.ndarray, buckets: int, part: int) -> np.ndarray:
    """The hash range of each of the sorted ``h``, of which the lowest ``part`` 256ths are dealt."""
    return np.minimum((h // _U(min((part << 56) // buckets + 1, 2**64 - 1))).astype(np.int64), buckets - 1)


def _deal(text: DataFrame, buckets: int, part: int, words: int) -> DataFrame:
    """The shingles of all distinct sets among ``text`` in the lowest ``part`` 256ths of the hash
    space, packed by hash range: ``bucket`` and, for the sets of one chunk, signatures, sizes, numbers
    of shingles and the shingles that only one set of the chunk has; ``many``: those of several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in _chunks(texts):
                sets, sigs = _sets(texts[lo:hi], words, seen)
                if not sets:
                    continue
                sig, n = np.array(sigs, np.int64), np.array([len(s) for s in sets], np.uint32)
                if part < 256:
                    sets = [s[: np.searchsorted(s, _U(part << 56))] for s in sets]
                h = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                new = np.append(True, h[1:] != h[:-1])
                single = new & np.append(new[1:], True)
                many = h[new & ~single]
                h, owner = h[single], owner[single]
                edges = np.searchsorted(_ranges(h, buckets, part), np.arange(buckets + 1))
                apart = np.searchsorted(_ranges(many, buckets, part), np.arange(buckets + 1))
                rows = []
                for k in range(buckets):
                    a, b = edges[k], edges[k + 1]
                    if a < b or apart[k] < apart[k + 1]:
                        o = np.argsort(owner[a:b], kind="stable")
                        who, count = np.unique(owner[a:b], return_counts=True)
                        rows.append((k, sig[who].tobytes(), n[who].tobytes(), count.astype(np.uint32).tobytes(), h[a:b][o].tobytes(), many[apart[k] : apart[k + 1]].tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "sigs", "ns", "counts", "hashes", "many"])
            release()

    return text.mapInPandas(run, "bucket long, sigs binary, ns binary, counts binary, hashes binary, many binary")


def _joined(column: pd.Series, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype)


def _tally(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every set how many of its shingles no other has. A set that came twice counts once."""
    release()
    sig, n = _joined(pdf["sigs"], np.int64), _joined(pdf["ns"], np.uint32).astype(np.int64)
    count, h = _joined(pdf["counts"], np.uint32).astype(np.int64), _joined(pdf["hashes"], _U)
    owner = np.repeat(np.arange(len(sig)), count)
    _, first = np.unique(sig, return_index=True)
    if len(first) < len(sig):
        keep = np.zeros(len(sig), bool)
        keep[first] = True
        h, owner = h[keep[owner]], owner[keep[owner]]
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    alone = new & np.append(new[1:], True)[: len(h)]
    alone[alone] = ~np.isin(h[alone], np.unique(_joined(pdf["many"], _U)))
    lone = np.bincount(owner[alone], minlength=len(sig))[first]
    return pd.DataFrame({"sig": sig[first], "n": n[first], "lone": lone})[lone > 0]


def _pack(text: DataFrame, words: int) -> DataFrame:
    """The sets of ``text``, packed by chunk, which is named by a hash of what it holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in _chunks(texts):
                sets, sigs = _sets(texts[lo:hi], words, seen)
                if sets:
                    n = np.array([len(s) for s in sets], np.uint32)
                    name = signature(np.array(sigs, np.int64).view(_U))
                    yield pd.DataFrame([(name, np.array(sigs, np.int64).tobytes(), n.tobytes(), np.concatenate(sets).tobytes())], columns=["chunk", "sigs", "ns", "hashes"])
            release()

    return text.mapInPandas(run, "chunk long, sigs binary, ns binary, hashes binary")


def _asked(packed: DataFrame, buckets: int) -> DataFrame:
    """The distinct shingles of every chunk by hash range, with the number of its sets that have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["chunk"], pdf["hashes"], strict=True):
                h, count = np.unique(np.frombuffer(raw, _U), return_counts=True)
                edges = np.searchsorted(_ranges(h, buckets, 256), np.arange(buckets + 1))
                rows = [(k, name, h[a:b].tobytes(), count[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "hashes", "counts"])
            release()

    return packed.mapInPandas(run, "bucket long, chunk long, hashes binary, counts binary")


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every chunk those of its shingles in the range that several sets have, with their number."""
    release()
    pdf = pdf.drop_duplicates("chunk")
    h, count = _joined(pdf["hashes"], _U), _joined(pdf["counts"], np.uint32).astype(np.int64)
    _, inverse = np.unique(h, return_inverse=True)
    df = np.bincount(inverse, count).astype(np.int64)[inverse]
    rows, at = [], 0
    for name, raw in zip(pdf["chunk"], pdf["hashes"], strict=True):
        d = df[at : at + len(raw) // 8]
        at += len(d)
        if (keep := d > 1).any():
            rows.append((name, np.frombuffer(raw, _U)[keep].tobytes(), d[keep].tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "hashes", "dfs"])


def _ordered(percent: int):
    """(chunk's sets, answers) -> ``sig, n, tokens, prefix, short, central`` of the sets of which enough is
    shared. A token is a shared shingle: its frequency in the upper bits, its hash in the lower, so that
    tokens in their own order are in the global order, rarest first. ``prefix`` are those that a linked
    class shares one of, at least; of the first ``short`` of them if it has no fewer shingles."""

    def run(packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(packed) and len(answers):
            sig, n = np.frombuffer(packed["sigs"][0], np.int64), np.frombuffer(packed["ns"][0], np.uint32).astype(np.int64)
            h = np.frombuffer(packed["hashes"][0], _U)
            known, df = _joined(answers["hashes"], _U), _joined(answers["dfs"], np.int64)
            order = np.argsort(known)
            known, df = known[order], df[order]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            shared = known[at] == h
            level = np.minimum(np.floor(4 * np.log2(df)), 127).astype(_U)
            token = ((level[at] << _U(56)) | (h >> _U(8))).astype(np.int64)
            weight = np.minimum(df[at], 1000)
            ends = np.cumsum(n)
            for k, (lo, hi) in enumerate(zip(ends - n, ends, strict=True)):
                mine = shared[lo:hi]
                size, m = int(n[k]), int(np.count_nonzero(mine))
                if m * 100 >= percent * size:
                    t = np.sort(token[lo:hi][mine])
                    length = m + 1 + (-percent * size) // 100  # n - ceil(0.8 n) + 1, less those of no other
                    short = m + 1 + (-2 * percent * size) // (100 + percent)
                    rows.append((sig[k], size, t, t[:length], max(0, short), weight[lo:hi][mine].sum() / size))
        release()
        return pd.DataFrame(rows, columns=["sig", "n", "tokens", "prefix", "short", "central"])

    return run


# -- prefix trees ----------------------------------------------------------------------------


class Node:
    """A path of tokens; below it, sets of ``lo`` to ``hi`` shingles with at most ``rest`` tokens
    more, all of component ``label`` unless that is None."""

    __slots__ = ("edge", "children", "lo", "hi", "rest", "label", "sets")

    def __init__(self, edge: np.ndarray, label) -> None:
        self.edge, self.children, self.lo, self.hi, self.rest, self.label, self.sets = edge, {}, 1 << 62, 0, 0, label, []

    def widen(self, n: int, rest: int, label) -> None:
        self.lo, self.hi, self.rest = min(self.lo, n), max(self.hi, n), max(self.rest, rest)
        if self.label != label:
            self.label = None


class Trie:
    def __init__(self, percent: int) -> None:
        self.root, self.percent = None, percent

    def insert(self, tokens: np.ndarray, n: int, name, label=None) -> None:
        if self.root is None:
            self.root = Node(tokens[:0], label)
        node, at = self.root, 0
        node.widen(n, len(tokens), label)
        while at < len(tokens):
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = node.children[int(tokens[at])] = Node(tokens[at:], label)
                k = len(child.edge)
            else:
                m = min(len(child.edge), len(tokens) - at)
                differ = np.flatnonzero(child.edge[:m] != tokens[at : at + m])
                k = int(differ[0]) if len(differ) else m
                if k < len(child.edge):  # the path forks here
                    upper = Node(child.edge[:k], child.label)
                    upper.lo, upper.hi, upper.rest = child.lo, child.hi, child.rest + len(child.edge) - k
                    child.edge = child.edge[k:]
                    upper.children[int(child.edge[0])] = child
                    node.children[int(tokens[at])] = child = upper
            at += k
            child.widen(n, len(tokens) - at, label)
            node = child
        node.sets.append((n, name, label))

    def search(self, tokens: np.ndarray, n: int, mark: np.ndarray, joined: frozenset | set = frozenset()) -> Iterator:
        """(name, label) of the sets similar to a set of ``n`` shingles with these ``tokens``. ``mark`` is
        true for the tokens' numbers; numbers follow the global order. What is of a component in
        ``joined``, which may grow meanwhile, is left out."""
        p = self.percent
        stack = [(self.root, 0)] if self.root else []
        while stack:
            node, overlap = stack.pop()
            if node.hi * 100 < p * n or node.lo * p > 100 * n or node.label is not None and node.label in joined:
                continue
            left = len(tokens)
            if len(node.edge):
                overlap += int(np.count_nonzero(mark[node.edge]))
                left -= int(np.searchsorted(tokens, node.edge[-1], "right"))
            if (overlap + min(node.rest, left)) * (100 + p) < p * (n + max(node.lo, -(-p * n // 100))):
                continue
            for m, name, label in node.sets:
                if overlap * 100 >= p * (n + m - overlap) and (label is None or label not in joined):
                    yield name, label
            stack += [(c, overlap) for c in node.children.values()]


def _trie_links(keys: list[str], percent: int):
    """Links between the classes of each group: those with ``index`` are put into a trie, those with
    ``probe`` traverse it. A class of a component is linked to every other component once at most."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        out: list[tuple[int, int]] = []
        for _, group in pdf.groupby(keys):
            vocab = np.unique(np.concatenate(group["tokens"].tolist()))
            numbers = [len(vocab) - 1 - np.searchsorted(vocab, t[::-1]) for t in group["tokens"]]  # frequent first
            labels = [None if x is None or x != x else int(x) for x in group["label"]]
            rows = list(zip(group["sig"].tolist(), group["n"].tolist(), numbers, labels, group["index"].tolist(), group["probe"].tolist(), strict=True))
            trie, mark = Trie(percent), np.zeros(len(vocab), bool)
            for sig, n, ids, label, index, _ in rows:
                if index:
                    trie.insert(ids, n, sig, label)
            for sig, n, ids, label, _, probe in rows:
                if probe:
                    mark[ids] = True
                    joined = set() if label is None else {label}
                    for name, other in trie.search(ids, n, mark, joined):
                        if name != sig:
                            out.append((sig, name))
                            if other is not None:
                                joined.add(other)
                    mark[ids] = False
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return links


def _search(sets: DataFrame, places: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """``a, b``: links within the groups of ``places`` (``sig``, keys, ``label``, ``index``, ``probe``)."""
    rows = places.count()
    both = sets.select("sig", "n", "tokens").join(places, "sig").withColumn("task", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-rows // 500)))))
    return both.groupBy("task").applyInPandas(_trie_links(keys, percent), "a long, b long")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _pivot_places(tokens: DataFrame) -> DataFrame:
    """Tries of pivots and who traverses them. ``tokens`` has ``token, sig, central``."""
    pivot = tokens.groupBy("token").agg(F.max(F.struct("central", "sig"))["sig"].alias("pivot"), F.min("sig").alias("lo"), F.max("sig").alias("hi"))
    # Written down, so that the next join has an exchange of its own on either side, which can be split.
    pivot = materialize(pivot.filter("lo <> hi").select("token", "pivot"), "join-pivots")
    blocks = max(1, -(-pivot.select("pivot").distinct().count() // PIVOTS))
    block = F.pmod(F.xxhash64("pivot"), F.lit(blocks)).alias("block")
    probes = materialize_narrow(tokens.join(pivot, "token").filter("sig <> pivot").select("sig", block).distinct(), "join-probes")
    parts = probes.groupBy("block").agg(F.ceil(F.count("*") / PROBES).alias("parts"))
    held = pivot.select(F.col("pivot").alias("sig"), block).distinct().join(parts, "block")
    index = held.select("sig", "block", _every(F.col("parts")).alias("part"), F.lit(True).alias("index"), F.lit(False).alias("probe"))
    probe = probes.join(parts, "block").select("sig", "block", F.pmod(F.xxhash64("sig"), "parts").alias("part"), F.lit(False).alias("index"), F.lit(True).alias("probe"))
    return materialize_narrow(index.unionByName(probe).withColumn("label", F.lit(None).cast("long")), "join-places")


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(BANDS)))


def _home_places(tokens: DataFrame, percent: int) -> DataFrame:
    """Tries of the shingles that different components share. ``tokens`` has ``token, sig, n, short, label``;
    of two linked classes that of fewer shingles has the token among its short prefix. The classes of all
    shingles with the same home, their least class, are one group: near copies have few homes."""
    own = tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("sig").alias("home"), F.count_if("short").alias("few"))
    # Written down, so that the next join has an exchange of its own on either side, which can be split.
    mixed = materialize(own.filter("lo <> hi and few > 0").select("token", "home"), "join-mixed")
    member = tokens.join(mixed, "token").groupBy("home", "sig").agg(F.max("short").alias("short"), F.first("n").alias("n"), F.first("label").alias("label"))
    member = materialize_narrow(member, "join-members")
    large = member.groupBy("home").agg((F.count("*") > PROBES).alias("large"))
    m = member.join(materialize_narrow(large, "join-large"), "home")
    low = F.ceil(F.col("n") * percent / 100)
    # A class traverses its own band and those of classes of fewer shingles that are similar enough.
    bands = F.explode(F.when(F.col("large"), F.sequence(_band(low), _band(F.col("n")))).otherwise(F.array(F.lit(0).cast("long"))))
    m = m.withColumn("own", F.when(F.col("large"), _band(F.col("n"))).otherwise(0)).withColumn("band", bands)
    m = materialize_narrow(m.select("home", "band", "sig", "label", (F.col("short") & (F.col("own") == F.col("band"))).alias("index")), "join-bands")
    sizes = m.groupBy("home", "band").agg(F.ceil(F.count_if("index") / BLOCK).alias("blocks"), F.ceil(F.count("*") / PROBES).alias("parts")).filter("blocks > 0")
    m = m.join(materialize_narrow(sizes, "join-sizes"), ["home", "band"])
    mine = lambda n: F.pmod(F.xxhash64("sig"), F.col(n))
    out = ["home", "band", "sig", "label", "block", "part", "index", "probe"]
    zero = F.lit(0).cast("long")
    one = m.filter("blocks * parts = 1").withColumns({"block": zero, "part": zero, "probe": F.lit(True)}).select(out)
    more = m.filter("blocks * parts > 1")
    index = more.filter("index").withColumn("part", _every(F.col("parts"))).withColumns({"block": mine("blocks"), "probe": F.lit(False)}).select(out)
    probe = more.withColumn("block", _every(F.col("blocks"))).withColumns({"part": mine("parts"), "index": F.lit(False), "probe": F.lit(True)}).select(out)
    return materialize_narrow(one.unionByName(index).unionByName(probe), "join-places")


def class_labels(text: DataFrame, sets: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``node, label``: classes with a link and their component. ``text`` has ``rid, id, text``,
    ``sets`` is ``document_sets`` of the same rows."""
    classes = materialize(sets.filter("sig is not null").groupBy("sig").agg(F.first("n").alias("n"), F.min(F.struct("rid", "id")).alias("row")), "join-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0

    # Which classes have enough shared shingles in a part of the hash space, if the rest is shared?
    few = max(RANGES, -(-total * PART // 256 // BUCKET))
    tally = _deal(text.select("text"), few, PART, words).groupBy("bucket").applyInPandas(_tally, "sig long, n long, lone long")
    lone = tally.groupBy("sig").agg(F.sum("lone").alias("lone"))
    # None counted in that part: nothing is known, so it stays.
    alive = classes.join(lone, "sig", "left").filter(F.coalesce("lone", F.lit(0)) * 100 <= (100 - percent) * F.col("n"))
    alive = materialize(alive.select("n", "row.rid", "row.id"), "join-alive")
    r = alive.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()

    ids = alive.select(F.col("rid").alias("_rid"), F.col("id").alias("_id"))
    ids = F.broadcast(ids) if r.c <= BROADCAST_ROWS else ids
    texts = text.join(ids, (F.col("rid") == F.col("_rid")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    packed = materialize(_pack(texts, words), "join-packed")
    answers = _asked(packed, max(RANGES, -(-r.n // BUCKET))).groupBy("bucket").applyInPandas(_answer, "chunk long, hashes binary, dfs binary")
    ordered = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_ordered(percent), "sig long, n long, tokens array<long>, prefix array<long>, short int, central double")
    ordered = materialize(ordered.dropDuplicates(["sig"]), "join-sets")

    prefix = ordered.select("sig", "central", F.explode("prefix").alias("token"))
    found = materialize(_search(ordered, _pivot_places(prefix), ["block", "part"], percent), "join-links")
    labels = materialize_narrow(components(found, "join-labels"), "join-labels")
    labelled = ordered.select("sig", "n", "prefix", "short").join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    exploded = labelled.select("sig", "n", "short", F.coalesce("label", "sig").alias("label"), F.posexplode("prefix").alias("at", "token"))
    places = _home_places(exploded.withColumn("short", F.col("at") < F.col("short")).drop("at"), percent)
    more = materialize(_search(ordered, places, ["home", "band", "block", "part"], percent), "join-links")
    if more.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), "join-labels")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, id, n, component_id`` of every row of ``docs``.

    ``n`` is the size of the set, ``component_id`` the least id reachable by links, its own
    included. Null, empty and blank texts have an empty set and no links. Repeated rows link like any
    others. Null ids never are a component's id, unless it has no other. Texts are read whole."""
    text = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = materialize(document_sets(docs, id_col, text_col, words), "join-documents")
    labels = materialize(class_labels(text, sets, percent, words), "join-labels")
    least = sets.filter("sig is not null").groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("c"))
    grouped = least.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left")
    top = grouped.filter("label is not null").groupBy(F.col("label").alias("l")).agg(F.min("least").alias("top"))
    named = grouped.filter("c > 1 or label is not null").join(top, F.col("label") == F.col("l"), "left").select(F.col("sig").alias("s"), F.coalesce("top", "least").alias("found"))
    named = materialize(named, "join-named")
    return sets.join(named, F.col("sig") == F.col("s"), "left").select("rid", "id", "n", F.coalesce("found", "id").alias("component_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of least id; documents without words all stay."""
    c = materialize(jaccard_components(docs), "join-result").filter("n > 0")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    first = c.groupBy(F.col("component_id").alias("component")).agg(F.min(order).alias("first"))
    rest = c.join(first, F.col("component_id").eqNullSafe(F.col("component"))).filter(~order.eqNullSafe(F.col("first")))
    rest = materialize(rest.select(F.col("rid").alias("_join_rid"), F.col("id").alias("_join_id")).distinct(), "join-rest")
    gone = F.broadcast(rest) if rest.count() <= BROADCAST_ROWS else rest
    keyed = docs.withColumn("_join_key", row_key("doc_id", "text"))
    kept = keyed.join(gone, (F.col("_join_key") == F.col("_join_rid")) & F.col("doc_id").eqNullSafe(F.col("_join_id")), "left_anti")
    # Rows repeated in full: one of them.
    again = c.groupBy("rid").count().filter("count > 1").select(F.col("rid").alias("_join_again"))
    marked = kept.join(F.broadcast(again) if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else again, F.col("_join_key") == F.col("_join_again"), "left")
    nth = F.row_number().over(W.partitionBy("_join_key", "doc_id").orderBy("_join_key"))
    once = marked.filter("_join_again is null").select(*docs.columns)
    return once.unionByName(marked.filter("_join_again is not null").withColumn("_join_nth", nth).filter("_join_nth = 1").select(*docs.columns))
