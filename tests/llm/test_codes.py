import hashlib

import numpy as np
import pytest

from tests.conftest import DATA, duck_rows, rows
from treeline.llm import codes


def brute(table):
    """The query's result: every part against every entry, in whole numbers of any size."""
    kept = {}
    for i, v, label in table:
        if v and len(v) % 8 == 0 and all(x is not None and np.isfinite(x) and abs(x) < 2**50 for x in v):
            kept.setdefault(len(v), []).append((i, label, [int(np.floor(4096 * float(x))) for x in v]))
    out = []
    for dim, found in kept.items():
        w = dim // 8
        parts = [[v[p * w : (p + 1) * w] for *_, v in found] for p in range(8)]
        first = sorted(range(len(found)), key=lambda k: (found[k][0] is None, found[k][0] or 0, found[k][2]))[:16]
        books = [[parts[p][k] for k in first] for p in range(8)]

        def near(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

        for _ in range(6):
            for p in range(8):
                owner = [near(x, books[p])[1] for x in parts[p]]
                for j in range(len(books[p])):
                    mine = [x for x, o in zip(parts[p], owner, strict=True) if o == j]
                    if mine:
                        books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for k, (i, label, _) in enumerate(found):
            best = [near(parts[p][k], books[p]) for p in range(8)]
            out.append([i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label, sha])
    by = {}
    for _, _, error, label, _ in out:
        by[label] = by.get(label, 0) + error
    fit = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, fit(e), fit(by[label]), s) for i, c, e, label, s in out), key=str)


def run(spark, tmp_path, table, kind="double"):
    df = spark.createDataFrame(table, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS id", "'v' AS v", "2 AS dim", "3 AS k", "4 AS error", "5 AS l", "6 AS trees")
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in codes.op12(spark, str(tmp_path)).collect()), key=str)


def test_like_brute_force(spark, tmp_path, monkeypatch):
    nan, inf, rng = float("nan"), float("inf"), np.random.default_rng(1)
    table = [(int(i), (rng.standard_normal(16) * rng.choice([0.01, 1, 100])).tolist(), int(rng.integers(3))) for i in rng.integers(0, 400, 300)]
    table += [(1000 + i, [0.5] * 16, None) for i in range(150)]  # one hot vector
    table += [(3, None, 1), (4, [], 1), (5, [nan] * 16, 1), (6, [inf] * 16, 1), (7, [None] * 16, 1), (8, [1.0] * 9, 1), (None, [0.25] * 16, None), (9, [0.0] * 16, None), (10, [1e300] * 16, 2)]
    table += [(i, rng.standard_normal(8).tolist(), 7) for i in range(10)]  # fewer than entries
    monkeypatch.setattr(codes, "SHARD_VALUES", 16 * 60)
    assert run(spark, tmp_path, table) == brute(table)


def test_large_numbers(spark, tmp_path):
    rng = np.random.default_rng(2)
    table = [(i, (rng.standard_normal(8) * 10.0 ** rng.integers(0, 13)).tolist(), i % 2) for i in range(60)]
    got = run(spark, tmp_path, table)
    assert got == brute(table) and any(r[2] is None for r in got)


@pytest.mark.parametrize("table", [[], [(1, None, 1)], [(1, [1.0] * 8, None)] * 3])
def test_small_tables(spark, tmp_path, table):
    assert run(spark, tmp_path, table) == brute(table)


@pytest.mark.parametrize("kind", ["noise", "clusters", "repeats", "large"])
def test_trees(kind):
    rng = np.random.default_rng(3)
    x = rng.integers(-3000, 3000, (1500, 4))
    if kind == "clusters":
        x = rng.integers(-30000, 30000, (12, 4))[rng.integers(0, 12, 1500)] + x // 100
    if kind == "repeats":
        x = x[rng.integers(0, 5, 1500)]
    if kind == "large":
        x = x[:300].astype(object) * 10**14
    t = codes.build(x, leaf=10)
    assert sorted(t.order) == list(range(len(x))) and (t.lo[0], t.hi[0]) == (0, len(x))
    for k in range(len(t.lo)):
        p = x[t.order[t.lo[k] : t.hi[k]]]
        assert len(p) and (t.sums[k] == p.sum(0)).all() and t.radius2[k] == ((p - t.centre[k]) ** 2).sum(1).max()
        if t.left[k] >= 0:
            assert {(t.lo[k], t.hi[k])} == {(t.lo[t.left[k]], t.hi[t.right[k]])} and t.hi[t.left[k]] == t.lo[t.right[k]]
    book = x[:16].copy()
    book[3] = book[2]  # a tie: the lower entry
    want = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (codes.labels(t, x, book) == want).all()
    n, s = codes.totals(t, x, book)
    assert n.tolist() == [(want == e).sum() for e in range(16)] and all((s[e] == x[want == e].sum(0)).all() for e in range(16))
    u, y = codes._unpacked(codes._packed(t, x))
    assert (y == x).all() and all((getattr(u, f) == getattr(t, f)).all() for f in vars(t))
    (balls, _), (points, _) = codes.descend(t, x, book)
    assert kind == "noise" or len(points) < len(x)  # balls were owned whole


def test_matches_sql(spark):
    assert rows(codes.op12(spark, DATA)) == duck_rows(codes.op12_sql())
