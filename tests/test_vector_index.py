"""Inverted lists of vectors against a search of all."""

import numpy as np
import pytest

from treeline.operators import similarity, vector_index

SCHEMA = "entry_id string, chunk_position int, chunk_text string, embedding array<float>"


def brute(rows, q, k):
    best = {}
    for e, p, t, v in rows:
        if v and len(v) == len(q) and np.linalg.norm(v) > 0:
            v = np.array(v, np.float32).astype(float)
            d = 1 - v @ q / (np.linalg.norm(v) * np.linalg.norm(q))
            best[e] = min(best.get(e, (9,)), (round(d, 9), p, t))
    return sorted((d, e, t) for e, (d, _, t) in best.items())[:k]


def run(spark, tmp_path, rows, q, k, **kw):
    vector_index.write(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/x", **kw)
    found, read = vector_index.search(spark, f"file://{tmp_path}/x", q, k)
    return [(round(r.distance, 9), r.entry_id, r.chunk_text) for r in found.collect()], read


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_like_a_full_search(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    if kind == "clusters":
        x = rng.standard_normal((40, 16))[rng.integers(0, 40, 3000)] + 0.1 * x
    rows = [(f"e{i // 2}", i % 2, f"t{i}", v.tolist()) for i, v in enumerate(x)]
    q = x[17] + 0.01
    got, read = run(spark, tmp_path, rows, q.tolist(), 10)
    assert got == brute(rows, q, 10)
    assert read < 0.2 * len(rows) if kind == "clusters" else read <= len(rows)


def test_odd_rows(spark, tmp_path):
    one = [1.0, 0.0, 0.0]
    rows = [("a", 0, "x", one), ("a", 1, "y", one), ("b", 0, None, [0.0, 0.0, 0.0]), ("c", 0, "z", None), ("d", None, "w", [0.0, 1.0, 0.0]), ("h", 0, "h", [1.0, 1.0, 0.0])] + [("h", 0, "h", [1.0, 1.0, 0.0])] * 50
    got, read = run(spark, tmp_path, rows, one, 3)
    assert [(d, e) for d, e, _ in got] == [(0.0, "a"), (round(1 - 2**-0.5, 9), "h"), (1.0, "d")] and got[0][2] == "x"
    assert run(spark, tmp_path, rows, [0.0, 0.0, 0.0], 3)[0] == []
    assert run(spark, tmp_path, [], one, 3) == ([], 0)


@pytest.mark.parametrize("kind,threshold,limit,block", [("clusters", 0.15, 1000, 2000), ("clusters", 0.65, 50, 30), ("noise", 0.65, 200, 2000), ("noise", 0.15, 10, 2000)])
def test_nearest_pairs(spark, monkeypatch, kind, threshold, limit, block):
    monkeypatch.setattr(similarity, "CELL_ROWS", block)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8))
    if kind == "clusters":
        x = rng.standard_normal((9, 8))[rng.integers(0, 9, 400)] + 0.2 * x
    x[7] = 0
    rows = [(i, i % 7, v.tolist()) for i, v in enumerate(x)] + [(1000, 0, None)]
    got = [(r.a, r.b) for r in similarity.similar_pairs(spark.createDataFrame(rows, "id long, grp int, v array<double>"), threshold, limit).collect()]
    norm = np.linalg.norm(x, axis=1)
    d = 1 - x @ x.T / np.where(norm > 0, norm, np.nan)[:, None] / np.where(norm > 0, norm, np.nan)
    want = sorted((d[a, b], a, b) for a in range(400) for b in range(a + 1, 400) if a % 7 != b % 7 and d[a, b] < threshold)[:limit]
    assert got == [(a, b) for _, a, b in want]
    assert similarity.similar_pairs(spark.createDataFrame(rows[:1], "id long, grp int, v array<double>"), threshold, limit).count() == 0


def test_nearest_pairs_of_many_small_shares(spark, monkeypatch):
    """Shares, blocks and measured slices of a few rows, with copies; components that are null or not finite."""
    for name, size in (("SHARE_ROWS", 50), ("CELL_ROWS", 20), ("MEASURED", 7)):
        monkeypatch.setattr(similarity, name, size)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((240, 6)).astype(np.float32)
    x[100:140] = x[5]
    odd = [[None, 1.0] * 3, [float("nan"), 1.0] * 3, [float("inf"), 1.0] * 3]
    rows = [(f"e{i}", None if i == 9 else i % 3, v.tolist()) for i, v in enumerate(x)] + [(f"x{i}", 8 + i, v) for i, v in enumerate(odd)]
    for limit in (60, 100_000):
        got = similarity.similar_pairs(spark.createDataFrame(rows, "id string, grp int, v array<float>"), 0.4, limit)
        x64, d = x.astype(np.float64), {}
        norm = np.sqrt((x64 * x64).sum(1))
        for a in range(240):
            for b in range(240):
                if f"e{a}" < f"e{b}" and 9 not in (a, b) and a % 3 != b % 3:
                    d[f"e{a}", f"e{b}"] = round(1 - float(x64[a] @ x64[b]) / (norm[a] * norm[b]), 9)
        found = [((r.a, r.b), round(r.distance, 9)) for r in got.collect()]
        want = sorted((v, *k) for k, v in d.items() if v < 0.4)
        assert all(d[k] == v for k, v in found) and len({k for k, _ in found}) == len(found)
        assert [v for _, v in found] == [v for v, _, _ in want[:limit]]
