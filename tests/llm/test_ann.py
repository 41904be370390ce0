import numpy as np

from treeline.llm import ann


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in {i: v for i, v in sorted(ok, key=lambda r: tuple(-r[1])) if i % 50 == 0}.items():
        c = [(-(float((v * q).sum()) / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), j) for j, v in ok if j != i and len(v) == len(q)]
        out[i] = sorted(c)[:k]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS score", "1 AS rank", "2 AS shard")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id, r["rank"]))
    return got


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (10, [1.0, 1.0, 1.0]), (50, [-1.0, 0.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0]), (11, [3.0, 0.0]), (11, [3.0, 0.0]), (150, [1.0, 2.0, 3.0])]
    got = run(spark, rows)
    assert set(got) == {0, 50, 150}
    assert [(j, n) for _, j, n in got[0]] == [(1, 1), (11, 2), (11, 3), (3, 4), (2, 5)]  # ties to the smaller id
    assert [j for _, j, _ in got[150]] == [10]  # fewer candidates: all
    for q, want in brute(rows).items():
        assert np.allclose([s for s, *_ in got[q]], [s for s, _ in want])


def test_empty(spark):
    assert run(spark, []) == {}


def test_recall_on_clusters_and_noise(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32))
    x = np.vstack([centres[rng.integers(0, 20, 1500)] + 0.5 * rng.standard_normal((1500, 32)), rng.standard_normal((1500, 32))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(ann, "SHARD_ROWS", 800)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 25)
    got, want = run(spark, rows), brute(rows)
    assert np.mean([len({j for _, j, _ in got[q]} & {j for _, j in want[q]}) / 5 for q in want]) >= 0.9


def test_recall_where_less_than_half_is_looked_at():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 64))
    for x in (rng.standard_normal((3000, 64)), centres[rng.integers(0, 30, 3000)] + 0.7 * rng.standard_normal((3000, 64))):
        x /= np.sqrt((x * x).sum(1))[:, None]
        looked, hits = [], []
        for q, c in zip(range(0, 3000, 50), ann.Forest(x).candidates(x[::50], int(ann.SHARE * len(x))), strict=True):
            best = np.argsort(-(x @ x[q]))[1:6]
            looked.append(len(c) / len(x))
            hits.append(np.isin(best, c).mean())
        assert np.mean(looked) < 0.5 and np.mean(hits) >= 0.9


def test_huge_and_tiny_components(spark):
    rows = [(i, [s * a, s * b, s]) for i, (a, b, s) in enumerate([(1.0, 2.0, 1e300), (1.0, 1.0, 1e300), (-1.0, 1.0, 1e200), (2.0, 1.0, 1e-300), (1.0, 0.0, 1.0), (0.5, 3.0, 1e-310)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in ann.nearest(df, df.filter("vec_id = 0")).collect()}
    one = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    want = {i: one[0] @ v / np.sqrt((one[0] @ one[0]) * (v @ v)) for i, v in one.items() if i}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, [float(i), 1.0, -1.0]) for i in range(300, 400)]
    got = run(spark, rows)
    assert [j for _, j, _ in got[50]] == [0, 1, 2, 3, 4] and [j for _, j, _ in got[0]] == [1, 2, 3, 4, 5]


def test_forest_ascends_until_enough():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 16))
    f = ann.Forest(x, trees=8, bits=10)
    sizes = [len(c) for c in f.candidates(x[:20], 50)]
    assert all(50 <= n <= 500 for n in sizes)
    assert all(k in c for k, c in enumerate(f.candidates(x[:20], 1)))  # its own string matches whole
    assert [len(c) for c in f.candidates(x[:3], 10_000)] == [500] * 3


def test_recall_on_the_table(spark):
    from tests.conftest import DATA

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(DATA.replace("0.001", "0.01") + "/embeddings.parquet").collect()]
    want = brute(rows)
    hits = [(r.query_id, r.vec_id) in {(q, j) for q in want for _, j in want[q]} for r in ann.op6(spark, DATA.replace("0.001", "0.01")).collect()]
    assert sum(hits) / (5 * len(want)) >= 0.9
