import math

import pytest
from pyspark.sql import functions as F

from treeline.llm import mixing as mx


def targets_of(sizes):
    """Water filling by the rule as it is worded."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    out, open_ = {}, set(order)
    while True:
        left = total - sum(out.values())
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_} if w else {}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.remove(s)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS rate", "'a' AS skey", "3 AS copies")
    return mx.mix(df)


def documents(counts, words):
    rows, i = [], 0
    for source, n in counts.items():
        for k in range(n):
            rows.append((i, source, "w " * words(k)))
            i += 1
    return rows


@pytest.mark.parametrize("counts", [{"a": 100, "b": 100, "c": 100, None: 100}, {"a": 10, "b": 300, "é": 40, "z": 5, None: 2}, {"only": 50}])
def test_targets_and_words_taken(spark, counts):
    rows = documents(counts, lambda k: 1 + (k * 37) % 97)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets_of(sizes)
    got = run(spark, rows)
    assert got.count() == len(rows)
    by = {(None if r.skey == "1" else r.skey[1:]): r for r in got.groupBy("skey").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("n"), F.max("copies").alias("most")).collect()}
    for s in counts:
        assert by[s].n == sizes[s] and math.isclose(by[s].target, want[s], rel_tol=1e-9)
        assert abs(by[s].taken - by[s].target) <= 0.01 * by[s].target + 1
        assert by[s].most <= 2


def test_rates_are_exponential_in_the_size(spark):
    got = run(spark, documents({"a": 60, "b": 600, "c": 600}, lambda k: 1 + k % 50)).select("skey", "size", "rate").distinct().collect()
    for key in {r.skey for r in got}:
        slopes = {round(math.log(r.rate) / r.size, 9) for r in got if r.skey == key and r.rate < 2}
        assert len(slopes) <= 1


def test_reruns_agree(spark):
    rows = documents({"a": 50, "b": 90, "c": 400}, lambda k: 1 + (k * 13) % 31)
    once = sorted(map(tuple, run(spark, rows).collect()))
    assert once == sorted(map(tuple, run(spark, rows[::-1]).collect()))


def test_odd_documents(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "a", " \n\t"), (4, "a", "x y z"), (4, "a", "x y z"), (None, None, "x y"), (5, None, "x " * 50_000), (6, "b", "é ñ\u00a0w")]
    got = {(r.id, r.size): r for r in run(spark, rows).collect()}
    assert got[(1, 0)].copies == got[(2, 0)].copies == got[(3, 0)].copies == 1
    assert got[(4, 3)].source_size == 6 and (6, 2) in got and (5, 50_000) in got
    assert run(spark, []).count() == 0
    assert run(spark, [(1, "a", None)]).first().target == 0


def test_hot_source_of_equal_sizes(spark, monkeypatch):
    monkeypatch.setattr(mx, "SHARD", 20)
    rows = documents({"a": 900, "b": 50, "c": 50}, lambda k: 7)
    got = run(spark, rows).groupBy("skey").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("t")).collect()
    assert all(abs(r.taken - r.t) <= 7 for r in got)


def test_stage_repeats_documents(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "ab"[i % 2], i) for i in range(80)] + [(500, "same words", "en", "a", 1)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mx.stage(spark, docs, "")
    assert out.columns == docs.columns
    counted = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r.id: r.c for r in mx.mix(docs).groupBy("id").agg(F.sum("copies").alias("c")).collect() if r.c}
    assert counted == want


def test_query(spark):
    from tests.conftest import DATA

    got = mx.op7(spark, DATA)
    assert got.filter("taken > 2 * size").count() == 0
    for r in got.groupBy("target", "source_size").agg(F.sum("taken").alias("t")).collect():
        assert abs(r.t - r.target) <= 0.05 * r.target
