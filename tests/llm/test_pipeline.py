import re

import corpus_pipeline as cp
from tests.conftest import DATA
from treeline.llm.common import components, materialize, table


def test_stages_by_brute_force(spark):
    from tests.llm.test_ngram_join import brute
    from tests.llm.test_pii import brute as spans

    docs = table(spark, DATA, "documents")
    kept = [docs]
    for _, stage in cp.STAGES:
        kept.append(materialize(stage(spark, kept[-1], DATA), "test"))
    start, known, unique, clean, mixed, encoded = kept
    assert all(k.columns == docs.columns for k in kept[:5])
    letters = {r.doc_id for r in start.collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert sorted(r.doc_id for r in known.collect()) == sorted(letters)
    groups = brute([(r.doc_id, r.text) for r in known.collect()])
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, _, c in groups if i == c)
    before = {r.doc_id: r for r in unique.collect()}
    for r in clean.collect():
        assert not spans(r.text)
        if not spans(before[r.doc_id].text):
            assert r == before[r.doc_id]
    ids = [r.doc_id for r in mixed.collect()]
    assert set(ids) <= set(before) and max(map(ids.count, ids)) <= 2
    assert sorted(r.doc_id for r in encoded.collect()) == sorted(ids)
    assert encoded.filter("not parity or not round_trip").count() == 0


def test_run_gives_the_last_stage(spark):
    assert [n for n, _ in cp.STAGES][0] == "language ID" and len(cp.STAGES) == 5
    assert "ids" in cp.run(spark, DATA).columns


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, label long, size long"
    text = "some words of a text that is long enough to have shingles " * 3
    rows = [(i, f"{text} {i} " + "und der die das " * (i % 3), "en" if i % 3 else "de", "s", 9, "x", 1, 1) for i in range(12)]
    rows += [(50, text, "en", None, None, None, None, None)] * 3 + [(None, text + "more", None, None, None, None, None, None), (51, None, None, None, None, None, None, None), (52, "", None, None, 0, None, None, None)]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "odd/documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
    got = cp.run(spark, str(tmp_path / "odd")).collect()
    assert got and not {r.doc_id for r in got} & {51, 52} and all(r.parity and r.round_trip for r in got)
    assert max(sum(x.doc_id == r.doc_id for x in got) for r in got) <= 2


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), (2, 1)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 260)]
    got = {r.node: r.label for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got[3] == 1 and got[9] == 7 and got[159] == 100 and got[260] == 200 and len(got) == 3 + 3 + 60 + 61
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
