import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import language_id as li

EN = "the cat and the dog with the thing that was there "
DE = "der hund und die katze mit dem ding das dort war "


def frame(spark, rows, schema="doc_id long, text string, lang string, score string"):
    return spark.createDataFrame(rows, schema)


def test_codewords_differ():
    for n in (2, 3, 4, 7, 8, 40):
        code = li.codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert (np.abs(code.sum(0)) < n).all()


def test_decoding_corrects_a_wrong_bit():
    code = li.codewords(4)
    margins = 2.0 * code[2:3].copy()
    margins[0, 0] *= -0.5
    assert li.decode(margins, code).argmax() == 2


def test_decoding_flags_a_tie():
    code = li.codewords(2)
    p = li.decode(np.zeros((1, code.shape[1])), code)
    assert abs(p[0, 0] - p[0, 1]) < 1e-9


def test_whole_text_is_read():
    long = EN * 3 + "x" * (li.PIECE + 10)
    assert not np.allclose(li.features([long]), li.features([long[:100]]))
    whole = np.frombuffer(long.encode(), np.uint8)
    assert len(whole) > li.PIECE


def test_pieces_count_as_one_text(monkeypatch):
    one = li.features([EN * 20])
    monkeypatch.setattr(li, "PIECE", 64)
    assert np.allclose(one, li.features([EN * 20]), atol=1e-6)


def test_predictions(spark):
    train = [(i, (EN if i % 2 else DE) * (1 + i % 5), "en" if i % 2 else "de", None) for i in range(40)]
    model = li.Model.train(frame(spark, train))
    odd = [(1, None, "en", "a"), (2, "", None, "b"), (3, "123 !?", "de", None), (4, EN, None, None), (4, EN, None, None), (None, DE, None, None), (5, DE * 20000, None, None)]
    got = model.predict(frame(spark, odd)).collect()
    assert len(got) == 7
    by = [(r.doc_id, r.lang_pred) for r in got]
    assert by == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, "de")]
    assert all(0 <= r.score <= 1 for r in got) and [r.score for r in got[:3]] == [0, 0, 0]
    assert "score" in got[0].asDict() and isinstance(got[0].score, float)  # replaces a column of that name


def test_nothing_to_learn_from(spark):
    empty = frame(spark, [])
    model = li.Model.train(empty)
    assert [r.lang_pred for r in model.predict(frame(spark, [(1, EN, None, None)])).collect()] == ["und"]
    assert model.predict(empty).count() == 0


def test_one_language(spark):
    model = li.Model.train(frame(spark, [(1, EN, "en", None)]))
    assert [r.lang_pred for r in model.predict(frame(spark, [(1, DE, None, None)])).collect()] == ["en"]


def test_sample_is_bounded(spark):
    train = frame(spark, [(i, (EN if i % 2 else DE), "en" if i % 2 else "de", None) for i in range(400)])
    model = li.Model.train(train, rows=20)
    assert model.langs == ["de", "en"] and 0 < model.rows <= 40
    same = frame(spark, [(1, EN, "en", None)] * 300 + [(None, DE, "de", None)] * 300)
    assert li.Model.train(same, rows=20).rows <= 40


def test_held_out_accuracy(spark):
    from tests.conftest import DATA

    got = li.op1(spark, DATA.replace("0.001", "0.01")).filter("held_out").join(spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_stage_drops_what_has_no_language(spark):
    docs = spark.createDataFrame([(i, EN if i % 2 else DE, "en" if i % 2 else "de", "s", 3) for i in range(30)] + [(90, None, "en", "s", 0), (91, "12 34", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = li.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(30))


if __name__ == "__main__":
    pytest.main([__file__])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("der die das und nicht", "de"), ("the and of to is", "en")] * 20)], "doc_id long, text string, lang string")
    odd = docs.selectExpr("*", "true AS _has_letter", "1 AS _has_letter_", "'x' AS lang_pred", "2 AS k", "3 AS h", "4 AS x", "5 AS id")
    assert li.stage(spark, odd, "").columns == odd.columns
