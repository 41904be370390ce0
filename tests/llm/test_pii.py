import hashlib
import re

import pytest

from treeline.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None,
    "",
    "nothing here",
    "a@b.c_x@d.e and z@q.r.s@t.u a@b@c.d",
    "é😀 mail jo.doe+1@ex-ample.co.uk, 😀 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5.6.7.8.9",
    "cards 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111, 0000000000000000",
    "phones +1 (555) 555-1234, +49 30 12345678., +1 2, +1(555)5551234x +++1 555 555 1234",
    "000000255.1.1.1 999999999999.1.1.1 1.1.1.1@x.y",
    "4111 1111  1111 1111 +14111111111111111",
    "x" * 3000 + "@" + "y" * 3000 + ".z " + "1" * 5000 + "." * 50,
    "1.2.3.4 " * 400 + "\nline\ttab " + "+1 234 567 8901 ",
    "\x00 a@b.c \n+1\n2 555 123 4567",
]


def test_base_spans_are_those_of_plain_matching(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    from pyspark.sql import functions as F

    got = {r.id: [(s.start, s.kind, s.end) for s in r.s] for r in df.select("id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), t and t[:60]


@pytest.fixture(scope="module")
def corpus(spark):
    secret = "zarquon"
    rows = [(i, f"the common words {secret} mail me at boss@corp.example today the end", "x", "y") for i in range(4)]
    rows += [(i, f"the common words end today me at number {i} mail the rest", "x", "y") for i in range(10, 60)]
    rows += [(99, None, "x", None), (100, "", None, None), (4, rows[0][1], "x", "y"), (4, rows[0][1], "x", "y"), (None, rows[0][1], None, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, spans string")


def test_revealing_term_is_found_and_common_words_are_not(spark, corpus):
    got = pii.sanitise(corpus)
    r = got.filter("id = 1").first()
    text = corpus.filter("doc_id = 1").first().text
    terms = {text[s.start : s.end] for s in r.spans if s.kind == 4}
    assert "zarquon" in terms and not terms & {"the", "common", "words", "today", "me"}
    assert {s.kind for s in r.base} == {0}
    assert got.filter("id = 4").count() == 1  # repeated rows are reported once
    assert got.filter("id is null").count() == 1


def test_query_form(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op2(spark, str(tmp_path)).collect()
    assert len(got) == corpus.count()
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("term")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_email == len(base)
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)
    assert {r.spans for r in got if r.doc_id in (99, 100)} == {""}


def test_stage_takes_personal_data_out(spark):
    rows = [(1, "write to a@b.example or call +1 555 555 1234 now", "en", "s", 1), (2, "clean text stays", "en", None, 2), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pii.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "write to [email] or call [phone] now", 2: "clean text stays", 3: None}


def test_overlapping_spans_are_replaced_once(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("+1 4111111111111",)], "text string")
    out = df.select(pii.cleaned(F.col("text"), pii.base_spans(F.col("text"))).alias("t")).first().t
    assert out == "[phone]"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert pii.op2(spark, str(tmp_path)).count() == 0


def test_main_path_is_native(spark, corpus):
    plan = pii.sanitise(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _terms(got, texts):
    return {r.id: [texts[r.id][s.start : s.end] for s in r.spans if s.kind == 4] for r in got.collect()}


def test_names_beside_entities_that_stand_once_or_twice(spark):
    names = [a + b + c for a in ("bar", "mel", "tor", "vin") for b in ("a", "e", "o") for c in ("dok", "lim", "sun")]
    texts = {i: f"the common words of all, {n} reads mail at box{i}@corp.example or today the end" for i, n in enumerate(names)}
    texts |= {100 + i: texts[i] for i in range(10)}  # these stand twice
    texts |= {200 + i: f"clean the common words of all reads mail at or today the end {'oddxx' if i == 5 else ''}" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert _terms(pii.sanitise(docs), texts) == {i: [names[i % 100]] for i in texts if i < 200}
    out = {r.doc_id: r.text for r in pii.stage(spark, docs, "").collect()}
    assert all(out[i] == texts[i] for i in texts if i >= 200)
    assert not any(names[i % 100] in out[i] for i in texts if i < 200)


def test_rare_words_by_chance_stay(spark):
    """Near mentions there are as many rare words as elsewhere; only the name part tells."""
    texts = {i: f"common words with rare{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]} here" + (f" and jan.pohl@corp{i}.example, pohl" if i == 7 else f" mail 10.0.0.{i}" if i < 40 else "") for i in range(100)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i: t for i, t in _terms(pii.sanitise(docs), texts).items() if t} == {7: ["pohl"]}


def test_terms_count_and_go_in_whole_documents(spark):
    fill = "common words of all " * 12
    texts = {i: f"zarquon {fill} mail boss@corp.example {fill} zarquon" for i in range(4)}
    texts |= {i: f"{fill} mail boss@corp.example" for i in (10, 11)}
    texts |= {i: f"{fill} mail {i}" for i in range(20, 80)}
    docs = spark.createDataFrame(list(texts.items()) + [(3, texts[3])] * 5, "doc_id long, text string")
    got = _terms(pii.sanitise(docs), texts)
    assert got == {i: ["zarquon"] * 2 if i < 4 else [] for i in texts if i < 20}
    assert not any("zarquon" in r.text for r in pii.stage(spark, docs, "").collect())


def test_repeated_rows_keep_the_disclosure(spark):
    texts = {0: "zarquon mail boss@corp.example", 1: "zarquon mail a lot", **{i: f"mail and words {i}" for i in range(10, 30)}}
    docs = spark.createDataFrame([(0, texts[0])] * 9 + [(i, t) for i, t in texts.items() if i], "doc_id long, text string")
    assert _terms(pii.sanitise(docs), texts) == {0: ["zarquon"]}


def test_many_entities_in_one_text(spark):
    """In seconds, and with the spans of plain matching."""
    import time

    text = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}name{i} of user{i}@corp{i % 7}.example" for i in range(4000)) + " é" * 1000
    docs = spark.createDataFrame([(1, text), (2, "clean text of corp")] + [(i, f"name of {i}") for i in range(10, 30)], "doc_id long, text string")
    began = time.time()
    got = pii.sanitise(docs).filter("id = 1").first()
    assert [(s.start, s.kind, s.end) for s in got.base] == brute(text) and len(got.base) == 4000
    out = pii.stage(spark, docs.selectExpr("*", "'en' AS lang", "1 AS row", "2 AS _pii"), "").filter("doc_id = 1").first().text
    assert out.count("[email]") == 4000 and "@" not in out and out.endswith(" é" * 1000)
    assert time.time() - began < 120
