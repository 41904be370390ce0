"""Stems of known words, and searches of an index."""

from pyspark.sql import functions as F

from tests.test_outline import entries
from treeline.functions.stems import stem
from treeline.operators import fulltext

#: Words and their stems by the published rules.
STEMS = """consist consist consisted consist consistency consist consistently consist consign consign knackeries knackeri knightly knight
kneeling kneel national nation relational relat hopping hop hoping hope generally general generate generat communication communic sky sky
skies sky dying die happy happi flies fli ties tie cries cri by by say say cry cri enjoy enjoy agreed agre feed feed plastered plaster
bled bled motoring motor sing sing conflated conflat troubled troubl sized size falling fall hissing hiss fizzed fizz failing fail filing file
customers custom orders order ordering order lines line gas gas this this kiwis kiwi gaps gap inning inning proceed proceed rate rate
adjustable adjust defensible defens replacement replac adoption adopt formality formal sensitivity sensit vietnamization vietnam
hopefulness hope goodness good controlling control roll roll luxuriate luxuri yield yield boy boy exceedingly exceed news news ugly ugli
77 77 a1b a1b caf\u00e9s caf\u00e9s""".split()


def test_stems(spark):
    df = spark.createDataFrame(list(zip(STEMS[::2], STEMS[1::2], strict=True)), "w string, want string")
    assert [tuple(r) for r in df.withColumn("got", stem(F.col("w"))).filter("not want <=> got").collect()] == []


def test_search(spark, tmp_path):
    rows = [("a", None, 1, 0, "Ordering the customers"), ("b", None, 1, 1, "Customs of an order"), ("c", None, 1, 2, "orderly conduct"), ("d", None, 1, 3, ""), ("e", None, 1, 4, None), ("f", None, 1, 5, "order order 77"), ("f", None, 1, 5, "order again"), ("g", None, 1, 6, "\u00dcber 7712")]
    s = entries(spark, rows)
    s = type(s)(**{**vars(s), "entries": s.entries.withColumn("headline", F.when(F.col("id") == "b", F.lit("Customs")))})
    fulltext.write_index(fulltext.index(s), f"file://{tmp_path}/i")
    for p in (fulltext.index(s), fulltext.read_index(spark, f"file://{tmp_path}/i")):
        found = lambda text, n=None: [(r.entry_id, round(r.rank, 6)) for r in fulltext.search(p, text, n).orderBy(F.desc("rank"), "entry_id").collect()]  # noqa: B023, E731
        assert found("orders of a customer") == [("b", 1.8), ("a", 0.8)]  # the headline weighs more
        assert found("order 7") == [("f", 1.6)]
        assert found("77") == [("f", 0.4), ("g", 0.4)] and found("\u00dcber") == [("g", 0.4)]
        assert [i for i, _ in found("ORDERED", 2)] == ["f", "a"]
        assert found("the of") == found("") == found("order nothing") == []


def test_frequent_words_and_files_of_like_size(spark, tmp_path, monkeypatch):
    """Words above and below ``FREQUENT``; a stem that all entries have isn't one task's, nor one folder's share of a fixed number."""
    monkeypatch.setattr(fulltext, "FREQUENT", 5)
    s = entries(spark, [("x", None, 1, 0, "x")])
    many = spark.range(4000).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("Orders "), "id", F.when(F.col("id") < 3, " rarely").otherwise("")).alias("title"))
    e = s.entries.limit(0).drop("id", "title").join(many, F.lit(False), "right").select(s.entries.columns)
    postings = fulltext.index(type(s)(**{**vars(s), "entries": e}))
    count = lambda w: {r.entry_id for r in fulltext.search(postings, w).collect()}
    assert len(count("ordering")) == 4000 and count("rarely order") == {"e0", "e1", "e2"} and count("order 3999") == {"e3999"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        fulltext.write_index(postings.filter("stem = 'order'"), f"file://{tmp_path}/i")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = [r["count"] for r in spark.read.parquet(f"file://{tmp_path}/i").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 500
