"""Parsing, printing, rules, functions."""

import pytest
from pyspark.sql import functions as F

from treeline.functions import scalars as fn
from treeline.model import SCHEMAS, Store
from treeline.operators import lint, similarity, stats, sync, tags, tree
from treeline.sinks import graph, site, text
from treeline.sources import outline_text

DOC = """#+title: My File
#+filetags: :todo:
preamble
* TODO [#A] (ctx) Call: the title {here}   :x:y:
SCHEDULED: <2024-01-02 Tue 10:30-11:00 +1w> DEADLINE: <2024-02-30 Fri>
:PROPERTIES:
:ID: 4f1c
:CATEGORY: veryverylongcategory
:END:
- State "DONE"       from "TODO"       [2024-01-03 Wed 09:00]
- State "TODO"       from              [2024-01-04 Thu 09:00]
:LOGBOOK:
CLOCK: [2024-01-02 Tue 10:00]--[2024-01-02 Tue 11:30] =>  1:30
:END:
body line with [[https://x.example/a][desc]] and [[id:zz]]
second line

:END:
*** skipped level  with double space
**************** inline
* DONE next
"""


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([("a.org", DOC), ("b.org", ""), ("c.org", "no heading\n\n"), ("d.png", None)], "path string, content string")
    return outline_text.parse(files)


def test_headings(parsed):
    e = {r.title: r for r in parsed.store.entries.collect()}
    r = e["the title"]
    assert (r.id, r.keyword_value, r.keyword_type, r.priority, r.context, r.verb, r.locator, r.depth) == ("4f1c", "TODO", "open", "A", "ctx", "Call", "here", 1)
    child = e["skipped level  with double space"]
    assert child.depth == 3 and e["next"].keyword_type == "closed" and e["next"].position == 1
    assert len(e) == 3 and parsed.store.files.count() == 3
    assert {t.tag for t in parsed.store.entry_tags.collect()} == {"x", "y"}


def test_ids_are_the_same_in_every_run(spark, parsed):
    again = outline_text.parse(spark.createDataFrame([("a.org", DOC)], "path string, content string"))
    assert {r.id for r in again.store.entries.collect()} == {r.id for r in parsed.store.entries.collect()}


def test_stamps_logs_and_errors(parsed):
    s = parsed.store
    (t,) = s.entry_stamps.collect()
    assert (t.stamp_type, t.time_kind, t.day, t.time_start, t.time_end, t.suffix) == ("scheduled", "active", 60311, 630, 660, "+1w")
    log = {(r.log_type, r.to_keyword): r for r in s.entry_log_entries.collect()}
    assert log["state", "DONE"].from_keyword == "TODO" and log["state", "TODO"].from_keyword is None
    clock = log["clock", None]
    assert clock.duration_minutes == 90 and clock.logbook_id and clock.time_start == 600
    assert sorted(r.message.split(":")[0] for r in parsed.errors.collect()) == ["heading skips a level", "no such time"]


def test_body_links_and_file(parsed):
    s = parsed.store
    blocks = s.entry_body_blocks.filter("entry_id = '4f1c'").orderBy("position").collect()
    assert blocks[0].content.startswith("body line") and blocks[0].content.endswith("second line") and blocks[1].block_type == "whitespace"
    assert {(r.link_type, r.target, r.description) for r in s.entry_links.collect()} == {("https", "https://x.example/a", "desc"), ("id", "zz", None)}
    assert {(r.name, r.value) for r in s.file_properties.collect()} == {("title", "My File"), ("filetags", ":todo:")}
    assert {r.title for r in s.files.collect()} == {"My File", None}


def test_rules(parsed):
    m = {(r.code, r.arg) for r in lint.lint(parsed.store).collect()}
    codes = {c for c, _ in m}
    assert {"CategoryTooLong", "DanglingIdLink", "MisplacedDrawerEnd", "MixedLogbook", "StateChangeLast", "TitleDoubleSpace", "FileTitleMissing"} <= codes
    assert ("CategoryTooLong", "veryverylongcategory") in m and ("DanglingIdLink", "zz") in m
    assert ("MixedLogbook", None) in m and "TodoMismatch" not in codes
    assert all(r.severity in ("WARN", "ERROR") for r in lint.lint(parsed.store, level="WARN").collect())
    lines = [r.line for r in lint.render(lint.lint(parsed.store), parsed.store).collect()]
    assert any(x.startswith("a.org:4f1c: WARN CategoryTooLong") for x in lines)


def shaped(df, name):
    cols = [c.strip().split(" ", 1) for c in SCHEMAS[name].split(",")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in cols])


def empty_store(spark, **given):
    return Store(**{n: given.get(n, spark.createDataFrame([], s)) for n, s in SCHEMAS.items()})


def test_state_changes(spark):
    rows = [("1", 2, 10, None, "TODO"), ("2", 1, 9, "TODO", "TODO"), ("3", 0, 11, "DONE", "WAIT")]
    logs = shaped(spark.createDataFrame(rows, "id string, position int, time_day int, from_keyword string, to_keyword string").selectExpr("*", "'e' AS entry_id", "'state' AS log_type", "5 AS time_start"), "entry_log_entries")
    entries = [("e", "f", None, 1, 0, None, "open", "TODO", None, "t", "t", None, None, None, None, ["e"])]
    s = empty_store(spark, entry_log_entries=logs, entries=spark.createDataFrame(entries, SCHEMAS["entries"]))
    codes = sorted(r.code for r in lint.lint(s).filter("code like 'State%'").collect())
    assert codes == ["StateChangeIdempotent", "StateChangeIntermediate", "StateChangeLast", "StateChangeTimeOrder"]
    assert lint.lint(empty_store(spark)).count() == 0


def test_round_trip(spark, parsed):
    printed = text.file_texts(parsed.store)
    again = outline_text.parse(printed)
    cols = ["id", "depth", "keyword_value", "priority", "title", "context", "verb", "locator"]
    assert sorted(map(str, again.store.entries.filter("depth = 1").select(cols).collect())) == sorted(map(str, parsed.store.entries.filter("depth = 1").select(cols).collect()))


def test_rules_about_files_and_hashes(spark):
    files = [("f", "d/20240101-a.org", "a", None, None, None, None), ("g", "d/b.org", "b", None, None, None, None)]
    fp = [("f", "CREATED", "[2024-01-02 Tue]", "file", 0), ("g", "Effort", "1", "file", 0), ("g", "ARCHIVE", "gone.org::", "drawer", 1)]
    e = [("e", "f", None, 1, 0, None, None, None, None, "t", "t", None, None, None, None, ["e"]), ("h", "g", None, 1, 0, None, None, None, None, "t", "t", None, None, None, None, ["h"])]
    props = [("e", "ARCHIVE", "b.org::x", 0), ("e", "AUDIO", "a.mp3", 1), ("e", "HASH_sha512", "0", 2)]
    blocks = [("e", 0, "paragraph", "x", None)]
    make = lambda n, rows: spark.createDataFrame(rows, SCHEMAS[n])
    s = empty_store(spark, files=make("files", files), file_properties=make("file_properties", fp), entries=make("entries", e), entry_properties=make("entry_properties", props), entry_body_blocks=make("entry_body_blocks", blocks))
    got = {(r.code, r.arg) for r in lint.lint(s).collect()}
    assert {("CreationTimeMismatch", "20240102"), ("ReviewOnFile", "Effort"), ("ArchiveMissing", "gone.org"), ("AudioMissing", "a.mp3"), ("HashMismatch", "0"), ("FileCreatedMissing", None)} <= got
    assert ("ArchiveMissing", "b.org") not in got


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("given,want", [("Hello World", "hello-world"), ("what's up?", "whats-up"), ("a__b__c", "a-b-c"), ("   hi   ", "hi"), ("Él Café", "él-café"), ("", "")])
def test_slug(spark, given, want):
    assert col(spark, given, fn.slug) == want


@pytest.mark.parametrize(
    "name,want",
    [
        ("foo.org", (None, "foo", None, "org")),
        ("20240601-foo.org", ("20240601", "foo", None, "org")),
        ("20240601foo-.org", ("20240601", "foo-", None, "org")),
        ("20240601-foo [a b].org", ("20240601", "foo", ["a", "b"], "org")),
        ("20240601[a b].org", ("20240601", "", ["a", "b"], "org")),
        ("20240601-foo -- a b.org", ("20240601", "foo", ["a", "b"], "org")),
        ("20240601--foo bar.org", ("20240601", "-foo bar", None, "org")),
        ("20240601 -- a b.org", ("20240601", "", ["a", "b"], "org")),
        ("-foo", (None, "-foo", None, None)),
    ],
)
def test_file_names(spark, name, want):
    r = col(spark, name, fn.file_name_parts)
    assert (r.date, r.slug, r.tags, r.ext) == want


def test_chunks(spark):
    n = 20
    assert col(spark, "  \n ", lambda c: fn.chunks(c, n)) == []
    assert col(spark, "short", lambda c: fn.chunks(c, n)) == ["short"]
    assert col(spark, "aaaa\n\nbbbb\n\ncccccccccccc\n\nd", lambda c: fn.chunks(c, n)) == ["aaaa\n\nbbbb", "cccccccccccc\n\nd"]
    assert col(spark, "x" * 45 + "\nyy\nzz\n\nend", lambda c: fn.chunks(c, n)) == ["x" * 20, "x" * 20, "x" * 5, "yy\nzz", "end"]


def test_times(spark):
    assert col(spark, "202401021030", fn.compact_time)[:] == (60311, 630)
    assert col(spark, "20240102103059", fn.compact_time)[:] == (60311, 630)
    assert col(spark, "20240102", fn.compact_time)[:] == (60311, None)
    for bad in ("2024010", "20240230", "x"):
        assert col(spark, bad, fn.compact_time) is None
    assert col(spark, 65, fn.show_duration, "int") == " 1:05"
    assert col(spark, "on <2024-01-02 Tue>", fn.iso_date) == "2024-01-02"
    assert col(spark, 60311, lambda c: fn.show_time(c, F.lit(630), F.lit(660), F.lit(True), F.lit("+1w")), "int") == "<2024-01-02 Tue 10:30-11:00 +1w>"


def test_text_functions(spark):
    assert col(spark, 'a,"b"', fn.csv_field) == '"a,""b"""'
    assert col(spark, "ab\ncd", lambda c: fn.line_and_column(c, F.lit(4)))[:] == (2, 2)
    assert col(spark, "<p>a b<!--more-->c</p>", fn.teaser) == "a b"
    assert col(spark, "--", fn.path_label) == "__" and col(spark, "é", fn.path_label) == "x"
    assert col(spark, ["a", "b"], fn.tag_string, "array<string>") == "::a:b:"
    assert col(spark, [0.0, 0.0], lambda c: fn.cosine_distance(c, c), "array<float>") is None


def test_tags(spark):
    items = spark.createDataFrame([("d/i", ["a", "b", "c", "a"]), ("j", []), ("k", None)], "item string, tags array<string>")
    assert tags.combinations(items, 3).count() == 3 + 6 + 6
    assert {r.link for r in tags.tag_tree_links(items, "t", 1).collect()} == {"t/a/i", "t/b/i", "t/c/i"}
    e = tags.all_of(tags.var("a"), tags.no(tags.var("z")))
    assert [r.item for r in tags.matching(items, e).collect()] == ["d/i"]


def test_loading_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", "1", "old"), ("b", "2", "old"), ("c", "3", "old")], "id string, hash string, v string")
    new = spark.createDataFrame([("a", "1", "new"), ("b", "9", "new"), ("d", "4", "new")], "id string, hash string, v string")
    assert {(r.id, r.action) for r in sync.diff_entries(new, old).collect()} == {("b", "update"), ("c", "delete"), ("d", "insert")}
    after = sync.apply_diff(old, new)
    assert {(r.id, r.v) for r in after.collect()} == {("a", "old"), ("b", "new"), ("d", "new")}
    assert sync.diff_entries(new, after).count() == 0


def test_clusters(spark):
    p = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.3), (8, 9, 0.2)], "a long, b long, distance double")
    assert {tuple(r) for r in similarity.clusters(p).collect()} == {(1, 1, 0.1), (2, 1, 0.1), (3, 1, 0.3), (8, 8, 0.2), (9, 8, 0.2)}


def test_paths_of_orphans_and_cycles(spark):
    e = spark.createDataFrame([("a", None), ("b", "a"), ("o", "gone"), ("x", "y"), ("y", "x")], "id string, parent_id string")
    assert {(r.id, tuple(r.path)) for r in tree.build_paths(e).collect()} == {("a", ("a",)), ("b", ("a", "b"))}


def test_store_on_disk(spark, tmp_path, parsed):
    parsed.store.write(str(tmp_path))
    again = Store.read(spark, str(tmp_path))
    assert stats.scalars(again).collect() == stats.scalars(parsed.store).collect()
    assert graph.relations(again).count() == graph.relations(parsed.store).count()


def test_pages_of_few_posts(spark):
    p = spark.sql("select id, array('s', 'publish') tags, date_add(date'2024-01-01', cast(id as int)) date from range(8)")
    got = site.pages(p).collect()
    assert [r.page for r in got] == [1] * 6 + [2] * 2 and got[0].id == 7 and got[0].next == 2 and got[-1].is_last


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.org").write_text("* x é\n")
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in outline_text.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.org": "* x é\n", "b.png": None}
