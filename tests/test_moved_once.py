"""Rows that a join needs are moved once, and only those that are asked for."""

from dataclasses import replace

from tests.test_outline import entries
from treeline.operators import stats, tree
from treeline.sinks import text

ROWS = [("a", None, 1, 0, "A"), ("b", "a", 2, 0, "B"), ("c", "b", 3, 0, "C"), ("c", "b", 3, 0, "C"), ("c", "b", 3, 1, "D"), ("z", None, 1, 1, "Z"), ("y", "z", 2, 0, "Y")]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def plain(spark, rows=ROWS):
    above = {i: p for i, p, *_ in rows}
    path = lambda i: path(above[i]) + [i] if i else []
    s = entries(spark, rows)
    p = spark.createDataFrame([(i, path(i)) for i in above], "id string, path array<string>")
    e = s.entries.drop("path").join(p, "id").select(s.entries.columns)
    return replace(s, entries=e.localCheckpoint())


def test_breadcrumbs_of_some_entries(spark):
    s = plain(spark)
    want = {("b", "A"), ("c", "A > B"), ("y", "Z")}
    assert sorted((r.entry_id, r.breadcrumb) for r in tree.breadcrumbs(s).collect()) == sorted(want)
    assert [tuple(r) for r in tree.breadcrumbs(s, s.entries.filter("id = 'c'")).collect()] == [("c", "A > B")]
    hits = s.entries.filter("id in ('c', 'z')").select("id").distinct()
    got = text.search_rows(hits, s).collect()
    assert sorted(r.line.split(":0 ")[1] for r in got) == ["A > B > C", "A > B > D", "Z"]
    twice = entries(spark, [("p", None, 1, 0, "T"), ("q", None, 1, 0, "T")])
    one = spark.createDataFrame([("x", ["p", "x"]), ("x", ["q", "x"]), ("x", ["q", "x"])], "id string, path array<string>")
    e = twice.entries.unionByName(one, allowMissingColumns=True)
    assert [r.breadcrumb for r in tree.breadcrumbs(replace(twice, entries=e)).collect()] == ["T > T"]
    assert [r.text.strip() for r in stats.combined_text(replace(twice, entries=e)).filter("entry_id = 'x'").collect()] == ["T > T"]


def test_exchanges(spark):
    s = plain(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(tree.any_property(s, "TITLE")) <= 2
        assert shuffles(stats.combined_text(s)) <= 3
        assert shuffles(tree.breadcrumbs(s)) <= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.id, r.value) for r in tree.any_property(s, "PRIORITY").collect()) == []
    assert sorted((r.id, r.value) for r in tree.any_property(s, "TITLE").collect()) == [("a", "A"), ("b", "B"), ("c", "C"), ("c", "D"), ("y", "Y"), ("z", "Z")]
    assert sorted((r.entry_id, r.text) for r in stats.combined_text(s).filter("entry_id in ('c', 'y')").collect()) == [("c", "A > B\nC D"), ("y", "Z\nY")]


def test_preorder_moves_entries_once(spark):
    s = plain(spark)
    assert shuffles(tree.preorder(s.entries)) == 1
    want = {("a", 0), ("b", 1), ("c", 2), ("z", 3), ("y", 4)}
    assert {(r.id, r.preorder) for r in tree.preorder(s.entries).collect()} == want
    # a step that isn't in the file is passed over, also at the end of a path that lacks the entry itself
    odd = spark.createDataFrame([("p", ["gone", "p"], 3), ("q", ["p"], 1), ("r", ["gone"], 0), ("t", None, 0), ("v", ["q", "v"], None)], "id string, path array<string>, position int")
    got = tree.preorder(odd.selectExpr("'f' AS file_id", "*")).collect()
    assert {(r.id, r.preorder) for r in got} == {("v", 0), ("p", 1), ("q", 2)}


def test_printed_entries_are_moved_once_by_file(spark):
    s = plain(spark)
    assert text.entry_rows(s)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(file_id") == 1
    got = text.entry_rows(s).filter("file_id is not null").orderBy("file_id", "key").collect()
    heads = [r.text.split("\n")[0] for r in got if not r.text.startswith(("* Z", "** Y"))]
    assert heads == ["* A", "** B", "*** C", "*** C", "*** D"]


def test_nothing_is_told_apart_before_it_is_moved(spark):
    """An aggregation of ids below an exchange would hold those of a whole split of the input."""
    from treeline.operators import lint
    from treeline.sinks import graph
    from treeline.sources import testbed

    s = testbed.store(spark, "/root/testdata/sf0.001")
    for df in (graph.relations(s), lint.lint(s, codes=("TodoMissingId",)), lint.lint(s, codes=("DuplicateIdentifier",)), lint.lint(s, codes=("DuplicateTag",))):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        below = [b for a, b in zip(plan, plan[1:]) if "Exchange hashpartitioning" in a]
        assert below and not [x for x in below if "HashAggregate" in x]
    orphan = plain(spark, ROWS)
    lost = spark.createDataFrame([("gone", 0, "id", "a", None), ("b", 0, "id", "A", None), ("b", 1, "id", "a", None)], "entry_id string, position int, link_type string, target string, description string")
    got = graph.edges(replace(orphan, entry_links=lost))
    assert sorted((r.source, r.target) for r in got.collect()) == [("a", "b"), ("b", "a"), ("b", "c"), ("z", "y")]


def test_files_are_parsed_where_their_lines_were_moved(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F
    from treeline.sources import lines, outline_text

    f = spark.createDataFrame([("a", "* A\n:PROPERTIES:\n:ID: a\n:END:\nx\n** B\ny"), ("b", "z\n* C\n")], "path string, content string")
    pieces = lines.file_pieces(f)
    x = lines.number(pieces, F.transform("lines", outline_text.note_shape), True)
    assert shuffles(x.withColumn("k", F.row_number().over(W.partitionBy("path", "owner").orderBy("n")))) == 1
    only = lines.number(pieces, F.transform("lines", outline_text.note_shape), True, f.select("path").filter("path = 'b'"))
    assert sorted((r.n, r.line, r.owner, r.offset) for r in only.collect()) == [(0, "z", -1, 0), (1, "* C", 1, 2)]
    assert dict(x.dtypes) == dict(lines.number(pieces, F.transform("lines", outline_text.note_shape), False).dtypes)


def test_logs_are_moved_with_their_notes(spark):
    s = plain(spark)
    log = [("l0", "a", 0, "note", "inactive", 51000), ("l1", "a", 1, "note", "inactive", 51001), ("l2", "b", 0, "note", "inactive", 51002)]
    notes = [("l1", "a", 0, 1, "paragraph", "more"), ("l1", "a", 0, 0, "paragraph", "said\n- State \"X\""), ("l2", "b", 0, 0, "paragraph", None)]
    log = spark.createDataFrame(log, "id string, entry_id string, position int, log_type string, time_kind string, time_day int")
    notes = spark.createDataFrame(notes, "log_id string, entry_id string, log_position int, position int, block_type string, content string")
    empty = s.entry_log_entries.limit(0)
    s = replace(s, entry_log_entries=empty.unionByName(log, allowMissingColumns=True), entry_log_bodies=notes)
    got = text.log_texts(s)
    assert shuffles(got) == 1
    assert {r.id: r.logs.replace("[1998-0", "").count("\n") for r in got.collect()} == {"a": 4, "b": 1}
    assert [r.logs.split("\n")[2:] for r in got.filter("id = 'a'").collect()] == [["  said", '  ,- State "X"', "  more"]]


def test_summaries_move_what_an_entry_has_once(spark):
    s = plain(spark)
    tags = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("gone", "x")], "entry_id string, tag string")
    props = spark.createDataFrame([("a", "P", "2", 1), ("a", "Q", "1", 0)], "entry_id string, name string, value string, position int")
    body = spark.createDataFrame([("c", 0, "paragraph", "ab\nc"), ("c", 1, "paragraph", None)], "entry_id string, position int, block_type string, content string")
    s = replace(s, entry_tags=tags, entry_properties=props, entry_body_blocks=body)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(text.summary(s)) <= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = sorted((r.id, [x for x in r.line.split("\n") if not x.startswith(":FILE:")]) for r in text.summary(s).collect())
    assert [x for x in got if x[0] == "a"] == [("a", ["* A", ":PROPERTIES:", ":Q: 1", ":P: 2", ":TAGS: :x:y:", ":END:"])]
    assert [x for x in got if x[0] == "c"] == [("c", ["*** C", ":PROPERTIES:", ":BODY_LEN: 3", ":END:"]), ("c", ["*** D", ":PROPERTIES:", ":BODY_LEN: 3", ":END:"])]


def test_documents_take_entries_in_as_json(spark):
    from treeline.sources import documents

    s = plain(spark)
    files = spark.createDataFrame([(f, f"{f}.org") for f in sorted({r.file_id for r in s.entries.select("file_id").distinct().collect()} | {"none"})], "id string, path string")
    s = replace(s, files=s.files.limit(0).unionByName(files, allowMissingColumns=True))
    got = documents.documents(s)
    plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    below = [b for a, b in zip(plan, plan[1:]) if "Exchange hashpartitioning(_key" in a]
    assert below and all("StructsToJson" in x and "Aggregate" not in x for x in below)
    again = documents.from_documents(got)
    assert again.files.count() == files.count()
    assert sorted(map(str, again.entries.select("id", "title", "path").collect())) == sorted(map(str, documents.unique_entries(s.entries).select("id", "title", "path").collect()))


def test_rules_move_what_an_entry_has_once_and_only_what_they_look_into(spark):
    from treeline.operators import lint

    s = plain(spark)
    tags = spark.createDataFrame([("a", "x"), ("a", "x"), ("gone", "LINK"), (None, "y"), (None, "y")], "entry_id string, tag string")
    props = spark.createDataFrame([("a", "Created", "1", 0), ("b", "p", "1", 0), ("b", "P", "1", 1)], "entry_id string, name string, value string, position int")
    stamps = spark.createDataFrame([("c", "scheduled", 1), ("c", "closed", 1), ("z", "active", 1)], "entry_id string, stamp_type string, day int")
    kinds = spark.createDataFrame([("a", "k", True), ("z", "k", True), ("c", "k", False)], "entry_id string, category string, is_explicit boolean")
    stamps = s.entry_stamps.limit(0).unionByName(stamps, allowMissingColumns=True)
    s = replace(s, entry_tags=tags, entry_properties=props, entry_stamps=stamps, entry_categories=kinds)
    codes = ("DuplicateIdentifier", "TodoMissingCreated", "TodoMissingId", "DuplicateTag", "DuplicateProperty", "StampOnPlainEntry", "ReviewOnPlainEntry", "TaskWithoutTags")
    got = lint.lint(s, codes=codes)
    assert shuffles(got) == 1
    assert sorted((r.code, r.entry_id or "", r.arg) for r in got.filter("entry_id <> 'c' or entry_id is null").collect()) == [
        ("DuplicateProperty", "b", "p"), ("DuplicateTag", "", "y"), ("DuplicateTag", "a", "x"), ("TodoMissingCreated", "z", None), ("TodoMissingId", "a", None), ("TodoMissingId", "z", None),
    ]
    assert sorted((r.code, r.arg) for r in got.filter("entry_id = 'c'").collect()) == [("DuplicateIdentifier", "3")] + 3 * [("StampOnPlainEntry", None)]
    # no links, hashes, lists of tags or verbs, notes or bodies that begin or end with white space: nothing is moved to look for them
    for code in ("HashMismatch", "TagNotAllowed", "VerbNotAllowed", "BrokenFileLink", "ArchiveMissing", "AudioMissing", "InconsistentBodySpace", "InconsistentWhitespace"):
        none = lint.lint(s, codes=(code,))
        assert (code, shuffles(none)) == (code, 0) and none.count() == 0


def below_exchanges(df, key):
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [b for a, b in zip(plan, plan[1:]) if f"Exchange hashpartitioning({key}" in a]


def test_headings_are_not_moved_by_id_to_be_printed(spark):
    from treeline.sources import testbed

    s = plain(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        below = below_exchanges(text.entry_rows(s), "id#")
        assert below and not [x for x in below if "title" in x or "path" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the window over a customer's orders moves their columns, not what is made of them
    below = below_exchanges(testbed.store(spark, "/root/testdata/sf0.001").entries, "o_custkey#")
    assert below and not [x for x in below if "concat_ws" in x]


def test_what_hangs_on_shared_ids_is_written_with_each(spark):
    """Rows of an id in two files, at two depths and as an inline task; paths that don't end in the entry."""
    s = plain(spark)
    rows = [("f", "a", 1, 0, "A", ["a"]), ("f", "a", 1, 1, "A2", ["a"]), ("g", "a", 2, 0, "A3", ["gone", "a"]), ("g", "b", 1, 0, "B", ["b"]), ("f", "b", 15, 0, "B2", None)]
    e = spark.createDataFrame(rows, "file_id string, id string, depth int, position int, title string, path array<string>")
    tags = spark.createDataFrame([("a", "x"), ("b", "y"), ("gone", "z")], "entry_id string, tag string")
    task = spark.createDataFrame([("a", 0, "inline_task", "b"), ("a", 1, "paragraph", "below")], "entry_id string, position int, block_type string, content string")
    s = replace(s, entries=s.entries.limit(0).unionByName(e, allowMissingColumns=True), entry_tags=tags, entry_body_blocks=s.entry_body_blocks.limit(0).unionByName(task, allowMissingColumns=True))
    got = [(r.file_id, " ".join(r.text.split("\n")[0].split())) for r in text.entry_rows(s).orderBy("file_id", "key").collect()]
    stars = "*" * 15
    assert got == [("f", "* A :x:"), ("f", "* A2 :x:"), ("f", f"{stars} B2 :y:"), ("f", "below"), ("f", "below"), ("g", "** A3 :x:"), ("g", "below"), ("g", "* B :y:")]


def test_files_go_as_their_text_and_bodies_stay_by_entry(spark):
    from pyspark.sql import functions as F
    from treeline.sources import lines, outline_text

    f = spark.createDataFrame([("a", "é\n* A\n:PROPERTIES:\n:ID: a\n:END:\nx\n\n*************** T\ny\n*************** END\nz\n"), ("b", ""), ("c", "\n\n* C\n<2024-01-02 Tue> ")], "path string, content string")
    x = lines.number(lines.file_pieces(f), F.transform("lines", outline_text.note_shape), True)
    below = below_exchanges(x, "path#")
    assert below and all("array_join(lines" in b and "offset" not in b for b in below)
    assert [(r.n, r.offset) for r in x.filter("path = 'a'").orderBy("n").collect()][:4] == [(0, 0), (1, 3), (2, 7), (3, 20)]
    assert [(r.path, r.n, r.line, r.offset) for r in x.filter("path <> 'a'").orderBy("path", "n").collect()] == [("b", 0, "", 0), ("c", 0, "", 0), ("c", 1, "", 1), ("c", 2, "* C", 2), ("c", 3, "<2024-01-02 Tue> ", 6)]
    got = outline_text.parse(f).store
    assert sorted((r.title, r.byte_offset) for r in got.entries.collect()) == [("A", 3), ("C", 2), ("T", 36)]
    body = got.entry_body_blocks.groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("position", "block_type", "content"))).alias("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(below_exchanges(body, "id#")) == 1 and len(below_exchanges(body, "entry_id#")) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [[tuple(b)[1:] for b in r.b] for r in body.filter("entry_id = 'a'").collect()] == [[("paragraph", "x"), ("whitespace", ""), ("inline_task", got.entries.filter("title = 'T'").first().id), ("paragraph", "z")]]


def test_parts_of_entries_are_moved_as_rows(spark):
    """No lists of a part or two are made below the exchange, and no value goes twice."""
    from treeline.operators import similarity

    s = plain(spark)
    tags = spark.createDataFrame([("c", "y"), ("c", "x"), ("c", "x")], "entry_id string, tag string")
    kinds = spark.createDataFrame([("c", "k2", True), ("c", "k1", True)], "entry_id string, category string, is_explicit boolean")
    s = replace(s, entry_tags=tags, entry_categories=kinds)
    plan = stats.context_parts(s)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(plan) if "Exchange hashpartitioning(entry_id" in x)
    assert not [x for x in plan[at:] if "collect_list" in x] and not [x for x in plan[at:] if "tag#" in x and "AS s#" in x and "null AS s#" not in x]
    got = {(r.entry_id, r.chunk) for r in similarity.entry_chunks(s).filter("entry_id in ('c', 'y')").collect()}
    assert got == {("c", "Path: A > B\nTitle: C D\nTags: x, x, y\nCategories: k1, k2"), ("y", "Path: Z\nTitle: Y")}
