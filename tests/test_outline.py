"""Logs, notes and ranges read and written; operators without SQL against plain Python."""

import hashlib
import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from treeline import queries as outline
from treeline.functions import scalars as fn
from treeline.model import SCHEMAS, Config, Store
from treeline.operators import lint, similarity, sync, tree
from treeline.sinks import text
from treeline.sources import config, documents, lines, outline_text, testbed

LOG = """* TODO Task
SCHEDULED: <2024-01-02 Tue>
:PROPERTIES:
:ID: a1
:END:
- CLOSING NOTE [2024-01-09 Tue 10:00] \\\\
  closed, see

  ,* below
- State "DONE"       from "TODO"       [2024-01-08 Mon 10:00] \\\\

  after a blank
- State "TODO"       [2024-01-07 Sun 10:00]
- Note taken on [2024-01-06 Sat 10:00]
- Rescheduled from "[2024-01-01 Mon]" on [2024-01-05 Fri 09:00]
- Not scheduled, was "<2024-01-01 Mon +1w>" on [2024-01-05 Fri 08:00]
- New deadline from "[2024-01-01 Mon 10:00-11:00]" on [2024-01-04 Thu 09:00]
- Removed deadline, was "[2024-01-01 Mon]" on [2024-01-03 Wed 09:00]
- Refiled on [2024-01-02 Tue 09:00]
:LOGBOOK:
CLOCK: [2024-01-02 Tue 23:00]--[2024-01-03 Wed 00:30] =>  1:30
CLOCK: [2024-01-02 Tue 10:00]
- Note taken on [2024-01-02 Tue 10:05]
:END:
:LOGBOOK:
:END:
<2024-01-10 Wed 10:00>--<2024-01-11 Thu 11:00>
body
- State "TODO"       [2024-01-07 Sun 10:00]
,* no heading
,,* one comma
:MINE:
:in: a drawer
:END:
** DONE child
  indented body
"""
BROKEN = "* A\n<2024-01-10 Wed>--<2024-01-11 Thu 10:00-11:00>\n*** B\n"


@pytest.fixture(scope="module")
def parsed(spark):
    return outline_text.parse(spark.createDataFrame([("a.org", LOG)], "path string, content string"))


def test_every_kind_of_log_entry(parsed):
    log = parsed.store.entry_log_entries.orderBy("position").collect()
    assert [r.log_type for r in log] == ["closing", "state", "state", "note", "rescheduled", "not_scheduled", "deadline", "no_deadline", "refiling", "logbook", "clock", "clock", "note", "logbook"]
    by = {r.position: r for r in log}
    assert (by[1].to_keyword, by[1].from_keyword, by[2].from_keyword) == ("DONE", "TODO", None)
    assert (by[4].orig_day, by[4].time_start, by[5].orig_kind, by[5].orig_suffix) == (60310, 540, "active", "+1w")
    assert (by[6].orig_start, by[6].orig_end) == (600, 660)
    assert (by[10].time_day, by[10].day_end, by[10].time_start, by[10].time_end, by[10].duration_minutes) == (60311, 60312, 1380, 30, 90)
    assert [r.logbook_id for r in log[10:13]] == [by[9].id] * 3 and by[13].logbook_id is None
    notes = [(r.log_position, r.block_type, r.content) for r in parsed.store.entry_log_bodies.orderBy("log_position", "position").collect()]
    assert notes == [(0, "paragraph", "closed, see"), (0, "whitespace", ""), (0, "paragraph", "* below"), (1, "whitespace", ""), (1, "paragraph", "after a blank")]
    codes = {r.code for r in lint.lint(parsed.store).collect()}
    assert {"MultipleLogbooks", "MixedLogbook", "WhitespaceAtStartOfNote", "MisplacedLogEntry"} <= codes


def test_stamps_and_body(parsed):
    s = parsed.store
    stamp = {r.stamp_type: r for r in s.entry_stamps.collect()}
    assert (stamp["active"].day, stamp["active"].day_end, stamp["active"].time_start, stamp["active"].time_end) == (60319, 60320, 600, 660)
    blocks = [(r.block_type, r.content, r.drawer_name) for r in s.entry_body_blocks.filter("entry_id = 'a1'").orderBy("position").collect()]
    assert blocks == [("paragraph", 'body\n- State "TODO"       [2024-01-07 Sun 10:00]\n* no heading\n,* one comma', None), ("drawer", ":MINE:\n:in: a drawer\n:END:", "MINE")]
    assert s.entries.count() == 2 and parsed.errors.count() == 0


def test_printed_text_is_read_as_the_same(parsed):
    once = text.file_texts(parsed.store)
    again = outline_text.parse(once).store
    for name in SCHEMAS:
        cols = [c for c in getattr(again, name).columns if c not in ("byte_offset", "id", "log_id", "logbook_id", "parent_id", "entry_id", "path") or name == "entry_tags"]
        same = lambda st, name=name, cols=cols: sorted(map(str, getattr(st, name).select(cols).collect()))
        if name not in ("files", "entry_properties"):
            assert same(again) == same(parsed.store), name
    assert text.file_texts(again).collect()[0].content == once.collect()[0].content
    assert sync.round_trip_failures(parsed.store).count() == 0


def test_fail_fast_names_the_line(spark, parsed):
    bad = outline_text.parse(spark.createDataFrame([("b.org", BROKEN)], "path string, content string"))
    assert sorted((r.line, r.message.split(":")[0]) for r in bad.errors.collect()) == [(1, "an end of its own or a suffix after --"), (2, "heading skips a level")]
    with pytest.raises(ValueError, match="b.org:2: an end"):
        outline_text.fail_fast(bad)
    assert outline_text.fail_fast(parsed) is parsed


def entries(spark, rows):
    """Store of (id, parent, depth, position, title)."""
    up = {i: p for i, p, *_ in rows}

    def path(i):
        return (path(up[i]) if up[i] else []) + [i]

    e = spark.createDataFrame([(i, "f", p, d, n, t, path(i)) for i, p, d, n, t in rows], "id string, file_id string, parent_id string, depth int, position int, title string, path array<string>")
    made = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    made["entries"] = e.select(*[(F.col(c) if c in e.columns else F.lit(None).cast(t)).alias(c) for c, t in (x.strip().split(" ", 1) for x in SCHEMAS["entries"].split(","))])
    return Store(**made)


def test_nesting_and_paths_of_any_depth(spark):
    rows = [("A", None, 1, 0, "a")] + [(chr(65 + k), chr(64 + k), k + 1, 0, "x") for k in range(1, 20)] + [("C2", "B", 3, 1, 'quo"te'), ("Z", None, 1, 1, "z")]
    s = entries(spark, rows)
    got = {r.id: json.loads(r.tree) for r in tree.nest(s).collect()}

    def brute(i):
        kids = sorted((n, k) for k, p, _, n, _ in rows if p == i)
        own = next({"position": n, "id": k, "title": t} for k, _, _, n, t in rows if k == i)
        return own | ({"children": [brute(k) for _, k in kids]} if kids else {})

    assert got == {i: brute(i) for i in ("A", "Z")}
    assert {r.id: r.path for r in tree.build_paths(s.entries).collect()} == {r.id: r.path for r in s.entries.collect()}
    loop = spark.createDataFrame([("a", None), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "gone")], "id string, parent_id string")
    assert {r.id for r in tree.build_paths(loop).collect()} == {"a", "b"}


def test_nest_of_the_store(spark):
    s = testbed.store(spark, DATA)
    rows = {}
    kids = defaultdict(list)
    for r in s.entries.select("id", "parent_id", "position", "title", "keyword_value").collect():
        kids[r.parent_id].append(r)
        rows[r.id] = r

    def brute(r):
        own = {"position": r.position, "id": r.id, "title": r.title} | ({"keyword": r.keyword_value} if r.keyword_value else {})
        below = [brute(k) for k in kids[r.id]]
        return own | ({"children": sorted(below, key=lambda x: json.dumps(x, sort_keys=True))} if below else {})

    def ordered(x):
        return x | ({"children": sorted(map(ordered, x["children"]), key=lambda y: json.dumps(y, sort_keys=True))} if "children" in x else {})

    got = {r.id: json.loads(r.tree) for r in outline.QUERIES["tree_nest"](spark, DATA).collect()}
    assert len(got) == len(kids[None]) > 0
    for r in kids[None]:
        assert ordered(got[r.id]) == ordered(brute(r))
        at = [x["position"] for x in got[r.id].get("children", [])]
        assert at == sorted(at)


def cut(t, n):
    """The chunk rules in plain words."""
    if not t.strip(" \n\t\r"):
        return []
    if len(t) <= n:
        return [t]

    def merged(parts, sep, split):
        done, open_ = [], None
        for p in parts:
            if len(p) > n:
                done += ([open_] if open_ is not None else []) + split(p)
                open_ = None
            elif open_ is not None and len(open_) + len(sep) + len(p) <= n:
                open_ += sep + p
            else:
                done += [open_] if open_ is not None else []
                open_ = p
        return done + ([open_] if open_ is not None else [])

    lines = lambda p: merged(re.sub("\n$", "", p).split("\n"), "\n", lambda x: [x[k : k + n] for k in range(0, len(x), n)])
    return merged([p for p in t.split("\n\n") if p.strip(" \n\t\r")], "\n\n", lines)


def test_chunks_of_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = defaultdict(list)
    for r in outline.QUERIES["chunk_text"](spark, DATA).orderBy("doc_id", "position").collect():
        got[r.doc_id].append(r.chunk)
    assert len(got) > 100
    assert dict(got) == {i: c for i, t in texts.items() if (c := cut(t or "", 2000))}


def test_chunks_of_entries(spark):
    s = testbed.store(spark, DATA)
    size = 300
    of = lambda df, key: {k: v for k, v in ((r[0], r[1]) for r in df.collect())} if key else None
    crumbs = of(tree.breadcrumbs(s), True)
    title, tags, cats, body, notes, props = ({} for _ in range(6))
    for r in s.entries.collect():
        title.setdefault(r.id, set()).add(r.title)
    for df, into, pair in ((s.entry_tags, tags, lambda r: r.tag), (s.entry_categories, cats, lambda r: r.category), (s.entry_body_blocks, body, lambda r: (r.position, r.content)), (s.entry_log_bodies, notes, lambda r: (r.log_position, r.position, r.content)), (s.entry_properties, props, lambda r: (r.name, f"{r.name}: {r.value}"))):
        for r in df.collect():
            into.setdefault(r.entry_id, []).append(pair(r))
    want = {}
    for i, ts in title.items():
        head = "\n".join([f"Path: {crumbs.get(i)}"] * (i in crumbs) + [f"Title: {' '.join(sorted(ts))}"] + [f"Tags: {', '.join(sorted(tags.get(i, [])))}"] * (i in tags) + [f"Categories: {', '.join(sorted(cats.get(i, [])))}"] * (i in cats))
        parts = [(f"body[{p}]", c) for p, c in sorted(body.get(i, []))] + [(f"log[{p}]/body[{k}]", c) for p, k, c in sorted(notes.get(i, []))] + [("properties", "\n".join(v for _, v in sorted(props.get(i, []))))]
        room = max(100, size - len(head) - 2)
        rows = [(source, f"{head}\n\n{piece}") for source, c in parts for piece in cut(c, room)] or [("header", head)]
        want[i] = [(k, *r) for k, r in enumerate(rows)]
    got = defaultdict(list)
    for r in similarity.entry_chunks(s, size).collect():
        got[r.entry_id].append((r.position, r.source, r.chunk))
    assert {i: sorted(x) for i, x in got.items()} == want
    assert outline.QUERIES["entry_chunks"](spark, DATA).count() >= len(want)


def test_blocks_of_documents(spark):
    """Bodies by counting the runs of blank and other lines of plain text."""
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        lines = (r.text or "").split("\n") if r.text is not None and r.lang is not None else []
        if lines and not any(re.match(r"^,*(\*{1,14} |\s*:[\w-]+:\s*$|\s*CLOCK: |\s*- |#\+|\s*[<\[]\d{4})", x) for x in lines):
            kinds = [not x.strip(" ") for x in lines]
            want[f"Doc {r.doc_id}"] = 1 + sum(a != b for a, b in zip(kinds, kinds[1:]))
    got = {r.title: r.blocks for r in outline.QUERIES["parse_blocks"](spark, DATA).collect()}
    assert len(want) > 50 and {t: got.get(t) for t in want} == want


def test_printed_files_hold_every_entry(spark):
    got = outline.QUERIES["print_text"](spark, DATA).collect()
    s = testbed.store(spark, DATA)
    assert len(got) == s.files.count()
    ids = re.findall(r"(?m)^:ID: +(\S+)$", "\n".join(r.content for r in got))
    assert sorted(ids) == sorted(r.id for r in s.entries.select("id").collect())


BLOCKS = """preamble
#+begin_src text
* no heading
:END:
#+end_src
* One
:PROPERTIES:
:ID: one
:END:
  #+BEGIN_EXAMPLE
* no heading
#+END_EXAMPLE at another indentation
  #+END_EXAMPLE
:NOTES:
** no heading
*************** no task
:END:
*************** TODO [#A] Task :t:
SCHEDULED: <2024-01-02 Tue>
:PROPERTIES:
:ID: task
:END:
in it
*************** END
after it
*************** no END
#+begin_quote without an end
:drawer: not one
  :OPEN:
** Two
:PROPERTIES:
:ID: two
:END:
é #+begin_src
**************** sixteen
*************** END
"""


def of_blocks(parsed):
    s = parsed.store
    heads = [tuple(r) for r in s.entries.select("id", "depth", "parent_id", "position", "byte_offset", "title", F.array_join("path", "/")).orderBy("byte_offset").collect()]
    blocks = [tuple(r) for r in s.entry_body_blocks.select("entry_id", "position", "block_type", "content", "drawer_name").orderBy("entry_id", "position").collect()]
    return heads, blocks


@pytest.mark.parametrize("size", [None, 1, 3])
def test_blocks_and_inline_tasks(spark, size, monkeypatch):
    """The same whatever pieces a file is cut into."""
    if size:
        monkeypatch.setattr(lines, "PIECE", size)
    p = outline_text.parse(spark.createDataFrame([("a.org", BLOCKS), ("b.org", "* é\n** x"), ("c.org", None)], "path string, content string"))
    at = lambda text: len(BLOCKS[: BLOCKS.index(text)].encode())
    heads, blocks = of_blocks(p)
    assert [h for h in heads if h[0] in ("one", "task", "two")] == [
        ("one", 1, None, 0, at("* One"), "One", "one"), ("task", 15, "one", 0, at("*************** TODO"), "Task", "one/task"), ("two", 2, "one", 1, at("** Two"), "Two", "one/two"),
    ]
    assert sorted(h[4:6] for h in heads if h[0] not in ("one", "task", "two")) == [(0, "é"), (5, "x")]
    assert blocks == [
        ("one", 0, "drawer", "  #+BEGIN_EXAMPLE\n* no heading\n#+END_EXAMPLE at another indentation\n  #+END_EXAMPLE", "#+BEGIN_EXAMPLE"),
        ("one", 1, "drawer", ":NOTES:\n** no heading\n*************** no task\n:END:", "NOTES"),
        ("one", 2, "inline_task", "task", None),
        ("one", 3, "paragraph", "after it\n*************** no END\n#+begin_quote without an end\n:drawer: not one\n  :OPEN:", None),
        ("task", 0, "paragraph", "in it", None),
        ("two", 0, "paragraph", "é #+begin_src\n**************** sixteen\n*************** END", None),
    ]
    assert [tuple(r) for r in p.store.entry_tags.collect()] == [("task", "t")] and p.store.entry_stamps.count() == 1
    if size:
        return
    once = text.file_texts(p.store)
    again = outline_text.parse(once)
    strip = lambda found: [h[:4] + h[5:] for h in found if h[0] in ("one", "task", "two")]
    assert strip(of_blocks(again)[0]) == strip(heads) and of_blocks(again)[1] == blocks
    assert again.store.files.filter("path = 'a.org'").first().preamble == p.store.files.filter("path = 'a.org'").first().preamble == BLOCKS[: BLOCKS.index("\n* One")]
    assert text.file_texts(again.store).filter("path = 'a.org'").first() == once.filter("path = 'a.org'").first()


def test_places_of_errors(spark):
    bad = {"1969-01-15 Wed": "year", "2201-01-15 Wed": "year", "2024-00-15 Mon": "month", "2024-13-15 Mon": "month", "2024-01-00 Mon": "day out", "2024-02-30 Fri": "no such day", "2024-01-15 Mon 24:00": "hour", "2024-01-15 Mon 09:60": "minute", "2024-01-15 Mon 09:00-24:00": "hour", "2024-01-15 Mon 09:00-10:99": "minute"}
    rows = [(f"{k}.org", f"é\n* TODO é\n SCHEDULED: <2024-01-02 Tue> DEADLINE: <{s}>\n") for k, s in enumerate(bad)]
    got = {r.path: r for r in outline_text.parse(spark.createDataFrame(rows, "path string, content string")).errors.collect()}
    for k, (s, word) in enumerate(bad.items()):
        r, line = got[f"{k}.org"], rows[k][1].split("\n")[2]
        assert r.line == 2 and r.column == line.index(f"<{s}>") + 1 and r.message.startswith(f"no such time: {word}"), r
        assert rows[k][1].encode()[r.offset :].startswith(f"<{s}>".encode())


def test_a_long_file_is_many_pieces(spark, tmp_path):
    """Read in splits, cut into pieces; blocks and tasks reach over both."""
    body = "".join(f"* H {k}\n#+begin_src\n" + f"* no {k}\n" * (k % 700) + "#+end_src\n*************** T\né\n*************** END\ntext\n" for k in range(300))
    (tmp_path / "long.org").write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        pieces = lines.text_pieces(spark, str(tmp_path / "long.org"), size=lines.PIECE // 20)
        lines.PIECE, size = lines.PIECE // 20, lines.PIECE
        p = outline_text.parse_pieces(pieces, pieces.select("path").distinct()).store
        assert pieces.count() > 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        lines.PIECE = size
    got = p.entries.select("title", "depth", "byte_offset").orderBy("byte_offset").collect()
    want = [(m.start(), m[1].strip()) for m in re.finditer(r"(?m)^(\* H \d+|\*{15} T)$", body)]
    lead = lambda i: len(body[:i].encode())
    assert [(r.byte_offset, r.title) for r in got] == [(lead(i), t.lstrip("* ")) for i, t in want]
    assert p.entry_body_blocks.filter("block_type = 'drawer'").count() == 300 and p.entry_body_blocks.filter("content = 'text'").count() == 300


def test_files_may_share_ids(spark):
    """Each keeps its own headings and children."""
    head = lambda stars, title, i: f"{stars} {title}\n:PROPERTIES:\n:ID: {i}\n:END:\n"
    one = head("*", "Zed", "x") + head("**", "D", "d")
    two = head("*", "Abe", "x") + head("**", "E", "e")
    p = outline_text.parse(spark.createDataFrame([("1.org", one), ("2.org", two)], "path string, content string"))
    written = {r.path: r.content for r in text.file_texts(p.store).collect()}
    squeezed = {k: re.sub(":ID: +", ":ID: ", v) for k, v in written.items()}
    assert squeezed == {"1.org": one, "2.org": two} or squeezed == {"1.org": one.rstrip("\n"), "2.org": two.rstrip("\n")}
    trees = sorted((json.loads(r.tree) for r in tree.nest(p.store).collect()), key=lambda t: t["title"])
    assert [(t["title"], [c["title"] for c in t["children"]]) for t in trees] == [("Abe", ["E"]), ("Zed", ["D"])]
    assert sync.round_trip_failures(p.store).count() == 0


NOTED = "- Note taken on [2024-01-0{} Mon 10:00] \\\\\n{}"
SPACED = {
    "plain": "body\n",
    "around": "\nbody\n\n",
    "only before": "\nbody\n",
    "only after": "body\n\n",
    "logs alike": NOTED.format(1, "\n  a\n\n") + NOTED.format(2, "\n  b\n") + "\nbody\n\n",
    "before logs": NOTED.format(1, "\n  a\n") + NOTED.format(2, "  b\n") + "body\n",
    "after logs": NOTED.format(1, "  a\n\n") + NOTED.format(2, "  b\n") + NOTED.format(3, "  c\n") + "body\n",
    "last ends the file": "\nbody",
}


def test_white_space_rules(spark):
    doc = "".join(f"* {name}\n:PROPERTIES:\n:ID: {name.replace(' ', '-')}\n:END:\n{body}" for name, body in SPACED.items())
    s = outline_text.parse(spark.createDataFrame([("a.org", doc)], "path string, content string")).store
    assert s.entry_log_entries.filter("entry_id = 'after-logs'").count() == 3  # blank lines don't end a log
    got = {(r.entry_id, r.code, r.arg) for r in lint.lint(s, codes=("InconsistentLogSpace", "InconsistentBodySpace", "EmptyBodySpace")).collect()}
    assert got == {
        ("only-before", "InconsistentBodySpace", "surrounding body"), ("only-after", "InconsistentBodySpace", "surrounding body"),
        ("before-logs", "InconsistentLogSpace", "before log entries"), ("after-logs", "InconsistentLogSpace", "after log entries"),
    }
    assert sync.round_trip_failures(s).count() == 0


def test_hash_of_the_printed_entry(spark):
    """It changes with a tag, and with nothing of another entry."""
    head = lambda tag, sha: f"* TODO One  :{tag}:\n:PROPERTIES:\n{sha}:ID: one\n:END:\nbody\n** Two\n"
    parse = lambda doc: outline_text.parse(spark.createDataFrame([("a.org", doc)], "path string, content string")).store
    written = text.entry_texts(parse(head("t", ""))).filter("id = 'one'").first().text
    sha = f":HASH_sha512: {hashlib.sha512((written + chr(10)).encode()).hexdigest()[:64]}\n"
    found = lambda doc: [r.entry_id for r in lint.lint(parse(doc), codes=("HashMismatch",)).collect()]
    assert found(head("t", sha)) == [] and found(head("u", sha)) == ["one"]
    assert found(head("t", sha).replace("Two", "Three")) == []


def test_clusters_need_a_fixed_point(spark):
    chain = spark.createDataFrame([(k, k + 1, 0.5) for k in range(60)], "a long, b long, distance double")
    assert {r.cluster for r in similarity.clusters(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        similarity.clusters(chain, rounds=1)


def test_settings_from_files(spark, tmp_path):
    (tmp_path / "k.dot").write_text('digraph {\n  TODO [color=red];\n  "WAIT" [shape=box, color="blue"]; // waits\n  DONE [color=green];\n  TODO -> DONE;\n  "WAIT" -> TODO [label=x];\n}\n')
    c = config.from_graph(spark, str(tmp_path / "k.dot"))
    assert (c.start_keywords, c.open_keywords, c.closed_keywords, c.transitions) == (("TODO",), ("TODO", "WAIT"), ("DONE",), (("TODO", "DONE"), ("WAIT", "TODO")))
    (tmp_path / "c.json").write_text('{"tags_column": 80,\n "priorities": ["A"]}')
    assert config.from_json(spark, str(tmp_path / "c.json")) == Config(tags_column=80, priorities=("A",))
    (tmp_path / "d.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        config.from_json(spark, str(tmp_path / "d.json"))
    page = spark.createDataFrame([("#+TITLE: One\n#+title: Two\n#+tags: a b\ntext", {"tags": "given"}), ("plain", None)], "t string, m map<string,string>")
    assert [r.m for r in page.select(config.metadata(F.col("m"), F.col("t")).alias("m")).collect()] == [{"tags": "given", "title": "One"}, {}]


def test_documents_are_the_store(spark, parsed):
    lines = documents.documents(parsed.store)
    again = documents.from_documents(lines)
    for name in SCHEMAS:
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(parsed.store, name).collect())), name
    with pytest.raises(Exception, match="MALFORMED|malformed|parse"):
        documents.from_documents(spark.createDataFrame([("{no",)], "json string")).files.collect()


def test_loading(spark, parsed):
    left = sync.delete_files(parsed.store, spark.createDataFrame([("a.org",)], "path string"))
    assert all(getattr(left, n).count() == 0 for n in SCHEMAS)
    kept = sync.delete_files(parsed.store, spark.createDataFrame([("other",)], "path string"))
    assert all(getattr(kept, n).count() == getattr(parsed.store, n).count() for n in SCHEMAS)
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, mod_time int")
    cached = spark.createDataFrame([("a", 1), ("b", 1), ("b", 0)], "path string, mod_time int")
    assert sorted(r.path for r in sync.stale_files(files, cached).collect()) == ["b", "c"]
    old = spark.createDataFrame([("e", 0, "x", [1.0]), ("g", 0, "y", [2.0])], "entry_id string, chunk_position int, chunk_text string, embedding array<float>")
    marks = spark.createDataFrame([("e", "h0"), ("g", "h1")], "entry_id string, embedded_hash string")
    new = spark.createDataFrame([("e", "h2", 0, "z", [3.0]), ("k", "h3", 0, "w", [4.0])], "entry_id string, hash string, chunk_position int, chunk_text string, embedding array<float>")
    v, m = sync.store_vectors(old, marks, new)
    assert sorted((r.entry_id, r.chunk_text) for r in v.collect()) == [("e", "z"), ("g", "y"), ("k", "w")]
    assert {r.entry_id: r.embedded_hash for r in m.collect()} == {"e": "h2", "g": "h1", "k": "h3"}


def test_facts_and_instants(spark, parsed):
    files = spark.createDataFrame([("a.org", "x/20240601-my name.org", "#+slug: own\n#+created: [2020-01-02 Thu]\n"), ("b", "archive/plain.org", "")], "k string, path string, content string")
    got = {r.title: r for r in tree.file_facts(outline_text.parse(files.drop("k")).store).collect()}
    assert (got["my name"].slug, got["my name"].stamp, got["my name"].created, got["my name"].archive) == ("own", 60462, 58850, False)
    assert (got["plain"].slug, got["plain"].stamp, got["plain"].archive) == ("plain", None, True)
    space = {r.entry_id: (r.lead, r.trail, r.empty) for r in tree.body_space(outline_text.parse(spark.createDataFrame([("a", "* A\n:PROPERTIES:\n:ID: a\n:END:\n\nx\n\n* B\n:PROPERTIES:\n:ID: b\n:END:")], "path string, content string")).store).collect()}
    assert space == {"a": ("", "", False), "b": (None, None, True)}
    t = spark.createDataFrame([(40587, 61), (0, None)], "d int, m int").select(fn.from_instant(fn.instant(F.col("d"), F.col("m"))).alias("t")).collect()
    assert [(r.t.day, r.t.minute) for r in t] == [(40587, 61), (0, 0)]


def test_search_rows(spark, parsed):
    hits = spark.createDataFrame([("a1", "body[0]", "text", 0.25)], "id string, source string, chunk string, distance double")
    r = text.search_rows(hits, parsed.store).first()
    assert r.line == "a.org:0 TODO Task [body[0]]"
    assert json.loads(r.json) == {"id": "a1", "file": "a.org", "title": "Task", "headline": "Task", "keyword": "TODO", "depth": 1, "byte_offset": 0, "distance": 0.25, "matched_source": "body[0]", "matched_text": "text"}


def test_lists_of_files(spark, tmp_path):
    (tmp_path / "a.org").write_text("* A")
    (tmp_path / "b.png").write_bytes(b"\x89")
    (tmp_path / "list").write_text(f"{tmp_path}/a.org\n\n{tmp_path}/b.png\n")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in outline_text.read_files(spark, *outline_text.read_list(spark, str(tmp_path / "list"))).collect()}
    assert got == {"a.org": "* A", "b.png": None}


def test_files_are_followed(spark, tmp_path):
    from treeline.streaming import clocked

    (tmp_path / "in").mkdir()
    seen = []
    load = lambda batch, k: seen.extend((r.path.rsplit("/", 1)[1], r.content) for r in batch.collect())
    for name in ("a.org", "b.org"):
        (tmp_path / "in" / name).write_text(f"* {name}")
        clocked.follow_files(spark, str(tmp_path / "in"), load, str(tmp_path / "state")).awaitTermination()
    assert seen == [("a.org", "* a.org"), ("b.org", "* b.org")]
