"""Predicates on a store small enough to know by heart."""

import datetime
from dataclasses import fields

import pytest

from treeline.model import SCHEMAS, Store
from treeline.plans import predicates as q

DAY = datetime.date(2024, 3, 10)
MJD = (DAY - datetime.date(1858, 11, 17)).days


@pytest.fixture(scope="module")
def store(spark):
    e = lambda i, parent, depth, kind, kw, pri, title, path: (i, "f", parent, depth, 0, None, kind, kw, pri, title, title, None, None, None, None, path)
    data = {
        "files": [("f", "notes/100%_done.org", None, None, None, None, None)],
        "entries": [
            e("a", None, 1, None, None, None, "Work", ["a"]),
            e("b", "a", 2, "open", "TODO", "A", "Write 50% of it", ["a", "b"]),
            e("c", "b", 3, "closed", "DONE", "C", "under_score", ["a", "b", "c"]),
            e("d", "a", 2, "open", "WAIT", None, r"back\slash", ["a", "d"]),
            e("x", None, 1, None, None, "B", "Alone", ["x"]),
        ],
        "entry_tags": [("a", "work"), ("c", "deep"), ("x", "solo")],
        "entry_properties": [("b", "Effort", "10", 0), ("d", "EFFORT", "9", 0), ("c", "style", "HABIT", 0)],
        "entry_stamps": [("b", "scheduled", "active", MJD, None, None, None, None), ("c", "closed", "inactive", MJD - 5, None, None, None, None)],
        "entry_log_entries": [("l", "b", 0, "clock", "inactive", MJD, None, 1, 2, *[None] * 8, 30, "book"), ("m", "d", 0, "note", "inactive", MJD, *[None] * 13)],
        "entry_body_blocks": [("d", 0, "paragraph", "A Body with work in it", None)],
        "entry_categories": [("b", "cat", True)],
        "entry_links": [("d", 0, "id", "b", None)],
    }
    return Store(**{f.name: spark.createDataFrame(data.get(f.name, []), SCHEMAS[f.name]) for f in fields(Store)})


CASES = [
    (q.and_(), "abcdx"),
    (q.or_(), ""),
    (q.todo(), "bcd"),
    (q.todo("TODO"), "b"),
    (q.not_(q.todo("TODO")), "cd"),  # null stays out
    (q.or_(q.todo("TODO"), q.done()), "bc"),
    (q.when(q.todo("TODO"), q.priority("B")), "cd"),
    (q.unless(q.todo("TODO"), q.priority("C")), "bc"),
    (q.heading("work", "ALONE"), "ax"),
    (q.heading("50%"), "b"),
    (q.heading("5_"), ""),
    (q.heading("r_s"), "c"),
    (q.heading("k\\s"), "d"),
    (q.heading(), "abcdx"),
    (q.regexp("work"), "ad"),
    (q.regexp("work", "body"), "d"),
    (q.rifle("wri 50"), "b"),
    (q.rifle("body with"), "d"),
    (q.level(2), "bd"),
    (q.level(">=", 2), "bcd"),
    (q.priority("<", "C"), "bx"),
    (q.priority("A", "B"), "bx"),
    (q.priority(), "bcx"),
    (q.tags("work"), "abcd"),
    (q.tags(), "acx"),
    (q.tags_local("work"), "a"),
    (q.tags_inherited("work"), "bcd"),
    (q.tags_inherited(), "bcd"),
    (q.tags_all("work", "deep"), "c"),
    (q.tags_all(), "abcdx"),
    (q.property_("effort"), "bd"),
    (q.property_("EFFORT", "10"), "b"),
    (q.property_("effort", ">", "10"), "d"),  # as text
    (q.habit(), "c"),
    (q.category("cat"), "b"),
    (q.category(), "abcdx"),
    (q.link(), "d"),
    (q.link("B"), "d"),
    (q.link("zz"), ""),
    (q.path("0%_D"), "abcdx"),
    (q.path("0x"), ""),
    (q.ts(), "bc"),
    (q.ts_active(), "b"),
    (q.ts_inactive(), "c"),
    (q.scheduled(on="today"), "b"),
    (q.scheduled(before="2024-03-10"), "b"),  # inclusive
    (q.scheduled(to=-1), ""),
    (q.closed(from_=-5, to=0), "c"),
    (q.planning(from_="2024-02-30"), "bc"),  # no such day: day 0
    (q.deadline(), ""),
    (q.clocked(on=0), "b"),
    (q.parent(q.or_(q.todo("TODO"), q.tags("solo"))), "c"),
    (q.ancestors(q.or_(q.todo("TODO"), q.tags_local("work"))), "bcd"),
    (q.children(), "ab"),
    (q.children(q.or_(q.done(), q.todo("WAIT"))), "ab"),
    (q.not_(q.children()), "cdx"),
    (q.descendants(q.done()), "ab"),
    (q.descendants(q.parent(q.priority("A"))), "ab"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(store, k):
    p, want = CASES[k]
    assert "".join(sorted(r.id for r in q.select(store, p, DAY).collect())) == want


def test_errors(store):
    for bad in (lambda: q.build("nonsense"), lambda: q.regexp(), lambda: q.select(store, q.scheduled(on="03-10")), lambda: q.select(store, q.level("!", 2))):
        with pytest.raises(ValueError):
            bad()


def nest(n):
    p = q.done()
    for _ in range(n):
        p = q.children(p)
    return p


def test_nesting_is_limited(store):
    with pytest.raises(ValueError):
        q.select(store, nest(q.MAX_NESTING + 1), DAY)
    q.select(store, nest(5), DAY)


def test_build_by_name_and_own_predicate(store):
    assert [r.id for r in q.select(store, q.build("h", "alone"), DAY).collect()] == ["x"]

    @q.register_predicate("short-title")
    def short(n):
        from pyspark.sql import functions as F

        return lambda c: F.length(c.col("title")) <= n

    assert {r.id for r in q.select(store, q.build("short-title", 5), DAY).collect()} == {"a", "x"}


def test_limit_takes_the_first(store):
    assert [r.id for r in q.select(store, q.todo(), DAY, limit=2).collect()] == ["b", "c"]


def test_hierarchy_is_planned_as_hash_or_merge_joins(store):
    plan = q.select(store, q.ancestors(q.tags("work")), DAY)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
