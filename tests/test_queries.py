"""Every registered query against its SQL, on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA, duck_rows, rows
from treeline import queries as outline


@pytest.mark.parametrize("name", sorted(outline.SQL))
def test_query_matches_sql(spark, name):
    got = rows(outline.QUERIES[name](spark, DATA))
    assert got == duck_rows(outline.SQL[name])
    assert got[1]


@pytest.mark.parametrize("name", sorted(set(outline.QUERIES) - set(outline.SQL)))
def test_query_runs(spark, name):
    """What they return is held against plain Python in test_outline.py."""
    assert outline.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dot_lines_draw_all_entries_and_relations(spark):
    from treeline.sinks import graph
    from treeline.sources import testbed

    got = [r.line for r in outline.QUERIES["dot_lines"](spark, DATA).collect()]
    edges = [(r.source, r.target) for r in graph.relations(testbed.store(spark, DATA)).collect()]
    assert edges and sorted(x.split(" [")[0] for x in got if " -> " in x) == sorted(f'"{a}" -> "{b}"' for a, b in edges)
    drawn = "\n".join(x for x in got if x.startswith("subgraph"))
    assert all(f'"{i}" [label=' in drawn for i in {i for e in edges for i in e})
