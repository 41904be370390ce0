"""All registered queries of the outline engine, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import predicates as q
from .sources import testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: "Today" of the registered queries.
TODAY = datetime.date(1998, 9, 2)
TODAY_MJD = (TODAY - datetime.date(1858, 11, 17)).days


def query(name: str, sql: str | None = None, head: str = testbed.SQL):
    """Register a function of (store, spark, sf_dir), and the SQL that follows the tables' WITH."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(testbed.store(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            SQL[name] = head + sql
        return f

    return add


def _predicate(name: str, p: q.Predicate, where: str) -> None:
    """The ids and titles of the entries that a predicate selects."""
    query(name, f"SELECT id, title, depth FROM entries e WHERE {where}")(lambda s, spark, d: q.select(s, p, TODAY).select("id", "title", "depth"))


def _hierarchy(name: str, p: q.Predicate, hits: str, on: str) -> None:
    """The same for predicates about other entries: what they ask for is worked out of the tables that the store comes from, and
    joined, so that its tables are read once."""
    query(name, f", {hits} SELECT e.id, e.title, e.depth FROM entries e JOIN hit ON {on}")(lambda s, spark, d: q.select(s, p, TODAY).select("id", "title", "depth"))


#: Tags of the entries above each entry, and those with its own.
_TAGGED = """ups AS (SELECT 'o-' || o_orderkey AS entry_id, lower(c_mktsegment) AS tag FROM orders JOIN cust ON o_custkey = c_custkey),
inherited AS (SELECT * FROM ups
  UNION ALL SELECT 'l-' || l_orderkey || '-' || l_linenumber, lower(c_mktsegment) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey
  UNION ALL SELECT 'l-' || l_orderkey || '-' || l_linenumber, replace(lower(substr(o_orderpriority, 3, 20)), ' ', '_') FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tagged AS (SELECT * FROM inherited UNION ALL SELECT entry_id, tag FROM entry_tags),"""


def _mjd(day: str) -> int:
    return (datetime.date.fromisoformat(day) - datetime.date(1858, 11, 17)).days


def _own(tag: str, e: str = "e") -> str:
    return f"{e}.id IN (SELECT entry_id FROM entry_tags WHERE tag IN ({tag}))"


def _up(tag: str, e: str = "e") -> str:
    return f"{e}.id IN (SELECT a.entry_id FROM ancestors a JOIN entry_tags t ON t.entry_id = a.ancestor_id WHERE t.tag IN ({tag}))"


def _stamp(cond: str, e: str = "e") -> str:
    return f"EXISTS (SELECT 1 FROM entry_stamps s WHERE s.entry_id = {e}.id AND {cond})"


def _prop(cond: str, e: str = "e") -> str:
    return f"EXISTS (SELECT 1 FROM entry_properties p WHERE p.entry_id = {e}.id AND {cond})"


_predicate("ql_and_or_not", q.and_(q.or_(q.todo("TODO"), q.todo("WAIT")), q.not_(q.tags_local("low"))), f"keyword_value IN ('TODO', 'WAIT') AND NOT {_own(chr(39) + 'low' + chr(39))}")
_predicate("ql_not_null", q.not_(q.todo("TODO")), "NOT (keyword_value = 'TODO')")
_predicate("ql_when", q.when(q.todo("TODO"), q.priority("A")), "NOT (keyword_value = 'TODO') OR (keyword_value = 'TODO' AND priority = 'A')")
_predicate("ql_unless", q.unless(q.todo("TODO"), q.priority("A")), "keyword_value = 'TODO' OR (NOT (keyword_value = 'TODO') AND priority = 'A')")
_predicate("ql_todo", q.and_(q.todo(), q.level(2)), "keyword_value IS NOT NULL AND depth = 2")
_predicate("ql_todo_in", q.todo("TODO", "WAIT"), "keyword_value IN ('TODO', 'WAIT')")
_predicate("ql_done", q.and_(q.done(), q.level(2)), "keyword_type = 'closed' AND depth = 2")
_hierarchy("ql_tags", q.tags("building", "urgent"), f"{_TAGGED} hit AS MATERIALIZED (SELECT DISTINCT entry_id AS id FROM tagged WHERE tag IN ('building', 'urgent'))", "e.id = hit.id")
_predicate("ql_tags_local", q.tags_local("building", "urgent"), _own("'building', 'urgent'"))
_hierarchy("ql_tags_all", q.tags_all("building", "urgent", "r"), f"{_TAGGED} hit AS MATERIALIZED (SELECT entry_id AS id FROM tagged WHERE tag IN ('building', 'urgent', 'r') GROUP BY entry_id HAVING count(DISTINCT tag) = 3)", "e.id = hit.id")
_hierarchy("ql_tags_inherited", q.tags_inherited("machinery"), f"{_TAGGED} hit AS MATERIALIZED (SELECT DISTINCT entry_id AS id FROM inherited WHERE tag = 'machinery')", "e.id = hit.id")
_predicate("ql_heading", q.heading("ORDER 12", "line 3"), "headline ILIKE '%order 12%' OR headline ILIKE '%line 3%'")
_predicate("ql_heading_escaped", q.heading("r#0000000_1", "#00000012"), "contains(headline, 'r#0000000_1') OR contains(headline, '#00000012')")
_predicate("ql_regexp", q.regexp("the", "an"), " AND ".join(f"(headline ILIKE '%{t}%' OR EXISTS (SELECT 1 FROM entry_body_blocks b WHERE b.entry_id = e.id AND b.content ILIKE '%{t}%'))" for t in ("the", "an")))
_predicate("ql_rifle", q.rifle("ord 77"), "(len(list_filter(regexp_split_to_array(lower(headline || ' ' || title), '[^a-z0-9]+'), lambda w: starts_with(w, 'ord'))) > 0 AND len(list_filter(regexp_split_to_array(lower(headline || ' ' || title), '[^a-z0-9]+'), lambda w: starts_with(w, '77'))) > 0) OR EXISTS (SELECT 1 FROM entry_body_blocks b WHERE b.entry_id = e.id AND b.content ILIKE '%ord 77%')")
_predicate("ql_property", q.property_("nation", "NATION_3"), _prop("lower(p.name) = 'nation' AND p.value = 'NATION_3'"))
_predicate("ql_property_exists", q.property_("Style"), _prop("lower(p.name) = 'style'"))
_predicate("ql_property_cmp", q.property_("totalprice", ">", "9"), _prop("lower(p.name) = 'totalprice' AND p.value > '9'"))
_predicate("ql_priority", q.priority("A", "C"), "priority IN ('A', 'C')")
_predicate("ql_priority_cmp", q.priority("<", "C"), "priority < 'C'")
_predicate("ql_level_cmp", q.level("<=", 2), "depth <= 2")
_predicate("ql_category", q.category("ASIA", "EUROPE"), "EXISTS (SELECT 1 FROM entry_categories k WHERE k.entry_id = e.id AND k.category IN ('ASIA', 'EUROPE'))")
_predicate("ql_habit", q.habit(), _prop("lower(p.name) = 'style' AND lower(p.value) = 'habit'"))
_predicate("ql_ts", q.ts(on="1997-03-05"), _stamp(f"s.day = {_mjd('1997-03-05')}"))
_predicate("ql_ts_active", q.ts_active(from_=-30, to="today"), _stamp(f"s.time_kind = 'active' AND s.day BETWEEN {TODAY_MJD - 30} AND {TODAY_MJD}"))
_predicate("ql_ts_inactive", q.ts_inactive(before="1996-01-01"), _stamp(f"s.time_kind = 'inactive' AND s.day <= {_mjd('1996-01-01')}"))
_predicate("ql_scheduled", q.scheduled(from_="1997-01-01", to="1997-12-31"), _stamp(f"s.stamp_type = 'scheduled' AND s.day BETWEEN {_mjd('1997-01-01')} AND {_mjd('1997-12-31')}"))
_predicate("ql_deadline", q.deadline(on="today"), _stamp(f"s.stamp_type = 'deadline' AND s.day = {TODAY_MJD}"))
_predicate("ql_closed", q.closed(from_="1999-01-01"), _stamp(f"s.stamp_type = 'closed' AND s.day >= {_mjd('1999-01-01')}"))
_predicate("ql_invalid_day", q.scheduled(from_="1997-02-30"), _stamp("s.stamp_type = 'scheduled' AND s.day >= 0"))
_predicate("ql_planning", q.planning(before="1995-02-28"), _stamp(f"s.stamp_type IN ('scheduled', 'deadline', 'closed') AND s.day <= {_mjd('1995-02-28')}"))
_predicate("ql_clocked", q.clocked(from_="2024-01-10"), f"EXISTS (SELECT 1 FROM entry_log_entries l WHERE l.entry_id = e.id AND l.log_type = 'clock' AND l.time_day >= {_mjd('2024-01-10')})")
_predicate("ql_path", q.path("NATION_1/1", "nation_7/"), "EXISTS (SELECT 1 FROM files f WHERE f.id = e.file_id AND (contains(f.path, 'nation_1/1') OR contains(f.path, 'nation_7/')))")
_predicate("ql_link", q.link("part:77"), "EXISTS (SELECT 1 FROM entry_links k WHERE k.entry_id = e.id AND k.target ILIKE '%part:77%')")
_hierarchy("ql_parent", q.parent(q.or_(q.todo("WAIT"), q.priority("A"))), "hit AS MATERIALIZED (SELECT DISTINCT 'o-' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority LIKE '1%')", "e.parent_id = hit.id")
_hierarchy("ql_ancestors", q.ancestors(q.property_("Nation", "NATION_3")), "hit AS MATERIALIZED (SELECT DISTINCT 'f-' || c_custkey AS id FROM cust WHERE n_name = 'NATION_3')", "e.file_id = hit.id AND e.depth > 1")
_hierarchy("ql_children", q.and_(q.level(2), q.not_(q.children())), "hit AS MATERIALIZED (SELECT DISTINCT 'o-' || o_orderkey AS id FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey)", "e.id = hit.id")
_hierarchy("ql_children_q", q.children(q.todo("WAIT")), "hit AS MATERIALIZED (SELECT DISTINCT 'c-' || o_custkey AS id FROM orders WHERE o_orderstatus = 'P')", "e.id = hit.id")
_hierarchy("ql_descendants", q.descendants(q.and_(q.tags_local("r"), q.done())), "done AS (SELECT DISTINCT a.l_orderkey AS k FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber) WHERE a.l_linestatus = 'F' AND b.l_returnflag = 'R'), hit AS MATERIALIZED (SELECT DISTINCT unnest(['o-' || o_orderkey, 'c-' || o_custkey]) AS id FROM orders JOIN done ON k = o_orderkey)", "e.id = hit.id")
_hierarchy("ql_nested", q.children(q.children(q.and_(q.done(), q.parent(q.priority("A"))))), "hit AS MATERIALIZED (SELECT DISTINCT 'c-' || o_custkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' AND o_orderpriority LIKE '1%')", "e.id = hit.id")

# -- scans, joins, hierarchy -------------------------------------------------------------------

from .functions import scalars as fn  # noqa: E402
from .operators import stats, tree  # noqa: E402


@query("entry_projection", "SELECT id, file_id, parent_id, depth, position, keyword_type, keyword_value, priority, headline, title, array_to_string(path, '.') AS path FROM entries")
def _(s, spark, d):
    return s.entries.select("id", "file_id", "parent_id", "depth", "position", "keyword_type", "keyword_value", "priority", "headline", "title", F.array_join("path", ".").alias("path"))


@query("file_lookup", "SELECT id, path FROM files WHERE path = 'customers/nation_3/77.org' OR id = 'f-12'")
def _(s, spark, d):
    return s.files.filter((F.col("path") == "customers/nation_3/77.org") | (F.col("id") == "f-12")).select("id", "path")


@query("by_tag_join", "SELECT e.id, e.title, t.tag FROM entries e JOIN entry_tags t ON t.entry_id = e.id WHERE t.tag = 'urgent'")
def _(s, spark, d):
    return s.entries.join(s.entry_tags.filter("tag = 'urgent'"), F.col("id") == F.col("entry_id")).select("id", "title", "tag")


@query("children_of_file", "SELECT DISTINCT e.id, p.name, p.value, t.tag FROM entries e JOIN entry_properties p ON p.entry_id = e.id JOIN entry_tags t ON t.entry_id = e.id WHERE e.file_id = 'f-7'")
def _(s, spark, d):
    e = s.entries.filter("file_id = 'f-7'").select("id")
    return e.join(s.entry_properties, F.col("id") == F.col("entry_id")).drop("entry_id").join(s.entry_tags, F.col("id") == F.col("entry_id")).select("id", "name", "value", "tag").distinct()


@query("dump_ordered", "SELECT id, path, title FROM files ORDER BY id LIMIT 100")
def _(s, spark, d):
    return s.files.select("id", "path", "title").orderBy("id").limit(100)


@query("closure", "SELECT entry_id, ancestor_id, n - pos AS distance FROM ancestors")
def _(s, spark, d):
    return s.ancestors


@query("path_build", "SELECT DISTINCT id, array_to_string(path, '/') AS path FROM entries")
def _(s, spark, d):
    return tree.build_paths(s.entries).select("id", F.array_join("path", "/").alias("path"))


@query("breadcrumb", "SELECT entry_id, string_agg(title, ' > ' ORDER BY pos) AS breadcrumb FROM (SELECT DISTINCT a.entry_id, a.pos, e.title FROM ancestors a JOIN entries e ON e.id = a.ancestor_id) GROUP BY entry_id")
def _(s, spark, d):
    return tree.breadcrumbs(s)


@query(
    "prop_inherit",
    """SELECT entry_id, name, value, false AS inherited FROM entry_properties
    UNION ALL SELECT e.id, f.name, f.value, true FROM (SELECT DISTINCT id, file_id FROM entries) e JOIN file_properties f ON f.file_id = e.file_id
    WHERE f.name IN ('COLUMNS', 'CATEGORY', 'ARCHIVE', 'LOGGING') AND NOT EXISTS (SELECT 1 FROM entry_properties p WHERE p.entry_id = e.id AND lower(p.name) = lower(f.name))""",
)
def _(s, spark, d):
    return tree.inherit_properties(s)


@query(
    "effective_tags",
    """SELECT entry_id, tag, bool_and(up) AS inherited FROM (SELECT entry_id, tag, false AS up FROM entry_tags
    UNION ALL SELECT a.entry_id, t.tag, true FROM ancestors a JOIN entry_tags t ON t.entry_id = a.ancestor_id) GROUP BY entry_id, tag""",
)
def _(s, spark, d):
    return tree.effective_tags(s)


@query(
    "preorder",
    """SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY key, id) - 1 AS preorder FROM (
    SELECT e.file_id, e.id, list(p.position ORDER BY e.k) AS key FROM (SELECT DISTINCT file_id, id, unnest(path) AS step, generate_subscripts(path, 1) AS k FROM entries) e
    JOIN (SELECT file_id, id, min(position) AS position FROM entries GROUP BY ALL) p ON p.id = e.step AND p.file_id = e.file_id GROUP BY e.file_id, e.id)""",
)
def _(s, spark, d):
    return tree.preorder(s.entries)


@query(
    "tree_nest",
    """, lv AS (SELECT file_id, id, parent_id, depth, position, '{"position":' || position || ',"id":"' || id || '","title":"' || title || '"' || coalesce(',"keyword":"' || keyword_value || '"', '') AS own FROM entries),
    k3 AS (SELECT file_id, parent_id, string_agg(own || '}', ',' ORDER BY position, id, own || '}') AS kids FROM lv WHERE depth = 3 GROUP BY ALL),
    t2 AS (SELECT l.*, own || coalesce(',"children":[' || kids || ']', '') || '}' AS tree FROM lv l LEFT JOIN k3 k ON k.file_id = l.file_id AND k.parent_id = l.id WHERE depth = 2),
    k2 AS (SELECT file_id, parent_id, string_agg(tree, ',' ORDER BY position, id, tree) AS kids FROM t2 GROUP BY ALL)
    SELECT l.file_id, l.id, own || coalesce(',"children":[' || kids || ']', '') || '}' AS tree FROM lv l LEFT JOIN k2 k ON k.file_id = l.file_id AND k.parent_id = l.id WHERE depth = 1""",
)
def _(s, spark, d):
    return tree.nest(s)


@query("any_property_keyword", "SELECT DISTINCT e.id, coalesce(p.value, e.keyword_value) AS value FROM entries e LEFT JOIN entry_properties p ON p.entry_id = e.id AND lower(p.name) = 'todo' WHERE coalesce(p.value, e.keyword_value) IS NOT NULL")
def _(s, spark, d):
    return tree.any_property(s, "TODO").distinct()


@query("any_property_file", "SELECT DISTINCT e.id, f.path AS value FROM entries e JOIN files f ON f.id = e.file_id")
def _(s, spark, d):
    return tree.any_property(s, "FILE")


@query(
    "state_transitions",
    """SELECT entry_id, position, to_keyword, lag(to_keyword) OVER (PARTITION BY entry_id ORDER BY position DESC) AS before, time_day, time_start FROM entry_log_entries WHERE log_type = 'state'""",
)
def _(s, spark, d):
    return tree.state_history(s)


# -- tallies -----------------------------------------------------------------------------------


@query(
    "histograms",
    """SELECT 'keyword' AS kind, coalesce(keyword_value, '<plain>') AS value, count(*) AS n FROM entries GROUP BY ALL
    UNION ALL SELECT 'tag', tag, count(*) FROM entry_tags GROUP BY ALL
    UNION ALL SELECT 'priority', priority, count(*) FROM entries WHERE priority IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'property', name, count(*) FROM (SELECT name FROM entry_properties UNION ALL SELECT name FROM file_properties) GROUP BY ALL
    UNION ALL SELECT 'log', log_type, count(*) FROM entry_log_entries GROUP BY ALL
    UNION ALL SELECT 'stamp', stamp_type, count(*) FROM entry_stamps GROUP BY ALL""",
)
def _(s, spark, d):
    return stats.histograms(s)


@query(
    "block_histograms",
    testbed.BLOCKS_SQL + "SELECT 'verb' AS kind, verb AS value, count(*) AS n FROM entries2 WHERE verb IS NOT NULL GROUP BY ALL UNION ALL SELECT 'drawer', drawer_name, count(*) FROM blocks2 WHERE drawer_name IS NOT NULL GROUP BY ALL",
)
def _(s, spark, d):
    """Verbs and drawers, of the store that has some."""
    return stats.histograms(testbed.with_blocks(spark, d)).filter("kind in ('verb', 'drawer')")


@query("file_sizes", "SELECT count(*) AS files, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, coalesce(sum(strlen(text)), 0)::BIGINT / 1048576.0::DOUBLE AS mb FROM documents", head="")
def _(s, spark, d):
    return stats.sizes(spark.read.parquet(f"{d}/documents.parquet").select(F.col("text").alias("content")))


@query("stats_scalars", "SELECT (SELECT count(*) FROM files) AS files, count(*) AS entries, count(keyword_value) AS items, count(*) FILTER (keyword_type = 'open') AS open, count(keyword_value) - count(*) FILTER (keyword_type = 'open') AS closed FROM entries")
def _(s, spark, d):
    return stats.scalars(s)


@query("duplicates", "SELECT parent_id, title, count(*) AS n FROM entries GROUP BY ALL HAVING count(*) > 1")
def _(s, spark, d):
    return stats.duplicates(s.entries, "parent_id", "title")


@query("id_map", "SELECT id, count(*) AS n, count(DISTINCT file_id) AS files FROM entries GROUP BY id")
def _(s, spark, d):
    return stats.id_map(s)


@query("dangling_links", "SELECT entry_id, target FROM entry_links k WHERE link_type = 'id' AND NOT EXISTS (SELECT 1 FROM entries e WHERE lower(e.id) = lower(k.target))")
def _(s, spark, d):
    return stats.dangling_links(s)


_COMBINED = """SELECT e.entry_id, md5(concat_ws(chr(10), b.x, e.title, t.x, k.x, y.x, l.x, p.x)) AS hash FROM (SELECT id AS entry_id, string_agg(title, ' ' ORDER BY title) AS title FROM (SELECT DISTINCT id, title FROM entries) GROUP BY id) e
    LEFT JOIN (SELECT entry_id, string_agg(title, ' > ' ORDER BY pos) AS x FROM (SELECT DISTINCT a.entry_id, a.pos, e.title FROM ancestors a JOIN entries e ON e.id = a.ancestor_id) GROUP BY entry_id) b USING (entry_id)
    LEFT JOIN (SELECT entry_id, string_agg(tag, ' ' ORDER BY tag) AS x FROM entry_tags GROUP BY entry_id) t USING (entry_id)
    LEFT JOIN (SELECT entry_id, string_agg(category, ' ' ORDER BY category) AS x FROM entry_categories GROUP BY entry_id) k USING (entry_id)
    LEFT JOIN (SELECT entry_id, string_agg(content, chr(10) ORDER BY position) AS x FROM entry_body_blocks GROUP BY entry_id) y USING (entry_id)
    LEFT JOIN (SELECT entry_id, string_agg(content, chr(10) ORDER BY log_position, position) AS x FROM entry_log_bodies GROUP BY entry_id) l USING (entry_id)
    LEFT JOIN (SELECT entry_id, string_agg(name || ': ' || value, chr(10) ORDER BY name) AS x FROM entry_properties GROUP BY entry_id) p USING (entry_id)"""


@query("combined_text_md5", _COMBINED)
def _(s, spark, d):
    return stats.combined_text(s).select("entry_id", "hash")


@query("log_notes", "SELECT e.id, l.log_type, l.time_day, b.content FROM entry_log_entries l JOIN entry_log_bodies b ON b.log_id = l.id JOIN entries e ON e.id = l.entry_id")
def _(s, spark, d):
    log = s.entry_log_entries.select(F.col("id").alias("log_id"), "log_type", "time_day").join(s.entry_log_bodies.select("log_id", "entry_id", "content"), "log_id")
    return log.join(s.entries.select("id"), F.col("entry_id") == F.col("id")).select("id", "log_type", "time_day", "content")


@query("file_groups", "SELECT file_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM entries GROUP BY file_id")
def _(s, spark, d):
    return s.entries.groupBy("file_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))

# -- scalar functions --------------------------------------------------------------------------


@query("slugify", "SELECT e.id, regexp_replace(regexp_replace(translate(replace(replace(lower(title || ' it''s Übermut!'), '''', ''), '`', ''), 'áíú', 'aiu'), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM entries e")
def _(s, spark, d):
    return s.entries.select("id", fn.slug(F.concat("title", F.lit(" it's Übermut!"))).alias("slug"))


@query("time_text", "SELECT entry_id, stamp_type, CASE WHEN time_kind = 'active' THEN '<' ELSE '[' END || strftime(DATE '1858-11-17' + day::INT, '%Y-%m-%d %a') || CASE WHEN time_kind = 'active' THEN '>' ELSE ']' END AS written FROM entry_stamps")
def _(s, spark, d):
    none = F.lit(None).cast("int")
    return s.entry_stamps.select("entry_id", "stamp_type", fn.show_time(F.col("day"), none, none, F.col("time_kind") == "active", F.lit(None).cast("string")).alias("written"))


@query("clock_text", "SELECT id, lpad((duration_minutes // 60)::VARCHAR, 2, ' ') || ':' || lpad((duration_minutes % 60)::VARCHAR, 2, '0') AS duration, lpad((time_start // 60)::VARCHAR, 2, '0') || ':' || lpad((time_start % 60)::VARCHAR, 2, '0') AS at FROM entry_log_entries WHERE log_type = 'clock'")
def _(s, spark, d):
    return s.entry_log_entries.filter("log_type = 'clock'").select("id", fn.show_duration(F.col("duration_minutes")).alias("duration"), fn.clock(F.col("time_start")).alias("at"))


@query("compact_time", "SELECT entry_id, stamp_type, day, (day * 7) % 1440 AS minute FROM entry_stamps")
def _(s, spark, d):
    minute = (F.col("day") * 7) % 1440
    text = F.concat(F.date_format(F.date_from_unix_date(F.col("day") - 40587), "yyyyMMdd"), F.format_string("%02d%02d", F.floor(minute / 60), minute % 60), F.lit("59"))
    return s.entry_stamps.select("entry_id", "stamp_type", fn.compact_time(text).alias("t")).select("entry_id", "stamp_type", "t.*")


@query(
    "link_extract",
    """SELECT l_orderkey, l_linenumber, l_partkey, k.kind AS link_type, k.target, k.descr AS description FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
    LATERAL (SELECT 'https' AS kind, 'https://x.example/' || l_partkey AS target, 'part ' || l_partkey AS descr UNION ALL SELECT 'id', 's-' || l_suppkey, NULL UNION ALL SELECT 'unknown', 'notes', 'n') k""",
)
def _(s, spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    text = F.concat(F.lit("see [[https://x.example/"), "l_partkey", F.lit("][part "), "l_partkey", F.lit("]] and [[id:s-"), "l_suppkey", F.lit("]], [[notes][n]]"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(fn.links(text)).alias("k")).select("l_orderkey", "l_linenumber", "l_partkey", "k.*")


@query("filename_parts", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS date, 'order ' || o_orderkey AS slug, lower(o_orderstatus) || ',' || left(o_orderpriority, 1) AS tags, 'org' AS ext FROM orders")
def _(s, spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-order "), "o_orderkey", F.lit(" ["), F.lower("o_orderstatus"), F.lit(" "), F.substring("o_orderpriority", 1, 1), F.lit("].org"))
    p = o.select("o_orderkey", fn.file_name_parts(name).alias("p"))
    return p.select("o_orderkey", "p.date", "p.slug", F.array_join("p.tags", ",").alias("tags"), "p.ext")


@query("tag_strings", "SELECT entry_id, '::' || string_agg(tag, ':' ORDER BY tag) || ':' AS written, string_agg(tag, ',' ORDER BY tag) AS listed FROM entry_tags GROUP BY entry_id")
def _(s, spark, d):
    written = fn.tag_string(F.sort_array(F.collect_list("tag")))
    return s.entry_tags.groupBy("entry_id").agg(written.alias("written")).withColumn("listed", F.array_join(fn.tag_list(F.col("written")), ","))


@query("chunk_text")
def _(s, spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.posexplode(fn.chunks(F.col("text"), 2000)).alias("position", "chunk"))


@query("path_labels", "SELECT id, replace(id, '-', '_') AS label FROM entries")
def _(s, spark, d):
    return s.entries.select("id", fn.path_label(F.col("id")).alias("label"))


@query("csv_rows", "SELECT id || ',' || depth || ',\"' || title || ', \"\"' || id || '\"\"\"' AS row FROM entries")
def _(s, spark, d):
    title = fn.csv_field(F.concat("title", F.lit(', "'), "id", F.lit('"')))
    return s.entries.select(F.concat_ws(",", "id", "depth", title).alias("row"))


@query("teaser", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> '')[1:60], ' ') AS teaser FROM documents")
def _(s, spark, d):
    html = F.concat(F.lit("<p><strong>"), F.col("text"), F.lit("</strong></p><img src='x'>"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", fn.teaser(html).alias("teaser"))


@query("urls", "SELECT page_id, replace(url, '/', '!') AS mangled, regexp_replace(regexp_replace(url, '[?#].*$', '') || '/index.html', '/index\\.html$', '/') AS clean FROM pages")
def _(s, spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", fn.mangle(F.col("url")).alias("mangled"), fn.clean_url(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/index.html"))).alias("clean"))


@query("routes", "SELECT e.id, strftime(DATE '1858-11-17' + s.day::INT, '%Y/%m/') || lower(replace(e.title, ' ', '-')) || '/index.html' AS route FROM entries e JOIN entry_stamps s ON s.entry_id = e.id WHERE s.stamp_type = 'scheduled'")
def _(s, spark, d):
    return s.entries.join(s.entry_stamps.filter("stamp_type = 'scheduled'"), F.col("id") == F.col("entry_id")).select("id", fn.route(F.col("day"), fn.slug(F.col("title"))).alias("route"))


@query("line_columns", "SELECT doc_id, length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(string_split(before, chr(10))[-1]) + 1 AS col FROM (SELECT doc_id, left(text, length(text) // 2) AS before FROM documents)")
def _(s, spark, d):
    p = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", fn.line_and_column(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("p"))
    return p.select("doc_id", "p.*")


@query("hashes", "SELECT id, md5('+' || id || chr(0) || coalesce('+' || keyword_value, '-') || chr(0) || '+' || title) AS hash FROM entries")
def _(s, spark, d):
    return s.entries.select("id", fn.entry_hash(F.col("id"), F.col("keyword_value"), F.col("title")).alias("hash"))


@query("aligned", "SELECT DISTINCT e.id, '** ' || e.title || repeat(' ', greatest(2, 60 - length(e.title) - 3 - length(t.tag) - 2)) || ':' || t.tag || ':' AS line FROM entries e JOIN entry_tags t ON t.entry_id = e.id WHERE e.depth = 2")
def _(s, spark, d):
    e = s.entries.filter("depth = 2").join(s.entry_tags, F.col("id") == F.col("entry_id"))
    return e.select("id", fn.align_right(F.concat(F.lit("** "), "title"), F.concat(F.lit(":"), "tag", F.lit(":")), 60).alias("line")).distinct()

# -- rules, vectors, loading, sinks --------------------------------------------------------------

from .operators import fulltext, lint, similarity, sync, tags as tag_ops, vector_index  # noqa: E402
from .sinks import graph, review, site, text  # noqa: E402
from .sources import outline_text, stored  # noqa: E402
from .storage import materialize, shared_path  # noqa: E402
from .streaming import clocked  # noqa: E402

_LINT_SQL = {
    "DuplicateIdentifier": "SELECT NULL AS file_id, id AS entry_id, 'ERROR' AS severity, 'DuplicateIdentifier' AS code, count(*)::VARCHAR AS arg FROM entries GROUP BY id HAVING count(*) > 1",
    "TodoMismatch": "SELECT file_id, NULL, 'WARN', 'TodoMismatch', 'untagged' FROM entries GROUP BY file_id HAVING bool_or(keyword_type = 'open')",
    "TodoMissingCreated": "SELECT NULL, id, 'WARN', 'TodoMissingCreated', keyword_value FROM (SELECT DISTINCT id, keyword_value FROM entries) WHERE keyword_value IS NOT NULL OR id IN (SELECT entry_id FROM entry_categories WHERE is_explicit)",
    "TodoMissingId": "SELECT NULL, id, 'WARN', 'TodoMissingId', keyword_value FROM (SELECT DISTINCT id, keyword_value FROM entries) WHERE keyword_value IS NOT NULL OR id IN (SELECT entry_id FROM entry_categories WHERE is_explicit)",
    "CategoryTooLong": "SELECT NULL, entry_id, 'WARN', 'CategoryTooLong', category FROM entry_categories WHERE length(category) > 10",
    "DuplicateTag": "SELECT NULL, entry_id, 'ERROR', 'DuplicateTag', tag FROM entry_tags GROUP BY entry_id, tag HAVING count(*) > 1",
    "StampOnPlainEntry": "SELECT NULL, id, 'WARN', 'StampOnPlainEntry', NULL FROM entries e WHERE keyword_value IS NULL AND EXISTS (SELECT 1 FROM entry_stamps s WHERE s.entry_id = e.id AND s.stamp_type <> 'active')",
    "FileIdMissing": "SELECT id, NULL, 'INFO', 'FileIdMissing', NULL FROM files",
}


@query("lint_union", " UNION ALL ".join(_LINT_SQL.values()))
def _(s, spark, d):
    return lint.lint(s, codes=tuple(_LINT_SQL))


_ORDER_SQL = "SELECT NULL AS file_id, entry_id, 'WARN' AS severity, 'StateChangeTimeOrder' AS code, position::VARCHAR AS arg FROM (SELECT *, lag(time_day * 1440 + time_start) OVER (PARTITION BY entry_id ORDER BY position DESC) AS before FROM entry_log_entries WHERE log_type = 'state') WHERE time_day * 1440 + time_start < before"
_DANGLING_SQL = "SELECT NULL AS file_id, entry_id, 'ERROR' AS severity, 'DanglingIdLink' AS code, target AS arg FROM entry_links k WHERE link_type = 'id' AND NOT EXISTS (SELECT 1 FROM entries e WHERE lower(e.id) = lower(k.target))"
#: The other rules that this store breaks: names of files are numbers, titles aren't.
_MORE_SQL = [_ORDER_SQL, _DANGLING_SQL, "SELECT id, NULL, 'INFO', 'FileSlugMismatch', title FROM files", "SELECT id, NULL, 'INFO', 'FileCreatedMissing', NULL FROM files WHERE NOT regexp_matches(path, '/[0-9]{8}[^/]*$')"]


@query("lint_all", f"SELECT severity, code, count(*) AS n FROM ({' UNION ALL '.join([*_LINT_SQL.values(), *_MORE_SQL])}) GROUP BY ALL")
def _(s, spark, d):
    return lint.lint(s).groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("lint_state_time_order", _ORDER_SQL)
def _(s, spark, d):
    return lint.lint(s, codes=("StateChangeTimeOrder",))


@query("lint_dangling", _DANGLING_SQL)
def _(s, spark, d):
    return lint.lint(s, codes=("DanglingIdLink",))


@query(
    "broken_links",
    """, said AS (SELECT o_orderkey, 'nation_' || o_orderkey % 25 || '/' || o_orderkey % 400 || '.org' AS link FROM orders)
    SELECT NULL AS file_id, 'o-' || o_orderkey AS entry_id, 'ERROR' AS severity, 'BrokenFileLink' AS code, '../' || link AS arg FROM said WHERE 'customers/' || link NOT IN (SELECT path FROM files)
    UNION ALL SELECT id, NULL, 'ERROR', 'BrokenFileLink', 'none/' || title FROM files
    UNION ALL SELECT NULL, 'o-' || o_orderkey, 'ERROR', 'BrokenFileLink', 'gone.txt' FROM orders WHERE o_orderkey % 10 = 3""",
)
def _(s, spark, d):
    """Orders link to files of other folders, some of which exist, to the folder above, and by the property URL; files have a
    link in their preamble."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("o-"), "o_orderkey").alias("entry_id"))
    said = F.concat(F.lit("see [[https://x.example]], [[file:../nation_"), F.col("o_orderkey") % 25, F.lit("/"), F.col("o_orderkey") % 400, F.lit(".org::*x][a]] and [[file:./x//../..]]"))
    body = o.select("entry_id", F.lit(0).alias("position"), F.lit("paragraph").alias("block_type"), said.alias("content"), F.lit(None).cast("string").alias("drawer_name"))
    urls = o.filter("o_orderkey % 10 = 3").select("entry_id", F.lit("URL").alias("name"), F.lit("[[file:gone.txt]]").alias("value"), F.lit(2).alias("position"))
    files = s.files.withColumn("preamble", F.concat(F.lit("#+begin_src\n[[file:no/link]]\n#+end_src\n[[file:none/"), "title", F.lit("][x]]")))
    return lint.lint(replace(s, files=files, entry_body_blocks=body, entry_properties=s.entry_properties.unionByName(urls)), codes=("BrokenFileLink",))


_QUERY_VECTOR = [((i * 37) % 11 - 5) / 10 for i in range(64)]
_DISTANCE = "1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query(
    "topk_similar",
    f"SELECT entry_id, chunk_text, round(distance, 6) AS distance FROM (SELECT entry_id, chunk_text, distance, row_number() OVER (PARTITION BY entry_id ORDER BY distance, chunk_position) AS r FROM (SELECT *, {_DISTANCE.format(a='embedding::DOUBLE[]', b=str(_QUERY_VECTOR) + '::DOUBLE[]')} AS distance FROM entry_embeddings)) WHERE r = 1 ORDER BY distance, entry_id LIMIT 5",
)
def _(s, spark, d):
    return similarity.search(s, _QUERY_VECTOR, 5).withColumn("distance", F.round("distance", 6))


@query("topk_by_lists", SQL["topk_similar"].removeprefix(testbed.SQL))
def _(s, spark, d):
    """The same from inverted lists on disk, as many as it takes to be sure."""
    folder = shared_path(spark, "vector-lists")
    vector_index.write(s.entry_embeddings, folder)
    return vector_index.search(spark, folder, _QUERY_VECTOR, 5)[0].withColumn("distance", F.round("distance", 6))


@query(
    "best_chunk",
    f"SELECT entry_id, min_by(chunk_position, distance) AS chunk_position FROM (SELECT *, {_DISTANCE.format(a='embedding::DOUBLE[]', b=str(_QUERY_VECTOR) + '::DOUBLE[]')} AS distance FROM entry_embeddings) GROUP BY entry_id",
)
def _(s, spark, d):
    e = s.entry_embeddings.withColumn("distance", fn.cosine_distance(F.col("embedding"), F.array(*[F.lit(x) for x in _QUERY_VECTOR])))
    return e.groupBy("entry_id").agg(F.min_by("chunk_position", "distance").alias("chunk_position"))


def _open_titles(s, spark, d):
    """Open entries with a vector of their title; the title is the group, as like titles are no pair."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("o-"), "vec_id").alias("id"), F.col("embedding").alias("v"))
    return s.entries.filter("keyword_type = 'open'").select("id", F.col("title").alias("grp")).join(e, "id")


_TITLES = "SELECT e.id, e.title, v.embedding::DOUBLE[] AS v FROM entries e JOIN embeddings v ON e.id = 'o-' || v.vec_id WHERE e.keyword_type = 'open'"
_PAIRS = f"SELECT a, b, d AS distance FROM (SELECT x.id AS a, y.id AS b, {_DISTANCE.format(a='x.v', b='y.v')} AS d FROM ({_TITLES}) x JOIN ({_TITLES}) y ON x.id < y.id AND x.title <> y.title) WHERE d < 0.65 ORDER BY d, a, b LIMIT 1000"


@query("review_pairs", f"SELECT a, b, round(distance, 6) AS distance FROM ({_PAIRS})")
def _(s, spark, d):
    return similarity.similar_pairs(_open_titles(s, spark, d), 0.65, 1000).withColumn("distance", F.round("distance", 6))


@query(
    "review_clusters",
    f"""SELECT id, cluster, round(distance, 6) AS distance FROM (WITH RECURSIVE p AS MATERIALIZED ({_PAIRS}), g AS MATERIALIZED (SELECT a AS x, b AS y, distance FROM p UNION ALL SELECT b, a, distance FROM p),
    r AS (SELECT DISTINCT x AS id, x AS at FROM g UNION SELECT r.id, g.y FROM r JOIN g ON g.x = r.at)
    SELECT r.id, min(r.at) AS cluster, any_value(n.distance) AS distance FROM r JOIN (SELECT x, min(distance) AS distance FROM g GROUP BY x) n ON n.x = r.id GROUP BY r.id)""",
)
def _(s, spark, d):
    return similarity.clusters(similarity.similar_pairs(_open_titles(s, spark, d), 0.65, 1000)).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query("cluster_sizes", f"SELECT cluster, count(*) AS n, round(min(distance), 6) AS distance FROM ({SQL['review_clusters'].removeprefix(testbed.SQL)}) GROUP BY cluster")
def _(s, spark, d):
    return similarity.nearest_group(similarity.similar_pairs(_open_titles(s, spark, d), 0.65, 1000)).withColumn("distance", F.round("distance", 6))


_GROUPS = f"""SELECT dense_rank() OVER (ORDER BY least, cluster) AS grp, least, id, distance, path AS file, keyword_value AS keyword, e.title FROM (SELECT *, min(distance) OVER (PARTITION BY cluster) AS least FROM
    ({SQL['review_clusters'].removeprefix(testbed.SQL).replace('round(distance, 6) AS distance', 'distance', 1)})) JOIN (SELECT DISTINCT id, file_id, keyword_value, title FROM entries) e USING (id) JOIN files f ON f.id = e.file_id"""


def _review(s, spark, d):
    return review.groups(similarity.similar_pairs(_open_titles(s, spark, d), 0.65, 1000), s)


@query("review_text", f"SELECT grp::INT AS grp, 'Group ' || grp || ' (distance: ' || round(least, 3) || '):' || chr(10) || string_agg('  ' || file || ':0 ' || keyword || ' ' || title, chr(10) ORDER BY id) AS line FROM ({_GROUPS}) GROUP BY grp, least")
def _(s, spark, d):
    return review.text(_review(s, spark, d))


@query(
    "review_json",
    f"""SELECT grp::INT AS grp, '{{"group":' || grp || ',"min_distance":' || round(least, 6) || ',"entries":[' || string_agg('{{"id":"' || id || '","file":"' || file || '","title":"' || title || '","keyword":"' || keyword || '","distance":' || round(distance, 6) || '}}', ',' ORDER BY id) || ']}}' AS line FROM ({_GROUPS}) GROUP BY grp, least""",
)
def _(s, spark, d):
    return review.json(_review(s, spark, d), 6)


@query("review_csv", f"SELECT concat_ws(',', grp, file, id, keyword, title, round(distance, 6)) AS line FROM ({_GROUPS})")
def _(s, spark, d):
    return review.csv(_review(s, spark, d), 6)


@query("embed_candidates", f"SELECT c.entry_id, c.hash FROM ({_COMBINED}) c JOIN (SELECT DISTINCT id, depth FROM entries) e ON e.id = c.entry_id WHERE e.depth = 3 OR (e.depth = 2 AND right(c.entry_id, 1) IN ('1', '2'))")
def _(s, spark, d):
    """Nothing of depth 3 was embedded, and some orders have changed since."""
    t = stats.combined_text(s).select("entry_id", "hash").join(s.entries.select(F.col("id").alias("entry_id"), "depth").distinct(), "entry_id")
    done = t.filter("depth < 3").select("entry_id", F.when((F.col("depth") == 2) & F.right("entry_id", F.lit(1)).isin("1", "2"), F.md5(F.lit("old"))).otherwise(F.col("hash")).alias("embedded_hash"))
    return similarity.candidates(t.drop("depth"), done)


@query("entry_chunks")
def _(s, spark, d):
    return similarity.entry_chunks(s, 2000)


def _versions(spark, d):
    """The orders as files: the store has the older half, with times and hashes of its own."""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("k", F.col("o_orderkey") % 6)
    path = F.concat(F.lit("orders/"), "o_orderkey", F.lit(".org"))
    files = o.filter("k <> 5").select(path.alias("path"), F.col("o_orderdate").alias("mod_time"), F.md5("o_orderstatus").alias("hash"))
    old = F.when(F.col("k") == 2, F.col("o_orderdate") + F.expr("interval 1 day")).when(F.col("k") == 3, F.col("o_orderdate")).otherwise(F.col("o_orderdate") - F.expr("interval 1 day"))
    stored = o.filter("k <> 1").select(path.alias("path"), old.alias("mod_time"), F.when(F.col("k") == 4, F.md5("o_orderstatus")).otherwise(F.lit("x")).alias("hash"))
    return files, stored


@query("sync_classify", "SELECT 'orders/' || o_orderkey || '.org' AS path, CASE o_orderkey % 6 WHEN 0 THEN 'update' WHEN 1 THEN 'insert' WHEN 2 THEN 'conflict' WHEN 3 THEN 'skip' WHEN 4 THEN 'skip' ELSE 'delete' END AS action FROM orders", head="")
def _(s, spark, d):
    return sync.classify_files(*_versions(spark, d))


@query(
    "sync_report",
    "SELECT count(*) FILTER (o_orderkey % 6 <> 5) AS processed, count(*) FILTER (o_orderkey % 6 IN (0, 1)) AS updated, count(*) FILTER (o_orderkey % 6 IN (3, 4)) AS skipped, count(*) FILTER (o_orderkey % 6 = 5) AS deleted, count(*) FILTER (o_orderkey % 6 = 2) AS conflicts FROM orders",
    head="",
)
def _(s, spark, d):
    return sync.report(sync.classify_files(*_versions(spark, d)))


@query(
    "merged_reports",
    "SELECT count(*) FILTER (o_orderkey % 6 <> 5) AS processed, count(*) FILTER (o_orderkey % 6 IN (0, 1)) AS updated, count(*) FILTER (o_orderkey % 6 IN (3, 4)) AS skipped FROM orders",
    head="",
)
def _(s, spark, d):
    """The reports of two runs, one over each half of the orders, added up."""
    files, stored = _versions(spark, d)
    odd = lambda df: F.pmod(F.xxhash64("path"), F.lit(2))
    reports = [sync.report(sync.classify_files(files.filter(odd(files) == k), stored.filter(odd(stored) == k))) for k in (0, 1)]
    return stats.merge_counters(reports[0].unionByName(reports[1]), "processed", "updated", "skipped")


@query(
    "incremental_diff",
    "SELECT id, CASE WHEN o_orderkey % 4 = 1 THEN 'insert' WHEN o_orderkey % 4 = 2 THEN 'delete' ELSE 'update' END AS action FROM (SELECT 'o-' || o_orderkey AS id, o_orderkey FROM orders) WHERE o_orderkey % 4 > 0",
    head="",
)
def _(s, spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("o-"), "o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("k"), F.md5("o_orderpriority").alias("hash"))
    old = o.filter("k <> 1").select("id", F.when(F.col("k") == 3, "x").otherwise(F.col("hash")).alias("hash"))
    return sync.diff_entries(o.filter("k <> 2"), old)


@query("upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS seq FROM orders", head="")
def _(s, spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return sync.upsert(o.select("id", F.lit("old").alias("version"), F.lit(1).alias("seq")), o.filter("id % 3 = 0").select("id", F.lit("new").alias("version"), F.lit(2).alias("seq")))


@query("stale_ids", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0", head="")
def _(s, spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return sync.stale(o, o.filter("id % 5 > 0"))


def _tagged(s):
    return s.entry_tags.groupBy(F.col("entry_id").alias("item")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))


@query("tag_expr", "SELECT entry_id AS item FROM (SELECT entry_id, list(DISTINCT tag) AS tags FROM entry_tags GROUP BY entry_id) WHERE (list_contains(tags, 'r') OR list_contains(tags, 'urgent')) AND NOT list_contains(tags, 'a')")
def _(s, spark, d):
    v = tag_ops.var
    return tag_ops.matching(_tagged(s), tag_ops.all_of(tag_ops.any_of(v("r"), v("urgent")), tag_ops.no(v("a")))).select("item")


@query(
    "tag_combinations",
    "SELECT DISTINCT x.entry_id AS item, x.tag || '/' || y.tag AS path FROM entry_tags x JOIN entry_tags y ON x.entry_id = y.entry_id AND x.tag <> y.tag UNION ALL SELECT DISTINCT entry_id, tag FROM entry_tags",
)
def _(s, spark, d):
    return tag_ops.combinations(_tagged(s), 2).select("item", F.array_join("path", "/").alias("path"))


@query("filter_links", "SELECT entry_id AS item, 'views/' || entry_id AS link FROM (SELECT entry_id, list(DISTINCT tag) AS tags FROM entry_tags GROUP BY entry_id) WHERE list_contains(tags, 'urgent')")
def _(s, spark, d):
    return tag_ops.filter_links(_tagged(s), tag_ops.var("urgent"), "views")


@query("tag_links", "SELECT DISTINCT entry_id AS item, 'tree/' || tag || '/' || entry_id AS link FROM entry_tags")
def _(s, spark, d):
    return tag_ops.tag_tree_links(_tagged(s), "tree", 1)


_RELATIONS = "SELECT DISTINCT parent_id AS source, id AS target, 'parent_child' AS relation FROM entries WHERE parent_id IS NOT NULL UNION ALL SELECT DISTINCT k.entry_id, e.id, 'link' FROM entry_links k JOIN entries e ON lower(k.target) = lower(e.id) WHERE k.link_type = 'id'"


@query("dot_edges", f"SELECT source, target, relation, CASE relation WHEN 'link' THEN 'blue' ELSE 'gray' END AS colour FROM ({_RELATIONS})")
def _(s, spark, d):
    return graph.edges(s)


@query("relations", _RELATIONS)
def _(s, spark, d):
    return graph.relations(s)


@query(
    "dot_lines",
    f"""SELECT 'subgraph "cluster_' || file_id || '" {{ ' || string_agg(x, ' ' ORDER BY x) || ' }}' AS line FROM (SELECT DISTINCT file_id, '"' || id || '" [label="' || title || '"];' AS x FROM entries WHERE id IN (SELECT source FROM ({_RELATIONS}) UNION ALL SELECT target FROM ({_RELATIONS}))) GROUP BY file_id
    UNION ALL SELECT '"' || source || '" -> "' || target || '" [' || CASE relation WHEN 'link' THEN 'color=blue, label="link"' ELSE 'color=gray, style=dotted' END || '];' FROM ({_RELATIONS})""",
)
def _(s, spark, d):
    return graph.dot_lines(s)


@query(
    "summary_lines",
    """SELECT e.id, concat_ws(chr(10), repeat('*', e.depth) || ' ' || e.title, ':PROPERTIES:', p.x, ':FILE: ' || f.path, ':KEYWORD: ' || e.keyword_value, ':PRIORITY: ' || e.priority, ':LOG_ENTRIES: ' || l.n, ':BODY_LEN: ' || b.n, ':TAGS: :' || t.x || ':', z.x, ':END:') AS line
    FROM (SELECT DISTINCT id, file_id, depth, title, keyword_value, priority FROM entries) e JOIN files f ON f.id = e.file_id
    LEFT JOIN (SELECT entry_id, string_agg(':' || name || ': ' || value, chr(10) ORDER BY position) AS x FROM entry_properties GROUP BY entry_id) p ON p.entry_id = e.id
    LEFT JOIN (SELECT entry_id, count(*) AS n FROM entry_log_entries GROUP BY entry_id) l ON l.entry_id = e.id
    LEFT JOIN (SELECT entry_id, sum(length(content)) AS n FROM entry_body_blocks GROUP BY entry_id) b ON b.entry_id = e.id
    LEFT JOIN (SELECT entry_id, string_agg(DISTINCT tag, ':' ORDER BY tag) AS x FROM entry_tags GROUP BY entry_id) t ON t.entry_id = e.id
    LEFT JOIN (SELECT entry_id, string_agg(x, chr(10) ORDER BY k, day) AS x FROM (SELECT entry_id, day, list_position(['closed', 'scheduled', 'deadline', 'active'], stamp_type) AS k,
      ':' || upper(stamp_type) || ': ' || CASE WHEN time_kind = 'active' THEN '<' ELSE '[' END || strftime(DATE '1858-11-17' + day::INT, '%Y-%m-%d %a') || CASE WHEN time_kind = 'active' THEN '>' ELSE ']' END AS x FROM entry_stamps) GROUP BY entry_id) z ON z.entry_id = e.id""",
)
def _(s, spark, d):
    return text.summary(s)


@query(
    "search_rows",
    """SELECT e.id, f.path || ':0 ' || e.keyword_value || ' ' || b.x || ' > ' || e.title || ' [title]' AS line FROM (SELECT DISTINCT id, file_id, title, keyword_value FROM entries WHERE keyword_value = 'WAIT') e JOIN files f ON f.id = e.file_id
    JOIN (SELECT entry_id, string_agg(title, ' > ' ORDER BY pos) AS x FROM (SELECT DISTINCT a.entry_id, a.pos, e.title FROM ancestors a JOIN entries e ON e.id = a.ancestor_id) GROUP BY entry_id) b ON b.entry_id = e.id""",
)
def _(s, spark, d):
    hits = q.select(s, q.todo("WAIT"), TODAY).select("id", F.lit("title").alias("source"))
    return text.search_rows(hits, s).select("id", "line")


@query(
    "cascade_delete",
    """SELECT 'files' AS part, count(*) AS n FROM files WHERE NOT contains(path, 'nation_3/') UNION ALL SELECT 'entries', count(*) FROM entries WHERE file_id NOT IN (SELECT id FROM files WHERE contains(path, 'nation_3/'))
    UNION ALL SELECT 'tags', count(*) FROM entry_tags WHERE entry_id NOT IN (SELECT id FROM entries WHERE file_id IN (SELECT id FROM files WHERE contains(path, 'nation_3/')))
    UNION ALL SELECT 'logs', count(*) FROM entry_log_entries WHERE entry_id NOT IN (SELECT id FROM entries WHERE file_id IN (SELECT id FROM files WHERE contains(path, 'nation_3/')))""",
)
def _(s, spark, d):
    left = sync.delete_files(s, s.files.filter(F.contains("path", F.lit("nation_3/"))))
    parts = {"files": left.files, "entries": left.entries, "tags": left.entry_tags, "logs": left.entry_log_entries}
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


@query("title_candidates", "SELECT DISTINCT id AS entry_id, title FROM entries WHERE keyword_type = 'open' AND id NOT IN (SELECT 'o-' || vec_id FROM embeddings)")
def _(s, spark, d):
    done = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("o-"), "vec_id").alias("entry_id"))
    return similarity.title_candidates(s, done, open_only=True)


@query("vector_marks", f"SELECT e.entry_id, coalesce(c.hash, 'old') AS embedded_hash FROM (SELECT DISTINCT entry_id FROM entry_embeddings) e LEFT JOIN (SELECT * FROM ({_COMBINED}) WHERE right(entry_id, 1) = '1') c ON c.entry_id = e.entry_id")
def _(s, spark, d):
    """Entries that end in 1 were embedded again; their marks are the hashes of their texts now."""
    hashes = s.entry_embeddings.select("entry_id", F.lit("old").alias("embedded_hash")).distinct()
    again = s.entry_embeddings.filter("entry_id like '%1'").join(stats.combined_text(s).select("entry_id", "hash"), "entry_id")
    return sync.store_vectors(s.entry_embeddings, hashes, again)[1]


@query("file_facts", "SELECT id AS file_id, title, lower(replace(title, '#', '-')) AS slug, NULL::INT AS stamp, NULL::INT AS created, contains(path, 'archive') AS archive FROM files")
def _(s, spark, d):
    return tree.file_facts(s)


@query(
    "body_space",
    """SELECT e.id AS entry_id, NULL AS lead, NULL AS trail, b.entry_id IS NULL AS empty FROM (SELECT DISTINCT id FROM entries) e LEFT JOIN (SELECT DISTINCT entry_id FROM entry_body_blocks) b ON b.entry_id = e.id""",
)
def _(s, spark, d):
    return tree.body_space(s)


@query(
    "file_dates",
    """SELECT 'w-' || o_orderkey AS file_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Order No. ' ELSE 'order ' END || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN 's' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'order-no-' ELSE 'order-' END END || o_orderkey AS slug,
    date_diff('day', DATE '1858-11-17', o_orderdate::DATE)::INT AS stamp, (date_diff('day', DATE '1858-11-17', o_orderdate::DATE) + CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 0 END)::INT AS created, o_orderkey % 7 = 0 AS archive FROM orders""",
    head="",
)
def _(s, spark, d):
    """Facts of files that have dates in their names, and some of them properties that say otherwise."""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("k", F.col("o_orderkey"))
    key = F.concat(F.lit("w-"), "k")
    name = F.concat(F.when(F.col("k") % 7 == 0, "archive/").otherwise("notes/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-order "), "k", F.lit(".org"))
    written = F.concat(F.lit("["), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 9), "yyyy-MM-dd EEE"), F.lit("]"))
    said = [("TITLE", 5, F.concat(F.lit("Order No. "), "k")), ("Slug", 3, F.concat(F.lit("s"), "k")), ("CREATED", 2, written)]
    props = F.array_compact(F.array(*[F.when(F.col("k") % n == 0, F.struct(F.lit(p).alias("name"), v.alias("value"), F.lit("file").alias("source"), F.lit(n).alias("position"))) for p, n, v in said]))
    files = o.select(key.alias("id"), name.alias("path"))
    return tree.file_facts(replace(s, files=files, file_properties=o.select(key.alias("file_id"), F.explode(props).alias("p")).select("file_id", "p.*")))


@query(
    "body_edges",
    """SELECT e.id AS entry_id, CASE WHEN k % 2 = 0 THEN repeat(chr(10), (k % 3)::INT) END AS lead, CASE WHEN k % 5 = 0 THEN '' END AS trail, k IS NULL AS empty FROM (SELECT DISTINCT id FROM entries) e LEFT JOIN (SELECT doc_id AS k FROM documents) ON id = 'c-' || k""",
)
def _(s, spark, d):
    """Bodies that begin or end with blank lines, or do not."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("int").alias("k"))
    block = lambda at, kind, content: F.struct(F.lit(at).alias("position"), F.lit(kind).alias("block_type"), content.alias("content"), F.lit(None).cast("string").alias("drawer_name"))
    lead = F.when(F.col("k") % 2 == 0, block(0, "whitespace", F.repeat(F.lit("\n"), F.col("k") % 3)))
    trail = F.when(F.col("k") % 5 == 0, block(2, "whitespace", F.lit("")))
    blocks = docs.select(F.concat(F.lit("c-"), "k").alias("entry_id"), F.explode(F.array_compact(F.array(lead, block(1, "paragraph", F.lit("x")), trail))).alias("b"))
    return tree.body_space(replace(s, entry_body_blocks=blocks.select("entry_id", "b.*")))


@query("instants", "SELECT entry_id, stamp_type, strftime(TIMESTAMP '1858-11-17' + to_days(day::INT) + to_minutes((day * 7) % 1440), '%Y-%m-%d %H:%M') AS at, day, (day * 7) % 1440 AS minute FROM entry_stamps WHERE stamp_type IN ('scheduled', 'deadline', 'closed')")
def _(s, spark, d):
    ts = fn.instant(F.col("day"), (F.col("day") * 7) % 1440)
    x = s.entry_stamps.filter(fn.is_leading(F.col("stamp_type"))).select("entry_id", "stamp_type", ts.alias("ts"))
    return x.select("entry_id", "stamp_type", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), fn.from_instant(F.col("ts")).alias("t")).select("entry_id", "stamp_type", "at", "t.*")


@query("json_documents", "SELECT e.id, e.file_id, e.title, t.x AS tags, p.n AS props FROM (SELECT DISTINCT ON (id) * FROM entries ORDER BY id, title, keyword_value NULLS FIRST) e LEFT JOIN (SELECT entry_id, string_agg(tag, ',' ORDER BY tag) AS x FROM entry_tags GROUP BY entry_id) t ON t.entry_id = e.id LEFT JOIN (SELECT entry_id, count(*) AS n FROM entry_properties GROUP BY entry_id) p ON p.entry_id = e.id")
def _(s, spark, d):
    """The store as JSON documents and back."""
    from .sources import documents

    got = documents.from_documents(documents.documents(s))
    tags = got.entry_tags.groupBy(F.col("entry_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))
    props = got.entry_properties.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("props"))
    return got.entries.select("id", "file_id", "title").join(tags, "id", "left").join(props, "id", "left")


@query("json_lines", """SELECT '{"id":"' || id || '","depth":' || depth || coalesce(',"keyword_value":"' || keyword_value || '"', '') || '}' AS line FROM entries""")
def _(s, spark, d):
    return text.json_lines(s.entries.select("id", "depth", "keyword_value"))


@query("print_text")
def _(s, spark, d):
    return text.file_texts(s)


@query(
    "round_trip",
    testbed.BLOCKS_SQL
    + """SELECT e.id, e.depth, e.parent_id, e.keyword_value, e.priority, e.title, t.x AS tags, p.x AS props, z.x AS stamps, l.x AS logs, y.x AS body FROM entries2 e
    LEFT JOIN (SELECT entry_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS x FROM entry_tags GROUP BY entry_id) t ON t.entry_id = e.id
    LEFT JOIN (SELECT entry_id, string_agg(name || '=' || value, ',' ORDER BY name) AS x FROM entry_properties GROUP BY entry_id) p ON p.entry_id = e.id
    LEFT JOIN (SELECT entry_id, string_agg(stamp_type || '=' || day, ',' ORDER BY stamp_type) AS x FROM (SELECT entry_id, stamp_type, min(day) AS day FROM entry_stamps GROUP BY ALL) GROUP BY entry_id) z ON z.entry_id = e.id
    LEFT JOIN (SELECT l.entry_id, string_agg(concat_ws('=', lpad(l.position::VARCHAR, 6, '0'), l.log_type, l.time_day, l.time_start, l.to_keyword, l.duration_minutes, n.content), ',' ORDER BY l.position) AS x
      FROM entry_log_entries l LEFT JOIN entry_log_bodies n ON n.log_id = l.id GROUP BY l.entry_id) l ON l.entry_id = e.id
    LEFT JOIN (SELECT entry_id, md5(string_agg(content, chr(10) ORDER BY position)) AS x FROM blocks2 GROUP BY entry_id) y ON y.entry_id = e.id""",
)
def _(s, spark, d):
    """The whole store, with blocks and inline tasks, written as text and read again. Entries that share an id keep their
    headings; what hangs on the id is written, and read, with each, so values are compared as sets."""
    got = outline_text.parse(materialize(text.file_texts(testbed.with_blocks(spark, d)), "printed")).store
    joined = lambda df, v, n: df.groupBy(F.col("entry_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(v)), ",").alias(n))
    e = got.entries.select("id", "depth", "parent_id", "keyword_value", "priority", "title")
    e = e.join(joined(got.entry_tags, F.col("tag"), "tags"), "id", "left")
    e = e.join(joined(got.entry_properties.filter("name <> 'ID'"), F.concat_ws("=", "name", "value"), "props"), "id", "left")
    notes = got.entry_log_bodies.select(F.col("log_id").alias("id"), "content")
    log = F.concat_ws("=", F.lpad(F.col("position").cast("string"), 6, "0"), "log_type", *[F.col(c).cast("string") for c in ("time_day", "time_start", "to_keyword", "duration_minutes", "content")])
    e = e.join(joined(got.entry_log_entries.join(notes, "id", "left"), log, "logs"), "id", "left")
    blocks = F.sort_array(F.collect_list(F.struct("position", "content")))
    body = got.entry_body_blocks.groupBy(F.col("entry_id").alias("id")).agg(F.md5(F.array_join(F.transform(blocks, lambda b: b["content"]), "\n")).alias("body"))
    return e.join(joined(got.entry_stamps, F.concat_ws("=", "stamp_type", "day"), "stamps"), "id", "left").join(body, "id", "left")


#: Documents as outlines: every fourth line of a text is a heading.
_OUTLINE_SQL = """WITH x AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
l AS (SELECT doc_id, n, n % 4 = 0 AS head, CASE WHEN n % 4 = 0 THEN '* H ' || n || ' ' || translate(line, ':{}[]#', '') ELSE '- ' || line END AS line FROM x),
p AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM l)
"""


def _outlines(spark, d):
    t = F.transform(F.split("text", "\n"), lambda x, n: F.when(n % 4 == 0, F.concat(F.lit("* H "), n, F.lit(" "), F.translate(x, ":{}[]#", ""))).otherwise(F.concat(F.lit("- "), x)))
    return spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".org")).alias("path"), F.array_join(t, "\n").alias("content"))


@query("byte_positions", "SELECT doc_id, byte_offset, 'H ' || n AS head FROM p WHERE head", head=_OUTLINE_SQL)
def _(s, spark, d):
    """Where the headings of outlines begin, in octets."""
    got = outline_text.parse(_outlines(spark, d)).store
    e = got.entries.join(got.files.select(F.col("id").alias("f"), F.col("path").alias("name")), F.col("file_id") == F.col("f"))
    return e.select(F.regexp_extract("name", "([0-9]+)", 1).cast("long").alias("doc_id"), "byte_offset", F.regexp_extract("title", "^(H [0-9]+)", 1).alias("head"))


@query(
    "store_updates",
    "SELECT doc_id, n, CASE WHEN doc_id % 3 = 0 THEN replace(left(line, 30), 'e', 'E') ELSE left(line, 30) END AS head FROM p WHERE head AND n = 0 AND NOT (doc_id % 3 = 2 AND doc_id % 5 = 0)",
    head=_OUTLINE_SQL,
)
def _(s, spark, d):
    """A store on disk after four updates: all outlines; a third changed, a third only touched; the same batch once more; some
    files gone."""
    first = _outlines(spark, d).withColumns({"mod_time": F.timestamp_seconds(F.lit(1000)), "k": F.regexp_extract("path", "([0-9]+)", 1).cast("long")})
    files = lambda df: df.withColumn("hash", F.md5("content")).select("path", "content", "mod_time", "hash")
    fs = stored.FileStore(spark, shared_path(spark, "file-store"))
    fs.update(files(first), ("documents", 0))
    later = first.filter("k % 3 < 2").withColumns({"mod_time": F.timestamp_seconds(F.lit(2000)), "content": F.when(F.col("k") % 3 == 0, F.replace("content", F.lit("e"), F.lit("E"))).otherwise(F.col("content"))})
    for _ in range(2):
        fs.update(files(later), ("documents", 1))
    fs.update(files(first).limit(0), ("documents", 2), listed=first.filter("not (k % 3 = 2 and k % 5 = 0)"))
    got = fs.store()
    e = got.entries.filter("byte_offset = 0").join(got.files.select(F.col("id").alias("f"), F.col("path").alias("name")), F.col("file_id") == F.col("f"))
    number = lambda c, p: F.regexp_extract(c, p, 1).cast("long")
    return e.select(number("name", "([0-9]+)").alias("doc_id"), number("headline", "^H ([0-9]+)").cast("int").alias("n"), F.substring(F.concat(F.lit("* "), "headline"), 1, 30).alias("head"))


@query("full_text", "SELECT id AS entry_id, 2.8::DOUBLE AS rank FROM entries WHERE starts_with(title, 'Order 77') OR starts_with(title, 'Customer#00000001')")
def _(s, spark, d):
    """Two searches of a written index, by other forms of the words and beginnings of numbers."""
    folder = shared_path(spark, "postings")
    fulltext.write_index(fulltext.index(s), folder)
    found = [fulltext.search(fulltext.read_index(spark, folder), t) for t in ("the ordering of 77", "customers 00000001")]
    return found[0].unionByName(found[1]).select("entry_id", F.round("rank", 6).alias("rank"))


@query("parse_blocks")
def _(s, spark, d):
    """Bodies, links and errors that the parser finds in the pages' text as it is."""
    p = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".org")).alias("path"), F.concat(F.lit("* TODO [#B] Doc "), "doc_id", F.lit("  :"), "lang", F.lit(":\n"), "text").alias("content"))
    got = outline_text.parse(p).store
    return got.entries.join(got.entry_body_blocks, F.col("id") == F.col("entry_id")).groupBy("title", "keyword_value", "priority").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"))


def _posts(spark, d):
    """Conversations as posts, dated by id, tagged by the roles that take part."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("conv_id") % 1500).cast("int"))
    tags = F.sort_array(F.concat(F.collect_set("role"), F.array(F.lit("site")), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("publish"))).otherwise(F.array().cast("array<string>"))))
    return c.groupBy("conv_id").agg(tags.alias("tags")).select(F.col("conv_id").alias("id"), "tags", day.alias("date"))


_POSTS_SQL = "WITH posts AS (SELECT conv_id AS id, list_concat(list(DISTINCT role), ['site'], CASE WHEN conv_id % 2 = 0 THEN ['publish'] ELSE [] END) AS tags, DATE '2020-01-01' + (conv_id % 1500)::INT AS date FROM conversations GROUP BY conv_id), pub AS (SELECT * FROM posts WHERE list_contains(tags, 'publish') AND date < DATE '2024-01-01')\n"


def _published(spark, d):
    return site.publishable(_posts(spark, d), "site", F.lit("2024-01-01").cast("date"))


@query("feed_top10", "SELECT id, strftime(date, '%Y-%m-%d') AS day FROM pub ORDER BY date DESC, id LIMIT 10", head=_POSTS_SQL)
def _(s, spark, d):
    return site.feed(_published(spark, d)).select("id", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query(
    "pagination",
    "SELECT page, id, place, page = 1 AS is_first, page = 2 AS is_second, page = max(page) OVER () AS is_last, CASE WHEN page > 1 THEN page - 1 END AS previous, CASE WHEN page < max(page) OVER () THEN page + 1 END AS next FROM (SELECT id, row_number() OVER (ORDER BY date DESC, id) - 1 AS place, ((row_number() OVER (ORDER BY date DESC, id) - 1) // 6 + 1)::INT AS page FROM pub) WHERE place < 60",
    head=_POSTS_SQL,
)
def _(s, spark, d):
    return site.pages(_published(spark, d))


@query("tag_pages", "SELECT tag, count(*) AS n, arg_max(id, (date, id)) AS newest FROM (SELECT id, date, unnest(tags) AS tag FROM pub) GROUP BY tag", head=_POSTS_SQL)
def _(s, spark, d):
    return site.tag_pages(_published(spark, d))


@query("archive", "SELECT year(date)::INT AS year, month(date)::INT AS month, count(*) AS n FROM pub GROUP BY ALL", head=_POSTS_SQL)
def _(s, spark, d):
    return site.archive(_published(spark, d))


@query("sitemap", "SELECT 'https://site.example/' || id || '/' AS loc, strftime(date, '%Y-%m-%d') AS lastmod FROM pub", head=_POSTS_SQL)
def _(s, spark, d):
    return site.sitemap(_published(spark, d).withColumn("route", F.concat("id", F.lit("/"))), "https://site.example/")


_SITE = site.Site("https://site.example", "Notes & such", "What was said", "A. Author", "a@site.example")


def _told(spark, d):
    """The published posts with a title, a route and a teaser: what is said first, with marks that XML has to escape."""
    first = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.min_by("text", "turn").alias("said"))
    p = _published(spark, d).join(first, F.col("id") == F.col("conv_id"))
    return p.select("id", "date", F.concat(F.lit("Talk <"), "id", F.lit(">")).alias("title"), F.concat(F.lit("/"), "id", F.lit("/")).alias("route"), F.concat(F.lit('"'), F.coalesce("said", F.lit("")), F.lit("' & c")).alias("teaser"))


_NEWEST = r""", top AS (SELECT p.id, date, row_number() OVER (ORDER BY date DESC, p.id) AS place, '&quot;' || replace(replace(replace(replace(replace(coalesce(said, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') || '&#39; &amp; c' AS said
    FROM pub p JOIN (SELECT conv_id, arg_min(text, turn) AS said FROM conversations GROUP BY conv_id) ON conv_id = p.id ORDER BY place LIMIT 10)
"""


@query(
    "atom_feed",
    _NEWEST
    + """SELECT 0 AS place, '<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Notes &amp; such</title><link href="https://site.example/atom.xml" rel="self" /><link href="https://site.example" /><id>https://site.example/atom.xml</id><author><name>A. Author</name><email>a@site.example</email></author><updated>' || strftime(max(date), '%Y-%m-%dT00:00:00Z') || '</updated>' AS line FROM top
    UNION ALL SELECT place, '<entry><title>Talk &lt;' || id || '&gt;</title><link href="https://site.example/' || id || '/" /><id>https://site.example/' || id || '/</id><published>' || strftime(date, '%Y-%m-%dT00:00:00Z') || '</published><updated>' || strftime(date, '%Y-%m-%dT00:00:00Z') || '</updated><summary type="html">' || said || '</summary></entry>' FROM top UNION ALL SELECT 11, '</feed>'""",
    head=_POSTS_SQL.rstrip(),
)
def _(s, spark, d):
    return site.atom(_told(spark, d), _SITE)


@query(
    "rss_feed",
    _NEWEST
    + """SELECT 0 AS place, '<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>Notes &amp; such</title><link>https://site.example</link><description>What was said</description><atom:link href="https://site.example/rss.xml" rel="self" type="application/rss+xml" /><lastBuildDate>' || strftime(max(date), '%a, %d %b %Y 00:00:00 UT') || '</lastBuildDate>' AS line FROM top
    UNION ALL SELECT place, '<item><title>Talk &lt;' || id || '&gt;</title><link>https://site.example/' || id || '/</link><description>' || said || '</description><pubDate>' || strftime(date, '%a, %d %b %Y 00:00:00 UT') || '</pubDate><guid>https://site.example/' || id || '/</guid></item>' FROM top UNION ALL SELECT 11, '</channel></rss>'""",
    head=_POSTS_SQL.rstrip(),
)
def _(s, spark, d):
    return site.rss(_told(spark, d), _SITE)


@query(
    "stream_sessions",
    """WITH x AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS new FROM events), y AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x),
    z AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM y GROUP BY user_id, k)
    SELECT user_id AS key, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(stop, '%Y-%m-%d %H:%M:%S') AS stop, n FROM z WHERE stop <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
    head="",
)
def _(s, spark, d):
    """Sessions of the users over the whole table as a stream; those that the watermark closed."""
    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a file or a folder
    out = clocked.run_available(spark, clocked.sessions(events), shared_path(spark, "stream"))
    return out.select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("stop"), "n")


@query(
    "stream_windows",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL)
    SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, kind, n, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
    head="",
)
def _(s, spark, d):
    """The whole table as a stream; windows that the watermark closed."""
    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a file or a folder
    out = clocked.run_available(spark, clocked.windowed_counts(events), shared_path(spark, "stream"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "kind", "n", "total")
