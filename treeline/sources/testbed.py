"""An outline store derived from a star schema, so that the operators have data of any size.

A customer is a file with one heading of depth 1; its orders are depth 2, their lines depth 3.
``SQL`` derives the same tables in DuckDB.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import SCHEMAS, Store, mjd


def _shape(df: DataFrame, name: str) -> DataFrame:
    """Columns of the model in order; those ``df`` lacks are null."""
    cols = [c.strip().split(" ", 1) for c in SCHEMAS[name].replace("array<string>", "array<string>").split(",")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in cols])


def _bodies(documents: DataFrame, entries: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The lines of documents, and ``more`` blocks, as the bodies of ``entries``; moved once, by entry."""
    body = documents.select(F.concat_ws("-", F.lit("c"), "doc_id").alias("entry_id"), F.posexplode(F.split("text", "\n")).alias("position", "content")).withColumn("block_type", F.lit("paragraph"))
    body = body if more is None else body.withColumn("drawer_name", F.lit(None).cast("string")).unionByName(more)
    return body.join(entries.select("id"), F.col("entry_id") == F.col("id"), "left_semi")


#: Plans of stores by session and folder: they take seconds to put together, and hold no data.
_STORES: dict[tuple[str, str], Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark._jsparkSession.sessionUUID(), sf_dir)
    if key not in _STORES:
        _STORES[key] = _store(spark, sf_dir)
    return _STORES[key]


def _store(spark: SparkSession, sf_dir: str) -> Store:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    orders, line, events = t("orders"), t("lineitem"), t("events")
    key = lambda prefix, *c: F.concat_ws("-", F.lit(prefix), *c)

    files = customer.select(key("f", "c_custkey").alias("id"), F.concat(F.lit("customers/"), F.lower("n_name"), F.lit("/"), F.col("c_custkey"), F.lit(".org")).alias("path"), F.col("c_name").alias("title"))
    file_properties = customer.select(key("f", "c_custkey").alias("file_id"), F.explode(F.array(F.struct(F.lit("CATEGORY").alias("name"), F.col("r_name").alias("value"), F.lit("drawer").alias("source"), F.lit(0).alias("position")), F.struct(F.lit("title").alias("name"), F.col("c_name").alias("value"), F.lit("file").alias("source"), F.lit(1).alias("position")))).alias("p")).select("file_id", "p.*")

    status = F.col("o_orderstatus")
    # A window moves what stands beside it in a select, so what is made of the columns comes after it.
    position = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    order = orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("o_orderpriority"), position.alias("position")).select(
        key("o", "o_orderkey").alias("id"), key("f", "o_custkey").alias("file_id"), key("c", "o_custkey").alias("parent_id"), F.lit(2).alias("depth"),
        "position",
        F.when(status.isin("O", "P"), "open").when(status == "F", "closed").alias("keyword_type"),
        F.when(status == "O", "TODO").when(status == "P", "WAIT").when(status == "F", "DONE").alias("keyword_value"),
        F.when(F.col("o_orderpriority").startswith("1"), "A").when(F.col("o_orderpriority").startswith("2"), "B").when(F.col("o_orderpriority").startswith("3"), "C").alias("priority"),
        F.concat(F.lit("Order "), "o_orderkey").alias("title"),
        F.array(key("c", "o_custkey"), key("o", "o_orderkey")).alias("path"),
    )
    cust = customer.select(key("c", "c_custkey").alias("id"), key("f", "c_custkey").alias("file_id"), F.lit(1).alias("depth"), F.lit(0).alias("position"), F.col("c_name").alias("title"), F.array(key("c", "c_custkey")).alias("path"))
    placed = line.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = placed.select(
        key("l", "l_orderkey", "l_linenumber").alias("id"), key("f", "o_custkey").alias("file_id"), key("o", "l_orderkey").alias("parent_id"), F.lit(3).alias("depth"), (F.col("l_linenumber") - 1).alias("position"),
        F.when(F.col("l_linestatus") == "F", "closed").alias("keyword_type"), F.when(F.col("l_linestatus") == "F", "DONE").alias("keyword_value"),
        F.concat(F.lit("Line "), "l_linenumber", F.lit(" part "), "l_partkey").alias("title"),
        F.array(key("c", "o_custkey"), key("o", "l_orderkey"), key("l", "l_orderkey", "l_linenumber")).alias("path"),
    )
    entries = _shape(cust, "entries").unionByName(_shape(order, "entries")).unionByName(_shape(lines, "entries")).withColumn("headline", F.col("title"))

    tags = customer.select(key("c", "c_custkey").alias("entry_id"), F.lower("c_mktsegment").alias("tag"))
    tags = tags.unionByName(orders.select(key("o", "o_orderkey").alias("entry_id"), F.translate(F.lower(F.substring("o_orderpriority", 3, 20)), " ", "_").alias("tag")))
    tags = tags.unionByName(line.select(key("l", "l_orderkey", "l_linenumber").alias("entry_id"), F.lower("l_returnflag").alias("tag")))

    cents = lambda c: F.round(F.col(c) * 100).cast("long").cast("string")
    prop = lambda name, value, at: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(at).alias("position"))
    props = customer.select(key("c", "c_custkey").alias("entry_id"), F.explode(F.array(prop("ACCTBAL", cents("c_acctbal"), 0), prop("Nation", F.col("n_name"), 1))).alias("p"))
    props = props.unionByName(orders.select(key("o", "o_orderkey").alias("entry_id"), F.explode(F.array_compact(F.array(prop("TOTALPRICE", cents("o_totalprice"), 0), F.when(F.col("o_orderkey") % 50 == 0, prop("STYLE", F.lit("habit"), 1))))).alias("p")))
    props = props.select("entry_id", "p.*")

    shipped = line.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    o = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stamp = lambda kind, day, time: F.struct(F.lit(kind).alias("stamp_type"), F.lit(time).alias("time_kind"), day.alias("day"))
    stamps = o.select(key("o", "o_orderkey").alias("entry_id"), F.explode(F.array_compact(F.array(stamp("scheduled", mjd(F.col("o_orderdate")), "active"), stamp("deadline", mjd(F.col("o_orderdate")) + 30, "active"), F.when((status == "F") & F.col("last").isNotNull(), stamp("closed", mjd(F.col("last")), "inactive"))))).alias("s")).select("entry_id", "s.*")
    stamps = stamps.unionByName(line.select(key("l", "l_orderkey", "l_linenumber").alias("entry_id"), F.lit("active").alias("stamp_type"), F.lit("active").alias("time_kind"), mjd(F.col("l_shipdate")).alias("day")))

    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(F.col("event_id") + F.col("event_id") % 3 * 40), "event_id")) - 1
    clock = F.col("event_type") == "purchase"
    minute = F.hour("ts") * 60 + F.minute("ts")
    placed_events = events.withColumn("position", place)
    logs = placed_events.select(key("e", "event_id").alias("id"), key("c", "user_id").alias("entry_id"), "position", F.lit("inactive").alias("time_kind"), F.when(clock, "clock").when(F.col("event_type") == "click", "state").otherwise("note").alias("log_type"), mjd(F.col("ts")).alias("time_day"), minute.alias("time_start"), F.when(F.col("event_type") == "click", F.element_at(F.array(F.lit("TODO"), F.lit("WAIT"), F.lit("DONE")), (F.col("event_id") % 3 + 1).cast("int"))).alias("to_keyword"), F.when(clock, F.floor("value").cast("int")).alias("duration_minutes"))

    notes = placed_events.filter("event_type not in ('purchase', 'click')").select(key("e", "event_id").alias("log_id"), key("c", "user_id").alias("entry_id"), F.col("position").alias("log_position"), F.lit(0).alias("position"), F.lit("paragraph").alias("block_type"), F.concat(F.col("event_type"), F.lit(" noted as "), "event_id").alias("content"))

    body = _bodies(t("documents"), cust.select("id"))

    links = line.select(key("l", "l_orderkey", "l_linenumber").alias("entry_id"), F.explode(F.array(F.struct(F.lit(0).alias("position"), F.lit("part").alias("link_type"), F.concat(F.lit("part:"), "l_partkey").alias("target")), F.struct(F.lit(1).alias("position"), F.lit("id").alias("link_type"), F.concat(F.lit("c-"), F.col("l_suppkey") * 20).alias("target")))).alias("k")).select("entry_id", "k.*")

    categories = customer.select(key("c", "c_custkey").alias("entry_id"), F.col("r_name").alias("category"), F.lit(True).alias("is_explicit"))
    categories = categories.unionByName(orders.join(customer.select("c_custkey", "r_name"), F.col("o_custkey") == F.col("c_custkey")).select(key("o", "o_orderkey").alias("entry_id"), F.col("r_name").alias("category"), F.lit(False).alias("is_explicit")))

    vectors = t("embeddings").select(key("c", "label").alias("entry_id"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("chunk_position"), F.concat(F.lit("vector "), "vec_id").alias("chunk_text"), "embedding")

    made = dict(files=files, file_properties=file_properties, entries=entries, entry_tags=tags, entry_properties=props, entry_stamps=stamps, entry_log_entries=logs, entry_log_bodies=notes, entry_body_blocks=body, entry_categories=categories, entry_links=links, entry_embeddings=vectors)
    return Store(**{k: _shape(v, k) for k, v in made.items()})


def with_blocks(spark: SparkSession, sf_dir: str) -> Store:
    """The store with blocks, drawers and inline tasks in the bodies of the customers that ``labels`` names."""
    s = store(spark, sf_dir)
    k = lambda prefix: F.concat_ws("-", F.lit(prefix), "doc_id")
    scored = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    scored = scored.join(s.entries.select("id"), k("c") == F.col("id"), "left_semi")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    block = lambda of, at, kind, content, name=None: F.struct(of.alias("entry_id"), F.lit(at).alias("position"), F.lit(kind).alias("block_type"), content.alias("content"), F.lit(name).cast("string").alias("drawer_name"))
    blocks = [
        block(k("c"), 1_000_000, "drawer", text("#+begin_src text\n* no heading ", F.col("doc_id"), "\n:PROPERTIES:\n:ID: none\n*************** no task\n#+end_src"), "#+begin_src text"),
        block(k("c"), 1_000_001, "inline_task", k("i")),
        block(k("c"), 1_000_002, "paragraph", text("after the task ", F.col("doc_id"))),
        block(k("c"), 1_000_003, "drawer", text(":SCORES:\n** quality ", F.col("quality"), "\n:END:"), "SCORES"),
        block(k("c"), 1_000_004, "paragraph", F.lit("#+begin_src without an end")),
        block(k("i"), 0, "paragraph", text("within the task ", F.col("doc_id"))),
    ]
    more = scored.select(F.explode(F.array(*blocks)).alias("b")).select("b.*")
    tasks = scored.select(k("i").alias("id"), k("f").alias("file_id"), k("c").alias("parent_id"), F.lit(15).alias("depth"), F.lit(-1).alias("position"), F.lit("open").alias("keyword_type"), F.lit("TODO").alias("keyword_value"), text("Task ", F.col("doc_id")).alias("title"), F.array(k("c"), k("i")).alias("path"))
    verb = F.when(F.col("title").endswith("7"), "Call")
    tasks = _shape(tasks.withColumns({"verb": verb, "headline": F.concat_ws(": ", verb, "title")}), "entries")
    with_body = s.entries.filter("depth = 1").select("id").unionByName(tasks.select("id"))
    body = _bodies(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_body, more)
    return replace(s, entries=s.entries.unionByName(tasks), entry_body_blocks=_shape(body, "entry_body_blocks"))


#: Of ``with_blocks``, to be put after ``SQL``.
BLOCKS_SQL = """
, scored AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE 'c-' || doc_id IN (SELECT 'c-' || c_custkey FROM cust) GROUP BY doc_id),
entries2 AS (SELECT id, depth, parent_id, keyword_value, priority, title, NULL AS verb FROM entries
  UNION ALL SELECT 'i-' || doc_id, 15, 'c-' || doc_id, 'TODO', NULL, 'Task ' || doc_id, CASE WHEN doc_id % 10 = 7 THEN 'Call' END FROM scored),
blocks2 AS (SELECT entry_id, position, content, NULL AS drawer_name FROM entry_body_blocks
  UNION ALL SELECT 'c-' || doc_id, 1000000, concat_ws(chr(10), '#+begin_src text', '* no heading ' || doc_id, ':PROPERTIES:', ':ID: none', '*************** no task', '#+end_src'), '#+begin_src text' FROM scored
  UNION ALL SELECT 'c-' || doc_id, 1000001, 'i-' || doc_id, NULL FROM scored
  UNION ALL SELECT 'c-' || doc_id, 1000002, 'after the task ' || doc_id, NULL FROM scored
  UNION ALL SELECT 'c-' || doc_id, 1000003, concat_ws(chr(10), ':SCORES:', '** quality ' || quality, ':END:'), 'SCORES' FROM scored
  UNION ALL SELECT 'c-' || doc_id, 1000004, '#+begin_src without an end', NULL FROM scored
  UNION ALL SELECT 'i-' || doc_id, 0, 'within the task ' || doc_id, NULL FROM scored)
"""

#: The same tables in DuckDB, as the head of a WITH query.
SQL = """
WITH cust AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
files AS (SELECT 'f-' || c_custkey AS id, 'customers/' || lower(n_name) || '/' || c_custkey || '.org' AS path, c_name AS title FROM cust),
file_properties AS (SELECT 'f-' || c_custkey AS file_id, 'CATEGORY' AS name, r_name AS value, 'drawer' AS source, 0 AS position FROM cust
  UNION ALL SELECT 'f-' || c_custkey, 'title', c_name, 'file', 1 FROM cust),
entries AS (
  SELECT 'c-' || c_custkey AS id, 'f-' || c_custkey AS file_id, NULL::VARCHAR AS parent_id, 1 AS depth, 0 AS position, NULL::VARCHAR AS keyword_type, NULL::VARCHAR AS keyword_value,
         NULL::VARCHAR AS priority, c_name AS headline, c_name AS title, ['c-' || c_custkey] AS path FROM cust
  UNION ALL
  SELECT 'o-' || o_orderkey, 'f-' || o_custkey, 'c-' || o_custkey, 2, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1,
         CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' WHEN o_orderstatus = 'F' THEN 'closed' END,
         CASE o_orderstatus WHEN 'O' THEN 'TODO' WHEN 'P' THEN 'WAIT' WHEN 'F' THEN 'DONE' END,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' END,
         'Order ' || o_orderkey, 'Order ' || o_orderkey, ['c-' || o_custkey, 'o-' || o_orderkey] FROM orders
  UNION ALL
  SELECT 'l-' || l_orderkey || '-' || l_linenumber, 'f-' || o_custkey, 'o-' || l_orderkey, 3, l_linenumber - 1,
         CASE WHEN l_linestatus = 'F' THEN 'closed' END, CASE WHEN l_linestatus = 'F' THEN 'DONE' END, NULL,
         'Line ' || l_linenumber || ' part ' || l_partkey, 'Line ' || l_linenumber || ' part ' || l_partkey,
         ['c-' || o_custkey, 'o-' || l_orderkey, 'l-' || l_orderkey || '-' || l_linenumber] FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ancestors AS (SELECT * FROM (SELECT id AS entry_id, unnest(path) AS ancestor_id, len(path) AS n, generate_subscripts(path, 1) AS pos FROM entries) WHERE ancestor_id <> entry_id),
entry_tags AS (SELECT 'c-' || c_custkey AS entry_id, lower(c_mktsegment) AS tag FROM cust
  UNION ALL SELECT 'o-' || o_orderkey, replace(lower(substr(o_orderpriority, 3, 20)), ' ', '_') FROM orders
  UNION ALL SELECT 'l-' || l_orderkey || '-' || l_linenumber, lower(l_returnflag) FROM lineitem),
entry_properties AS (SELECT 'c-' || c_custkey AS entry_id, 'ACCTBAL' AS name, round(c_acctbal * 100)::BIGINT::VARCHAR AS value, 0 AS position FROM cust
  UNION ALL SELECT 'c-' || c_custkey, 'Nation', n_name, 1 FROM cust
  UNION ALL SELECT 'o-' || o_orderkey, 'TOTALPRICE', round(o_totalprice * 100)::BIGINT::VARCHAR, 0 FROM orders
  UNION ALL SELECT 'o-' || o_orderkey, 'STYLE', 'habit', 1 FROM orders WHERE o_orderkey % 50 = 0),
entry_stamps AS (SELECT 'o-' || o_orderkey AS entry_id, 'scheduled' AS stamp_type, 'active' AS time_kind, date_diff('day', DATE '1858-11-17', o_orderdate::DATE) AS day FROM orders
  UNION ALL SELECT 'o-' || o_orderkey, 'deadline', 'active', date_diff('day', DATE '1858-11-17', o_orderdate::DATE) + 30 FROM orders
  UNION ALL SELECT 'o-' || o_orderkey, 'closed', 'inactive', date_diff('day', DATE '1858-11-17', max(l_shipdate)::DATE) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey
  UNION ALL SELECT 'l-' || l_orderkey || '-' || l_linenumber, 'active', 'active', date_diff('day', DATE '1858-11-17', l_shipdate::DATE) FROM lineitem),
entry_log_entries AS (SELECT 'e-' || event_id AS id, 'c-' || user_id AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id + event_id % 3 * 40 DESC, event_id) - 1 AS position,
         CASE event_type WHEN 'purchase' THEN 'clock' WHEN 'click' THEN 'state' ELSE 'note' END AS log_type, date_diff('day', DATE '1858-11-17', ts::DATE) AS time_day,
         hour(ts) * 60 + minute(ts) AS time_start, CASE WHEN event_type = 'click' THEN ['TODO', 'WAIT', 'DONE'][event_id % 3 + 1] END AS to_keyword,
         CASE WHEN event_type = 'purchase' THEN floor(value)::INT END AS duration_minutes FROM events),
entry_log_bodies AS (SELECT e.id AS log_id, e.entry_id, e.position AS log_position, 0 AS position, v.event_type || ' noted as ' || v.event_id AS content FROM events v JOIN entry_log_entries e ON e.id = 'e-' || v.event_id WHERE e.log_type = 'note'),
entry_body_blocks AS (SELECT * FROM (SELECT 'c-' || doc_id AS entry_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents)
  WHERE entry_id IN (SELECT 'c-' || c_custkey FROM cust)),
entry_links AS (SELECT 'l-' || l_orderkey || '-' || l_linenumber AS entry_id, 0 AS position, 'part' AS link_type, 'part:' || l_partkey AS target FROM lineitem
  UNION ALL SELECT 'l-' || l_orderkey || '-' || l_linenumber, 1, 'id', 'c-' || l_suppkey * 20 FROM lineitem),
entry_categories AS (SELECT 'c-' || c_custkey AS entry_id, r_name AS category, true AS is_explicit FROM cust
  UNION ALL SELECT 'o-' || o_orderkey, r_name, false FROM orders JOIN cust ON o_custkey = c_custkey),
entry_embeddings AS (SELECT 'c-' || label AS entry_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_position, 'vector ' || vec_id AS chunk_text, embedding FROM embeddings)
"""
