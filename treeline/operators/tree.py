"""Hierarchy: paths, ancestors, inheritance, reassembly."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Store, mjd
from ..storage import materialize

#: File properties that entries inherit, by exact name.
INHERITED = ("COLUMNS", "CATEGORY", "ARCHIVE", "LOGGING")


def build_paths(entries: DataFrame) -> DataFrame:
    """``id, path`` from ``id, parent_id`` alone, root first: level by level from the roots until one is
    empty, one join a level. Rows whose parent doesn't exist, and cycles, have no path; of an id with
    several parents each has one."""
    e = materialize(entries.select("id", "parent_id").distinct(), "paths-edges")
    out = level = materialize(e.filter("parent_id is null").select("id", F.array("id").alias("path")), "paths-level")
    while not level.isEmpty():
        below = e.alias("e").join(level.alias("p"), F.col("e.parent_id") == F.col("p.id")).select("e.id", F.concat("p.path", F.array("e.id")).alias("path"))
        level = materialize(below.filter(F.size(F.array_distinct("path")) == F.size("path")), "paths-level")
        out = out.unionByName(level)
    return out


def unique_entries(entries: DataFrame) -> DataFrame:
    """Entries, of those that share an id one, the same in every run: that of least title and keyword."""
    rest = F.struct(*[c for c in entries.columns if c != "id"])
    return entries.repartition("id").groupBy("id").agg(F.min_by(rest, F.struct("title", "keyword_value")).alias("e")).select("id", "e.*").select(entries.columns)


def breadcrumbs(store: Store, entries: DataFrame | None = None) -> DataFrame:
    """``entry_id, breadcrumb``: the titles of the ancestors, root first; of all entries or of those given."""
    # Distinct where the join needs them, so that they are moved once; what entries of the same id and path repeat ends in the set.
    titles = store.entries.select(F.col("id").alias("a_id"), "title").repartition("a_id").distinct()
    above = store.ancestors if entries is None else replace(store, entries=entries).ancestors
    a = above.join(titles, F.col("ancestor_id") == F.col("a_id"))
    listed = F.sort_array(F.collect_set(F.struct((-F.col("distance")).alias("d"), "title", "ancestor_id")))
    return a.groupBy("entry_id").agg(F.array_join(F.transform(listed, lambda x: x["title"]), " > ").alias("breadcrumb"))


def inherit_properties(store: Store, names: tuple[str, ...] = INHERITED) -> DataFrame:
    """``entry_id, name, value, inherited``: an entry's own properties, and those of its file among
    ``names`` that it lacks (without regard to case). Headings never pass properties down."""
    own = store.entry_properties.select("entry_id", "name", "value", F.lit(False).alias("inherited"))
    files = store.file_properties.filter(F.col("name").isin(*names)).select("file_id", "name", "value")
    given = store.entries.select(F.col("id").alias("entry_id"), "file_id").distinct().join(files, "file_id")
    have = store.entry_properties.select(F.col("entry_id").alias("h_id"), F.lower("name").alias("h_name")).distinct()
    missing = given.join(have, (F.col("entry_id") == F.col("h_id")) & (F.lower("name") == F.col("h_name")), "left_anti")
    return own.unionByName(missing.select("entry_id", "name", "value", F.lit(True).alias("inherited")))


def effective_tags(store: Store) -> DataFrame:
    """``entry_id, tag, inherited``: own tags, and those of ancestors that an entry lacks."""
    own = store.entry_tags.select("entry_id", "tag").distinct()
    up = store.ancestors.join(own.withColumnRenamed("entry_id", "owner"), F.col("ancestor_id") == F.col("owner")).select("entry_id", "tag").distinct()
    return own.withColumn("inherited", F.lit(False)).unionByName(up.join(own, ["entry_id", "tag"], "left_anti").withColumn("inherited", F.lit(True)))


def walk_steps(own: Column) -> Column:
    """``k, step, own`` for each id in the path of an entry (``id, path``); ``own`` only where it is the entry's, which is added
    without ``k`` to a path that lacks it."""
    none = F.array().cast("array<string>")
    steps = F.transform(F.coalesce("path", none), lambda x, k: F.struct(k.alias("k"), x.alias("step"), F.when(x == F.col("id"), own).alias("own")))
    alone = F.struct(F.lit(None).cast("int").alias("k"), F.col("id").alias("step"), own.alias("own"))
    return F.when(F.array_contains("path", F.col("id")), steps).otherwise(F.concat(steps, F.array(alone)))


def walk_key(k: Column, at: Column) -> Column:
    """What entries are walked by, of the rows of an entry: the positions down its path, of those steps that are there."""
    return F.transform(F.sort_array(F.collect_list(F.when(k.isNotNull() & at.isNotNull(), F.struct(k.alias("k"), at["position"].alias("position"))))), lambda x: x["position"])


def preorder(entries: DataFrame) -> DataFrame:
    """``file_id, id, preorder``: entries of a file as a depth-first walk meets them, from 0. Ids are those of the
    file: another file may have the same ones in other places. Entries are moved once, by file; the positions of the steps
    are found there, by a window over the file's steps."""
    one = entries.select("file_id", "id", "position", "path").repartition("file_id").groupBy("file_id", "id").agg(F.min("position").alias("position"), F.min("path").alias("path"))
    steps = one.select("file_id", "id", F.inline(walk_steps(F.struct("position")))).withColumn("at", F.max("own").over(W.partitionBy("file_id", "step")))
    keyed = steps.groupBy("file_id", "id").agg(walk_key(F.col("k"), F.col("at")).alias("key")).filter(F.size("key") > 0)
    return keyed.select("file_id", "id", (F.row_number().over(W.partitionBy("file_id").orderBy("key", "id")) - 1).alias("preorder"))


def nest(store: Store) -> DataFrame:
    """``file_id, id, tree``: every root (an entry without parent) as JSON with its children in order, to any
    depth. Built bottom-up from the deepest level, one aggregation and one join a level, each written down. A child is JSON
    already when its parent takes it in, so all levels have one schema. Parents and children are of one file, so files may
    share ids; entries of one file that share an id have the same children."""
    e = materialize(store.entries.select("file_id", "id", "parent_id", "depth", "position", "title", "keyword_value"), "nest-entries")
    deepest = e.agg(F.max("depth")).first()[0]
    kids = None  # file and parent, its children as one JSON array
    roots = []

    def written(level: DataFrame) -> DataFrame:
        own = F.to_json(F.struct("position", "id", "title", F.col("keyword_value").alias("keyword")))
        if kids is None:
            return level.withColumn("tree", own)
        has = level.join(kids, (F.col("file_id") == F.col("f")) & (F.col("id") == F.col("p")), "left")
        return has.withColumn("tree", F.when(F.col("kids").isNull(), own).otherwise(F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"children":'), "kids", F.lit("}")))).drop("f", "p", "kids")

    for depth in range(deepest or 0, 0, -1):
        level = materialize(written(e.filter(F.col("depth") == depth)), "nest-level")
        roots.append(level.filter("parent_id is null").select("file_id", "id", "tree"))
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "id", "tree"))), lambda x: x["tree"]), ",")
        kids = level.filter("parent_id is not null").groupBy(F.col("file_id").alias("f"), F.col("parent_id").alias("p")).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("kids"))
    return reduce(DataFrame.unionByName, roots) if roots else e.select("file_id", "id", F.lit("").alias("tree")).limit(0)


def lookup(properties: Column, name: str) -> Column:
    """First value of a property in ``array<struct<name, value>>``, without regard to case."""
    return F.get(F.filter(properties, lambda p: F.lower(p["name"]) == name.lower()), F.lit(0))["value"]


def any_property(store: Store, name: str) -> DataFrame:
    """``id, value``: an explicit property, else the built-in one of that name (KEYWORD and TODO,
    PRIORITY, ITEM and TITLE, DEPTH, FILE, TAGS, CATEGORY, SCHEDULED, DEADLINE, CLOSED, CONTEXT,
    VERB, LOCATOR, OFFSET). Entries without either are left out."""
    e = store.entries
    n = name.upper()
    columns = {"KEYWORD": "keyword_value", "TODO": "keyword_value", "PRIORITY": "priority", "ITEM": "headline", "TITLE": "title", "DEPTH": "depth", "CONTEXT": "context", "VERB": "verb", "LOCATOR": "locator", "OFFSET": "byte_offset"}
    if n in columns:
        special = e.select("id", F.col(columns[n]).cast("string").alias("s"))
    elif n == "FILE":
        special = e.select("id", "file_id").join(store.files.select(F.col("id").alias("f"), F.col("path").alias("s")), F.col("file_id") == F.col("f")).select("id", "s")
    elif n == "TAGS":
        special = store.entry_tags.groupBy(F.col("entry_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("tag")), ":").alias("s"))
    elif n == "CATEGORY":
        special = store.entry_categories.groupBy(F.col("entry_id").alias("id")).agg(F.min("category").alias("s"))
    elif n in ("SCHEDULED", "DEADLINE", "CLOSED"):
        special = store.entry_stamps.filter(F.col("stamp_type") == n.lower()).groupBy(F.col("entry_id").alias("id")).agg(F.date_from_unix_date(F.min("day") - 40587).cast("string").alias("s"))
    else:
        special = e.select("id", F.lit(None).cast("string").alias("s"))
    own = store.entry_properties.filter(F.lower("name") == name.lower()).groupBy(F.col("entry_id").alias("id")).agg(F.min_by("value", "position").alias("own"))
    value = F.coalesce("own", "s").alias("value")
    if n in columns:  # these have a row of every entry
        return special.repartition("id").distinct().join(own, "id", "left").select("id", value).filter("value is not null")
    ids = e.select("id").distinct()
    return ids.join(own, "id", "left").join(special.distinct(), "id", "left").select("id", value).filter("value is not null")


def state_history(store: Store) -> DataFrame:
    """State changes of entries, oldest first, each with the state before it: logs are kept newest
    first."""
    w = W.partitionBy("entry_id").orderBy(F.desc("position"))
    s = store.entry_log_entries.filter("log_type = 'state'")
    return s.select("entry_id", "position", "to_keyword", F.lag("to_keyword").over(w).alias("before"), "time_day", "time_start")


def file_facts(store: Store) -> DataFrame:
    """``file_id, title, slug, stamp, created, archive`` of every file: its TITLE or the slug in its name;
    its SLUG or that of the title; the time in its name as Modified Julian Day; the day of CREATED or that of the
    name; whether it is an archive."""
    from ..functions.scalars import compact_time, file_name_parts, is_archive, slug

    first = lambda n: F.min_by(F.when(F.upper("name") == n, F.col("value")), F.when(F.upper("name") == n, F.col("position")))
    p = store.file_properties.groupBy("file_id").agg(first("TITLE").alias("t"), first("SLUG").alias("s"), first("CREATED").alias("c"))
    f = store.files.select(F.col("id").alias("file_id"), "path", file_name_parts(F.substring_index("path", "/", -1)).alias("n")).join(p, "file_id", "left")
    title = F.coalesce("t", "n.slug")
    stamp = compact_time(F.col("n.date"))["day"]
    written = F.try_to_timestamp(F.regexp_extract("c", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("yyyy-MM-dd")).cast("date")
    return f.select("file_id", title.alias("title"), F.coalesce("s", slug(title)).alias("slug"), stamp.alias("stamp"), F.coalesce(mjd(written), stamp).alias("created"), is_archive(F.col("path")).alias("archive"))


def body_edges(store: Store) -> DataFrame:
    """``entry_id, lead, trail``: the white space that bodies begin and end with, if they do."""
    space = F.when(F.col("block_type") == "whitespace", F.col("content"))
    return store.entry_body_blocks.groupBy("entry_id").agg(F.min_by(F.struct(space.alias("v")), "position")["v"].alias("lead"), F.max_by(F.struct(space.alias("v")), "position")["v"].alias("trail"))


def body_space(store: Store) -> DataFrame:
    """``entry_id, lead, trail, empty``: the white space that a body begins and ends with, if it does, and
    whether nothing else is in it. Entries without a body are empty."""
    b = body_edges(store)
    ids = store.entries.select(F.col("id").alias("entry_id")).distinct()
    return ids.join(b.withColumn("full", F.lit(True)), "entry_id", "left").select("entry_id", "lead", "trail", F.col("full").isNull().alias("empty"))
