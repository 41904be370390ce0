"""Relations between entries, and their graph as DOT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Store
from ..storage import materialize

#: Colour, line style and whether the relation is written beside it. Other relations are only named.
COLOURS = {"link": "blue", "blocks": "red", "blocked_by": "red", "related": "forestgreen", "parent_child": "gray"}
STYLES = {"blocks": "dashed", "blocked_by": "dashed", "parent_child": "dotted"}
UNNAMED = ("parent_child",)


def relations(store: Store) -> DataFrame:
    """``source, target, relation``: parents of entries, and ``id:`` links to entries that exist. Nearly all rows differ, so they
    are told apart only where they are moved to."""
    up = store.entries.filter("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("parent_child").alias("relation"))
    ids = store.entries.select(F.lower("id").alias("k"), "id").repartition("k").distinct()
    links = store.entry_links.filter("link_type = 'id'").join(ids, F.lower("target") == F.col("k")).select(F.col("entry_id").alias("source"), F.col("id").alias("target"), F.lit("link").alias("relation"))
    return up.unionByName(links).filter("source <> target").repartition("source", "target").distinct()


def edges(store: Store, types: tuple[str, ...] = (), keywords: tuple[str, ...] = (), file_id: str | None = None, tags: tuple[str, ...] = (), max_depth: int | None = None) -> DataFrame:
    """``source, target, relation, colour`` between entries that pass all filters; the colour of a relation
    that has none of its own is null."""
    e = store.entries
    if keywords:
        e = e.filter(F.col("keyword_value").isin(*keywords))
    if file_id:
        e = e.filter(F.col("file_id") == file_id)
    if max_depth:
        e = e.filter(F.col("depth") <= max_depth)
    if tags:
        e = e.join(store.entry_tags.filter(F.col("tag").isin(*tags)), F.col("id") == F.col("entry_id"), "left_semi")
    nodes = e.select("id")
    r = relations(store)
    if types:
        r = r.filter(F.col("relation").isin(*types))
    if keywords or file_id or tags or max_depth:  # targets are entries, whether they pass or not
        r = r.join(nodes.withColumnRenamed("id", "target"), "target", "left_semi")
    r = r.join(nodes.withColumnRenamed("id", "source"), "source", "left_semi")
    colours = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    return r.select("source", "target", "relation", F.try_element_at(colours, F.col("relation")).alias("colour"))


def dot_lines(store: Store, **filters) -> DataFrame:
    """``line``: DOT statements, nodes in a cluster for each file, then edges."""
    x = materialize(edges(store, **filters), "dot-edges")
    used = x.select(F.explode(F.array("source", "target")).alias("id"))
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    nodes = store.entries.select("id", "file_id", "title").join(used, "id", "left_semi").distinct()
    styles = F.create_map(*[F.lit(v) for kv in STYLES.items() for v in kv])
    named = F.when(~F.col("relation").isin(*UNNAMED), F.concat(F.lit("label="), q("relation")))
    how = F.concat_ws(", ", F.concat(F.lit("color="), "colour"), named, F.concat(F.lit("style="), F.try_element_at(styles, F.col("relation"))))
    clusters = nodes.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(q("id"), F.lit(" [label="), q("title"), F.lit("];")))), " ").alias("s"))
    return clusters.select(F.concat(F.lit('subgraph "cluster_'), "file_id", F.lit('" { '), "s", F.lit(" }")).alias("line")).unionByName(x.select(F.concat(q("source"), F.lit(" -> "), q("target"), F.lit(" ["), how, F.lit("];")).alias("line")))
