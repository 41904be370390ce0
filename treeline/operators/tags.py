"""Tag algebra, tag trees and filters over tagged items (``item, tags`` with tags an array)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def var(tag: str):
    return lambda tags: F.array_contains(tags, tag)


def all_of(*es):
    """True without arguments."""
    return lambda tags: reduce(Column.__and__, [e(tags) for e in es], F.lit(True))


def any_of(*es):
    """False without arguments."""
    return lambda tags: reduce(Column.__or__, [e(tags) for e in es], F.lit(False))


def no(e):
    return lambda tags: ~e(tags)


def matching(items: DataFrame, expression) -> DataFrame:
    return items.filter(expression(F.col("tags")))


def combinations(items: DataFrame, depth: int) -> DataFrame:
    """``item, path``: every ordered choice of up to ``depth`` distinct tags of an item, one join a
    level."""
    own = items.select("item", F.explode(F.array_distinct("tags")).alias("tag"))
    level = own.select("item", F.array("tag").alias("path"))
    out = level
    for _ in range(depth - 1):
        level = level.join(own, "item").filter(~F.array_contains("path", F.col("tag"))).select("item", F.concat("path", F.array("tag")).alias("path"))
        out = out.unionByName(level)
    return out


def tag_tree_links(items: DataFrame, root: str, depth: int) -> DataFrame:
    """``item, link``: where a tag tree below ``root`` would link to each item."""
    base = F.substring_index("item", "/", -1)
    return combinations(items, depth).select("item", F.concat_ws("/", F.lit(root), F.array_join("path", "/"), base).alias("link"))


def filter_links(items: DataFrame, expression, folder: str) -> DataFrame:
    """``item, link`` of the items that match, in one folder."""
    return matching(items, expression).select("item", F.concat_ws("/", F.lit(folder), F.substring_index("item", "/", -1)).alias("link"))
