"""Groups of near-duplicate entries for a reader: as text, JSON lines and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Store
from ..operators.similarity import clusters
from ..storage import materialize
from .text import csv_lines


def groups(pairs: DataFrame, store: Store) -> DataFrame:
    """``grp, least, id, file, byte_offset, keyword, title, distance``: the entries of each group of ``pairs`` (``a, b,
    distance``) with their least distance to another. Groups are numbered from 1 by their least distance, then least id; there
    are no more of them than pairs, and pairs are the nearest so many. Entries that share an id are all members."""
    c = materialize(clusters(pairs), "review-groups")
    least = c.groupBy("cluster").agg(F.min("distance").alias("least"))
    number = least.withColumn("grp", F.row_number().over(W.orderBy("least", "cluster")))
    e = store.entries.select("id", "file_id", "byte_offset", "keyword_value", "title").distinct().join(c, "id").join(number, "cluster")
    file = store.files.select(F.col("id").alias("f"), "path")
    return e.join(file, F.col("file_id") == F.col("f"), "left").select("grp", "least", "id", F.coalesce("path", "file_id").alias("file"), F.coalesce("byte_offset", F.lit(0)).alias("byte_offset"), F.col("keyword_value").alias("keyword"), "title", "distance")


def _members(found: DataFrame, *fields) -> DataFrame:
    """``grp, least, members``: a row a group, members by id."""
    key = F.struct("id", "file", "byte_offset", F.struct(*fields).alias("m"))
    return found.groupBy("grp", "least").agg(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["m"]).alias("members"))


def text(found: DataFrame) -> DataFrame:
    """``grp, line``: a group's number and least distance to three places, and a line for each member: file, offset, keyword
    and title."""
    line = F.concat(F.lit("  "), "file", F.lit(":"), F.col("byte_offset").cast("string"), F.lit(" "), F.coalesce(F.concat("keyword", F.lit(" ")), F.lit("")), "title")
    g = _members(found, line.alias("line"))
    head = F.concat(F.lit("Group "), "grp", F.lit(" (distance: "), F.round("least", 3).cast("string"), F.lit("):"))
    return g.select("grp", F.concat_ws("\n", head, F.transform("members", lambda m: m["line"])).alias("line"))


def json(found: DataFrame, digits: int | None = None) -> DataFrame:
    """``grp, line``: a JSON object a group; distances rounded if ``digits`` says so."""
    d = lambda c: F.round(c, digits) if digits is not None else F.col(c)
    g = _members(found, "id", "file", "title", "keyword", d("distance").alias("distance"))
    return g.select("grp", F.to_json(F.struct(F.col("grp").alias("group"), d("least").alias("min_distance"), F.col("members").alias("entries")), {"ignoreNullFields": "false"}).alias("line"))


#: The first line of ``csv``.
HEADER = "group,file,id,keyword,title,distance"


def csv(found: DataFrame, digits: int | None = None) -> DataFrame:
    """``line`` of every member, groups in order, under ``HEADER``."""
    x = found.withColumn("distance", F.round("distance", digits) if digits is not None else F.col("distance"))
    return csv_lines(x.orderBy("grp", "id", "file", "byte_offset"), "grp", "file", "id", "keyword", "title", "distance")
