"""Files and folders as a table of their own, and where paths written in outlines lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*:)?(/*)"


def normal(path: Column) -> Column:
    """A path without ``.``, ``..`` and doubled slashes, resolved segment by segment. ``..`` at the root stays there; above the
    start of a relative path it is kept. ``file:///a`` and ``file:/a`` are one."""
    scheme, root = F.regexp_extract(path, SCHEME, 1), F.when(F.regexp_extract(path, SCHEME, 2) != "", "/").otherwise("")

    def step(acc: Column, s: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(".."))
        up = F.when(last != "..", F.slice(acc, 1, F.size(acc) - 1)).when(root == "/", acc).otherwise(F.concat(acc, F.array(s)))
        return F.when(s.isin("", "."), acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    segments = F.aggregate(F.split(F.regexp_replace(path, SCHEME, ""), "/"), F.array().cast("array<string>"), step)
    return F.concat(scheme, root, F.array_join(segments, "/"))


def resolve(link: Column, file: Column, home: str | None = None) -> Column:
    """Where a path that ``file`` names leads: below ``home`` after ``~/``, else from the folder of the file. Paths without a
    scheme have the file's."""
    scheme = F.regexp_extract(file, SCHEME, 1)
    whole = F.when(link.startswith("~/"), F.concat(scheme, F.lit(f"{home or '~'}/"), F.substring(link, F.lit(3), F.length(link))))
    whole = whole.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), link).when(link.startswith("/"), F.concat(scheme, link))
    return normal(whole.otherwise(F.concat(F.regexp_replace(file, "[^/]*$", ""), link)))


def known(paths: DataFrame) -> DataFrame:
    """``path, is_folder`` of the files in ``paths`` (``path``) and all folders above them, once each."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    files = paths.select(normal(F.col("path")).alias("path")).distinct()
    folders = files.select(F.explode(above).alias("path")).filter("path <> ''").distinct()
    return files.withColumn("is_folder", F.lit(False)).unionByName(folders.withColumn("is_folder", F.lit(True)))


def listing(spark: SparkSession, *folders: str) -> DataFrame:
    """``path, is_folder`` of what lies below the folders, at any depth, whatever its extension. Only names are read, no
    content. Files of no octets, and folders without any other file below them, aren't seen (Spark lists neither): where they
    matter, bring paths as a table."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
    return known(raw.select("path"))
