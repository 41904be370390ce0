"""Incremental loading: what to skip, store, delete or report as a conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Store
from ..storage import materialize

def classify_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, action``: both sides have ``path, mod_time, hash``. Not stored: ``insert``; the
    store's time is newer: ``conflict``; equal times, or equal hashes: ``skip``; else ``update``.
    Stored files that are gone: ``delete``."""
    f, s = files.alias("f"), stored.alias("s")
    j = f.join(s, F.col("f.path") == F.col("s.path"), "full_outer")
    action = (
        F.when(F.col("s.path").isNull(), "insert")
        .when(F.col("f.path").isNull(), "delete")
        .when(F.col("s.mod_time") > F.col("f.mod_time"), "conflict")
        .when((F.col("s.mod_time") == F.col("f.mod_time")) | (F.col("s.hash") == F.col("f.hash")), "skip")
        .otherwise("update")
    )
    return j.select(F.coalesce("f.path", "s.path").alias("path"), action.alias("action"))


def diff_entries(new: DataFrame, old: DataFrame, key: str = "id", digest: str = "hash") -> DataFrame:
    """``id, action`` of entries that are inserted, updated (other hash) or deleted; equal ones are
    left out."""
    n, o = new.select(key, digest).alias("n"), old.select(key, digest).alias("o")
    j = n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer")
    action = F.when(F.col(f"o.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull(), "delete").when(~F.col(f"n.{digest}").eqNullSafe(F.col(f"o.{digest}")), "update")
    return j.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), action.alias("action")).filter("action is not null")


def apply_diff(old: DataFrame, new: DataFrame, key: str = "id", digest: str = "hash") -> DataFrame:
    """The table after the diff: rows of ``new``, and of ``old`` nothing that changed or is gone.
    Unchanged rows are kept as ``old`` has them."""
    same = new.select(key, digest)
    kept = old.join(same, [key, digest], "left_semi")
    return kept.unionByName(new.join(kept.select(key, digest), [key, digest], "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last version of every key by sequence number."""
    w = W.partitionBy(key).orderBy(F.desc(seq))
    return old.unionByName(new).withColumn("_version", F.row_number().over(w)).filter("_version = 1").drop("_version")


def stale(old: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Keys of ``old`` that ``live`` lacks."""
    return old.select(key).distinct().join(live.select(key).distinct(), key, "left_anti")


def changed_paths(files: DataFrame, checked: DataFrame) -> DataFrame:
    """Files never checked, or changed since: ``path, mod_time`` against ``path, checked_at``."""
    j = files.join(checked, "path", "left")
    return j.filter("checked_at is null or mod_time >= checked_at").select("path", "mod_time")


def report(classified: DataFrame) -> DataFrame:
    """One row: files processed, updated, skipped, deleted, conflicts."""
    count = lambda *a: F.count_if(F.col("action").isin(*a))
    return classified.agg(F.count_if(F.col("action") != "delete").alias("processed"), count("insert", "update").alias("updated"), count("skip").alias("skipped"), count("delete").alias("deleted"), count("conflict").alias("conflicts"))


def delete_files(store: Store, paths: DataFrame) -> Store:
    """The store without the files of ``path`` in ``paths`` and all that hangs on them: properties, entries
    and what entries have. One anti-join a table."""
    gone = store.files.join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"))
    entries = store.entries.join(gone, "file_id", "left_semi").select(F.col("id").alias("entry_id")).distinct()

    def left(name: str, df: DataFrame) -> DataFrame:
        if name == "files":
            return df.join(gone, F.col("id") == F.col("file_id"), "left_anti")
        if "file_id" in df.columns:
            return df.join(gone, "file_id", "left_anti").select(df.columns)
        return df.join(entries, "entry_id", "left_anti").select(df.columns)

    return store.map(left)


def stale_files(files: DataFrame, cached: DataFrame) -> DataFrame:
    """The ``files`` (``path, mod_time, ...``) that have to be parsed again: not in ``cached`` (``path,
    mod_time``), or newer than there."""
    c = cached.groupBy("path").agg(F.max("mod_time").alias("_cached"))
    return files.join(c, "path", "left").filter("_cached is null or mod_time > _cached").select(files.columns)


def store_vectors(stored: DataFrame, hashes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors and marks after embedding: ``new`` has ``entry_id, hash, chunk_position, chunk_text,
    embedding``. Its entries' old vectors go, and their mark (``entry_id, embedded_hash``) is the hash of the text
    that was embedded."""
    done = new.groupBy("entry_id").agg(F.max("hash").alias("embedded_hash"))
    vectors = stored.join(done, "entry_id", "left_anti").select(stored.columns).unionByName(new.select("entry_id", "chunk_position", "chunk_text", "embedding"))
    return vectors, hashes.join(done, "entry_id", "left_anti").select("entry_id", "embedded_hash").unionByName(done)


def round_trip_failures(store: Store) -> DataFrame:
    """``path`` of the files whose text, written and read again, is written otherwise."""
    from ..sinks.text import file_texts
    from ..sources.outline_text import parse

    once = materialize(file_texts(store), "written")
    again = file_texts(parse(once).store).select(F.col("path").alias("p"), F.col("content").alias("c"))
    return once.join(again, F.col("path") == F.col("p"), "left").filter(~F.col("content").eqNullSafe(F.col("c"))).select("path")
