"""The relational model of outlines: one DataFrame for each kind of record.

Days are Modified Julian Day numbers and times of day minutes, as the model's own; ``mjd`` and
``mjd_to_date`` convert.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modified Julian Day of 1970-01-01.
UNIX_EPOCH_MJD = 40587

ENTRY_COLUMNS = (
    "id file_id parent_id depth position byte_offset keyword_type keyword_value priority headline title verb context locator hash path"
).split()

#: Schemas of the tables, as DDL.
SCHEMAS = {
    "files": "id string, path string, title string, preamble string, hash string, mod_time timestamp, created_time timestamp",
    "file_properties": "file_id string, name string, value string, source string, position int",
    "entries": "id string, file_id string, parent_id string, depth int, position int, byte_offset long, keyword_type string, keyword_value string, priority string, headline string, title string, verb string, context string, locator string, hash string, path array<string>",
    "entry_tags": "entry_id string, tag string",
    "entry_properties": "entry_id string, name string, value string, position int",
    "entry_stamps": "entry_id string, stamp_type string, time_kind string, day int, day_end int, time_start int, time_end int, suffix string",
    "entry_log_entries": "id string, entry_id string, position int, log_type string, time_kind string, time_day int, day_end int, time_start int, time_end int, suffix string, from_keyword string, to_keyword string, orig_kind string, orig_day int, orig_start int, orig_end int, orig_suffix string, duration_minutes int, logbook_id string",
    "entry_log_bodies": "log_id string, entry_id string, log_position int, position int, block_type string, content string",
    "entry_body_blocks": "entry_id string, position int, block_type string, content string, drawer_name string",
    "entry_categories": "entry_id string, category string, is_explicit boolean",
    "entry_links": "entry_id string, position int, link_type string, target string, description string",
    "entry_embeddings": "entry_id string, chunk_position int, chunk_text string, embedding array<float>",
}


@dataclass(frozen=True)
class Config:
    """Keywords, their allowed transitions (from -> to), priorities and columns of alignment; for rules about paths the home
    folder, the folder of attachments (without it they aren't looked for) and what there is (``path, is_folder``; else the
    files of the collection and their folders)."""

    open_keywords: tuple[str, ...] = ("TODO", "WAIT")
    closed_keywords: tuple[str, ...] = ("DONE", "CANCELED")
    start_keywords: tuple[str, ...] = ("TODO",)
    transitions: tuple[tuple[str, str], ...] = (("TODO", "DONE"), ("TODO", "WAIT"), ("TODO", "CANCELED"), ("WAIT", "TODO"), ("WAIT", "DONE"), ("WAIT", "CANCELED"))
    priorities: tuple[str, ...] = ("A", "B", "C")
    property_column: int = 11
    tags_column: int = 60
    home: str | None = None
    attachments: str | None = None
    paths: DataFrame | None = field(default=None, compare=False)

    @property
    def keywords(self) -> tuple[str, ...]:
        return self.open_keywords + self.closed_keywords


@dataclass(frozen=True)
class Store:
    """The tables of a collection of outlines."""

    files: DataFrame
    file_properties: DataFrame
    entries: DataFrame
    entry_tags: DataFrame
    entry_properties: DataFrame
    entry_stamps: DataFrame
    entry_log_entries: DataFrame
    entry_log_bodies: DataFrame
    entry_body_blocks: DataFrame
    entry_categories: DataFrame
    entry_links: DataFrame
    entry_embeddings: DataFrame

    @cached_property
    def ancestors(self) -> DataFrame:
        """``entry_id, ancestor_id, distance`` for all proper ancestors: the path, exploded. Every
        hierarchy predicate is an equi-join with it."""
        e = self.entries.select(F.col("id").alias("entry_id"), "path", F.posexplode("path").alias("pos", "ancestor_id"))
        return e.filter(F.col("ancestor_id") != F.col("entry_id")).select("entry_id", "ancestor_id", (F.size("path") - 1 - F.col("pos")).alias("distance"))

    def map(self, f) -> Store:
        """Every table through ``f(name, df)``."""
        return replace(self, **{x.name: f(x.name, getattr(self, x.name)) for x in fields(self)})

    def write(self, folder: str, mode: str = "overwrite") -> None:
        """All tables as Parquet below ``folder``."""
        self.map(lambda name, df: df.write.mode(mode).parquet(f"{folder}/{name}") or df)

    @staticmethod
    def read(spark, folder: str) -> Store:
        return Store(**{x.name: spark.read.schema(SCHEMAS[x.name]).parquet(f"{folder}/{x.name}") for x in fields(Store)})


def mjd(day: Column) -> Column:
    return F.unix_date(day.cast("date")) + UNIX_EPOCH_MJD


def mjd_to_date(day: Column) -> Column:
    return F.date_from_unix_date(day - UNIX_EPOCH_MJD)
