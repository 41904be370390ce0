"""A store on disk that is brought up to date file by file.

    parts/<name>/<table>    what was parsed at once, with the file and part of every row
    states/<n>/files        the live files: path, time, hash and the part that holds them
    states/<n>/ledger       the batches taken in so far, with their counts
    states/<n>/DONE         written last

A state counts once it is done, and the one of highest number is read. So an update that breaks off leaves the
state before it, its parts belong to none, and a reader sees one state or the other. A file that changes gets a place in a new
part; its rows in the old one are no longer live. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS, Config, Store
from ..operators import sync
from ..storage import materialize
from . import outline_text
from .lines import file_pieces

FILES = "path string, mod_time timestamp, hash string, part string"
LEDGER = "stream string, batch long, processed long, updated long, skipped long, deleted long, conflicts long"
COUNTS = ("processed", "updated", "skipped", "deleted", "conflicts")


class FileStore:
    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None) -> None:
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """The state that is read; 0 before the first."""
        for n in sorted((int(x) for x in self._names(f"{self.folder}/states")), reverse=True):
            fs, done = self._fs(f"{self.folder}/states/{n}/DONE")
            if fs.exists(done):
                return n
        return 0

    def _state(self, name: str, schema: str) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/states/{n}/{name}") if n else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        """``path, mod_time, hash, part`` of the live files."""
        return self._state("files", FILES)

    def ledger(self) -> DataFrame:
        return self._state("ledger", LEDGER)

    def _publish(self, files: DataFrame, ledger: DataFrame) -> None:
        # One above all that were begun: what a broken update left is never written over.
        n = max((int(x) for x in self._names(f"{self.folder}/states")), default=0) + 1
        files.select("path", "mod_time", "hash", "part").write.parquet(f"{self.folder}/states/{n}/files")
        ledger.coalesce(1).write.parquet(f"{self.folder}/states/{n}/ledger")
        fs, done = self._fs(f"{self.folder}/states/{n}/DONE")
        fs.create(done).close()

    def _write(self, store: Store, part: str) -> None:
        """Rows with their file: those of entries have it from the entry. A row of an id that several files share
        goes to each."""
        owner = materialize(store.entries.select(F.col("id").alias("_entry"), F.col("file_id").alias("_file")).distinct(), "stored-owner")

        def table(name: str, df: DataFrame) -> DataFrame:
            if name == "files":
                df = df.withColumn("_file", F.col("id"))
            elif "file_id" in df.columns:
                df = df.withColumn("_file", F.col("file_id"))
            else:
                df = df.join(owner, F.col("entry_id") == F.col("_entry")).drop("_entry")
            df.withColumn("_part", F.lit(part)).write.parquet(f"{self.folder}/parts/{part}/{name}")
            return df

        store.map(table)

    def update(self, files: DataFrame, batch: tuple[str, int] | None = None, listed: DataFrame | None = None) -> dict[str, int]:
        """Take in ``path, content, mod_time, hash``; returns how many files were processed, updated, skipped, deleted and in
        conflict.

        Of a path given twice the newest counts. Files whose time or hash is that of the store are skipped, those older than
        the store's are in conflict and left. ``listed`` (``path``) names all files there are; live ones that it lacks are
        deleted. A ``batch`` (stream and number) that the ledger has changes nothing and returns its counts.
        """
        ledger = self.ledger()
        if batch and (seen := ledger.filter((F.col("stream") == batch[0]) & (F.col("batch") == batch[1])).first()):
            return {c: seen[c] for c in COUNTS}
        newest = materialize(files.select("path", "content", "mod_time", "hash"), "stored-new")
        # Texts are moved for this only if a path is given twice.
        if not newest.groupBy("path").count().filter("count > 1").isEmpty():
            newest = newest.groupBy("path").agg(F.max_by(F.struct("content", "mod_time", "hash"), F.struct("mod_time", "hash")).alias("f")).select("path", "f.*")
            newest = materialize(newest, "stored-newest")
        live = self.files()
        told = sync.classify_files(newest.select("path", "mod_time", "hash"), live).filter("action <> 'delete'")
        if listed is not None:
            gone = live.select("path").join(listed.select("path").union(newest.select("path")).distinct(), "path", "left_anti")
            told = told.unionByName(gone.withColumn("action", F.lit("delete")))
        told = materialize(told, "stored-actions")
        report = sync.report(told).first().asDict()
        part = uuid.uuid4().hex
        taken = told.filter("action in ('insert', 'update')").select("path")
        fresh = newest.join(taken, "path", "left_semi")
        if report["updated"]:
            pieces = file_pieces(newest)
            self._write(outline_text.parse_pieces(pieces, fresh.filter("content is not null"), self.config, pieces.filter("piece > 0").isEmpty(), taken).store, part)
        kept = live.join(told.filter("action in ('update', 'delete')").select("path"), "path", "left_anti")
        # A file that was only touched is known by its new time from now on.
        touched = newest.join(told.filter("action = 'skip'"), "path").select("path", F.col("mod_time").alias("seen"))
        kept = kept.join(touched, "path", "left").withColumn("mod_time", F.greatest("mod_time", "seen")).drop("seen")
        entry = self.spark.createDataFrame([(batch[0] if batch else None, batch[1] if batch else None, *(report[c] for c in COUNTS))], LEDGER)
        self._publish(kept.unionByName(fresh.select("path", "mod_time", "hash", F.lit(part).alias("part"))), ledger.unionByName(entry))
        return report

    def scan(self, *paths: str) -> dict[str, int]:
        """``update`` from folders or files on disk. Only new files and those changed since are read; the rest is
        told by listing. The list of changed files goes to the reader, which wants paths; the first scan
        needs none."""
        listed = self.spark.read.format("binaryFile").load(list(paths)).select("path", F.col("modificationTime").alias("mod_time"))
        listed = materialize(listed, "stored-listed")
        stale = paths if not self.version() else [r.path for r in sync.stale_files(listed, self.files()).toLocalIterator()]
        read = outline_text.read_files(self.spark, *stale) if stale else self.spark.createDataFrame([], "path string, content string, mod_time timestamp, hash string")
        return self.update(read, listed=listed)

    def _live(self, name: str) -> DataFrame:
        schema = f"{SCHEMAS[name]}, _file string, _part string"
        live = self.files().select(F.md5("path").alias("_file"), F.col("part").alias("_part"))
        parts = {r._part for r in live.select("_part").distinct().collect()} & set(self._names(f"{self.folder}/parts"))  # one an update
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/parts/{p}/{name}" for p in sorted(parts)]).join(live, ["_file", "_part"], "left_semi")

    def store(self) -> Store:
        """The live rows of all tables. Files that aren't outlines have none but their own."""
        return Store(**{x.name: self._live(x.name).drop("_file", "_part") for x in fields(Store)})

    def compact(self) -> None:
        """All live rows into one part, in a new state."""
        part = uuid.uuid4().hex
        for x in fields(Store):
            self._live(x.name).withColumn("_part", F.lit(part)).write.parquet(f"{self.folder}/parts/{part}/{x.name}")
        self._publish(self.files().withColumn("part", F.lit(part)), self.ledger())

    def vacuum(self) -> None:
        """Delete the parts and states that the present state doesn't need. No one may be reading an older one."""
        now, parts = self.version(), {r.part for r in self.files().select("part").distinct().collect()}
        for kind, keep in (("parts", parts), ("states", {str(now)})):
            for name in set(self._names(f"{self.folder}/{kind}")) - keep:
                fs, p = self._fs(f"{self.folder}/{kind}/{name}")
                fs.delete(p, True)
