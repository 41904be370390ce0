"""Stores kept on disk: scans, streams, broken and repeated updates."""

import os

import pytest

from treeline.operators import sync
from treeline.sources import outline_text, stored
from treeline.streaming import clocked


def titles(fs):
    return sorted(r.title for r in fs.store().entries.collect())


def put(folder, name, text, at):
    (folder / name).write_text(text)
    os.utime(folder / name, (at, at))


def test_scan_reads_what_changed(spark, tmp_path, monkeypatch):
    notes = tmp_path / "notes"
    notes.mkdir()
    put(notes, "a.org", "* A\n:PROPERTIES:\n:ID: a\n:END:\nbody [[id:b]]\n", 1000)
    put(notes, "b.org", "* B\n** B2\n", 1000)
    put(notes, "c.txt", "no outline", 1000)
    fs = stored.FileStore(spark, f"file://{tmp_path}/store")
    assert fs.scan(str(notes)) == {"processed": 3, "updated": 3, "skipped": 0, "deleted": 0, "conflicts": 0}
    assert titles(fs) == ["A", "B", "B2"] and fs.store().entry_links.count() == 1

    # another text under the same time isn't seen, so the file wasn't read
    put(notes, "a.org", "* Changed without notice\n", 1000)
    put(notes, "b.org", "* New B\n", 2000)
    put(notes, "d.org", "* D\n", 500)
    assert fs.scan(str(notes)) == {"processed": 2, "updated": 2, "skipped": 0, "deleted": 0, "conflicts": 0}
    assert titles(fs) == ["A", "D", "New B"]

    # a touched file is skipped, and not read again later
    put(notes, "d.org", "* D\n", 600)
    assert fs.scan(str(notes))["skipped"] == 1
    assert sync.stale_files(spark.createDataFrame([(f"file:{notes}/d.org",)], "path string").selectExpr("path", "timestamp_seconds(600) AS mod_time"), fs.files()).count() == 0
    (notes / "d.org").unlink()

    # a scan that breaks off leaves the state before it
    before, version = titles(fs), fs.version()
    put(notes, "b.org", "* Newest B\n", 3000)
    with monkeypatch.context() as m:
        m.setattr(fs, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            fs.scan(str(notes))
    assert titles(fs) == before and fs.version() == version
    os.makedirs(tmp_path / "store" / "states" / "99" / "files")  # begun, never done
    assert fs.scan(str(notes)) == {"processed": 1, "updated": 1, "skipped": 0, "deleted": 1, "conflicts": 0}
    assert titles(fs) == ["A", "Newest B"] and fs.version() == 100

    links = fs.store().entry_links.count()
    fs.compact()
    fs.vacuum()
    assert len(os.listdir(tmp_path / "store" / "parts")) == 1 and os.listdir(tmp_path / "store" / "states") == ["101"]
    assert titles(fs) == ["A", "Newest B"] and fs.store().entry_links.count() == links
    assert fs.scan(str(notes)) == {"processed": 0, "updated": 0, "skipped": 0, "deleted": 0, "conflicts": 0}


def test_stream_and_replay(spark, tmp_path):
    schema = "path string, content string, mod_time timestamp, hash string"
    inbox = tmp_path / "in"
    rows = [
        [("a.org", "* A\n", 10), ("b.org", "* B\n", 10)],
        [("a.org", "* A two\n", 20), ("a.org", "* A three\n", 30), ("c.org", "* C\n", 20)],
        [("b.org", "* older B\n", 5), ("c.org", "* C\n", 40)],
    ]
    batches = [spark.createDataFrame([(p, c, t) for p, c, t in b], "path string, content string, t long").selectExpr("path", "content", "timestamp_seconds(t) AS mod_time", "md5(content) AS hash") for b in rows]
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(inbox))
        for f in inbox.glob("*.parquet"):
            if f.stat().st_mtime > 5000:
                os.utime(f, (1000 + k, 1000 + k))
    fs = stored.FileStore(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    clocked.sync_files(stream, fs, "inbox", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert titles(fs) == ["A three", "B", "C"]
    ledger = [tuple(r) for r in fs.ledger().orderBy("batch").collect()]
    assert ledger == [("inbox", 0, 2, 2, 0, 0, 0), ("inbox", 1, 2, 2, 0, 0, 0), ("inbox", 2, 2, 0, 1, 0, 1)]
    version = fs.version()
    assert fs.update(batches[1], ("inbox", 1)) == dict(zip(stored.COUNTS, ledger[1][2:], strict=True))
    assert fs.version() == version and titles(fs) == ["A three", "B", "C"]

    # as one batch of everything
    once = stored.FileStore(spark, f"file://{tmp_path}/once")
    once.update(batches[0].union(batches[1]).union(batches[2]))
    assert titles(once) == titles(fs) == sorted(r.title for r in outline_text.parse(spark.createDataFrame([("a.org", "* A three\n"), ("b.org", "* B\n"), ("c.org", "* C\n")], "path string, content string")).store.entries.collect())


def test_nothing(spark, tmp_path):
    fs = stored.FileStore(spark, f"file://{tmp_path}/store")
    assert fs.version() == 0 and fs.store().entries.count() == 0
    assert fs.update(spark.createDataFrame([], "path string, content string, mod_time timestamp, hash string"))["processed"] == 0
    assert fs.store().files.count() == 0 and fs.ledger().count() == 1


def test_headlines_keep_spaces_at_their_end(spark, tmp_path):
    """A headline is the rest of its line; title, and what else is cut out of it, has no spaces at its end."""
    from tests.conftest import duck_rows, rows
    from treeline import queries as outline

    got = outline_text.parse(spark.createDataFrame([("a", "* A b  \n* TODO \n* C {x}  \n* D  :t: \n*  E")], "path string, content string")).store.entries
    assert [(r.headline, r.title, r.locator) for r in got.orderBy("byte_offset").collect()] == [("A b  ", "A b", None), ("", "", None), ("C {x}  ", "C", "x"), ("D", "D", None), ("E", "E", None)]
    texts = ["", None, "\n", "ends in a space \nx", "e :", "e\t ", " e", "e" * 40, "\n\nx"]
    docs = spark.createDataFrame([(15 * i + k, t, "en", "s", 1) for i, t in enumerate(texts) for k in (0, 1, 2, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/written")
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    for t in ("customer", "nation", "region", "orders", "lineitem", "events", "embeddings"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    assert rows(outline.QUERIES["store_updates"](spark, str(tmp_path))) == duck_rows(outline.SQL["store_updates"], str(tmp_path))
