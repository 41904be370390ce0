"""Intermediate tables."""

import os

from treeline import storage


def test_clear_deletes_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert storage.materialize(spark.range(3), "x").count() == 3
    assert len(os.listdir(tmp_path)) == 1
    storage.clear(spark)
    assert os.listdir(tmp_path) == []
    storage.clear(spark)
