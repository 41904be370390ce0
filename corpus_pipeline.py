"""Corpus preparation: the stages of a pipeline over ``documents``.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir), works on all
rows of ``docs`` and returns a DataFrame. ``run`` writes what a stage returns to the shared folder
and reads it again as the next stage's ``docs``. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import language_id, mixing, ngram_join, pieces, pii
from treeline.llm.common import materialize, table

STAGES = [
    ("language ID", language_id.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("PII", pii.stage),
    ("mixing sources to target weights", mixing.stage),
    ("SentencePiece encoding and decoding", pieces.stage),
]

#: The stages train a model and solve for rates by iteration, which SQL can't express; they are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}".replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
