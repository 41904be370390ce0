"""Full-text search of headlines and titles: an inverted index of stems with weights.

The index is a table of postings, in folders by what stems begin with, so that a search reads the folders of its words and no
title. Words are stemmed once for each word of the vocabulary.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import STOP, stem
from ..model import Store
from ..storage import NARROW, materialize

#: Weights of a word in the headline and in the title.
WEIGHTS = {"headline": 1.0, "title": 0.4}
POSTINGS = "stem string, entry_id string, weight double, n long, head string"
#: Rows of a word above which they aren't gathered by word.
FREQUENT = NARROW
WORD = r"[^\p{L}\p{N}]+"


def _head(stem: Column) -> Column:
    """The folder of a stem: what it begins with."""
    found = F.regexp_extract(stem, "^[a-z0-9]{1,2}", 0)
    return F.when(found == "", F.lit("_")).otherwise(found)


def index(store: Store) -> DataFrame:
    """``stem, entry_id, weight, n``: how often an entry has words of a stem, and the sum of their weights. Stop words
    are left out; entries that share an id are one. Null headlines and titles have no words."""
    parts = F.array(*[F.struct(F.lit(w).alias("weight"), F.split(F.lower(F.coalesce(c, F.lit(""))), WORD).alias("words")) for c, w in WEIGHTS.items()])
    words = store.entries.select("id", F.explode(parts).alias("p")).select("id", "p.weight", F.explode("p.words").alias("word")).filter((F.col("word") != "") & ~F.col("word").isin(*STOP))
    # Other words are their own stems. The stem of a frequent word is brought to its rows, not they to it; there are few of them.
    own = (F.length("word") <= 2) | ~F.col("word").rlike("^[a-z]+$")
    counted = words.filter(~own).groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = materialize(counted.select("word", "n", stem(F.col("word")).alias("stem")), "vocabulary")
    frequent, rare = vocabulary.filter(F.col("n") > FREQUENT).select("word", "stem"), vocabulary.filter(F.col("n") <= FREQUENT).select("word", "stem")
    known = words.join(F.broadcast(frequent), "word", "left").withColumn("stem", F.when(own, F.col("word")).otherwise(F.col("stem")))
    stems = known.filter("stem is not null").select("stem", "id", "weight")
    if not rare.isEmpty():
        stems = stems.unionByName(known.filter("stem is null").drop("stem").join(rare, "word").select("stem", "id", "weight"))
    return stems.groupBy("stem", F.col("id").alias("entry_id")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def write_index(postings: DataFrame, folder: str) -> None:
    """Postings below ``folder``, by what stems begin with, sorted by stem. Files are ranges of stems and entries of like size, so that
    a stem that all entries have is in several."""
    p = postings.withColumn("head", _head(F.col("stem")))
    p.repartitionByRange("head", "stem", F.xxhash64("entry_id")).sortWithinPartitions("head", "stem").write.mode("overwrite").partitionBy("head").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(folder)


def search(postings: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """``entry_id, rank``: entries that for each word of ``text`` have a stem that begins with the word's, best first by the sum of
    weights; ties by id. Stop words don't count; a text without other words finds nothing. Of a written index only the
    folders of the words are read."""
    spark = postings.sparkSession
    words = sorted({w for w in re.split(r"[\W_]+", text.lower()) if w} - STOP)
    asked = spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w")).alias("s")).distinct()
    wanted = [(r.s, r.h) for r in asked.select("s", _head(F.col("s")).alias("h")).collect()]  # those of the search
    if not wanted:
        return postings.select("entry_id", F.lit(0.0).alias("rank")).limit(0)
    found = postings
    if "head" in postings.columns:
        found = found.filter(reduce(Column.__or__, [F.col("head") == h if len(h) == 2 or h == "_" else F.col("head").startswith(h) for _, h in wanted]))
    found = found.filter(reduce(Column.__or__, [F.col("stem").startswith(s) for s, _ in wanted]))
    has = [F.bool_or(F.col("stem").startswith(s)).alias(f"w{i}") for i, (s, _) in enumerate(wanted)]
    hits = found.groupBy("entry_id").agg(*has, F.sum("weight").alias("rank"))
    hits = hits.filter(reduce(Column.__and__, [F.col(f"w{i}") for i in range(len(wanted))])).select("entry_id", "rank")
    return hits if limit is None else hits.orderBy(F.desc("rank"), "entry_id").limit(limit)
