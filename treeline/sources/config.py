"""Settings from files: keywords and their transitions, or any of ``Config``'s fields."""

from __future__ import annotations

import re
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Config

#: What the colour of a keyword's node says.
START, OPEN, CLOSED = "red", "blue", "green"
NAME = r'(?:"([^"]+)"|([A-Za-z0-9_]+))'


def from_graph(spark: SparkSession, path: str, base: Config | None = None) -> Config:
    """``base`` with the keywords and transitions of a graph in DOT, a statement a line: red nodes are
    keywords to start with (and open), blue ones open, green ones closed; an edge is a transition that is
    allowed. The file is read by Spark, what comes to the driver is a row for each keyword and transition."""
    line = spark.read.text(path).select(F.regexp_replace("value", r"//.*$", "").alias("v"))
    name = lambda k: F.coalesce(F.nullif(F.regexp_extract("v", rf"^\s*{NAME}", k), F.lit("")), F.nullif(F.regexp_extract("v", rf"^\s*{NAME}", k + 1), F.lit("")))
    to = lambda k: F.nullif(F.regexp_extract("v", rf"->\s*{NAME}", k), F.lit(""))
    colour = F.lower(F.regexp_extract("v", r'\bcolor\s*=\s*"?([A-Za-z]+)', 1))
    got = line.select(name(1).alias("a"), F.coalesce(to(1), to(2)).alias("b"), colour.alias("colour")).filter("a is not null").distinct().collect()
    nodes = {c: tuple(sorted(r.a for r in got if r.b is None and r.colour == c)) for c in (START, OPEN, CLOSED)}
    old = {f.name: getattr(base or Config(), f.name) for f in fields(Config)}
    return Config(**old | {"start_keywords": nodes[START], "open_keywords": nodes[START] + nodes[OPEN], "closed_keywords": nodes[CLOSED], "transitions": tuple(sorted((r.a, r.b) for r in got if r.b))})


def from_json(spark: SparkSession, path: str) -> Config:
    """Fields of ``Config`` from one JSON object; those it lacks keep their defaults, others are an error."""
    row = spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)
    if unknown := sorted(set(row) - {f.name for f in fields(Config)}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    tuples = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in row.items()}
    return Config(**tuples)


def header(text):
    """``array<struct<name, value>>`` of the ``#+name: value`` lines of a text, as a column."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^#\+[^:\s]+:.*$"), F.lit(0))
    part = lambda m, k: F.regexp_extract(m, r"^#\+([^:\s]+):\s*(.*?)\s*$", k)
    return F.transform(found, lambda m: F.struct(F.lower(part(m, 1)).alias("name"), part(m, 2).alias("value")))


def metadata(given, text):
    """A site's metadata of a page: the map ``given``, and what the page's header adds to it; the first
    value of a name counts."""
    own = header(text)
    firsts = F.filter(own, lambda x, i: ~F.exists(F.slice(own, F.lit(1), i), lambda y: y["name"] == x["name"]))
    added = F.map_from_entries(F.filter(firsts, lambda x: ~F.coalesce(F.map_contains_key(given, x["name"]), F.lit(False))))
    return F.map_concat(F.coalesce(given, F.create_map().cast("map<string,string>")), added)
