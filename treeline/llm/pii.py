"""Personal data: patterns, and terms that give protected entities away.

Four kinds are found by pattern and check: ``email``, ``ip``, ``card`` (Luhn) and ``phone``. Every
distinct value found is a protected entity. A word in the same document may reveal it although it
is no personal data in itself: the name beside an address, say. How strongly is estimated from the
corpus: with N documents, of which c(e) hold entity e, c(t) the term t and c(t, e) both, the
disclosure of e by t is

    PMI(t; e) / IC(e) = log(c(t, e) N / (c(t) c(e))) / log(N / c(e)),

1 if the term never occurs without the entity, 0 if it tells nothing. All four count whole
documents, repeated rows as often as they stand.

From ``SUPPORT`` common documents on, the counts speak for themselves. Below, where most personal
data is, a rare word shares a document with an entity by chance as well, so c(t, e) is multiplied by
the probability that the word belongs to the entity. It is 1 for a name part of the entity; for words
within ``WINDOW`` code points of a mention of it, it is pooled over all entities of a kind: the share of
words as rare that stand near mentions in excess of their rate elsewhere, by the lower confidence
bound of the one and the upper of the other. Under ``BELIEF`` a word counts as chance.

Which pairs are counted is found without all pairs of a document's words and entities: name parts by
an equality join, near words from the neighbourhood of each mention, and for pairs of ``SUPPORT``
documents, entities that stand in the same documents are one.

Terms are removed from ``REMOVE`` on and generalised (to ``[term]``) from ``GENERALISE`` on, wherever
they stand in the documents that hold the entity.

All of it is DataFrame operations. Matches come with their places: what ``split`` leaves between
the matches of ``regexp_extract_all`` gives their offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, materialize_narrow, table

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive quantifiers, and starts only where a run of characters does: the matches are those
#: of the plain patterns, but long runs are read once. ``\\G`` is the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this string has no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"\p{L}{2,}+"
#: Set in ``near`` of a word that a base span covers in part.
INSIDE = 1 << len(PATTERNS)
WINDOW = 100
SUPPORT = 3
BELIEF = 0.5
#: Of confidence bounds, in standard deviations (95 %, one-sided).
Z = 1.645
REMOVE, GENERALISE = 0.9, 0.75
#: Frequent terms are broadcast up to this many (some 20 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Arrays are worked through in blocks of this many, words near spans in larger ones first.
STEP, LARGE_STEP = 128, 4096


def _let(value: Column, f) -> Column:
    """``f(value)``, the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _blocks(a: Column, step: int) -> Column:
    """The array in slices of ``step``; none for an empty one."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / step)), lambda b: F.slice(x, (b * step + 1).cast("int"), step))
    return F.flatten(F.transform(F.filter(F.array(a), lambda x: F.size(x) > 0), cut))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start, end, value>>``, in code points from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # lengths of what precedes each match, and of the match
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct((g + F.length(v)).alias("step"), v.alias("value")))

    def placed(block: Column, before: Column) -> Column:
        def place(q: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                end = q["before"] + _total(F.transform(F.slice(q["block"], 1, i + 1), lambda x: x["step"]))
                return F.struct((end - F.length(s["value"])).alias("start"), end.alias("end"), s["value"].alias("value"))

            return F.transform(q["block"], one)

        return _let(F.struct(block.alias("block"), before.alias("before")), place)

    def run(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: _total(F.transform(b, lambda s: s["step"])))
        both = lambda q: F.flatten(F.transform(q["blocks"], lambda b, k: placed(b, _total(F.slice(q["totals"], 1, k)))))
        return _let(F.struct(blocks.alias("blocks"), totals.alias("totals")), both)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), _let(_blocks(steps, STEP), run)).otherwise(none)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), F.right(part(p), F.lit(3))).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds by start, then kind: ``array<struct<start, kind, end, value>>``,
    kind as its place in ``KINDS``."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def of(k: int, kind: str) -> Column:
        valid = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        spans = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none)

    return F.sort_array(F.concat(*[of(k, kind) for k, kind in enumerate(PATTERNS)]))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _entity(kind: Column, value: Column) -> Column:
    return F.xxhash64(kind, F.lower(value))


def _words(text: Column, spans: Column) -> Column:
    """``array<struct<start, end, term, near, to>>``: the words outside all base spans; bit k of ``near``
    tells whether a span of kind k is within ``WINDOW`` code points, ``to`` names their entities."""

    def place(w: Column, spans: Column) -> Column:
        bit = lambda s: F.element_at(F.array(*[F.lit(1 << k) for k in range(len(PATTERNS))]), s["kind"] + 1)
        over = lambda s: (w["start"] < s["end"]) & (w["end"] > s["start"])
        near = lambda s: (w["start"] >= s["start"] - WINDOW) & (w["end"] <= s["end"] + WINDOW)
        step = lambda acc, s: acc.bitwiseOR(F.when(over(s), F.lit(INSIDE)).when(near(s), bit(s)).otherwise(F.lit(0)))
        to = F.array_distinct(F.transform(F.filter(spans, near), lambda s: _entity(s["kind"], s["value"])))
        return F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("term"), F.aggregate(spans, F.lit(0), step).alias("near"), to.alias("to"))

    def by(step: int, inner):
        """In blocks of words, each with the spans around it."""

        def run(words: Column, spans: Column) -> Column:
            def one(block: Column) -> Column:
                lo, hi = F.element_at(block, 1)["start"] - WINDOW, F.element_at(block, -1)["end"] + WINDOW
                local = F.filter(spans, lambda s: (s["end"] >= lo) & (s["start"] <= hi))
                return _let(F.struct(block.alias("b"), local.alias("s")), lambda q: inner(q["b"], q["s"]))

            return F.flatten(F.transform(_blocks(words, step), one))

        return run

    each = by(LARGE_STEP, by(STEP, lambda words, spans: F.transform(words, lambda w: place(w, spans))))
    return F.filter(_let(F.struct(matches(text, TERM).alias("w"), spans.alias("s")), lambda q: each(q["w"], q["s"])), lambda w: w["near"] < INSIDE)


def bound(hits: float, of: float, sign: int) -> float:
    """Wilson's confidence bound of a rate, the lower one for sign -1; 0 or 1 if nothing is known."""
    if of <= 0:
        return float(sign > 0)
    p, z = hits / of, Z * Z / of
    return min(1.0, max(0.0, (p + z / 2 + sign * math.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)))


def _rarity(c: Column) -> Column:
    return F.floor(F.log2(c)).cast("int")


def _excess(terms: DataFrame, counts: DataFrame) -> dict[tuple[int, int], float]:
    """By kind and rarity, the share of the words near mentions that are more than chance."""
    whole = dict(counts.groupBy(_rarity(F.col("c_t")).alias("b")).agg(F.sum("c_t").alias("n")).collect())
    of = [F.sum(F.when(F.col("near").bitwiseAND(1 << k) > 0, F.col("m")).otherwise(0)) for k in range(len(PATTERNS))]
    near = {r[0]: r[1:] for r in terms.groupBy(_rarity(F.col("c_t")).alias("b")).agg(*of).collect()}
    out = {}
    for k in range(len(PATTERNS)):
        total = sum(n[k] for n in near.values())
        rest = sum(whole.values()) - total
        for b, n in near.items():
            low, high = bound(n[k], total, -1), bound(whole[b] - n[k], rest, 1)
            out[k, b] = max(0.0, 1 - high / low) if low > 0 else 0.0
    return out


def disclosure(c_te: Column, c_t: Column, c_e: Column, n: int, tied: Column) -> Column:
    """PMI over IC, of the c_te documents only the share that is ``tied``."""
    ic = F.log(F.lit(float(n)) / c_e)
    return F.when((ic > 0) & (tied > 0), F.log(tied * c_te * F.lit(float(n)) / (c_t * c_e)) / ic).otherwise(0.0)


def _most(c_e: Column, n: int) -> Column:
    """c(t, e) <= c(e), so a term in more documents than this can't reach ``GENERALISE``."""
    return c_e * F.pow(F.lit(float(max(n, 1))) / c_e, F.lit(1 - GENERALISE)) * 1.000001


def _told(terms: DataFrame, entities: DataFrame, n: int, excess: dict[tuple[int, int], float]) -> DataFrame:
    """``row, id, term, disclosure``: terms that disclose an entity of their document. ``terms`` has
    ``row, id, m, term, to, c_t`` and ``entities`` ``row, id, m, kind, e, names, c_e, same`` (of
    entities in the same documents) for each distinct document."""
    most = _most(F.col("c_e"), n)
    here = lambda a, b: (F.col(f"{a}.row") == F.col(f"{b}.row")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))

    # Pairs of SUPPORT documents: entities of the same documents are one.
    groups = entities.filter(F.col("c_e") >= SUPPORT).select("row", "id", "same", "c_e").distinct()
    often = terms.filter(F.col("c_t") >= SUPPORT).select("row", "id", "m", "term", "c_t")
    pairs = often.alias("t").join(groups.alias("g"), here("t", "g") & (F.col("c_t") <= most)).select("t.row", "t.id", "t.m", "t.term", "t.c_t", "g.same", "g.c_e")
    pairs = materialize(pairs, "pii-pairs")
    counted = pairs.groupBy("same", "term", "c_t", "c_e").agg(F.sum("m").alias("c_te")).filter(F.col("c_te") >= SUPPORT)
    strong = counted.select("same", "term", disclosure(F.col("c_te"), F.col("c_t"), F.col("c_e"), n, F.lit(1.0)).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    told = pairs.join(strong, ["same", "term"]).select("row", "id", "term", "disclosure")

    # Fewer: name parts, and words near a mention.
    name = entities.select("row", "id", "e", "c_e", F.explode("names").alias("term"))
    named = terms.alias("t").join(name.alias("e"), here("t", "e") & (F.col("t.term") == F.col("e.term"))).select("t.term", "c_t", "e.e", "c_e", F.lit(1.0).alias("tied"))
    pooled = F.lit(0.0)
    for (k, b), x in excess.items():
        if x >= BELIEF:
            pooled = F.when((F.col("kind") == k) & (_rarity(F.col("c_t")) == b), F.lit(x)).otherwise(pooled)
    of = entities.groupBy("e").agg(F.first("kind").alias("kind"), F.first("c_e").alias("c_e"))
    near = terms.select("term", "c_t", F.explode("to").alias("e")).distinct().join(of, "e").select("term", "c_t", "e", "c_e", pooled.alias("tied"))
    few = named.unionByName(near).filter((F.col("tied") > 0) & (F.col("c_t") <= most)).groupBy("term", "e", "c_t", "c_e").agg(F.max("tied").alias("tied"))
    few = materialize(few, "pii-few")
    both = terms.select("row", "id", "m", "term").join(few, "term").alias("t").join(entities.select("row", "id", "e").alias("e"), here("t", "e") & (F.col("t.e") == F.col("e.e")))
    both = materialize(both.select("t.row", "t.id", "t.m", "t.term", "t.e", "c_t", "c_e", "tied"), "pii-few-pairs")
    weak = both.groupBy("term", "e", "c_t", "c_e", "tied").agg(F.sum("m").alias("c_te"))
    weak = weak.select("term", "e", disclosure(F.col("c_te"), F.col("c_t"), F.col("c_e"), n, F.col("tied")).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    return told.unionByName(both.join(weak, ["term", "e"]).select("row", "id", "term", "disclosure"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, text, base, spans`` of every distinct (id, text): its base spans and all spans.

    ``row`` is a hash of both. Spans have ``start, kind, end, value``; the value of a term is
    ``remove`` or ``generalise``. A null text counts as empty and has none. Whole texts are
    searched, in time about linear in their length; repeated rows count as documents of their own
    but are reported once here. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    found = d.withColumn("base", base_spans(F.col("text"))).filter(F.size("base") > 0)
    found = found.select("row", "id", "base", _words(F.col("text"), F.col("base")).alias("words"))
    found = materialize(found.groupBy("row", "id").agg(F.count("*").alias("m"), F.first("base").alias("base"), F.first("words").alias("words")), "pii-base")

    n = docs.count()
    each = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0)), F.lower))
    counts = materialize(d.select(F.explode(each).alias("term")).groupBy("term").agg(F.count("*").alias("c_t")), "pii-counts")
    email = F.col("e.kind") == KINDS.index("email")
    names = F.when(email, F.array_distinct(F.split(F.substring_index(F.lower("e.value"), "@", 1), r"\P{L}+"))).otherwise(F.array().cast("array<string>"))
    held = found.select("row", "id", "m", F.explode("base").alias("e"))
    held = held.select("row", "id", "m", "e.kind", _entity(F.col("e.kind"), F.col("e.value")).alias("e"), names.alias("names")).dropDuplicates(["row", "id", "e"])
    same = F.xxhash64(F.sum("m"), F.bit_xor(F.xxhash64("row", "id")))
    entities = materialize(held.join(held.groupBy("e").agg(F.sum("m").alias("c_e"), same.alias("same")), "e"), "pii-entities")

    # No entity can be told by a term of more documents than this. Such terms go before anything is gathered.
    limit = entities.agg(F.max(_most(F.col("c_e"), n))).first()[0] or 0.0
    frequent = materialize_narrow(counts.filter(F.col("c_t") > limit).select("term"), "pii-frequent")
    frequent = F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent
    word = F.struct("w.start", "w.end")
    words = found.select("row", "id", "m", F.explode("words").alias("w")).withColumn("term", F.col("w.term"))
    near = words.filter("w.near > 0").groupBy("row", "id", "m", "term").agg(F.bit_or("w.near").alias("near")).join(counts, "term")
    rare = words.join(frequent, "term", "left_anti").groupBy("row", "id", "m", "term").agg(F.array_distinct(F.flatten(F.collect_list("w.to"))).alias("to"), F.collect_list(word).alias("places"))
    terms = materialize(rare.join(counts, "term"), "pii-terms")

    told = _told(terms, entities, n, _excess(near, counts)).groupBy("row", "id", "term").agg(F.max("disclosure").alias("disclosure"))
    span = lambda p: F.struct(p["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), p["end"].alias("end"), F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("value"))
    places = terms.alias("p").join(told.alias("t"), (F.col("p.row") == F.col("t.row")) & F.col("p.id").eqNullSafe(F.col("t.id")) & (F.col("p.term") == F.col("t.term")))
    spans = places.select("p.row", "p.id", F.transform("places", span).alias("s")).groupBy("row", "id").agg(F.flatten(F.collect_list("s")).alias("terms"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    joined = found.alias("f").join(spans.alias("t"), (F.col("f.row") == F.col("t.row")) & F.col("f.id").eqNullSafe(F.col("t.id")), "left")
    return joined.select("f.row", "f.id", "f.base", F.sort_array(F.concat("f.base", F.coalesce("t.terms", none))).alias("spans"))


def cleaned(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind in brackets, terms removed or generalised.
    Of overlapping spans the first names the replacement of them all."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def piece(q: Column) -> Column:
        """What a block of spans makes of its part of the text, which begins at ``at``."""

        def step(acc: Column, s: Column) -> Column:
            label = F.when(s["value"].eqNullSafe("remove") & (s["kind"] == len(KINDS) - 1), "").otherwise(F.element_at(names, s["kind"] + 1))
            more = F.concat(acc["out"], F.substring(q["text"], acc["at"] - q["at"] + 1, s["start"] - acc["at"]), label)
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

        return F.aggregate(q["block"], F.struct(q["at"].alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def run(q: Column) -> Column:
        reach = lambda k: F.coalesce(F.array_max(F.slice(q["ends"], 1, k)), F.lit(0))
        part = lambda b, k: _let(F.struct(b.alias("block"), reach(k).alias("at"), F.substring(text, reach(k) + 1, reach(k + 1) - reach(k)).alias("text")), piece)
        return F.concat(F.array_join(F.transform(q["blocks"], part), ""), F.substring(text, reach(F.size(q["ends"])) + 1, F.length(text)))

    blocks = _blocks(spans, STEP)
    ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
    return _let(F.struct(blocks.alias("blocks"), ends.alias("ends")), run)


def _is(kind: int):
    return lambda s: s["kind"] == kind


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sanitise(docs)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"))
    joined = keyed.join(found, (F.col("key") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return joined.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and revealing terms taken out of its text."""
    found = materialize(sanitise(docs).select(F.col("row").alias("_pii_row"), F.col("id").alias("_pii_id"), F.col("spans").alias("_pii_spans")), "pii-spans")
    keyed = docs.withColumn("_pii_key", F.xxhash64("doc_id", "text"))
    joined = keyed.join(found, (F.col("_pii_key") == F.col("_pii_row")) & F.col("doc_id").eqNullSafe(F.col("_pii_id")), "left")
    text = F.when(F.size("_pii_spans") > 0, cleaned(F.col("text"), F.col("_pii_spans"))).otherwise(F.col("text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
