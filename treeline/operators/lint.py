"""Quality rules over a store. Every rule is a DataFrame of messages
``file_id, entry_id, severity, code, arg``; ``lint`` is their union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import short_sha512, slug
from ..model import Config, Store
from ..sources.inventory import known, resolve
from ..storage import NARROW, materialize

LEVELS = ("DEBUG", "ALL", "INFO", "WARN", "ERROR")
RULES: dict[str, Callable[[Store, Config], DataFrame]] = {}
#: Those about what hangs on an entry, which are worked out together: severity, facts asked for, arguments of the messages.
ENTRY_RULES: dict[str, tuple[str, tuple[str, ...], Callable[[], Column]]] = {}
#: Longest category that isn't reported.
CATEGORY_WIDTH = 10


def rule(code: str, severity: str):
    """Register a rule that returns ``entry_id`` or ``file_id`` and perhaps ``arg``."""

    def add(f):
        def run(store: Store, config: Config) -> DataFrame:
            df = f(store, config)
            has = lambda c: F.col(c) if c in df.columns else F.lit(None)
            return df.select(has("file_id").cast("string").alias("file_id"), has("entry_id").cast("string").alias("entry_id"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), has("arg").cast("string").alias("arg"))

        RULES[code] = run
        return f

    return add


def entry_rule(code: str, severity: str, *facts: str):
    """Register a rule that returns, for the row ``_facts`` has of an entry, an array with the argument of each message."""

    def add(f):
        ENTRY_RULES[code] = (severity, facts, f)
        RULES[code] = lambda store, config: _entry_messages(store, (code,))
        return f

    return add


def lint(store: Store, config: Config | None = None, level: str = "INFO", codes: tuple[str, ...] | None = None) -> DataFrame:
    """Messages of all rules (or those of ``codes``) at ``level`` or above."""
    config = config or Config()
    codes = tuple(codes or RULES)
    parts = [RULES[c](store, config) for c in codes if c not in ENTRY_RULES]
    together = tuple(c for c in codes if c in ENTRY_RULES)
    if together:
        parts.append(_entry_messages(store, together))
    order = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("severity"))
    return reduce(DataFrame.unionByName, parts).filter(order >= LEVELS.index(level) + 1)


def render(messages: DataFrame, store: Store) -> DataFrame:
    """``line``: path, entry, severity, code and argument as text."""
    files = store.files.select(F.col("id").alias("f"), "path")
    owner = store.entries.select(F.col("id").alias("e"), F.col("file_id").alias("ef")).distinct()
    m = messages.join(owner, F.col("entry_id") == F.col("e"), "left").withColumn("file_id", F.coalesce("file_id", "ef")).join(files, F.col("file_id") == F.col("f"), "left")
    return m.select(F.concat_ws("", F.coalesce("path", F.lit("?")), F.concat(F.lit(":"), "entry_id"), F.lit(": "), "severity", F.lit(" "), "code", F.concat(F.lit(" "), "arg")).alias("line"))


def _file_property(s: Store, name: str) -> DataFrame:
    return s.file_properties.filter(F.lower("name") == name.lower()).select("file_id", F.col("value").alias("v"))


def _property(s: Store, name: str) -> DataFrame:
    return s.entry_properties.filter(F.lower("name") == name.lower()).select("entry_id", F.col("value").alias("v"))


def _entries(s: Store, *cols: str) -> DataFrame:
    return s.entries.select(F.col("id").alias("entry_id"), *cols)


def _found(df: DataFrame, name: str) -> DataFrame:
    """What a rule looks into, written down before it is joined: what is little need not be moved, and neither need the tables
    it is joined with. If there is nothing, the optimizer sees that and leaves them out. Many rows are moved, however small
    they are as files."""
    df = materialize(df, f"lint-{name}")
    n = df.count()
    return df.filter(F.lit(False)) if n == 0 else df if n <= NARROW else df.hint("merge")


#: Kinds of rows that ``_facts`` brings together.
_KINDS = ("entries", "tags", "properties", "stamps", "categories", "changes", "bodies")


def _facts(s: Store, kinds: set[str]) -> DataFrame:
    """What rules ask about an id, one row each: ``keywords`` of its entries (distinct, none is null) and how many ``times``,
    ``doubled`` tags and properties, lower-case ``names`` of properties that rules know, whether it is ``tagged``, tagged LINK
    (``linked``), ``planned``, ``reviewed``, has a category of its own (``own``) or only white space in its body (``blank``),
    and the keyword that its newest change of state leads to (``changed``). The rows of ``kinds`` are moved once,
    together."""
    none = F.lit(None)
    reviews = F.when(F.upper("name").isin("LAST_REVIEW", "NEXT_REVIEW", "REVIEWS"), 1)
    # An id that is null is nobody's, but its repeats count.
    owned = lambda df: df.filter("entry_id is not null")
    made = {
        "entries": (_entries(s, "keyword_value"), F.col("keyword_value"), none),
        "tags": (s.entry_tags, F.col("tag"), none),
        "properties": (s.entry_properties, F.lower("name"), reviews),
        "stamps": (owned(s.entry_stamps).filter("stamp_type in ('scheduled', 'deadline', 'closed')"), none, none),
        "categories": (owned(s.entry_categories).filter("is_explicit"), none, none),
        "changes": (owned(s.entry_log_entries).filter("log_type = 'state' and to_keyword is not null"), F.col("to_keyword"), F.col("position")),
        "bodies": (owned(s.entry_body_blocks).groupBy("entry_id").agg(F.bool_and(F.col("block_type") == "whitespace").alias("only")).filter("only"), none, none),
    }
    some = [df.select("entry_id", F.lit(_KINDS.index(k)).alias("kind"), v.cast("string").alias("v"), n.cast("int").alias("n")) for k, (df, v, n) in made.items() if k in kinds]
    each = reduce(DataFrame.unionByName, some).repartition("entry_id").groupBy("entry_id", "kind", "v").agg(F.count("*").alias("times"), F.min("n").alias("n"))
    is_ = lambda k: F.col("kind") == _KINDS.index(k)
    has = lambda k: is_(k) & F.col("entry_id").isNotNull()
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return each.groupBy("entry_id").agg(
        F.collect_list(F.when(is_("entries"), F.struct("v", "times"))).alias("keywords"),
        F.collect_list(F.when((is_("tags") | is_("properties")) & (F.col("times") > 1), F.struct("kind", "v"))).alias("doubled"),
        F.collect_set(F.when(has("properties") & F.col("v").isin("created", "id", "url", "last_repeat"), F.col("v"))).alias("names"),
        any_(has("tags")).alias("tagged"),
        any_(has("tags") & (F.col("v") == "LINK")).alias("linked"),
        any_(has("properties") & (F.col("n") == 1)).alias("reviewed"),
        any_(has("stamps")).alias("planned"),
        any_(has("categories")).alias("own"),
        any_(has("bodies")).alias("blank"),
        F.min_by(F.when(has("changes"), F.col("v")), F.when(has("changes"), F.col("n"))).alias("changed"),
    )


def _entry_messages(s: Store, codes: tuple[str, ...]) -> DataFrame:
    none = F.array().cast("array<string>")
    said = lambda severity, code, args: F.transform(F.coalesce(args, none), lambda a: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), a.alias("arg")))
    every = F.flatten(F.array(*[said(ENTRY_RULES[c][0], c, ENTRY_RULES[c][2]()) for c in codes]))
    facts = _facts(s, {k for c in codes for k in ENTRY_RULES[c][1]})
    return facts.select(F.lit(None).cast("string").alias("file_id"), F.col("entry_id").cast("string").alias("entry_id"), F.inline(every))


def _times(which: Callable[[Column], Column]) -> Column:
    """How many entries have a keyword (null: none) such as ``which`` says."""
    of = F.transform(F.filter("keywords", lambda k: which(k["v"])), lambda k: k["times"])
    return F.aggregate(of, F.lit(0).cast("long"), lambda a, b: a + b)


def _each(which: Callable[[Column], Column]) -> Column:
    """A message without argument for each of these entries."""
    return F.array_repeat(F.lit(None).cast("string"), _times(which).cast("int"))


def _lacking(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


@rule("FileTitleMissing", "INFO")
def _(s, c):
    return _lacking(s.files.select(F.col("id").alias("file_id")), _file_property(s, "title"), "file_id")


@rule("FileIdMissing", "INFO")
def _(s, c):
    return _lacking(s.files.select(F.col("id").alias("file_id")), _file_property(s, "id"), "file_id")


@rule("FileSlugMismatch", "INFO")
def _(s, c):
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"^[0-9]{8,}-?|\.[^.]*$", "")
    f = s.files.select(F.col("id").alias("file_id"), base.alias("base")).join(_file_property(s, "title"), "file_id")
    f = _lacking(f, _file_property(s, "noslug"), "file_id")
    return f.filter(slug(F.col("v")) != slug(F.col("base"))).select("file_id", slug(F.col("v")).alias("arg"))


@rule("TitleNotLastProperty", "WARN")
def _(s, c):
    p = s.file_properties.filter("source = 'file'").groupBy("file_id").agg(F.max_by("name", "position").alias("arg"), F.max(F.lower("name") == "title").alias("has"))
    return p.filter(F.col("has") & (F.lower("arg") != "title")).select("file_id", "arg")


@rule("DuplicateFileProperty", "ERROR")
def _(s, c):
    p = s.file_properties.filter(~F.lower("name").isin("link", "tags")).groupBy("file_id", F.lower("name").alias("arg")).count()
    return p.filter("count > 1")


@entry_rule("DuplicateIdentifier", "ERROR", "entries")
def _():
    n = _times(lambda v: F.lit(True))
    return F.when(n > 1, F.array(n.cast("string")))


@rule("TodoMismatch", "WARN")
def _(s, c):
    """The file tag ``todo`` and open keywords go together."""
    opened = s.entries.groupBy("file_id").agg(F.bool_or(F.coalesce(F.col("keyword_type") == "open", F.lit(False))).alias("has"))
    tagged = _file_property(s, "filetags").filter(F.col("v").contains(":todo:")).select("file_id", F.lit(True).alias("tag"))
    both = opened.join(tagged, "file_id", "left").filter(F.col("has") != F.coalesce("tag", F.lit(False)))
    return _lacking(both, _file_property(s, "has_todo"), "file_id").select("file_id", F.when(F.col("has"), "untagged").otherwise("no open entry").alias("arg"))


@rule("TagNotAllowed", "WARN")
def _(s, c):
    allowed = _found(_file_property(s, "tags_all").select("file_id", F.explode(F.split("v", "[ :]+")).alias("tag")), "tags")
    owned = _entries(s, "file_id").join(allowed.select("file_id"), "file_id", "left_semi").distinct()
    t = s.entry_tags.join(owned, "entry_id")
    return t.join(allowed, ["file_id", "tag"], "left_anti").select("file_id", "entry_id", F.col("tag").alias("arg"))


@rule("VerbNotAllowed", "WARN")
def _(s, c):
    allowed = _found(_file_property(s, "verb_all").select("file_id", F.explode(F.split("v", "[ :]+")).alias("verb")), "verbs")
    e = s.entries.filter("verb is not null").select(F.col("id").alias("entry_id"), "file_id", "verb").join(allowed.select("file_id").distinct(), "file_id")
    return e.join(allowed, ["file_id", "verb"], "left_anti").select("file_id", "entry_id", F.col("verb").alias("arg"))


def _absent(named: DataFrame, s: Store, c: Config, folders: bool | None = None) -> DataFrame:
    """``file_id, entry_id, arg``: those of ``named`` whose ``arg`` (a path, from the folder of the file that names it) isn't
    there; only files, or only folders, if ``folders`` says so. Of an entry the file is that of every row with its id."""
    there = c.paths if c.paths is not None else known(s.files)
    if folders is not None:
        there = there.filter(F.col("is_folder") == folders)
    named = _found(named, "paths")
    owner = _entries(s, "file_id").withColumnRenamed("file_id", "owner")
    few = named.count() <= NARROW
    owner = owner.join(named.select("entry_id"), "entry_id", "left_semi").distinct() if few else owner.repartition("entry_id").distinct()
    whole = named.filter("entry_id is null").withColumn("owner", F.col("file_id"))
    whole = whole.unionByName(named.filter("entry_id is not null").drop("file_id").join(owner, "entry_id").withColumn("file_id", F.lit(None).cast("string")))
    x = whole.join(s.files.select(F.col("id").alias("owner"), F.col("path").alias("file")), "owner")
    x = x.withColumn("path", resolve(F.col("arg"), F.col("file"), c.home)).filter("path not in ('', '/')")
    return x.join(there.select("path"), "path", "left_anti")


def _named(df: DataFrame, arg: Column) -> DataFrame:
    has = lambda k: F.col(k) if k in df.columns else F.lit(None)
    return df.select(has("file_id").cast("string").alias("file_id"), has("entry_id").cast("string").alias("entry_id"), arg.alias("arg")).filter("trim(arg) <> ''")


@rule("BrokenFileLink", "ERROR")
def _(s, c):
    """``file:`` links to nothing, in preambles, paragraphs and the property URL, and NOTER_DOCUMENT, unless the file has
    IGNORE_LINKS. A path ends at a colon."""
    link = r"\[\[file:([^\]:]+)"
    every = lambda text: F.explode(F.regexp_extract_all(text, F.lit(link), F.lit(1)))
    loose = F.regexp_replace("preamble", r"(?ims)^\s*#\+begin.*?^\s*#\+end[^\n]*$", "")
    noter = F.regexp_extract(F.regexp_replace("v", r"^\[\[(file:)?", ""), "^([^]:]+)", 1)
    named = [
        _named(s.files.withColumnRenamed("id", "file_id"), every(loose)),
        _named(s.entry_body_blocks.filter((F.col("block_type") == "paragraph") & F.contains("content", F.lit("[[file:"))), every(F.col("content"))),
        _named(_property(s, "url"), every(F.col("v"))),
        _named(_property(s, "noter_document").withColumn("v", F.when(~F.contains(noter, F.lit("devonthink")), noter)), F.col("v")),
    ]
    broken = _absent(reduce(DataFrame.unionByName, named), s, c)
    ignored = _file_property(s, "ignore_links").select(F.col("file_id").alias("owner")).distinct()
    return broken.join(ignored, "owner", "left_anti").select("file_id", "entry_id", "arg")


@rule("DanglingIdLink", "ERROR")
def _(s, c):
    from .stats import dangling_links

    return dangling_links(s).withColumnRenamed("target", "arg")


def _kept(lacks: str) -> Column:
    """Keywords of entries with a keyword or a category of their own, if they lack a property."""
    kept = F.filter("keywords", lambda k: k["v"].isNotNull() | F.col("own"))
    return F.when(~F.array_contains("names", lacks), F.transform(kept, lambda k: k["v"]))


@entry_rule("TodoMissingCreated", "WARN", "entries", "categories", "properties")
def _():
    return _kept("created")


@entry_rule("TodoMissingId", "WARN", "entries", "categories", "properties")
def _():
    return _kept("id")


@rule("AttachmentsWithoutTag", "WARN")
def _(s, c):
    """Attachments, but no tag FILE."""
    return _lacking(s.entry_properties.filter("name = 'Attachments'").select("entry_id").distinct(), s.entry_tags.filter("tag = 'FILE'"), "entry_id")


@rule("AttachmentsMissing", "WARN")
def _(s, c):
    """Attachments or a tag FILE, but no folder below that of attachments: the first two characters of the ID, then the
    rest."""
    said = s.entry_properties.filter("name = 'Attachments'").select("entry_id").unionByName(s.entry_tags.filter("tag = 'FILE'").select("entry_id")).distinct()
    ids = _property(s, "id").filter(F.lit(c.attachments is not None)).join(said, "entry_id", "left_semi")
    folder = F.concat_ws("/", F.lit(c.attachments or ""), F.substring("v", 1, 2), F.substring(F.col("v"), F.lit(3), F.length("v")))
    return _absent(_named(ids, folder), s, c, folders=True).select("entry_id", "arg")


@rule("WhitespaceAtStartOfNote", "WARN")
def _(s, c):
    """A log entry's note begins with a blank line."""
    return s.entry_log_bodies.filter("position = 0 and block_type = 'whitespace'").select("entry_id", F.col("log_position").alias("arg"))


@entry_rule("TaskWithoutTags", "WARN", "entries", "tags")
def _():
    return F.when(~F.col("tagged"), _each(lambda v: v == "TASK"))


@entry_rule("LinkWithoutUrl", "WARN", "entries", "properties")
def _():
    return F.when(~F.array_contains("names", "url"), _each(lambda v: v == "LINK"))


@entry_rule("LinkTagRedundant", "WARN", "entries", "tags")
def _():
    return F.when(F.col("linked"), _each(lambda v: v == "LINK"))


@rule("CategoryTooLong", "WARN")
def _(s, c):
    return s.entry_categories.filter(F.length("category") > CATEGORY_WIDTH).select("entry_id", F.col("category").alias("arg"))


@rule("TitleDoubleSpace", "WARN")
def _(s, c):
    return _entries(s, "title").filter(F.contains("title", F.lit("  "))).select("entry_id", F.col("title").alias("arg"))


def _doubled(kind: str) -> Column:
    return F.transform(F.filter("doubled", lambda x: x["kind"] == _KINDS.index(kind)), lambda x: x["v"])


@entry_rule("DuplicateTag", "ERROR", "tags")
def _():
    return _doubled("tags")


@entry_rule("DuplicateProperty", "ERROR", "properties")
def _():
    return _doubled("properties")


def _body(pattern: str):
    def of(s: Store, c: Config) -> DataFrame:
        return s.entry_body_blocks.filter((F.col("block_type") == "paragraph") & F.col("content").rlike(pattern)).select("entry_id", F.col("position").alias("arg"))

    return of


rule("MisplacedDrawer", "ERROR")(_body(r"(?m)^\s*:PROPERTIES:"))
rule("MisplacedDrawerEnd", "ERROR")(_body(r"(?m)^\s*:END:"))
rule("MisplacedPlanning", "ERROR")(_body(r"(?m)^\s*(SCHEDULED|DEADLINE|CLOSED): *[<\[]"))
rule("MisplacedLogEntry", "ERROR")(_body(r'(?m)^\s*- (State "|Note taken on|CLOSING NOTE)'))


def _history(s: Store) -> DataFrame:
    """State changes oldest first with the one before. A repeating entry may start over."""
    w = W.partitionBy("entry_id").orderBy(F.desc("position"))
    t = F.struct("time_day", "time_start")
    h = s.entry_log_entries.filter("log_type = 'state'").select("entry_id", "position", "from_keyword", "to_keyword", t.alias("t"), F.last("to_keyword", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("previous"), F.lag(t).over(w).alias("t_previous"), F.row_number().over(w).alias("k"))
    repeating = _property(s, "last_repeat").select("entry_id", F.lit(True).alias("repeats")).distinct()
    return h.join(repeating, "entry_id", "left")


@rule("StateChangeTimeOrder", "WARN")
def _(s, c):
    return _history(s).filter(F.col("t") < F.col("t_previous")).select("entry_id", F.col("position").alias("arg"))


@rule("StateChangeFirst", "WARN")
def _(s, c):
    h = _history(s).filter("previous is null and from_keyword is not null")
    return h.filter(~F.col("from_keyword").isin(*c.start_keywords)).select("entry_id", F.col("from_keyword").alias("arg"))


@rule("StateChangeIntermediate", "WARN")
def _(s, c):
    return _history(s).filter("from_keyword <> previous and repeats is null").select("entry_id", F.concat_ws(">", "previous", "from_keyword").alias("arg"))


@rule("StateChangeIdempotent", "WARN")
def _(s, c):
    return _history(s).filter("from_keyword = to_keyword").select("entry_id", F.col("to_keyword").alias("arg"))


@rule("StateChangeNotAllowed", "WARN")
def _(s, c):
    """The keyword before has transitions, and this isn't one of them."""
    arcs = F.array(*[F.lit(f"{a}>{b}") for a, b in c.transitions])
    known = F.col("from_keyword").isin(*{a for a, _ in c.transitions})
    step = F.concat_ws(">", "from_keyword", "to_keyword")
    return _history(s).filter(known & (F.col("from_keyword") != F.col("to_keyword")) & ~F.array_contains(arcs, step)).select("entry_id", step.alias("arg"))


@entry_rule("StateChangeLast", "WARN", "entries", "changes", "properties")
def _():
    """The newest change leads to another keyword than the entry has."""
    other = F.filter("keywords", lambda k: k["v"] != F.col("changed"))
    return F.when(~F.array_contains("names", "last_repeat"), F.transform(other, lambda k: F.col("changed")))


@entry_rule("StampOnPlainEntry", "WARN", "entries", "stamps")
def _():
    return F.when(F.col("planned"), _each(lambda v: v.isNull()))


@entry_rule("ReviewOnPlainEntry", "WARN", "entries", "properties")
def _():
    return F.when(F.col("reviewed"), _each(lambda v: v.isNull()))


@rule("MultipleBlankLines", "WARN")
def _(s, c):
    return s.entry_body_blocks.filter((F.col("block_type") == "whitespace") & F.contains("content", F.lit("\n\n"))).select("entry_id", F.col("position").alias("arg"))


@rule("LeadingSpace", "INFO")
def _(s, c):
    return s.entry_body_blocks.filter("block_type = 'whitespace' and position = 0").select("entry_id")


@entry_rule("WhitespaceOnlyBody", "INFO", "entries", "bodies")
def _():
    return F.when(F.col("blank"), _each(lambda v: v.isNotNull()))


@rule("MultipleLogbooks", "ERROR")
def _(s, c):
    return s.entry_log_entries.filter("log_type = 'logbook'").groupBy("entry_id").agg(F.count("*").alias("arg")).filter("arg > 1")


@rule("MixedLogbook", "ERROR")
def _(s, c):
    """Log entries inside and outside a logbook."""
    mixed = s.entry_log_entries.groupBy("entry_id").agg(F.bool_or(F.col("logbook_id").isNotNull()).alias("inside"), F.bool_or(F.col("logbook_id").isNull() & (F.col("log_type") != "logbook")).alias("outside"))
    return mixed.filter("inside and outside").select("entry_id")


@rule("ZeroLocation", "ERROR")
def _(s, c):
    return _property(s, "location").filter("v = '0.0,0.0'").select("entry_id")


@rule("DrawerCase", "INFO")
def _(s, c):
    """Drawers are upper case, begin blocks lower case."""
    begin = F.col("drawer_name").rlike("(?i)^#\\+begin")
    odd = F.when(begin, F.col("drawer_name") != F.lower("drawer_name")).otherwise(F.col("drawer_name") != F.upper("drawer_name"))
    return s.entry_body_blocks.filter(odd).select("entry_id", F.col("drawer_name").alias("arg"))


@rule("FileCreatedMissing", "INFO")
def _(s, c):
    """No CREATED property, and no date in the name to take its place."""
    dated = s.files.filter(~F.substring_index("path", "/", -1).rlike("^[0-9]{8}")).select(F.col("id").alias("file_id"))
    return _lacking(dated, _file_property(s, "created"), "file_id")


@rule("CreationTimeMismatch", "WARN")
def _(s, c):
    """The date in the file's name isn't that of CREATED."""
    named = F.regexp_extract(F.substring_index("path", "/", -1), "^([0-9]{4})([0-9]{2})([0-9]{2})", 0)
    f = s.files.select(F.col("id").alias("file_id"), named.alias("named")).filter("named <> ''").join(_file_property(s, "created"), "file_id")
    written = F.translate(F.regexp_extract("v", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "-", "")
    return f.filter((written != "") & (written != F.col("named"))).select("file_id", written.alias("arg"))


@rule("ReviewOnFile", "WARN")
def _(s, c):
    return s.file_properties.filter(F.upper("name").isin("LAST_REVIEW", "NEXT_REVIEW", "REVIEWS", "EFFORT")).select("file_id", F.col("name").alias("arg"))


def _missing(s: Store, c: Config, name: str) -> DataFrame:
    """Files that a property of files or entries names (before any ``::``) and that aren't there."""
    path = F.trim(F.substring_index("v", "::", 1))
    named = _named(_file_property(s, name), path).unionByName(_named(_property(s, name), path))
    return _absent(named, s, c, folders=False).select("file_id", "entry_id", "arg")


@rule("ArchiveMissing", "WARN")
def _(s, c):
    return _missing(s, c, "archive")


@rule("AudioMissing", "ERROR")
def _(s, c):
    return _missing(s, c, "audio")


@rule("HashMismatch", "WARN")
def _(s, c):
    """HASH_sha512 isn't the start of the SHA-512 of the entry as it is written without it, with an end of line."""
    from ..sinks.text import entry_texts

    said = _found(_property(s, "hash_sha512"), "hashes")
    of = lambda df, key: df.join(said.select(F.col("entry_id").alias("_h")).distinct(), F.col(key) == F.col("_h"), "left_semi")
    # Only entries that have one are written.
    some = s.map(lambda name, df: of(df, "id") if name == "entries" else of(df, "entry_id") if "entry_id" in df.columns else df)
    some = replace(some, entry_properties=some.entry_properties.filter("lower(name) <> 'hash_sha512'"))
    e = entry_texts(some, c).join(said, F.col("id") == F.col("entry_id"))
    return e.filter(short_sha512(F.concat("text", F.lit("\n"))) != F.col("v")).select("entry_id", F.col("v").alias("arg"))


@rule("InconsistentWhitespace", "WARN")
def _(s, c):
    """Within a file, some bodies begin after a blank line and some don't."""
    ignored = _file_property(s, "whitespace").filter("lower(v) = 'ignore'")
    first = s.entry_body_blocks.filter("position = 0").select("entry_id", (F.col("block_type") == "whitespace").alias("spaced"))
    if first.filter("spaced").isEmpty():
        first = first.filter(F.lit(False))
    seen = first.join(_entries(s, "file_id").repartition("entry_id").distinct(), "entry_id").groupBy("file_id").agg(F.count_distinct("spaced").alias("arg"))
    return _lacking(seen.filter("arg > 1"), ignored, "file_id").select("file_id")


def _spaces(s: Store) -> DataFrame:
    """``entry_id, leads, trails, lead, trail, empty``: the white space that the notes of an entry's log begin and end
    with, in order, and its body; whether there is no body. Entries whose notes have none are left out."""
    from .tree import body_space

    space = F.struct(F.when(F.col("block_type") == "whitespace", F.col("content")).alias("v"))
    notes = s.entry_log_bodies.groupBy("entry_id", "log_position").agg(F.min_by(space, "position").alias("a"), F.max_by(space, "position").alias("b"))
    listed = F.sort_array(F.collect_list(F.struct("log_position", "a", "b")))
    notes = notes.groupBy("entry_id").agg(F.transform(listed, lambda x: x["a"]["v"]).alias("leads"), F.transform(listed, lambda x: x["b"]["v"]).alias("trails"))
    notes = _found(notes.filter(F.exists(F.concat("leads", "trails"), lambda x: x.isNotNull())), "notes")
    of = lambda df, key: df.join(notes.select(F.col("entry_id").alias("_n")), F.col(key) == F.col("_n"), "left_semi")
    return body_space(replace(s, entries=of(s.entries, "id"), entry_body_blocks=of(s.entry_body_blocks, "entry_id"))).join(notes, "entry_id")


def _unlike(values: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(values)) > 1, F.lit(False))


@rule("InconsistentLogSpace", "WARN")
def _(s, c):
    """Notes of one log begin, or end, some with white space and some without, or with other white space. The end of the last
    one may be where the body begins."""
    x = _spaces(s)
    head, tail = F.get("trails", F.lit(0)), F.element_at("trails", -1)
    end = F.coalesce(tail, F.when(F.col("empty"), head).when(head.isNotNull(), F.col("lead")))
    trails = F.concat(F.slice("trails", 1, F.greatest(F.size("trails") - 1, F.lit(0))), F.array(end))
    found = F.array(F.when(_unlike(F.col("leads")), "before log entries"), F.when(_unlike(trails), "after log entries"))
    return x.select("entry_id", F.explode(F.array_compact(found)).alias("arg"))


@rule("EmptyBodySpace", "INFO")
def _(s, c):
    """No body, and the last note ends with white space."""
    return _spaces(s).filter(F.col("empty") & F.element_at("trails", -1).isNotNull()).select("entry_id")


@rule("InconsistentBodySpace", "INFO")
def _(s, c):
    """A body begins and ends with different white space; the last entry of a file may end with none."""
    from .tree import body_edges, preorder

    odd = _found(body_edges(s).filter(~F.col("lead").eqNullSafe(F.col("trail"))), "bodies")
    owned = _entries(s, "file_id").join(odd.select("entry_id", "trail"), "entry_id")
    odd = odd.join(owned, "entry_id", "left_semi")
    # Only files of entries that may be excused are walked.
    files = owned.filter("trail is null").select(F.col("file_id").alias("_f")).distinct()
    walked = s.entries.join(files, F.col("file_id").eqNullSafe(F.col("_f")), "left_semi")
    last = preorder(walked).groupBy("file_id").agg(F.max_by("id", "preorder").alias("entry_id")).select("entry_id").distinct().withColumn("final", F.lit(True))
    fine = F.col("final").isNotNull() & F.col("trail").isNull()
    return odd.join(last, "entry_id", "left").filter(~fine).select("entry_id", F.lit("surrounding body").alias("arg"))


def severity_at_least(level: str) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("severity")) >= LEVELS.index(level) + 1


def exit_code(messages: DataFrame) -> int:
    """What a run of the rules ends with: the number of messages, 255 at most."""
    return min(255, messages.count())
