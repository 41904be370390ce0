"""Scalar functions, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import UNIX_EPOCH_MJD, mjd, mjd_to_date

#: Characters dropped from, and replaced in, a slug.
SLUG_DROPPED = "’‘“”`'"
SLUG_FROM, SLUG_TO = "áíú", "aiu"

LINK = r"\[\[([^\]]+)\](?:\[([^\]]*)\])?\]"
#: Fixed markup that a teaser loses.
TEASER_TAGS = ("<iframe [^>]*>", "<img [^>]*>", "</?p>", '<div class="line-block">', "</div>", "</?blockquote>", "</?strong>", "</?[ou]l>", "</?li>", "<h[0-9][^>]*>", "</h[0-9]>", "<pre[^>]*>", "</pre>", "<a [^>]*>", "</a>")
TEASER_WORDS = 60
MORE = "<!--more-->"


def slug(text: Column) -> Column:
    """Lower case, quotes dropped, whatever is no letter or digit as single dashes within."""
    s = F.translate(F.translate(F.lower(text), SLUG_DROPPED, ""), SLUG_FROM, SLUG_TO)
    return F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def compact_time(text: Column) -> Column:
    """``YYYYMMDD[HHMM[SS]]`` as ``struct<day, minute>`` (seconds are dropped); null for any other
    text or an impossible date."""
    ok = text.rlike("^[0-9]{8}([0-9]{4}([0-9]{2})?)?$")
    date = F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd") if hasattr(F, "try_to_date") else F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")).cast("date")
    minute = F.when(F.length(text) > 8, F.substring(text, 9, 2).try_cast("int") * 60 + F.substring(text, 11, 2).try_cast("int"))
    return F.when(ok & date.isNotNull(), F.struct(mjd(date).alias("day"), minute.alias("minute")))


def clock(minute: Column) -> Column:
    """Minutes of the day as ``HH:MM``."""
    return F.format_string("%02d:%02d", F.floor(minute / 60), minute % 60)


def show_time(day: Column, start: Column, end: Column, active: Column, suffix: Column) -> Column:
    """A stamp as outlines write it: ``<2024-01-02 Tue 10:30-11:00 +1w>``; ``[...]`` if inactive."""
    hours = F.when(start.isNotNull(), F.concat(F.lit(" "), clock(start), F.coalesce(F.concat(F.lit("-"), clock(end)), F.lit(""))))
    inner = F.concat(F.date_format(mjd_to_date(day), "yyyy-MM-dd EEE"), F.coalesce(hours, F.lit("")), F.coalesce(F.concat(F.lit(" "), suffix), F.lit("")))
    return F.when(active, F.concat(F.lit("<"), inner, F.lit(">"))).otherwise(F.concat(F.lit("["), inner, F.lit("]")))


def show_duration(minutes: Column) -> Column:
    """``H:MM``, hours padded to two by a space."""
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, " "), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def iso_date(stamp: Column) -> Column:
    """The first ``YYYY-MM-DD`` after a bracket of a written stamp."""
    return F.nullif(F.regexp_extract(stamp, r"[<\[]([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))


def links(text: Column) -> Column:
    """``array<struct<link_type, target, description>>`` of ``[[target][description]]``. The type is
    the scheme; of ``id:`` the target is what follows; without a scheme it is ``unknown``."""

    def one(m: Column) -> Column:
        url = F.regexp_extract(m, LINK, 1)
        scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        kind = F.when(scheme == "", "unknown").otherwise(F.lower(scheme))
        return F.struct(kind.alias("link_type"), F.when(kind == "id", F.substring(url, F.lit(4), F.length(url))).otherwise(url).alias("target"), F.nullif(F.regexp_extract(m, LINK, 2), F.lit("")).alias("description"))

    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), one)


def file_name_parts(name: Column) -> Column:
    """``struct<date, slug, tags, ext>`` of a file name such as ``20240601-name [tag tag].ext`` or
    ``20240601-name -- tag tag.ext``. A date has eight digits or more at the start."""
    ext = F.nullif(F.regexp_extract(name, r"\.([^.\[\]]*)$", 1), F.lit(""))
    stem = F.regexp_replace(name, r"\.[^.\[\]]*$", "")
    date = F.nullif(F.regexp_extract(stem, "^([0-9]{8,})", 1), F.lit(""))
    rest = F.when(date.isNotNull(), F.regexp_replace(stem, "^[0-9]{8,}-?", "")).otherwise(stem)
    bracket = F.regexp_extract(rest, r"^(.*?) ?\[([^\]]*)\]$", 2)
    dashed = F.regexp_extract(rest, r"^(.*?) -- (.+)$", 2)
    tags = F.when(bracket != "", bracket).when(dashed != "", dashed)
    left = F.when(bracket != "", F.regexp_replace(rest, r" ?\[[^\]]*\]$", "")).when(dashed != "", F.regexp_replace(rest, r" -- .+$", "")).otherwise(rest)
    return F.struct(date.alias("date"), left.alias("slug"), F.split(tags, " +").alias("tags"), ext.alias("ext"))


def tag_string(tags: Column) -> Column:
    """``::a:b:``."""
    return F.concat(F.lit("::"), F.array_join(tags, ":"), F.lit(":"))


def tag_list(text: Column) -> Column:
    """``:a:b:`` as a list."""
    return F.filter(F.split(text, ":"), lambda t: t != "")


def _hard(text: Column, n: int) -> Column:
    """Pieces of ``n`` characters."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / n).cast("int")), lambda k: F.substring(text, k * n + 1, n))


def _merge(parts: Column, n: int, sep: str, split) -> Column:
    """Neighbours joined by ``sep`` while they fit into ``n``; a part that never fits is split."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    flushed = lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["open"]) + len(sep) + F.length(p) <= n
        long = F.struct(F.concat(flushed(a), split(p)).alias("done"), F.lit(None).cast("string").alias("open"))
        first = F.struct(a["done"].alias("done"), p.alias("open"))
        more = F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit(sep), p).alias("open"))
        full = F.struct(flushed(a).alias("done"), p.alias("open"))
        return F.when(F.length(p) > n, long).when(a["open"].isNull(), first).when(fits, more).otherwise(full)

    return F.aggregate(parts, empty, step, flushed)


def chunks(text: Column, n: int = 2000) -> Column:
    """The text in pieces of at most ``n`` characters: whole if it fits, else whole paragraphs
    together, long paragraphs by lines, long lines cut. Blank text gives none."""
    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: F.trim(F.translate(p, "\n\t\r", "   ")) != "")
    lines = lambda p: _merge(F.split(F.regexp_replace(p, "\n$", ""), "\n"), n, "\n", lambda x: _hard(x, n))
    blank = F.trim(F.translate(text, "\n\t\r", "   ")) == ""
    return F.when(text.isNull() | blank, F.array().cast("array<string>")).when(F.length(text) <= n, F.array(text)).otherwise(_merge(paragraphs, n, "\n\n", lines))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - dot(a, b) / F.when(norm > 0, norm)


def path_label(id_: Column) -> Column:
    """An id as a label of a dotted path."""
    s = F.regexp_replace(F.translate(id_, "-", "_"), "[^A-Za-z0-9_]", "")
    return F.when(s == "", "x").otherwise(s)


def csv_field(text: Column) -> Column:
    """Quoted if it holds a comma, quote or line end."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def teaser(html: Column) -> Column:
    """Up to the ``more`` mark, else the first words, without block markup."""
    s = reduce(lambda c, p: F.regexp_replace(c, p, ""), TEASER_TAGS, F.regexp_replace(html, "<br />", "<br/>"))
    words = F.slice(F.filter(F.split(s, r"\s+"), lambda w: w != ""), 1, TEASER_WORDS)
    return F.when(F.instr(s, MORE) > 0, F.substring_index(s, MORE, 1)).otherwise(F.array_join(words, " "))


def clean_url(url: Column) -> Column:
    """``.../index.html`` as ``.../``."""
    return F.regexp_replace(url, "/index\\.html$", "/")


def route(day: Column, slug_: Column) -> Column:
    """``YYYY/MM/slug/index.html``."""
    return F.concat(F.date_format(mjd_to_date(day), "yyyy/MM/"), slug_, F.lit("/index.html"))


def mangle(path: Column) -> Column:
    return F.translate(path, "/", "!")


def line_and_column(text: Column, pos: Column) -> Column:
    """``struct<line, col>`` from 1 of a position from 0."""
    before = F.substring(text, F.lit(1), pos)
    return F.struct(F.size(F.split(before, "\n")).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("col"))


def entry_hash(*parts: Column) -> Column:
    """Detects changes: MD5 of the parts, NUL between them; null differs from empty."""
    return F.md5(F.array_join(F.transform(F.array(*[F.coalesce(F.concat(F.lit("+"), p.cast("string")), F.lit("-")) for p in parts]), lambda x: x), "\0"))


def short_sha512(text: Column) -> Column:
    return F.substring(F.sha2(text, 512), 1, 64)


def consistent(values: Column) -> Column:
    """All equal."""
    return F.size(F.array_distinct(values)) <= 1


def display_width(text: Column) -> Column:
    """Characters that a headline shows: of its first link with a description only that, and no marks of verbatim text (``=``)."""
    link = F.length(F.regexp_extract(text, r"\[\[[^\]]+\]\[", 0))
    return F.length(text) - F.length(F.regexp_replace(text, "[^=]", "")) - F.when(link > 0, link + 2).otherwise(0)


def align_right(left: Column, right: Column, column: int) -> Column:
    """``left`` and ``right`` with two spaces at least between, so that ``right`` ends at ``column`` if it can, as ``left`` is
    shown."""
    gap = F.greatest(F.lit(2), column - display_width(left) - F.length(right))
    return F.concat(left, F.repeat(F.lit(" "), gap), right)


def instant(day: Column, minute: Column | None = None) -> Column:
    """The UTC instant of a Modified Julian Day and minutes of the day (midnight without)."""
    minutes = F.coalesce(minute, F.lit(0)) if minute is not None else F.lit(0)
    return F.timestamp_seconds((day - UNIX_EPOCH_MJD).cast("long") * 86400 + minutes.cast("long") * 60)


def from_instant(ts: Column) -> Column:
    """``struct<day, minute>`` of an instant in UTC; seconds are dropped."""
    s = F.unix_seconds(ts)
    return F.struct((F.floor(s / 86400) + UNIX_EPOCH_MJD).cast("int").alias("day"), F.floor(F.pmod(s, F.lit(86400)) / 60).cast("int").alias("minute"))


def is_archive(path: Column) -> Column:
    """Files whose path names an archive."""
    return F.contains(path, F.lit("archive"))


def is_leading(stamp_type: Column) -> Column:
    """Stamps of the planning line."""
    return stamp_type.isin("scheduled", "deadline", "closed")
