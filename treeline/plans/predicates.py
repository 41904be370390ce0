"""Composable predicates over entries.

A predicate is built by the functions below and combined with ``and_``, ``or_``, ``not_``, ``when``
and ``unless``; ``select(store, predicate)`` gives the entries it holds for. Predicates on an entry's
own columns become column expressions; those on child tables and on the hierarchy become EXISTS
subqueries, which Catalyst plans as semi, anti and existence joins. Ancestors and descendants go
through the table of exploded paths, so that all joins have equality keys.

SQL's three-valued logic applies: ``not_(todo("TODO"))`` leaves out entries without a keyword.

    select(store, and_(todo("TODO"), tags("building"), ancestors(property_("Nation", "NATION_3"))))
"""

from __future__ import annotations

import datetime
import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ENTRY_COLUMNS, UNIX_EPOCH_MJD, Store

#: Hierarchy predicates within each other.
MAX_NESTING = 20


@dataclass
class Context:
    """What a predicate is compiled against: the store, today, and the alias of the entry."""

    store: Store
    today: int
    alias: str = "e"
    depth: int = 0
    names: count = field(default_factory=count)

    def col(self, name: str) -> Column:
        return F.col(f"{self.alias}.{name}")

    def outer(self, name: str) -> Column:
        return self.col(name).outer()

    def fresh(self) -> str:
        return f"q{next(self.names)}"

    def inner(self, alias: str) -> Context:
        if self.depth >= MAX_NESTING:
            raise ValueError(f"hierarchy predicates nest deeper than {MAX_NESTING}")
        return Context(self.store, self.today, alias, self.depth + 1, self.names)


Predicate = Callable[[Context], Column]
REGISTRY: dict[str, Callable[..., Predicate]] = {}


def register_predicate(*names: str):
    """Make a builder known by name, for ``build``."""

    def add(builder: Callable[..., Predicate]) -> Callable[..., Predicate]:
        for n in names:
            REGISTRY[n] = builder
        return builder

    return add


def build(name: str, *args, **kwargs) -> Predicate:
    """A predicate by its registered name or alias; unknown names are an error."""
    if name not in REGISTRY:
        raise ValueError(f"unknown predicate {name!r}")
    return REGISTRY[name](*args, **kwargs)


def select(store: Store, predicate: Predicate, today: datetime.date | None = None, limit: int | None = None) -> DataFrame:
    """The entries for which ``predicate`` is true. ``today`` is fixed once, here. With a limit,
    the first by file and position in it."""
    day = (today or datetime.date.today()).toordinal() - datetime.date(1970, 1, 1).toordinal() + UNIX_EPOCH_MJD
    found = store.entries.alias("e").where(predicate(Context(store, day))).select(*ENTRY_COLUMNS)
    return found if limit is None else found.orderBy("file_id", F.array_join("path", "/")).limit(limit)


# -- logic -----------------------------------------------------------------------------------


@register_predicate("and")
def and_(*ps: Predicate) -> Predicate:
    """True without arguments."""
    return lambda c: functools.reduce(Column.__and__, [p(c) for p in ps]) if ps else F.lit(True)


@register_predicate("or")
def or_(*ps: Predicate) -> Predicate:
    """False without arguments."""
    return lambda c: functools.reduce(Column.__or__, [p(c) for p in ps]) if ps else F.lit(False)


@register_predicate("not")
def not_(p: Predicate) -> Predicate:
    return lambda c: ~p(c)


@register_predicate("when")
def when(condition: Predicate, *ps: Predicate) -> Predicate:
    """Where the condition holds, all others must."""
    return or_(not_(condition), and_(condition, *ps))


@register_predicate("unless")
def unless(condition: Predicate, *ps: Predicate) -> Predicate:
    """Where the condition doesn't hold, all others must."""
    return or_(condition, and_(not_(condition), *ps))


# -- own columns -----------------------------------------------------------------------------


def _among(column: str, values: tuple) -> Predicate:
    return lambda c: c.col(column).isin(*values) if values else c.col(column).isNotNull()


def _compare(a: Column, op: str, b) -> Column:
    ops = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "=": Column.__eq__}
    if op not in ops:
        raise ValueError(f"unknown comparator {op!r}")
    return ops[op](a, F.lit(b))


def contains(column: Column, text: str) -> Column:
    """Case-insensitive substring; no character of ``text`` is special."""
    return column.ilike("%" + re.sub(r"([%_\\])", r"\\\1", text) + "%")


@register_predicate("todo")
def todo(*keywords: str) -> Predicate:
    """Has a keyword, or one of these."""
    return _among("keyword_value", keywords)


@register_predicate("done")
def done() -> Predicate:
    return lambda c: c.col("keyword_type") == "closed"


@register_predicate("heading", "headline", "h")
def heading(*texts: str) -> Predicate:
    """Any of these in the headline; true without arguments."""
    return or_(*[lambda c, t=t: contains(c.col("headline"), t) for t in texts]) if texts else and_()


@register_predicate("level")
def level(*args) -> Predicate:
    """``level(2)`` or ``level(">=", 2)``."""
    op, n = args if len(args) == 2 else ("=", *args)
    return lambda c: _compare(c.col("depth"), op, n)


@register_predicate("priority", "p")
def priority(*args: str) -> Predicate:
    """Has one, one of these, or by comparison as text: ``priority("<", "C")``."""
    if len(args) == 2 and args[0] in ("<", "<=", ">", ">=", "="):
        return lambda c: _compare(c.col("priority"), *args)
    return _among("priority", args)


# -- child tables ----------------------------------------------------------------------------


def _child(table: str, condition: Callable[[Callable[[str], Column]], Column] | None = None) -> Predicate:
    """A row of a child table that meets the condition."""

    def compile(c: Context) -> Column:
        a = c.fresh()
        col = lambda name: F.col(f"{a}.{name}")
        rows = getattr(c.store, table).alias(a).where(col("entry_id") == c.outer("id"))
        return (rows.where(condition(col)) if condition else rows).exists()

    return compile


@register_predicate("tags-local")
def tags_local(*names: str) -> Predicate:
    """Has a tag of its own, or one of these."""
    return _child("entry_tags", (lambda col: col("tag").isin(*names)) if names else None)


@register_predicate("tags-inherited", "itags")
def tags_inherited(*names: str) -> Predicate:
    """A proper ancestor has a tag, or one of these."""

    def compile(c: Context) -> Column:
        a, t = c.fresh(), c.fresh()
        rows = c.store.ancestors.alias(a).join(c.store.entry_tags.alias(t), F.col(f"{a}.ancestor_id") == F.col(f"{t}.entry_id")).where(F.col(f"{a}.entry_id") == c.outer("id"))
        return (rows.where(F.col(f"{t}.tag").isin(*names)) if names else rows).exists()

    return compile


@register_predicate("tags")
def tags(*names: str) -> Predicate:
    """A tag of its own or inherited, any of these; without arguments a tag of its own."""
    return or_(tags_local(*names), tags_inherited(*names)) if names else tags_local()


@register_predicate("tags-all")
def tags_all(*names: str) -> Predicate:
    """All of these, each its own or inherited; true without arguments. One aggregation of the entries'
    effective tags among these, however many they are."""
    if not names:
        return and_()

    def compile(c: Context) -> Column:
        a, t, x = c.fresh(), c.fresh(), c.fresh()
        own = c.store.entry_tags.where(F.col("tag").isin(*names)).select("entry_id", "tag")
        up = c.store.ancestors.alias(a).join(own.alias(t), F.col(f"{a}.ancestor_id") == F.col(f"{t}.entry_id")).select(F.col(f"{a}.entry_id").alias("entry_id"), F.col(f"{t}.tag").alias("tag"))
        all_of = own.unionByName(up).groupBy("entry_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(set(names)))
        return all_of.alias(x).where(F.col(f"{x}.entry_id") == c.outer("id")).exists()

    return compile


@register_predicate("regexp", "re")
def regexp(*texts: str) -> Predicate:
    """Each of these, as plain text, in the headline or a block of the body."""
    if not texts:
        raise ValueError("regexp needs an argument")
    one = lambda t: or_(lambda c: contains(c.col("headline"), t), _child("entry_body_blocks", lambda col: contains(col("content"), t)))
    return and_(*map(one, texts))


@register_predicate("rifle")
def rifle(*patterns: str) -> Predicate:
    """Every word of a pattern begins a word of headline or title, or the body holds the pattern.

    Words are runs of letters and digits, without regard to case. There is no stemming and there
    are no stop words: a prefix match finds what stemming would for most words."""

    def one(pattern: str) -> Predicate:
        words = [w.lower() for w in re.findall(r"[^\W_]+", pattern)]

        def title(c: Context) -> Column:
            found = F.split(F.lower(F.concat_ws(" ", c.col("headline"), c.col("title"))), r"[^\p{L}\p{N}]+")
            return functools.reduce(Column.__and__, [F.exists(found, _starts(w)) for w in words]) if words else F.lit(False)

        return or_(title, _child("entry_body_blocks", lambda col: contains(col("content"), pattern)))

    return and_(*map(one, patterns))


def _starts(word: str):
    return lambda token: token.startswith(word)


@register_predicate("property")
def property_(name: str, *args: str) -> Predicate:
    """Has the property (name without regard to case); with this value; or by comparison of its
    text: ``property_("EFFORT", ">", "1")``."""

    def condition(col) -> Column:
        named = F.lower(col("name")) == name.lower()
        if not args:
            return named
        return named & (_compare(col("value"), *args) if len(args) == 2 else col("value") == args[0])

    return _child("entry_properties", condition)


@register_predicate("habit")
def habit() -> Predicate:
    return _child("entry_properties", lambda col: (F.lower(col("name")) == "style") & (F.lower(col("value")) == "habit"))


@register_predicate("category")
def category(*names: str) -> Predicate:
    """One of these; true without arguments."""
    return _child("entry_categories", lambda col: col("category").isin(*names)) if names else and_()


@register_predicate("link")
def link(target: str | None = None) -> Predicate:
    return _child("entry_links", None if target is None else lambda col: contains(col("target"), target))


@register_predicate("path")
def path(*texts: str) -> Predicate:
    """Any of these in the file's path; true without arguments."""
    if not texts:
        return and_()

    def compile(c: Context) -> Column:
        a = c.fresh()
        col = F.col(f"{a}.path")
        return c.store.files.alias(a).where((F.col(f"{a}.id") == c.outer("file_id")) & functools.reduce(Column.__or__, [contains(col, t) for t in texts])).exists()

    return compile


# -- days ------------------------------------------------------------------------------------


def resolve_day(value: str | int, today: int) -> int:
    """``"today"``, an offset in days, or ``"YYYY-MM-DD"``; a date of that shape that is in no
    calendar is day 0."""
    if value == "today":
        return today
    if isinstance(value, int):
        return today + value
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        raise ValueError(f"not a date: {value!r}")
    try:
        return datetime.date.fromisoformat(value).toordinal() - datetime.date(1970, 1, 1).toordinal() + UNIX_EPOCH_MJD
    except ValueError:
        return 0


def _days(column: str, on=None, from_=None, to=None, before=None):
    """All conditions given; every bound is inclusive."""

    def condition(col, today: int) -> Column:
        day = col(column)
        tests = [(on, Column.__eq__), (from_, Column.__ge__), (to, Column.__le__), (before, Column.__le__)]
        return functools.reduce(Column.__and__, [f(day, F.lit(resolve_day(v, today))) for v, f in tests if v is not None], F.lit(True))

    return condition


def _stamped(types: tuple[str, ...], kind: str | None, days: dict) -> Predicate:
    when_ = _days("day", **days)

    def compile(c: Context) -> Column:
        def condition(col) -> Column:
            out = when_(col, c.today)
            out = out & col("stamp_type").isin(*types) if types else out
            return out & (col("time_kind") == kind) if kind else out

        return _child("entry_stamps", condition)(c)

    return compile


@register_predicate("ts")
def ts(**days) -> Predicate:
    """Any stamp; ``on``, ``from_``, ``to`` and ``before`` (inclusive) restrict its day."""
    return _stamped((), None, days)


@register_predicate("ts-active", "ts-a")
def ts_active(**days) -> Predicate:
    return _stamped((), "active", days)


@register_predicate("ts-inactive", "ts-i")
def ts_inactive(**days) -> Predicate:
    return _stamped((), "inactive", days)


@register_predicate("scheduled")
def scheduled(**days) -> Predicate:
    return _stamped(("scheduled",), None, days)


@register_predicate("deadline")
def deadline(**days) -> Predicate:
    return _stamped(("deadline",), None, days)


@register_predicate("closed")
def closed(**days) -> Predicate:
    return _stamped(("closed",), None, days)


@register_predicate("planning")
def planning(**days) -> Predicate:
    return _stamped(("scheduled", "deadline", "closed"), None, days)


@register_predicate("clocked")
def clocked(**days) -> Predicate:
    when_ = _days("time_day", **days)
    return lambda c: _child("entry_log_entries", lambda col: (col("log_type") == "clock") & when_(col, c.today))(c)


# -- hierarchy -------------------------------------------------------------------------------


@register_predicate("parent")
def parent(p: Predicate) -> Predicate:
    def compile(c: Context) -> Column:
        a = c.fresh()
        return c.store.entries.alias(a).where((F.col(f"{a}.id") == c.outer("parent_id")) & p(c.inner(a))).exists()

    return compile


@register_predicate("children")
def children(p: Predicate | None = None) -> Predicate:
    def compile(c: Context) -> Column:
        a = c.fresh()
        rows = c.store.entries.alias(a).where(F.col(f"{a}.parent_id") == c.outer("id"))
        return (rows.where(p(c.inner(a))) if p else rows).exists()

    return compile


def _through(near: str, far: str, p: Predicate) -> Predicate:
    def compile(c: Context) -> Column:
        x, a = c.fresh(), c.fresh()
        rows = c.store.ancestors.alias(x).join(c.store.entries.alias(a).where(p(c.inner(a))), F.col(f"{a}.id") == F.col(f"{x}.{far}"))
        return rows.where(F.col(f"{x}.{near}") == c.outer("id")).exists()

    return compile


@register_predicate("ancestors")
def ancestors(p: Predicate) -> Predicate:
    """Some proper ancestor."""
    return _through("entry_id", "ancestor_id", p)


@register_predicate("descendants")
def descendants(p: Predicate) -> Predicate:
    """Some proper descendant."""
    return _through("ancestor_id", "entry_id", p)
