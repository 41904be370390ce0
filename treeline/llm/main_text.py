"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the block they stand in (the innermost
block element with its first class, and whether within a link), tags by their name and always
below zero. The contiguous run of greatest total score, found by one linear scan, is the content
region; within it, elements that are never content are left out. Those score nothing.

The weights are log-odds learned from labelled pages: those with exactly one ``article`` (or
``main``) element, whose inside is content and whose outside isn't. A bounded sample of pages is
enough; counts are added up by Spark and at most ``MAX_KEYS`` weights are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bounds of the training sample (pages) and of the model (weights).
TRAIN_PAGES = 2000
MAX_KEYS = 5000
#: Words of unknown blocks, and unknown tags.
WORD_SCORE, TAG_SCORE = 0.5, -1.0
CLIP = 3.0

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Their content is not text.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video title".split())
#: Never content, wherever they stand.
OUT = frozenset("nav footer aside form button select menu dialog head".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Of these, those that hold other elements of their name.
NESTED = frozenset("svg math object canvas audio video template".split())
#: Class names, ids and roles of boilerplate. A name counts if all its parts, between hyphens and
#: underscores, are of these or say only which or where.
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices popup modal "
    "sidebar comment comments disqus respond menu nav navbar navigation breadcrumb breadcrumbs pagination footer masthead "
    "related recommended share sharing social newsletter subscribe signup login search widget complementary contentinfo".split()
)
WHERE = frozenset("site page main global left right top bottom primary secondary list section box block area container wrapper".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"\S+")


@dataclass(slots=True)
class Item:
    """A tag (``name`` with / in front of an end) or a run of text, and where it stands."""

    text: str | None
    name: str = ""
    key: str = ""  # of a run: its block; of a tag: its name
    n: int = 0  # words
    out: bool = False  # within an element that is never content
    inside: bool = False  # within the article
    starts_article: bool = False


def _out_name(value: str) -> bool:
    """Whether a class, id or role has a token that names boilerplate."""
    for token in value.lower().split():
        parts = [x for x in re.split(r"[_-]", token) if x and not x.isdigit()]
        if any(x in OUT_NAMES for x in parts) and all(x in OUT_NAMES or x in WHERE for x in parts):
            return True
    return False


def _end_of(name: str, page: str, at: int, comments: int) -> int | None:
    """Where the element ends whose start tag ends at ``at``; None if it is never closed. ``comments``: where the
    last end of a comment stands (-1: nowhere)."""
    if name not in NESTED:
        end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
        return end.end() if end else None
    depth, last = 1, None
    mark = re.compile(rf"<!--|<(/?){name}(?![\w:-])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
    while depth and (m := mark.search(page, at)):
        at = m.end()
        if m[1] is None:  # a comment, if it ends
            at = page.index("-->", at) + 3 if at <= comments else at
        elif m[1]:
            depth, last = depth - 1, m.end()
        elif not (name in FOREIGN and m[2].endswith("/")):
            depth += 1
    return last


@dataclass(slots=True)
class _Wrapper:
    """An element that its name or names put out, and its items."""

    start: int
    end: int
    by_words: bool  # it may be a wrapper of the page if it has most of its words


def _mark(items: list[Item], wrappers: list[_Wrapper], articles: list[_Wrapper]) -> None:
    """Set ``out`` within the wrappers, but for those that hold the article or, on pages without one,
    most of the words."""
    sums = list(accumulate((x.n for x in items), initial=0))
    words = lambda w: sums[w.end] - sums[w.start]
    article = max(articles, key=words, default=None)
    opened = [0] * (len(items) + 1)
    for w in wrappers:
        most = 2 * words(w) > sums[-1]
        if article and w.start < article.start and article.end <= w.end:
            if w.by_words or most:
                continue
        elif not article and w.by_words and most:
            continue
        opened[w.start] += 1
        opened[w.end] -= 1
    for x, n in zip(items, accumulate(opened)):
        x.out = x.out or n > 0


def parse(page: str) -> list[Item]:
    """Tags and text runs of a page in order. Unclosed elements end with their parent, stray end
    tags are kept as tags and close nothing."""
    items: list[Item] = []
    stack: list[tuple[str, str, bool, bool, list[_Wrapper]]] = []  # name, block key, link, inside, wrapper or article
    wrappers: list[_Wrapper] = []
    articles: list[_Wrapper] = []
    open_at: dict[str, list[int]] = defaultdict(list)  # where on the stack the elements of a name are
    unclosed: set[str] = set()
    at, key, link, inside = 0, "body", False, False

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            t = html.unescape(raw)
            items.append(Item(t, key=key + "/a" * link, n=len(WORDS.findall(t)), inside=inside))
        elif raw:
            items.append(Item(" ", key=key, inside=inside))

    def close(k: int) -> None:
        nonlocal key, link, inside
        for s in stack[k:]:
            open_at[s[0]].pop()
            for w in s[4]:
                w.end = len(items)
        del stack[k:]
        _, key, link, inside, _ = stack[-1] if stack else ("", "body", False, False, [])

    def last(*names: str) -> int | None:
        return max((open_at[n][-1] for n in names if open_at[n]), default=None)

    # No tag ends after the last >, and no comment after the last -->.
    tags, comments = page.rfind(">") + 1, page.rfind("-->")
    while m := TAG.search(page, at, tags):
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(page)
        slash, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            k = last(name)
            items.append(tag := Item(None, "/" + name, name, inside=inside))
            if k is not None:
                close(k)
                tag.inside = inside
            continue
        if name in RAW:
            items.append(Item(None, name, name, out=True, inside=inside))
            if name in FOREIGN and attrs.endswith("/"):
                continue
            end = None if name in unclosed else _end_of(name, page, at, comments)
            if end is None:
                unclosed.add(name)
                at = at if name in NESTED else len(page)
            else:
                at = end
            continue
        if name in ("p", "li") or name in BLOCKS and name not in VOID:  # an open paragraph ends here
            if (k := last("p")) is not None and (last("table", "button") or 0) <= k:
                close(k)
        if name == "li" and (k := last("li", "ul", "ol", "menu")) is not None and stack[k][0] == "li":
            close(k)
        named = {n.lower(): a or b or c for n, a, b, c in NAMES.findall(attrs)}
        article = name in ("article", "main")
        was_inside = inside
        if name in VOID:
            items.append(Item(None, name, name, inside=inside))
            continue
        named_out = any(_out_name(v) for v in named.values())
        held = []
        if name in OUT or name == "header" and not inside or named_out and name not in ("html", "body", "article", "main"):
            held.append(_Wrapper(len(items), -1, name == "form" or name not in OUT and name != "header"))
            wrappers.append(held[-1])
        if article and not inside and not named_out:
            held.append(_Wrapper(len(items), -1, False))
            articles.append(held[-1])
        link, inside = link or name == "a", inside or article
        if name in BLOCKS:
            first = (named.get("class") or named.get("id") or "").split()
            key = name + ("." + first[0].lower() if first else "")
        open_at[name].append(len(stack))
        stack.append((name, key, link, inside, held))
        items.append(Item(None, name, name, inside=was_inside, starts_article=article and not was_inside))
    text(re.split("<[!?]", page[at:], maxsplit=1)[0])
    close(0)
    _mark(items, wrappers, articles)
    return items


@dataclass
class Weights:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def score(self, item: Item) -> float:
        if item.out:  # left out anyway: it neither joins nor parts
            return 0.0
        if item.text is None:
            return self.tags.get(item.key, TAG_SCORE)
        return item.n * self.words.get(item.key, WORD_SCORE)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of greatest sum; of ties the first and shortest; (0, 0)
    if no sum is above zero."""
    best, run, total, start = (0, 0), 0.0, 0.0, 0
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > total:
            total, best = run, (start, k + 1)
    return best


def whole_blocks(items: list[Item], start: int, end: int) -> tuple[int, int]:
    """A run widened so that it parts no block."""
    border = lambda x: x.text is None and x.name.removeprefix("/") in BLOCKS
    while start < end and start > 0 and not border(items[start]) and not border(items[start - 1]):
        start -= 1
    while start < end < len(items) and not border(items[end - 1]) and not border(items[end]):
        end += 1
    return start, end


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the content region in page order, joined by newlines. References are decoded, white
    space within a block becomes one space. The region is the best run, widened to whole blocks. Empty for null, empty or wordless pages."""
    items = parse(page or "")
    start, end = whole_blocks(items, *best_run([weights.score(x) for x in items]))
    blocks: list[list[str]] = [[]]
    for x in items[start:end]:
        if x.text is None:
            if x.key in BLOCKS:
                blocks.append([])
        elif not x.out:
            blocks[-1].append(x.text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def learn(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", rows: int = TRAIN_PAGES) -> Weights:
    """Weights from up to ``rows`` pages, picked by a hash of id and body; null or repeated ids are as
    good as any. Without labelled pages all words and all tags score alike."""
    keyed = pages.select(F.xxhash64(F.col(id_col), F.col(body_col)).alias("k"), F.col(body_col).alias("body")).filter("body is not null")
    top = keyed.select("k").orderBy("k").limit(rows).agg(F.max("k")).first()[0]
    if top is None:
        return Weights()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in batches:
            for body in pdf["body"]:
                items = parse(body)
                if sum(x.starts_article for x in items) == 1:
                    for x in items:
                        content = x.inside and not x.out
                        c["tag" if x.text is None else "word", x.key, content] += 1 if x.text is None else x.n
        yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "key", "content", "n"])

    # A page counts once however often its row is repeated, so no more than ``rows`` are read.
    got = keyed.filter(F.col("k") <= top).dropDuplicates(["k"]).mapInPandas(count, "kind string, key string, content boolean, n long").groupBy("kind", "key").agg(F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("content"), 0).otherwise(F.col("n"))).alias("no"))
    got = got.orderBy(F.desc(F.col("yes") + F.col("no")), "kind", "key").limit(MAX_KEYS).collect()

    def odds(r) -> float:
        return max(-CLIP, min(CLIP, math.log((r.yes + 0.5) / (r.no + 0.5))))

    return Weights({r.key: odds(r) for r in got if r.kind == "word" and r.yes + r.no}, {r.key: min(odds(r) - 1, 0) / 2 - 0.1 for r in got if r.kind == "tag"})


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row; rows keep their number, repeated ones and those without an id as well; a null
    page is empty. Whole pages are read; other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(b if isinstance(b, str) else None, weights) for b in pdf["body"]]
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    p = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(body_col).alias("body"))
    return p.mapInPandas(run, "id string, url string, text string, n_chars long").withColumn("id", F.col("id").cast(pages.schema[id_col].dataType))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn(pages)).withColumnRenamed("id", "page_id")
