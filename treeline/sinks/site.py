"""A site's listings: posts, pages of them, tags, archive, feed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE_SIZE, MAX_PAGES, FEED = 6, 10, 10


def publishable(posts: DataFrame, site: str, now: Column) -> DataFrame:
    """Posts (``id, tags, date``) tagged for the site and ``publish`` and dated before now."""
    return posts.filter(F.array_contains("tags", site) & F.array_contains("tags", "publish") & (F.col("date") < now))


def feed(posts: DataFrame, n: int = FEED) -> DataFrame:
    """The most recent posts."""
    return posts.orderBy(F.desc("date"), "id").limit(n)


def pages(posts: DataFrame, size: int = PAGE_SIZE, most: int = MAX_PAGES) -> DataFrame:
    """``page, id, place, is_first, is_second, is_last, previous, next`` of the newest posts, ``size``
    a page. The newest are picked as a top-k before they are numbered."""
    top = posts.orderBy(F.desc("date"), "id").limit(size * most)
    n = F.row_number().over(W.orderBy(F.desc("date"), "id")) - 1
    p = top.withColumn("place", n).withColumn("page", F.floor(F.col("place") / size).cast("int") + 1)
    last = F.max("page").over(W.partitionBy())
    page = F.col("page")
    return p.withColumn("last", last).select(page, "id", "place", (page == 1).alias("is_first"), (page == 2).alias("is_second"), (page == F.col("last")).alias("is_last"), F.when(page > 1, page - 1).alias("previous"), F.when(page < F.col("last"), page + 1).alias("next"))


def tag_pages(posts: DataFrame) -> DataFrame:
    """``tag, n, newest``: how many posts a tag has, and the newest."""
    return posts.select("id", "date", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.max(F.struct("date", "id")).alias("x")).select("tag", "n", F.col("x.id").alias("newest"))


def archive(posts: DataFrame) -> DataFrame:
    """Posts by year and month."""
    return posts.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.count("*").alias("n"))


def sitemap(posts: DataFrame, root: str) -> DataFrame:
    return posts.select(F.concat(F.lit(root), "route").alias("loc"), F.date_format("date", "yyyy-MM-dd").alias("lastmod"))


@dataclass(frozen=True)
class Site:
    """What feeds say of a site; ``root`` has no slash at its end."""

    root: str
    title: str
    description: str
    author: str
    email: str


def xml_text(text: Column) -> Column:
    """Text as it stands in XML, without characters that XML 1.0 doesn't have."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def _feed(posts: DataFrame, head: Column, item: Column, foot: str, n: int) -> DataFrame:
    """``place, line``: a head with the newest date, the newest posts and a foot, one element a line. Only the posts of the feed
    are numbered; a site without posts has a feed without any."""
    top = feed(posts, n)
    items = top.select(F.row_number().over(W.orderBy(F.desc("date"), "id")).alias("place"), item.alias("line"))
    ends = top.agg(F.max("date").alias("date")).select(F.explode(F.array(F.struct(F.lit(0).alias("place"), head.alias("line")), F.struct(F.lit(n + 1).alias("place"), F.lit(foot).alias("line")))).alias("x")).select("x.*")
    return ends.unionByName(items).orderBy("place")


def atom(posts: DataFrame, site: Site, n: int = FEED) -> DataFrame:
    """The newest posts (``id, title, route, date, teaser``) as an Atom feed, ``place, line`` in order."""
    at = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.concat(F.lit(site.root), xml_text(F.col("route")))
    own = lambda x: xml_text(F.lit(x))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>'), own(site.title), F.lit('</title><link href="'), own(site.root), F.lit('/atom.xml" rel="self" /><link href="'), own(site.root), F.lit('" /><id>'), own(site.root),
        F.lit("/atom.xml</id><author><name>"), own(site.author), F.lit("</name><email>"), own(site.email), F.lit("</email></author><updated>"), F.coalesce(at, F.lit("1970-01-01T00:00:00Z")), F.lit("</updated>"),
    )
    item = F.concat(F.lit("<entry><title>"), xml_text(F.coalesce("title", F.lit(""))), F.lit('</title><link href="'), url, F.lit('" /><id>'), url, F.lit("</id><published>"), at, F.lit("</published><updated>"), at, F.lit('</updated><summary type="html">'), xml_text(F.coalesce("teaser", F.lit(""))), F.lit("</summary></entry>"))
    return _feed(posts, head, item, "</feed>", n)


def rss(posts: DataFrame, site: Site, n: int = FEED) -> DataFrame:
    """The same as RSS 2.0."""
    at = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss 'UT'")
    url = F.concat(F.lit(site.root), xml_text(F.col("route")))
    own = lambda x: xml_text(F.lit(x))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>'), own(site.title), F.lit("</title><link>"), own(site.root), F.lit("</link><description>"), own(site.description), F.lit('</description><atom:link href="'), own(site.root),
        F.lit('/rss.xml" rel="self" type="application/rss+xml" /><lastBuildDate>'), F.coalesce(at, F.lit("Thu, 01 Jan 1970 00:00:00 UT")), F.lit("</lastBuildDate>"),
    )
    item = F.concat(F.lit("<item><title>"), xml_text(F.coalesce("title", F.lit(""))), F.lit("</title><link>"), url, F.lit("</link><description>"), xml_text(F.coalesce("teaser", F.lit(""))), F.lit("</description><pubDate>"), at, F.lit("</pubDate><guid>"), url, F.lit("</guid></item>"))
    return _feed(posts, head, item, "</channel></rss>", n)


def robots(site: Site, hidden: tuple[str, ...] = ()) -> str:
    """What robots may read: all but ``hidden``, and where the sitemap is."""
    return "\n".join(["User-agent: *", *([f"Disallow: {x}" for x in hidden] or ["Disallow:"]), f"Sitemap: {site.root}/sitemap.xml", ""])
