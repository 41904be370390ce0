"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A pattern rule is a line of the usual blocking-list notation: ``||host`` (the host or a subdomain
of it), ``|`` (start or end of the URL), ``^`` (a separator or the end), ``*`` (anything) and a
leading ``@@`` (an exception). A rule's *literal tokens* are the runs of ``[a-z0-9]`` that any URL
it matches must hold as whole tokens. Each rule is filed under the one that fewest URLs of the
table hold; the tokens of a URL fetch the rules filed under them, and only those rules' regular
expressions run. Rules without such a token form a short list that runs on every URL.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path): a rule fits its host and all subdomains below the path; longest wins.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Pattern rules for URLs that no host rule fits.
PATTERN_RULES = (
    "||spam-farm.example.^",
    "||cheap-pills.example.^",
    "||adult-*.example.^",
    "||ads-track.example.^",
    "||casino-*.example.^",
    "||free-bets.example.^",
    "/casino/",
    "/adserver/",
    "&affid=",
    "||tracker.*/pixel^",
    "^sessionid=",
    "@@||blog.*/about^",
)

#: Rules are broadcast up to this many; beyond it the token join shuffles both sides.
BROADCAST_RULES = 100_000
TOKEN = "[a-z0-9]+"


def rule_regex(rule: str) -> tuple[str, str]:
    """(verdict, regular expression for the lower-cased URL) of a pattern rule."""
    verdict = "allow" if rule.startswith("@@") else "block"
    body = rule.removeprefix("@@").lower()
    start = end = ""
    if body.startswith("||"):
        start, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    if body.endswith("|"):
        end, body = "$", body[:-1]
    special = {"*": "[^\\n]*", "^": "([^a-z0-9_.%-]|$)"}
    return verdict, start + "".join(special.get(c) or (c if c.isalnum() else f"\\x{ord(c):02x}" if ord(c) < 128 else c) for c in body) + end


def rule_tokens(rule: str) -> list[str]:
    """The runs of a rule that a matching URL holds as whole tokens."""
    body = rule.removeprefix("@@").lower()
    # A run at an end that is not anchored, or beside a wildcard, may be part of a longer token.
    padded = (" " if body.startswith("|") else "*") + body.strip("|") + (" " if body.endswith("|") else "*")
    return sorted({m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", padded)})


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path:
    from there up to ``?``, ``#`` or the end. Both are empty for null or a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(urls: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, url_col: str = "url") -> DataFrame:
    """A verdict for every distinct URL of ``urls``: ``url, host, path, rule, verdict, pattern``.

    ``rule`` is the longest host rule that fits (host + path), else null; then ``verdict`` is that
    of the pattern rules: allow if an exception matches, else block if a rule matches (``pattern``
    names it), else allow. A null URL gets a row of its own: empty host and path, allowed.
    An empty table or empty rule lists give no rows or no matches.
    """
    spark = urls.sparkSession
    u = urls.select(F.col(url_col).alias("url")).distinct()
    host, path = host_and_path(F.col("url"))
    lower = F.translate(F.coalesce("url", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    u = u.select("url", host.alias("host"), path.alias("path"), lower.alias("low"))

    # Host rules: every suffix of the host's labels is looked up.
    hosts = spark.createDataFrame([(h, p, v) for v, h, p in host_rules] or [("", "", "")], "h string, p string, v string")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    small = F.broadcast if len(host_rules) <= BROADCAST_RULES else (lambda df: df)
    fits = (
        u.select("url", "path", F.explode(suffixes).alias("h"))
        .join(small(hosts), "h")
        .filter(F.expr("startswith(path, p) and v <> ''"))
        .groupBy("url")
        .agg(F.max(F.struct(F.length(F.concat("h", "p")).alias("n"), F.concat("h", "p").alias("rule"), F.col("v").alias("v"))).alias("best"))
        .select("url", F.col("best.rule").alias("rule"), F.col("best.v").alias("host_verdict"))
    )

    tokens = u.select("url", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(TOKEN), F.lit(0)))).alias("token"))
    rules = [(r, *rule_regex(r), rule_tokens(r)) for r in dict.fromkeys(pattern_rules)]
    wanted = sorted({t for *_, ts in rules for t in ts})
    # How many URLs hold each token that some rule has: one row for each such token.
    seen = {}
    if wanted:
        known = spark.createDataFrame([(t,) for t in wanted], "token string")
        held = tokens.select("token").join((F.broadcast if len(wanted) <= BROADCAST_RULES else (lambda d: d))(known), "token")
        seen = {r.token: r["count"] for r in held.groupBy("token").count().toLocalIterator()}
    index = [(min(ts, key=lambda t: (seen.get(t, 0), t)), r, v, rx) for r, v, rx, ts in rules if ts]
    index = spark.createDataFrame(index, "token string, pattern string, v string, rx string")
    hits = tokens.join((F.broadcast if len(rules) <= BROADCAST_RULES else (lambda d: d))(index), "token").filter(F.expr("regexp_like(low, rx)")).select("url", "pattern", "v")
    if bare := [(r, v, rx) for r, v, rx, ts in rules if not ts]:
        # Rules without a token: one expression of them all, then each of them where that matches.
        some = u.filter(F.col("low").rlike("|".join(f"(?:{rx})" for *_, rx in bare)))
        each = F.from_json(F.lit(json.dumps([dict(zip(("pattern", "v", "rx"), r, strict=True)) for r in bare])), "array<struct<pattern: string, v: string, rx: string>>")
        tried = some.select("url", "low", F.explode(each).alias("r"))
        hits = hits.unionByName(tried.filter(F.expr("regexp_like(low, r.rx)")).select("url", "r.pattern", "r.v"))
    # "allow" < "block", so that an exception wins
    hits = hits.groupBy("url").agg(F.min(F.struct("v", "pattern")).alias("hit"))
    return (
        u.join(fits, "url", "left")
        .join(hits, "url", "left")
        .select("url", "host", "path", "rule", F.coalesce("host_verdict", "hit.v", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("hit.pattern")).alias("pattern"))
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages).withColumnRenamed("url", "judged_url")
    return pages.join(judged, F.col("url").eqNullSafe(F.col("judged_url"))).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op9_sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    order = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in order)
    pats = sorted((*rule_regex(r), r) for r in PATTERN_RULES)
    pats.sort(key=lambda x: (x[0], x[2]))
    pattern = " ".join(f"WHEN regexp_matches(low, '{rx}') THEN '{r}'" for _, rx, r in pats)
    block = " ".join(f"WHEN pattern = '{r}' THEN '{v}'" for v, _, r in pats)
    return f"""
    WITH a AS (SELECT page_id, {low} AS low,
                      CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    c AS (SELECT *, CASE {rule} END AS rule, CASE {pattern} END AS pattern FROM b)
    SELECT page_id, host, path, rule, CASE {verdict} {block} ELSE 'allow' END AS verdict,
           CASE WHEN rule IS NULL THEN pattern END AS pattern FROM c"""
