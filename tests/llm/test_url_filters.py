import re

import pytest

from treeline.llm import url_filters as uf

URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/", "https://www.example.com/en/x?q#f", "http://Www.Example.COM/en/", "http://a.b.net/es/1", "http://net/fr/", "http://notexample.com/en/", "http://x.org/casino/1", "x://y://z/en/", "http://spam-farm.example.org/q", "http://not-spam-farm.example.org/q", "http://blog.x.org/about?a", "http://h.com:80/en/", "http://ü.com/É", "ftp://adult-1.example.net/es/", "http://q.org/?x&affid=3", "http://q.org/x?sessionid=1", "http://tracker.q.org/pixel", "http://example.com/EN/", "http://a.com?x", "http://a.com#/en/", "u://h/" + "a" * 50_000]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in uf.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    low = "".join(c.lower() if c.isascii() else c for c in url or "")
    hits = {v for v, rx in map(uf.rule_regex, uf.PATTERN_RULES) if re.search(rx, low)}
    return host, path, None, "allow" if "allow" in hits or not hits else "block"


def test_verdicts(spark):
    df = spark.createDataFrame([(u, 1, "x") for u in URLS + URLS[:3]], "url string, host int, rule string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(df).collect()}
    assert got == {u: brute(u) for u in URLS}


def test_rule_tokens_are_whole_tokens():
    assert uf.rule_tokens("||spam-farm.example.^") == ["example", "farm", "spam"]
    assert uf.rule_tokens("ads") == []  # may be part of a token
    assert uf.rule_tokens("/ads") == [] and uf.rule_tokens("/ads/") == ["ads"]
    assert uf.rule_tokens("/a*b/") == []
    assert uf.rule_tokens("|http://x.org|") == ["http", "org", "x"]


@pytest.mark.parametrize("rule,yes,no", [("||x.org^", ["http://x.org/", "http://a.x.org"], ["http://ax.org", "http://x.organ"]), ("|http:", ["http://a"], ["https://a"]), ("a*c|", ["http://abc"], ["http://abcd"])])
def test_patterns(spark, rule, yes, no):
    df = spark.createDataFrame([(u,) for u in yes + no], "url string")
    got = {r.url: r.verdict for r in uf.judge_urls(df, host_rules=(), pattern_rules=(rule,)).collect()}
    assert got == dict.fromkeys(yes, "block") | dict.fromkeys(no, "allow")


def test_indexed_rules_lose_nothing(spark):
    rules = uf.PATTERN_RULES + ("sess", "/en/")
    df = spark.createDataFrame([(u,) for u in URLS if u], "url string")
    got = {r.url: r.verdict for r in uf.judge_urls(df, (), rules).collect()}
    for u in filter(None, URLS):
        low = "".join(c.lower() if c.isascii() else c for c in u)
        hits = {v for v, rx in map(uf.rule_regex, rules) if re.search(rx, low)}
        assert got[u] == ("block" if hits == {"block"} else "allow"), u


def test_thousands_of_rules_without_a_token(spark):
    df = spark.createDataFrame([("http://a.org/xx777yy",), ("http://b.org/",)], "url string").selectExpr("*", "'t' AS token", "'l' AS low", "1 AS pattern")
    got = {r.url: (r.verdict, r.pattern) for r in uf.judge_urls(df, (), tuple(f"x{k}y" for k in range(3000))).collect()}
    assert got == {"http://a.org/xx777yy": ("block", "x777y"), "http://b.org/": ("allow", None)}


def test_empty_table_and_lists(spark):
    assert uf.judge_urls(spark.createDataFrame([], "url string")).count() == 0
    assert uf.judge_urls(spark.createDataFrame([("http://a",)], "url string"), (), ()).first().verdict == "allow"


def test_query_against_sql(spark, tmp_path):
    from tests.conftest import DATA, duck_rows, rows

    assert rows(uf.op9(spark, DATA)) == duck_rows(uf.op9_sql())
    odd = [u for u in URLS if u is None or u.isascii()]
    spark.createDataFrame(list(enumerate(odd)) + [(0, odd[5]), (None, odd[6])], "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert rows(uf.op9(spark, str(tmp_path))) == duck_rows(uf.op9_sql(), str(tmp_path))
