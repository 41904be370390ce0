import html as H
import itertools
import random
import re
import time

from treeline.llm import main_text as mt

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h2>Site header</h2></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, accept them</p></div><!-- <p>hidden</p> -->
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>
paragraph&nbsp;here.<p>Second &#233;t&eacute; one<br>next line</p><div class="ad">Buy this now</div><form><p>Your mail <input></p></form>
<ul><li>point a</li><li>point b</li></ul><section id="comments"><p>reader says so</p></section></article>
<aside><p>Side text</p></aside><footer>&copy; foot</footer></body></html>"""


def weights():
    words = {"p": 2.0, "h1": 2.0, "li": -1.0, "li/a": -3.0, "div.ad": -3.0, "footer": -3.0, "h2": -1.0, "title": -3.0}
    return mt.Weights(words, {"p": -0.1, "article": -0.1, "nav": -3.0, "footer": -3.0, "aside": -3.0, "header": -3.0, "br": -0.1, "b": -0.1, "li": -0.2, "ul": -0.2})


def test_page():
    assert mt.main_text(PAGE, weights()).split("\n")[:4] == ["Title & more", "First bold paragraph here.", "Second été one", "next line"]
    text = mt.main_text(PAGE, weights())
    for bad in ("Menu", "Buy", "mail", "reader", "Side", "foot", "cookies", "no", "hidden", "header"):
        assert not re.search(rf"\b{bad}\b", text), bad


def test_best_run_is_the_maximum():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice([-2, -1, 0, 1, 3]) for _ in range(rng.randrange(0, 9))]
        a, b = mt.best_run(s)
        most = max([0] + [sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2)])
        assert sum(s[a:b]) == most


def test_odd_pages():
    w = weights()
    assert mt.main_text(None, w) == mt.main_text("", w) == mt.main_text("<p></p>", w) == mt.main_text("<nav>x</nav>", w) == ""
    assert mt.main_text("just words", w) == "just words"
    assert mt.main_text("<p>a < b & c &bogus; <unclosed", w).startswith("a < b & c &bogus;")
    assert mt.main_text("<p>" + "w " * 100_000, w).count("w") == 100_000
    assert mt.main_text("</p></div></x><p>ok", w) == "ok"
    assert mt.main_text("<p>one<p>two<p>" * 2000, w).count("\n") == 3999
    assert mt.main_text('<p title="a > b">x</p><a href=\'q"', w).startswith("x")
    assert mt.main_text("<script>never closed <p>x</p>", w) == ""


def test_the_region_parts_no_block():
    """As by brute force over all runs of items, then whole blocks around it."""
    rng = random.Random(5)
    w = mt.Weights({"p": 1.0, "div": 0.6, "li": -0.5, "body": 0.2}, {"i": -3.0, "b": -1.0, "p": -0.4, "/p": -0.2, "div": -1.5})
    parts = ["<p>", "</p>", "<div>", "</div>", "<i>", "</i>", "<b>", "<br>", "<li>", "word", "two words", " ", "<ul>", "</ul>"]
    for _ in range(400):
        page = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        items = mt.parse(page)
        s = [w.score(x) for x in items]
        runs = sorted((-sum(s[i:j]), i, j) for i, j in itertools.combinations(range(len(s) + 1), 2))
        total, i, j = runs[0] if runs and runs[0][0] < -1e-9 else (0, 0, 0)
        # every block: the text between two block tags
        blocks, held = [], []
        for k, x in enumerate([*items, mt.Item(None, "p", "p")]):
            if x.text is None and x.name.lstrip("/") in mt.BLOCKS:
                blocks.append(held)
                held = []
            elif x.text is not None:
                held.append(k)
        near = {round(sum(s[a:b]), 9) for _, a, b in runs if abs(sum(s[a:b]) + total) < 1e-9}
        got = mt.best_run(s)
        assert round(sum(s[slice(*got)]), 9) in near or not runs or total == 0
        a, b = got
        kept = [" ".join("".join(items[k].text for k in block).split()) for block in blocks if any(a <= k < b for k in block)]
        assert mt.main_text(page, w) == "\n".join(t for t in kept if t), page


def test_blocks_begin_where_they_begin():
    w = mt.Weights({"div": 1.0, "p": 1.0}, {"i": -3.0, "b": -3.0})
    assert mt.main_text("<div>W<i>x</i> <i>y</i> tail words here more and more</div>", w) == "Wx y tail words here more and more"
    assert mt.main_text("<p>W<i><b><em><strong><span>c</span></strong></em></b></i> d e</p>", w) == "Wc d e"


def test_long_odd_pages_in_linear_time():
    w = weights()
    for piece in ("<svg><!-- x</svg> ", "<a ", "<svg>", "<!-- ", '<a "', "<template><svg>", "<object><!--"):
        began = time.time()
        mt.main_text("<p>text</p>" + piece * 40_000, w)
        assert time.time() - began < 5, piece
    assert mt.main_text("<p>a</p><!-- x > y", w) == "a" == mt.main_text("<p>a</p><!doctype", w)
    assert mt.main_text("<p>a <svg><!-- </svg> -->no</svg> b</p>", w) == "a b"


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS body", "3 AS text", "4 AS k", "5 AS n_chars")
    assert mt.extract(pages, mt.learn(pages)).columns == ["id", "url", "text", "n_chars"]


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (2, "v", "", 1)], "page_id long, url string, html string, n_chars int")
    got = mt.extract(pages, weights()).collect()
    assert len(got) == 4 and got[0] == got[1]
    assert {(r.id, r.text, r.n_chars) for r in got[2:]} == {(None, "", 0), (2, "", 0)}
    assert got[0].n_chars == len(got[0].text)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert mt.extract(none, mt.learn(none)).count() == 0


def test_learning(spark):
    pages = spark.createDataFrame([(i, "u", f"<html><nav><a href=x>menu {i}</a></nav><article><p>content words {i} here</p></article><footer>foot</footer></html>") for i in range(30)], "page_id long, url string, html string")
    w = mt.learn(pages)
    assert w.words["p"] > 0 > w.words["nav/a"] and w.words["footer"] < 0
    assert all(v < 0 for v in w.tags.values())


def test_articles_of_the_table(spark):
    """Against the page's own markup."""
    from tests.conftest import DATA

    got = {r.page_id: r.text for r in mt.op4(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_long_advert_does_not_part_the_article():
    for ad in ('<div class="ad">%s</div>', "<form><div class='ad'>%s</div></form>", "<aside>%s</aside>"):
        page = "<article><h1>Headline</h1><p>short lead</p>" + ad % ("buy now " * 200) + "<p>" + "long text " * 50 + "</p></article>"
        w = weights()
        w.words["aside"] = -3.0
        assert mt.main_text(page, w) == "Headline\nshort lead\n" + " ".join(["long text"] * 50)


def test_wrappers_of_the_article_stay():
    body = "<h1>Head</h1><p>the text of the page</p>"
    for tag in ('div class="has-sidebar"', 'div id="page" class="no-comments"', 'section id="related-work"', 'div class="search-result"', 'div class="sidebar"', "form"):
        name = tag.split()[0]
        for inner in (body, f"<article>{body}</article>"):
            page = f"<{tag}>{inner}<div class='site-footer_1'><p>boiler</p></div></{name}><div class='comments'><article class='comment'><p>reader</p></article></div>"
            assert mt.main_text(page, weights()) == "Head\nthe text of the page", page
    assert mt.main_text(f"{body}<div class='ad-box'><p>buy</p></div><div class='sidebar'><p>side</p></div>", weights()) == "Head\nthe text of the page"


def test_foreign_and_nested_elements_end_where_they_do():
    for cut in ("<svg viewBox='0 0'/>", "<math/>", "<svg><g/><svg><text>x</text></svg><text>no</text></svg>", "<object>a<object>b</object>no</object>", "<svg><svg/><text>no</text></svg>", "<object data='x'>"):
        assert mt.main_text(f"<p>one {cut} two</p><p>three</p>", weights()) == "one two\nthree", cut
    assert mt.main_text("<p>one<svg>" * 3000, weights()).count("one") == 3000


def test_deep_nesting_takes_linear_time():
    import time

    began = time.time()
    page = "<article>" + "<div><p>w</b>" * 20_000 + "</article>"
    assert mt.main_text(page, weights()).count("w") == 20_000
    assert time.time() - began < 10
