import re
import time
from html import unescape

import pytest

from factpanel.llm import extraction, markup, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<main><article class="post-12"><h1>Title &amp; more</h1><p>One <b>two</b>three
 four<br>five<p>Six&nbsp;seven<!-- no --><div class="ad">Buy</div><form>Name</form><ul><li>a<li>b</ul>
<section class="comments"><p>Nice</p></section></article></main><aside>Side</aside><footer>&copy;</footer>"""


def test_one_page():
    assert extraction.extract(PAGE, None)[0] == "Title & more One twothree four five Six seven a b"
    assert extraction.extract(PAGE, "body/main/article.post-#")[1:] == ("body/main/article.post-#", True)
    for odd in (None, "", "<", "<p", "</p>", "<<p>>", "<p class=\"x", "&am", "<article>"):
        assert isinstance(extraction.extract(odd, "body/article")[0], str)
    assert extraction.extract("plain words", None)[0] == "plain words"


def test_unclosed_elements_end():
    page = markup.read("<div><p><b>one<p>two</div>three<ul><li>x<li>y</ul><table><tr><td>c<td>d</table>")
    assert [b[1] for b in page.blocks] == ["one", "two", "three", "x", "y", "c", "d"]
    assert [page.elements[b[0]].path for b in page.blocks[:3]] == ["body/div/p", "body/div/p", "body"]


def test_hosts_agree(spark):
    def page(i, extra=""):
        return f'<body><div class="menu">m</div><div class="story-{i}"><p>Story {i} {"words " * 50}</p></div>{extra}</body>'

    rows = [(i, f"http://A.example/{i}", page(i)) for i in range(9)]
    rows.append((9, "http://a.example/9", page(9, f'<div class="big"><p>{"other " * 500}</p></div>')))
    rows += [(10, None, "<p>no host</p>"), (11, "http://[bad", None), (12, "http://b.example/", "")]
    out = {r["page_id"]: r for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 13
    assert out[9]["text"].startswith("Story 9") and out[9]["by_consensus"] and out[9]["path"] == "body/div.story-#"
    assert out[10]["text"] == "no host" and out[11]["text"] == out[12]["text"] == "" and out[12]["n_chars"] == 0


def test_text_beside_the_winning_body(spark):
    def page(i, outer):
        body = f'<div class="body"><p>Body {i} {"words " * 300}</p></div>'
        beside = f'<p class="lead">Lead {i}</p>{body}<div class="ad">Buy</div><section><p>More {i}</p></section><div class="share">Tell</div>'
        return f'<body><nav>Menu</nav><main><{outer}><header><h1>Head {i}</h1><p>By me</p></header>{beside}</{outer}></main><p>Outside</p></body>'

    rows = [(i, f"http://{outer}.example/{i}", page(i, outer)) for outer, at in (("article", 0), ("div", 10)) for i in range(at, at + 5)]
    rows = [(i, url, html if "article" in url else html.replace("<header>", "").replace("</header>", "").replace("<p>By me</p>", "")) for i, url, html in rows]
    for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r["page_id"]
        assert r["by_consensus"] and r["path"].endswith("div.body")
        assert r["text"] == f"Head {i} Lead {i} Body {i} {'words ' * 300}More {i}"


@pytest.mark.parametrize("n", range(1, 9))
@pytest.mark.parametrize("wrapped", [True, False])
def test_sections_of_a_page_builder(n, wrapped):
    """Sections that each stand in containers of their own, beside a menu and a footer of equal length."""
    names = "history method results outlook intro text outro notes".split()[:n]
    texts = {name: " ".join(f"{name}{i}" for i in range(80)) for name in names}
    for layout in ('<section class="{0}"><div class="row"><div class="col"><p>{1}</p></div></div></section>', '<div class="{0}"><div class="wrap"><p>{1}</p></div></div>'):
        body = "".join(layout.format(name, text) for name, text in texts.items())
        body = f'<div class="post">{body}</div>' if wrapped else body
        menu = "<ul>" + "".join(f'<li><a href="/{i}">menu entry {i}</a></li>' for i in range(60)) + "</ul>"
        noise = f"<footer><p>{'footer words ' * 60}</p></footer>"
        for page in (body, f"<nav>{menu}</nav>{body}{noise}", f'<div class="menu">{menu}</div>{body}<div class="site-footer"><p>{"foot " * 200}</p></div>'):
            html = f"<html><body>{page}</body></html>"
            own = extraction.extract(html, None)
            assert own[0] == " ".join(texts.values())
            for path in extraction.votes(markup.read(html, extraction.is_noise)):  # whichever path the host agrees on
                assert extraction.extract(html, path)[0] == own[0]


def test_votes_against_a_plain_account(spark):
    """Scores from each block outwards, added up in plain Python over the elements' ancestors."""
    pages = [(i, f"http://h{i % 2}.example/{i}", f'<body><div class="a{i}"><h1>Head</h1><p>{"one " * (20 + i)}<a href="x">{"link " * i}</a></p><section><p>{"two " * (9 * i)}</p></section></div><div class="b"><p>{"three " * 30}</p></div></body>') for i in range(1, 7)]
    total = {}
    for i, url, html in pages:
        blocks = [(["body", "body/div.a#"], "Head", 0), (["body", "body/div.a#"], "one " * (20 + i) + "link " * i, len("link " * i) - 1), (["body", "body/div.a#", "body/div.a#/section"], "two " * (9 * i), 0), (["body", "body/div.b"], "three " * 30, 0)]
        page = {}
        for path, text, links in blocks:
            weight = len(text.strip()) - links
            for p in reversed(path):
                if weight >= 1:
                    page[p] = page.get(p, 0) + weight
                weight /= 2
        for p, s in page.items():
            key = (url.split("/")[2], p)
            total[key] = total.get(key, 0) + s / sum(page.values())
    want = {}
    for host in ("h0.example", "h1.example"):
        want[host] = min((p for h, p in total if h == host), key=lambda p: (-round(total[host, p], 4), p))
    got = extraction.host_paths(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["host"]: r["path"] for r in got} == want
    assert all(abs(r["votes"] / 1e6 - total[r["host"], r["path"]]) < 0.05 for r in got)


def test_large_hosts_among_many(spark, monkeypatch):
    monkeypatch.setattr("factpanel.llm.components.HEAVY", 4)
    rows = [(i, f"http://{'big' if i % 2 else f'h{i}'}.example/", f'<div class="story"><p>Story {i}</p></div>') for i in range(40)] + [(40, None, ""), (41, "http://big.example/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    few, many = (sorted(map(str, extraction.main_text(df, broadcast_hosts=n).collect())) for n in (1000, 3))
    assert few == many and len(few) == 42


def test_query_against_the_article_element(spark, data):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = queries.op5_html(spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"<[^>]+>", "\n", re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", inner))
        assert r["text"] == " ".join(unescape(plain).split()) and r["n_chars"] == len(r["text"])


def test_empty_table_repeats_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, host string, path string, text string, votes long"
    assert extraction.main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://a/", PAGE, "?", "?", "?", 1)] * 3 + [(2, "http://a/", "<p>" + "long " * 100_000, "?", "?", "?", 1)]
    out = extraction.main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 4 and len({r["text"] for r in out if r["page_id"] == 1}) == 1


def test_work_grows_with_the_page_alone():
    for html in (
        "<div>x" * 100_000, "<b>x" * 100_000, "<x-a>x" * 100_000 + "</x-b>" * 100_000, "<a " * 300_000, "<p \"" * 100_000, "<p '\"" * 100_000,
        "<li>" + "<i>" * 50_000 + "<li>x" * 50_000, "<!-- " * 200_000, "<" * 500_000, "<ul>" * 50_000 + "<li>x" * 50_000, "<p>" * 100_000 + "text", "<div>" + "<span>" * 140_000 + "x" + "<p>" * 35_000, "<a><p>" + "<i>" * 140_000 + "</a>" * 140_000,
    ):
        began = time.time()
        text = extraction.extract("<article><p>Hello.</p></article>" + html, None)[0]
        assert time.time() - began < 20, html[:20]
        assert text.startswith("Hello.")


def test_names_within_an_article_are_taken_whole():
    kept = ['<p class="related-work">', '<p class="alert-level">', '<p class="share-price">', '<section id="search-algorithms">', '<div id="ad-hoc">', '<div class="post-content menuetto">']
    gone = ['<div class="related-posts">', '<div class="share-buttons">', '<div class="ad">', '<div id="comments-list">', '<div class="newsletter-signup">', '<div class="ad-slot-3">']
    body = "".join(f"{k}kept {i}.</{k[1:].split()[0]}>" for i, k in enumerate(kept)) + "".join(f"{g}gone</div>" for g in gone)
    text = extraction.extract(f"<body><article><p>Begin.</p>{body}</article></body>", None)[0]
    assert text == "Begin. " + " ".join(f"kept {i}." for i in range(len(kept)))


def test_siblings_without_an_article_and_math():
    page = '<body><div class="nav"><a href="/">Home</a></div><div id="page"><div class="intro">A lead of some words.</div><div class="body"><p>The long body of the page, with more words than its lead.</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p></div></div><div class="links"><a href="a">one link</a> <a href="b">and another one that is long</a></div></body>'
    text = extraction.extract(page, None)[0]
    assert text == "A lead of some words. The long body of the page, with more words than its lead. Let x=2 be."
