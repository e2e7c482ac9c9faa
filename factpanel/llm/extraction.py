"""Main text of web pages by consensus paths of hosts.

A page's containers are scored: a text block gives its length without links to the container that
holds it, half of that to the next one out, and so on; articles and main elements count more.  The
shares are votes for the containers' generalised paths (tags with classes, digits as one sign), added
up per host in Spark.  Each page is then read again and its text taken from the elements on its
host's winning path, each widened to the article or else the main element that it is in, as headlines
and leads stand beside a body, or else to all that holds its siblings; a page without text there uses its own
best container.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are known by element, role or class words, within an article by whole names; inside an article's own
header only headings count.

Cases: null and empty pages have the empty text; a null or odd address belongs to the host "";
repeated rows vote and are extracted alike; broken markup is read as far as it goes; an empty table
gives no rows; other columns are ignored; a very long page is read whole, in work and memory that grow
with its length.
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import markup
from .arrow import append_columns
from .components import checkpoint, join_spread

# Words of class names, ids and roles that mark what isn't main text.
NOISE_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies
    consent gdpr notice notices notification newsletter subscribe subscription signup login popup modal overlay sidebar
    sidenav rail widget widgets related recommended recommendations share sharing social comment comments disqus replies
    respond footer masthead nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar search form
    complementary contentinfo alert copyright tracking outbrain taboola hidden""".split()
)
#: Words that stand beside them in a name that marks the same; within an article a name must be made of nothing else.
PARTS = frozenset(
    """area bar bars block blocks body bottom box btn button buttons center col column container content count counts entries feed footer grid group header icon icons
    inline inner item items left link links list main meta middle module outer panel post posts right row section slot stories story text title tools top unit wrap wrapper
    thread reply form field fields label input submit user users reader readers site page web by this the in us follow""".split()
)
KEPT_TAGS = frozenset("html body main article".split())
LIKE = 4  #: what stands beside an element in the page itself is like it up to so many times its length
#: Beyond so many hosts the winners are joined by a shuffle instead of sent to each executor.
BROADCAST_HOSTS = 200_000


@lru_cache(maxsize=20_000)
def is_noise(tag: str, attribute_text: str, in_article: bool) -> str | None:
    if tag in NOISE_TAGS:
        return "noise"
    if tag == "header":
        return "header" if in_article else "noise"
    if not attribute_text.strip() or tag in KEPT_TAGS:
        return None
    named = markup.attributes(attribute_text)
    if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
        return "noise"
    names = [[w.lower() for w in markup.WORDS.findall(n)] for k in ("class", "id", "role") for n in named.get(k, "").split()]
    words = {w for name in names for w in name}
    if in_article:
        if any(set(name) & NOISE_WORDS and set(name) <= NOISE_WORDS | PARTS for name in names):
            return "noise"
    elif words & NOISE_WORDS:
        return "noise"
    return ("header" if in_article else "noise") if "header" in words and "h1" not in tag else None


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _kept(page: markup.Page) -> list[tuple[int, str, int]]:
    out = []
    for b in page.blocks:
        e = page.elements[b[0]]
        if not e.noise and (not e.header or e.heading):
            out.append(b)
    return out


def scores(page: markup.Page) -> dict[int, float]:
    """Scores of the containers that hold main text, by element."""
    found: dict[int, float] = {}
    for owner, text, links in _kept(page):
        weight, i = float(len(text) - links), page.elements[owner].container
        while i >= 0 and weight >= 1:
            found[i] = found.get(i, 0.0) + weight * (1.5 if page.elements[i].tag in ("article", "main") else 1.0)
            weight /= 2
            above = page.elements[i].parent
            i = page.elements[above].container if above >= 0 else -1
    return found


def votes(page: markup.Page) -> dict[str, float]:
    """Shares of the page's paths; they add up to one, or to nothing without text."""
    by_path: dict[str, float] = {}
    for i, s in scores(page).items():
        path = page.elements[i].path
        by_path[path] = by_path.get(path, 0.0) + s
    total = sum(by_path.values())
    return {p: s / total for p, s in by_path.items()} if total else {}


def _roots(page: markup.Page, path: str) -> set[int]:
    """The elements to take the text of: those on the path, widened.

    An element is widened to the nearest article that it is in, else the nearest main element; on a
    page with neither to the containers around it, as long as what they add isn't mostly links.  The
    page itself is one of them only if it adds less than is held, or has nothing else than siblings of
    the same element and not of another order of length.  Elements without text don't count.
    """
    n = len(page.elements)
    held, linked = [0] * n, [0] * n
    for owner, text, links in _kept(page):
        held[owner] += len(text)
        linked[owner] += links
    article, main = [-1] * n, [-1] * n
    for i, e in enumerate(page.elements):  # parents come before children
        article[i] = i if e.tag == "article" else article[e.parent] if e.parent >= 0 else -1
        main[i] = i if e.tag == "main" else main[e.parent] if e.parent >= 0 else -1
    for i in range(n - 1, 0, -1):
        held[page.elements[i].parent] += held[i]
        linked[page.elements[i].parent] += linked[i]
    roots, seen = set(), set()
    top = [i for i, e in enumerate(page.elements) if e.parent == 0 and held[i]]

    def siblings(i: int) -> bool:
        while page.elements[i].parent > 0:
            i = page.elements[i].parent
        return held[0] == sum(held[k] for k in top) and all(page.elements[k].tag == page.elements[i].tag and held[k] <= LIKE * held[i] for k in top)

    for i, e in enumerate(page.elements):
        if e.path != path or e.tag not in markup.CONTAINERS or not held[i]:
            continue
        if article[i] >= 0 or main[i] >= 0:
            roots.add(article[i] if article[i] >= 0 else main[i])
            continue
        while i > 0 and i not in seen:
            seen.add(i)
            above = page.elements[page.elements[i].parent].container
            more, more_links = held[above] - held[i], linked[above] - linked[i]
            if 2 * more_links > more or above == 0 and more >= held[i] and not siblings(i):
                break
            i = above
        roots.add(i)
    return roots


def _text(page: markup.Page, path: str) -> str:
    roots = _roots(page, path)
    inside = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        inside[i] = i in roots or (e.parent >= 0 and inside[e.parent])
    return " ".join([t for owner, t, _ in _kept(page) if inside[owner]])


def extract(html: str | None, path: str | None) -> tuple[str, str | None, bool]:
    """(text, path used, whether that was ``path``)."""
    page = markup.read(html, is_noise)
    if path is not None and (text := _text(page, path)):
        return text, path, True
    own = votes(page)
    if own:
        best = min(own, key=lambda p: (-own[p], p))
        return _text(page, best), best, False
    return "", None, False


def host_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): the path with most votes, which are millionths of pages; equal ones go to the first in order of text."""
    ballot = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("share", T.LongType())]))
    fields = [T.StructField("host", T.StringType()), T.StructField("ballot", ballot)]

    def work(urls: list, htmls: list) -> list:
        # shares in millionths: whole numbers add up alike in any order
        cast = [[{"path": p, "share": round(1e6 * s)} for p, s in votes(markup.read(h, is_noise)).items()] for h in htmls]
        return [[host(u) for u in urls], cast]

    cast = append_columns(pages, [url_col, html_col], fields, work, [])
    counted = cast.select("host", F.explode("ballot").alias("v")).groupBy("host", "v.path").agg(F.sum("v.share").alias("votes"))
    best = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("order"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"), (-F.col("best.order")).alias("votes"))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, url, text, n_chars, host, path, by_consensus), a row for each page."""
    winners = checkpoint(host_paths(pages, url_col=url_col, html_col=html_col))
    plain = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    named = append_columns(plain.select("page_id", "url", "html"), ["url"], [T.StructField("host", T.StringType())], lambda urls: [[host(u) for u in urls]])
    joined = join_spread(named, winners, "host", "votes", broadcast_hosts)
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("used", T.StringType()), T.StructField("by_consensus", T.BooleanType())]

    def work(htmls: list, paths: list) -> list:
        found = [extract(h, p) for h, p in zip(htmls, paths, strict=True)]
        return [[f[0] for f in found], [len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found]]

    out = append_columns(joined, ["html", "path"], fields, work, ["page_id", "url", "host"])
    return out.select("page_id", "url", "text", "n_chars", "host", F.col("used").alias("path"), "by_consensus")
