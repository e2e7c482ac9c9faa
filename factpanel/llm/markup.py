"""A forgiving reader of HTML: elements with generalised paths, and text blocks in page order."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var
    math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mmultiscripts mprescripts none mpadded mphantom menclose
    mtable mtr mtd""".split()
)
#: What stands in these elements isn't text of the page.
RAW = "script style noscript template title svg iframe object select textarea button canvas audio video annotation annotation-xml".split()
CONTAINERS = frozenset("body main article section div td center".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table article section main div body".split())
PAGE = frozenset("html head body".split())

LONGEST_PATH = 300
BEGINS = r"<(?:(/?)([a-zA-Z][^\s/>]*+)"
OTHERS = r">|(?=[!?]|/?[a-zA-Z]))"
#: A tag whose quotes are all closed, or one without quotes; a group is empty where something else begins.
TAG = re.compile(BEGINS + r"""([^'"<>]*+(?:(?:"[^"]*+"|'[^']*+')[^'"<>]*+)*+)""" + OTHERS)
BARE = re.compile(BEGINS + r"""([^'"<>]*+)""" + OTHERS)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
NOT_OF_NAMES = re.compile(r"<[!?/]")
RUN = re.compile(r"[^'\"<>]*")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DIGITS = re.compile(r"[0-9]+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
Token = tuple[int, int, str, str, str]


@dataclass
class Element:
    tag: str
    parent: int
    path: str  #: the names from the root on; a long one ends in a digest of them
    attributes: str
    noise: bool = False  #: itself or an ancestor isn't part of the main text
    header: bool = False  #: inside the header of an article: only its headings count
    heading: bool = False
    article: bool = False  #: in an article or main element
    block: int = 0  #: the nearest element, itself included, that isn't inline
    container: int = 0  #: the nearest container, itself included


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (index of the element that holds the text, text, characters that are links)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def squeeze(text: str) -> str:
    return " ".join(unescape(text).split()) if text else ""


def tokens(html: str) -> Iterator[Token]:
    """(start, end, slash, name, attribute text) of tags and of what is skipped.

    The slash of an element that is skipped with its content is "raw"; comments have no name.

    Any text is read in one pass: a tag ends at its ">" outside quotes, and one that meets "<" or the
    end before is text; a quote that isn't closed anywhere is looked for once.
    """
    at, find, open_quotes = 0, TAG.search, set()
    while found := find(html, at):
        start, end = found.span()
        slash, name, attribute_text = found.groups()
        if name is None:  # what isn't a plain tag
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = len(html) if end < 0 else end + 3
                yield start, at, "", "", ""
                continue
            if html.startswith(("<!", "<?"), start):
                end = html.find(">", start)
                if end < 0:
                    return
                at = end + 1
                yield start, at, "", "", ""
                continue
            m = NAME.match(html, start)
            i = m.end()
            while i < len(html):
                i = RUN.match(html, i).end()
                quote = html[i : i + 1]
                if quote not in ("'", '"'):
                    break
                if quote in open_quotes:
                    quote = ""
                    break
                end = html.find(quote, i + 1)
                if end < 0:
                    open_quotes.add(quote)
                    find, quote = BARE.search, ""
                    break
                i = end + 1
            else:
                quote = ""
            if quote != ">":  # nor is a tag that begins within its name, as it would end alike
                other = NOT_OF_NAMES.search(html, start + 1, m.end() + 1)
                at = other.start() if other else m.end()
                continue
            end, slash, name, attribute_text = i + 1, m[1], m[2], html[m.end() : i]
        name = name.lower()
        if not slash and name in RAW_END:
            if html[end - 2] != "/":
                closing = RAW_END[name].search(html, end)
                end = closing.end() if closing else len(html)
            slash = "raw"
        at = end
        yield start, end, slash, name, attribute_text


def close_before(tag: str, opened: dict[str, list[int]], scopes: list[int], pop_to: Callable[[int], None]) -> None:
    """Closes what the start of an element ends: open paragraphs, then one element of its kind, within the scope."""
    ends = CLOSES.get(tag, ())
    while (depth := max([opened[e][-1] for e in ("p", *ends) if opened[e]], default=0)) > scopes[-1]:
        paragraph = opened["p"] and opened["p"][-1] == depth
        pop_to(depth)
        if not paragraph:
            break


def lines(html: str, found: Iterable[Token]) -> list[str]:
    """The texts of the blocks that ``read`` finds, made of the page's tokens without its elements.

    Inline elements neither end a block nor close what isn't inline, so only the others are followed.
    """
    out: list[str] = []
    texts: list[str] = []
    opened: defaultdict[str, list[int]] = defaultdict(list)  # as in read, of elements that aren't inline
    stack, scopes = ["body"], [0]
    at = 0

    def pop_to(depth: int) -> None:
        for tag in reversed(stack[depth:]):
            opened[tag].pop()
        del stack[depth:]
        while scopes[-1] >= depth:
            scopes.pop()

    for start, end, slash, tag, _ in found:
        if start > at:
            texts.append(html[at:start])
        at = end
        if not tag or slash == "raw" or tag in INLINE or slash and not opened[tag]:
            continue
        if tag == "br" and not slash:
            texts.append(" ")
            continue
        if texts:
            if text := squeeze("".join(texts)):
                out.append(text)
            texts.clear()
        if slash:
            pop_to(opened[tag][-1])
            continue
        if tag in PAGE:
            continue
        if opened["p"] or tag in CLOSES:
            close_before(tag, opened, scopes, pop_to)
        if tag not in VOID:
            opened[tag].append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append(tag)
    texts.append(html[at:])
    if text := squeeze("".join(texts)):
        out.append(text)
    return out


def read(html: str | None, is_noise=None) -> Page:
    """Elements and text blocks.  Unclosed elements end where HTML ends them; stray ends are ignored.

    ``is_noise(tag, attribute text, in_article)`` marks elements whose text isn't main text.  Work and
    memory grow with the length of the page, however deep its elements are: the depths of open elements
    are kept by name, so none is looked for along the stack.
    """
    page = Page()
    elements, blocks = page.elements, page.blocks
    elements.append(Element("body", -1, "body", ""))
    opened: defaultdict[str, list[int]] = defaultdict(list)  # the depths at which elements of a name are open
    solid, scopes = [0], [0]  # the depths of open elements that aren't inline, and of those in SCOPES
    stack = [0]
    texts: list[str] = []
    owner = 0
    links = 0  # characters of links in the block that is open
    in_link = 0

    def flush() -> None:
        nonlocal links
        if texts:
            text = squeeze("".join(texts))
            if text:
                blocks.append((owner, text, min(links, len(text))))
            texts.clear()
        links = 0

    def take(text: str) -> None:
        nonlocal owner, links
        if not texts:
            if text.isspace():
                return
            owner = elements[stack[-1]].block
        texts.append(text)
        if in_link:
            links += len(text)

    def pop_to(depth: int) -> None:
        nonlocal in_link
        for i in reversed(stack[depth:]):
            opened[elements[i].tag].pop()
            if elements[i].tag == "a":
                in_link -= 1
        del stack[depth:]
        for depths in (solid, scopes):
            while depths[-1] >= depth:
                depths.pop()

    def push(element: Element) -> None:
        depth = len(stack)
        elements.append(element)
        stack.append(len(elements) - 1)
        opened[element.tag].append(depth)
        if element.tag not in INLINE:
            solid.append(depth)
        if element.tag in SCOPES:
            scopes.append(depth)

    html = html or ""
    at = 0
    for start, end, slash, tag, attribute_text in tokens(html):
        if start > at:
            take(html[at:start])
        at = end
        if not tag or slash == "raw":
            continue
        if slash:
            if not opened[tag]:
                continue
            depth = opened[tag][-1]
            if tag not in INLINE:
                flush()
                pop_to(depth)
            elif depth > solid[-1]:  # an inline element doesn't end beyond the block that is open
                pop_to(depth)
            continue
        if tag == "br":
            if texts:
                take(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link += 1
            top = elements[stack[-1]]
            push(Element(tag, stack[-1], top.path, attribute_text, top.noise, top.header, top.heading, top.article, top.block, top.container))
            continue
        flush()
        if tag in PAGE:
            if tag == "body":
                elements[0].attributes = attribute_text
            continue
        close_before(tag, opened, scopes, pop_to)
        if tag in VOID:
            continue
        parent, here = elements[stack[-1]], len(elements)
        name = tag
        if attribute_text and "class" in attribute_text.lower():
            classes = attributes(attribute_text).get("class", "").split()
            name = ".".join([tag, *sorted({DIGITS.sub("#", c) for c in classes})])
        path = f"{parent.path}/{name}"
        if len(path) > LONGEST_PATH:
            path = f".../{name[:100]}@{hashlib.blake2b(path.encode('utf-8', 'replace'), digest_size=8).hexdigest()}"
        heading = parent.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        element = Element(tag, stack[-1], path, attribute_text, parent.noise, parent.header, heading, parent.article or tag in ("article", "main"), here, here if tag in CONTAINERS else parent.container)
        if is_noise is not None and not element.noise:
            verdict = is_noise(tag, attribute_text, parent.article)
            element.noise = verdict == "noise"
            element.header = element.header or verdict == "header"
        push(element)
    if at < len(html):
        take(html[at:])
    flush()
    return page
