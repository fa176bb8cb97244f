"""Main text of web pages by wrappers inferred from pages of the same host.

A page becomes a stream of tokens: the elements that open, named with their
class or id, and texts. The wrapper of a host is a union-free regular
expression over such tokens. It starts as one page's stream; every further
stream is aligned with it (longest common token sequence). Texts that differ
become slots; tokens on one side only become optional groups; neighbouring
groups of equal tokens fold into one repeated group, before and after each
alignment. Its text nodes carry words, words in links and the number of pages.

A page is extracted by aligning it with its host's wrapper: each of its texts
takes the verdict of the node that it meets.

* The article is the innermost element of the wrapper that holds 0.6 of the
  words of unlinked text nodes. Nodes outside it are not content.
* A text node that is mostly links is a menu.
* A text node that is one fixed text on three or more different pages is
  template, if slots hold most of the article's words (pages that all carry
  one article are copies, not template).
* Tags and names (nav, footer, "ad", "comments", ...) break the tie where
  structure is silent: their elements are left out, and <article> or <main> is
  the article if it holds 0.3 of the words. Without these lists the rules
  above still decide.

A text that meets no node is kept if it is inside an element of the article's
name. A page of which nothing is kept gives all of its text that is not out.

All different pages of a host take part, each different stream once with its
summed figures; streams are aligned in buckets of at most some BUCKET, and the
results again, so no task grows with a host. Wrappers are broadcast while they
are few and small, else joined by host with salted keys.

A null or empty html has the empty text; a null url counts as the host "".
Markup that never closes is read to its end. Repeated rows give repeated
results, an empty table an empty one. Pages of any length are read whole. Ties
between elements go to the inner, then the first one. Columns other than
page_id, url and html are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import html as html_module
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, stored, table

#: The widest group that folds, and streams that one task aligns.
WIDEST, BUCKET = 12, 64
#: Bits of the alignment's rows that are kept at once; longer streams are halved.
TABLE = 1 << 29
BROADCAST_HOSTS, BROADCAST_BYTES, SALT = 50_000, 16_000_000, 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
OUT_TAGS = frozenset("nav header footer aside form button select option dialog menu head".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr"
    " notice notices notification alert popup modal overlay comment comments commentlist respond disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login search form pagination pager toolbar widget skip".split()
)
ARTICLE_TAGS = ("article", "main")
#: Elements that can be an article without a name of their own, and headings, which may be links.
SECTIONS = frozenset("html body article main section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that carry prose: repeated ones are paragraphs and items, other repeated elements form a list of entries.
PROSE = HEADINGS | frozenset("p li ul ol dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption address".split())
#: Names by which even an <article> is not the page's own.
REMARKS = frozenset("comment comments reply replies related teaser".split())


@dataclass
class Node:
    """A token of a wrapper: an element, a text (None once texts differ) or a group of nodes."""

    kind: str
    text: str | None = None
    body: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    path: tuple[str, ...] = ()
    out: bool = False
    words: int = 0
    linked: int = 0
    pages: int = 1
    blocks: tuple[int, ...] = ()
    sign: str = ""

    def __post_init__(self) -> None:
        self.sign = "(" + " ".join(x.sign for x in self.body) + ")" if self.kind == "group" else f"{self.kind} {'/'.join(self.path)}" if self.kind == "text" else self.kind

    def pattern(self) -> str:
        own = {"text": "#TEXT" if self.text is None else repr(self.text), "group": "( " + " ".join(x.pattern() for x in self.body) + " )"}.get(self.kind, f"<{self.kind}>")
        return own + ("*" if self.optional and self.repeated else "+" if self.repeated else "?" if self.optional else "")

    def texts(self) -> Iterator[Node]:
        if self.kind == "text":
            yield self
        for x in self.body:
            yield from x.texts()

    def elements(self) -> Iterator[Node]:
        if self.kind not in ("text", "group"):
            yield self
        for x in self.body:
            yield from x.elements()

    def packed(self) -> list | str:
        """The structure alone, as JSON; figures of text nodes are kept beside it."""
        if self.kind == "group":
            return [int(self.optional), int(self.repeated), [x.packed() for x in self.body]]
        return [int(self.optional), int(self.out), " ".join(self.path)] if self.kind == "text" else ["?" + self.kind] if self.optional else self.kind


def unpacked(own: list | str) -> Node:
    if isinstance(own, str):
        return Node(own)
    if len(own) == 1:
        return Node(own[0][1:], optional=True)
    if isinstance(own[2], str):
        return Node("text", optional=bool(own[0]), path=tuple(own[2].split()), out=bool(own[1]))
    return Node("group", None, [unpacked(x) for x in own[2]], bool(own[0]), bool(own[1]))


def named(tag: str, attributes: str) -> tuple[str, bool]:
    """A tag's name with its class or id, and whether tag or name say that it is not the article."""
    words: list[str] = []
    names: list[str] = []
    for key, a, b, c in _NAMED.findall(attributes) if "=" in attributes else ():
        value = html_module.unescape(a or b or c)
        words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        # The number in an id only tells elements of a page or pages of a host apart, as long numbers in a class do.
        names += [re.sub(r"\d+" if key.lower() == "id" else r"\d{3,}", "#", x) for x in re.sub(r"[.\x00-\x1f]", "_", value.lower()).split()]
    first = ".".join(dict.fromkeys(names))
    if tag in ("html", "body"):
        return tag, False
    shut = REMARKS if tag in ARTICLE_TAGS else OUT_NAMES
    return f"{tag}.{first}" if first else tag, tag in OUT_TAGS or not shut.isdisjoint(words)


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """("open" | "close" | "text", name or text, out): out as named() says."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], False
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if tag:
            if m[2] or m[5]:
                yield "close", tag, False
            else:
                name, out = named(tag, m[4] or m[7] or "")
                yield "open", name, out
    if at < len(page):
        yield "text", page[at:], False


@dataclass
class Open:
    """An element that is open: its tag, name, and whether it or one around it is out."""

    tag: str
    name: str
    out: bool
    number: int


def pieces(page: str) -> Iterator[tuple[tuple[Open, ...], bool, bool, str | None]]:
    """(open elements, out, in a link, text) of every text; None as text where a block starts or ends."""
    stack: list[Open] = []
    number = 0
    for kind, value, out in tokens(page):
        if kind == "text":
            yield tuple(stack), bool(stack) and stack[-1].out, any(x.tag == "a" for x in stack), value
            continue
        tag = value.split(".")[0]
        if kind == "open":
            if tag == "br":
                yield (), False, False, " "
                continue
            if tag not in INLINE:
                yield (), False, False, None
                while stack and (stack[-1].tag in INLINE or stack[-1].tag == "p" or stack[-1].tag == tag and tag in ("li", "td", "th", "tr", "option", "dt", "dd")):
                    stack.pop()  # unclosed inline elements and paragraphs end where a block begins
            if tag in ARTICLE_TAGS and not out:
                if menu := [x for x in stack if x.tag in ("nav", "header", "footer") and x.out]:
                    at = next(i for i, x in enumerate(stack) if x is menu[0])
                    before = at > 0 and stack[at - 1].out  # a menu that was never closed does not hold the article
                    stack[at:] = [Open(x.tag, x.name, before, x.number) for x in stack[at:] if x.tag not in ("nav", "header", "footer")]
            if tag in VOID:
                continue
            around = bool(stack) and stack[-1].out
            if tag == "header" and any(x.tag in ARTICLE_TAGS for x in stack):
                out = False  # an article's own heading
            number += 1
            stack.append(Open(tag, value, around or out, number))
        else:
            if tag not in INLINE:
                yield (), False, False, None
            if any(x.tag == tag for x in stack):
                while stack.pop().tag != tag:
                    pass


Block = tuple[tuple[str, ...], bool, int, int, str, tuple[int, ...]]


def blocks(page: str) -> list[Block]:
    """(names of the open block elements, out, words, words in links, text, numbers of these elements) of every block of text in page order."""
    found: list[Block] = []
    now: list[str] = []
    links: list[str] = []
    place: tuple[tuple[str, ...], bool] | None = None
    numbers: tuple[int, ...] = ()

    def close() -> None:
        nonlocal place
        if place is not None and (text := _SPACE.sub(" ", html_module.unescape("".join(now))).strip()):
            found.append((*place, text.count(" ") + 1, len("".join(links).split()), text, numbers))
        now.clear()
        links.clear()
        place = None

    for path, out, link, text in pieces(page):
        if text is None:
            close()
        elif not path and text == " " and place is not None:
            now.append(text)  # a line break
        else:
            held = [x for x in path if x.tag not in INLINE]
            own = tuple(x.name for x in held), out
            if own != place:
                if place is not None and (not text.strip() or own == (place[0], True)):
                    continue  # white space, or an inline advert within a block
                close()
                place, numbers = own, tuple(x.number for x in held)
            now.append(text)
            if link:
                links.append(text)
    close()
    return found


def fold(nodes: list[Node]) -> list[Node]:
    """Turns neighbouring equal groups of tokens into one repeated group."""
    width = 1
    while width <= min(WIDEST, len(nodes) // 2 + 1):
        i, out, changed = 0, [], False
        signs = [x.sign for x in nodes]
        while i < len(nodes):
            if i + width >= len(nodes) or signs[i] != signs[i + width]:
                out.append(nodes[i])
                i += 1
                continue
            here = signs[i : i + width]
            n = 1
            while len(here) == width and signs[i + n * width : i + (n + 1) * width] == here:
                n += 1
            if n > 1 and not (width == 1 and nodes[i].kind not in ("group", "text")):
                body = nodes[i : i + width]
                for k in range(1, n):
                    body = [_merged(a, b, True) for a, b in zip(body, nodes[i + k * width : i + (k + 1) * width], strict=True)]
                if width == 1 and body[0].kind == "group":
                    out.append(Node("group", None, body[0].body, body[0].optional, True))
                else:
                    out.append(Node("group", None, body, all(x.optional for x in body), True))
                i, changed = i + n * width, True
            else:
                out.append(nodes[i])
                i += 1
        nodes, width = out, 1 if changed else width + 1
    return nodes


def _merged(a: Node, b: Node, same_page: bool = False) -> Node:
    """One node for two that meet, with their figures summed; pages are not, where both are of one page."""
    optional = a.optional and b.optional if same_page else a.optional or b.optional
    if a.kind == "text":
        pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
        return Node("text", a.text if a.text == b.text else None, [], optional, False, a.path, a.out and b.out, a.words + b.words, a.linked + b.linked, pages, a.blocks + b.blocks)
    body = [_merged(x, y, same_page) for x, y in zip(a.body, b.body, strict=True)] if a.kind == "group" else []
    return Node(a.kind, None, body, optional, a.repeated or b.repeated)


def common(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """The places of a longest common sequence of two lists of nodes."""
    x, y = [n.sign for n in a], [n.sign for n in b]
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(len(x), len(y)) - start and x[-1 - end] == y[-1 - end]:
        end += 1
    middle = _longest(x[start : len(x) - end], y[start : len(y) - end])
    return [(k, k) for k in range(start)] + [(start + i, start + j) for i, j in middle] + [(len(x) - end + k, len(y) - end + k) for k in range(end)]


def _rows(x: list[str], y: list[str]) -> Iterator[int]:
    """For each prefix of x the places of y (bits) at which its longest common sequence with y's prefix does not grow."""
    places: dict[str, int] = {}
    for j, sign in enumerate(y):
        places[sign] = places.get(sign, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for sign in x:
        met = row & places.get(sign, 0)
        row = (row + met | row - met) & full
        yield row


def _longest(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common sequence: rows of bits, halves of x where they would be too many."""
    if not x or not y:
        return []
    if len(x) * len(y) > TABLE and len(x) > 1:
        half, left, right = len(x) // 2, 0, 0
        for left in _rows(x[:half], y):
            pass
        for right in _rows(x[half:][::-1], y[::-1]):
            pass
        # Common length of the first half with y[:j] and of the second with y[j:], for each j.
        ahead = list(accumulate((1 - (left >> j & 1) for j in range(len(y))), initial=0))
        behind = list(accumulate((1 - (right >> j & 1) for j in range(len(y))), initial=0))[::-1]
        j = max(range(len(y) + 1), key=lambda j: ahead[j] + behind[j])
        return _longest(x[:half], y[:j]) + [(half + a, j + b) for a, b in _longest(x[half:], y[j:])]
    rows = [(1 << len(y)) - 1, *_rows(x, y)]
    i, j, out = len(x), len(y), []
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def bodies(nodes: list[Node]) -> list[list[str]]:
    """The signs of the repeated groups, inner ones first."""
    found: dict[tuple[str, ...], None] = {}
    for x in nodes:
        if x.kind == "group":
            for own in bodies(x.body):
                found[tuple(own)] = None
            if x.repeated:
                found[tuple(y.sign for y in x.body)] = None
    return [list(f) for f in found]


def gathered(nodes: list[Node], repeated: list[list[str]]) -> list[Node]:
    """What stands once here and repeatedly elsewhere becomes a group here too, so that the two meet."""
    nodes = [Node("group", None, gathered(x.body, [o for o in repeated if len(o) < len(x.body)]), x.optional, x.repeated) if x.kind == "group" else x for x in nodes]
    for own in repeated:
        i, out, signs = 0, [], [x.sign for x in nodes]
        while i < len(nodes):
            if signs[i] == own[0] and signs[i : i + len(own)] == own:
                out.append(Node("group", None, nodes[i : i + len(own)]))
                i += len(own)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper that accepts what both accept: common tokens stay, others become optional groups."""
    wrapper, page = gathered(wrapper, bodies(page)), gathered(page, bodies(wrapper))
    out: list[Node] = []

    def spare(nodes: list[Node]) -> None:
        if len(nodes) > 1:
            out.append(Node("group", None, nodes, True, False))
        for x in nodes if len(nodes) == 1 else ():
            x.optional = True
            out.append(x)

    i = j = 0
    for a, b in [*common(wrapper, page), (len(wrapper), len(page))]:
        spare(wrapper[i:a])
        spare(page[j:b])
        if a < len(wrapper):
            out.append(_merged(wrapper[a], page[b]))
        i, j = a + 1, b + 1
    return fold(out)


def stream(found: list[Block]) -> list[Node]:
    """The folded tokens of a page's blocks."""
    nodes: list[Node] = []
    before: tuple[int, ...] = ()
    for k, (path, out, words, linked, text, numbers) in enumerate(found):
        same = 0
        while same < min(len(numbers), len(before)) and numbers[same] == before[same]:
            same += 1
        nodes += [Node(name) for name in path[same:]]
        nodes.append(Node("text", text, path=path, out=out, words=words, linked=min(linked, words), blocks=(k,)))
        before = numbers
    return fold(nodes)


def repeated_groups(nodes: list[Node]) -> Iterator[Node]:
    for x in nodes:
        if x.repeated:
            yield x
        yield from repeated_groups(x.body)


def entry_texts(wrapper: list[Node]) -> dict[int, bool]:
    """Text nodes of repeated groups that open more than prose (by id), and whether an entry looks like a remark: a short text, such as an
    author or a date, that is no heading, and a longer one."""
    found: dict[int, bool] = {}
    for group in repeated_groups(wrapper):
        if all(e.kind.split(".")[0] in PROSE for e in group.elements()):
            continue
        own = list(group.texts())
        plain = [x for x in own if not HEADINGS.intersection(y.split(".")[0] for y in x.path[-1:])]
        remark = len(plain) == len(own) > 1 and 4 * min(x.words for x in plain[:2]) <= max(x.words for x in plain)
        for x in own:
            found[id(x)] = found.get(id(x), False) or remark
    return found


def verdicts(wrapper: list[Node]) -> tuple[list[bool], str]:
    """Whether each text node of a wrapper is content, and the name of the article's element."""
    nodes = [t for x in wrapper for t in x.texts()]
    menu = {id(x) for x in nodes if 2 * x.linked > x.words and not HEADINGS.intersection(x.path[-1:])}
    loose = [x for x in nodes if not x.out and id(x) not in menu]
    total = sum(x.words for x in loose)
    by: dict[tuple[str, ...], int] = {}
    entries = entry_texts(wrapper)
    # Entries of lists (comments, teasers) do not say where the article is, unless all but a tenth of the words are in them.
    if 10 * sum(x.words for x in loose if id(x) not in entries) > total:
        loose = [x for x in loose if id(x) not in entries]
        total = sum(x.words for x in loose)
    else:
        entries = {}
    for x in loose:
        for k in range(len(x.path) + 1):
            by[x.path[:k]] = by.get(x.path[:k], 0) + x.words
    again = {e.kind for x in repeated_groups(wrapper) for e in x.elements()}  # what opens once a paragraph or item is no article
    tagged = {p: n for p, n in by.items() if p and p[-1].split(".")[0] in ARTICLE_TAGS}
    root: tuple[str, ...] = ()
    if total and sum(n for p, n in tagged.items() if not any(q != p and p[: len(q)] == q for q in tagged)) >= 0.3 * total:
        root = max(tagged, key=lambda p: (tagged[p], -len(p)))
    elif total:
        able = [p for p in by if not p or p[-1] not in again and ("." in p[-1] or p[-1] in SECTIONS)]
        title = [x.path for x in loose if x.path and x.path[-1].split(".")[0] == "h1"]
        # The innermost element that holds most of the words, or, with the page's one title, at least some.
        root = max((p for p in able if by[p] >= 0.6 * total or len(set(title)) == 1 and by[p] >= 0.3 * total and title[0][: len(p)] == p), key=len)
    # Several elements may bear the article's name; the path to it may differ a little between pages.
    name = root[-1] if root else ""
    inside = [x for x in nodes if not name or name in x.path]
    fixed = sum(x.words for x in inside if x.text is not None and x.pages >= 3)
    varied = sum(x.words for x in inside if x.text is None)
    template = {id(x) for x in inside if x.text is not None and x.pages >= 3} if varied > fixed else set()
    within = {id(x) for x in inside}
    remarks = {id(x) for x in inside if id(x) in entries and entries[id(x)]} if entries else set()
    return [id(x) in within and id(x) not in template | menu | remarks and not x.out for x in nodes], name


def finished(wrapper: list[Node]) -> dict:
    keep, name = verdicts(wrapper)
    return {"tree": [x.packed() for x in wrapper], "keep": [int(x) for x in keep], "article": name}


def infer(pages: list[str]) -> dict:
    """The wrapper of pages of one host: its pattern, tree, and which text nodes are content."""
    streams = [stream(blocks(p)) for p in dict.fromkeys(p for p in pages if p)]
    wrapper = streams[0] if streams else []
    for other in streams[1:]:
        wrapper = align(wrapper, other)
    return {"pattern": " ".join(x.pattern() for x in wrapper)} | finished(wrapper)


class Wrapper:
    """A host's wrapper, ready to read pages with."""

    def __init__(self, own: dict):
        self.tree = [unpacked(x) for x in own.get("tree", [])]
        self.article, self.bodies = own.get("article", ""), bodies(self.tree)
        for node, keep in zip((t for x in self.tree for t in x.texts()), own.get("keep", []), strict=True):
            node.words = keep
        self.seen: dict[str, list[bool | None]] = {}

    def text(self, page: str | None) -> str:
        found = blocks(page or "")
        if not found:
            return ""
        nodes = stream(found)
        key = " ".join(x.sign for x in nodes)
        if key not in self.seen:
            if len(self.seen) > 1000:
                self.seen.clear()
            met: dict[int, bool] = {}
            nodes = gathered(nodes, self.bodies)
            tree = gathered(self.tree, bodies(nodes))
            for i, j in common(tree, nodes):
                for a, b in zip(tree[i].texts(), nodes[j].texts(), strict=True):
                    met[id(b)] = bool(a.words)
            self.seen[key] = [met.get(id(x)) for t in nodes for x in t.texts()]
        kept: set[int] = set()
        for x, keep in zip((x for t in nodes for x in t.texts()), self.seen[key], strict=True):
            # Words that are linked here, or out here, stay out whatever other pages hold in that place.
            inside = not self.article or self.article in x.path
            if not x.out and (inside if keep is None else keep):
                kept.update(x.blocks)
        if not kept:
            kept = {k for k, b in enumerate(found) if not b[1]}
        return "\n".join(found[k][4] for k in sorted(kept))


def extract(page: str | None, wrapper: dict) -> str:
    """The main text of a page by its host's wrapper."""
    return Wrapper(wrapper).text(page)


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


_FIGURES = "array<struct<i: int, words: long, linked: long, pages: long, low: string, high: string>>"


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of every host of rows host, html."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, page, text in zip(batch["host"], batch["page"], batch["html"], strict=True):
                nodes = stream(blocks(text))
                texts = [t for x in nodes for t in x.texts()]
                hashes = ["" if t.text is None else hashlib.blake2b(t.text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest() for t in texts]
                rows.append((h, page, json.dumps([x.packed() for x in nodes]), [(t.words, t.linked, x) for t, x in zip(texts, hashes, strict=True)]))
            yield pd.DataFrame(rows, columns=["host", "page", "tree", "texts"])

    found = pages.filter("html <> ''").select("host", F.md5("html").alias("page"), "html").mapInPandas(measure, "host string, page string, tree string, texts array<struct<words: long, linked: long, text: string>>")
    # Equal pages count once, and equal streams of a host are one with summed figures.
    once = found.groupBy("host", "page").agg(F.first(F.struct("tree", "texts")).alias("x")).select("host", "x.*")
    by_node = once.select("host", "tree", F.posexplode_outer("texts").alias("i", "t")).groupBy("host", "tree", "i").agg(
        F.sum("t.words").alias("words"), F.sum("t.linked").alias("linked"), F.count("*").alias("pages"), F.min("t.text").alias("low"), F.max("t.text").alias("high")
    )
    figures = F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "words", "linked", "pages", "low", "high"))))
    now = stored(by_node.groupBy("host", "tree").agg(figures.alias("figures")), "html-streams")

    def read(tree: str, figures) -> list[Node]:
        nodes = [unpacked(x) for x in json.loads(tree)]
        for t, x in zip((t for n in nodes for t in n.texts()), figures, strict=True):
            t.words, t.linked, t.pages, t.text = x["words"], x["linked"], x["pages"], x["low"] if x["low"] == x["high"] and x["low"] else None
        return nodes

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tree", key=lambda s: s.map(lambda t: (len(t), t)), kind="stable")
        wrapper: list[Node] = []
        for k, (tree, figures) in enumerate(zip(group["tree"], group["figures"], strict=True)):
            own = read(tree, figures)
            wrapper = align(wrapper, own) if k else own
        texts = [t for x in wrapper for t in x.texts()]
        own = [{"i": i, "words": t.words, "linked": t.linked, "pages": t.pages, "low": t.text or "", "high": t.text or ""} for i, t in enumerate(texts)]
        return pd.DataFrame({"host": [group["host"].iloc[0]], "tree": [json.dumps([x.packed() for x in wrapper])], "figures": [own]})

    while (most := now.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        sizes = now.groupBy("host").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
        placed = now.join(sizes, "host").withColumn("bucket", F.pmod(F.xxhash64(F.lit(most), "tree"), F.col("buckets")))
        now = stored(placed.groupBy("host", "bucket").applyInPandas(merge, f"host string, tree string, figures {_FIGURES}"), "html-streams")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"host": batch["host"], "wrapper": [json.dumps(finished(read(t, f))) for t, f in zip(batch["tree"], batch["figures"], strict=True)]})

    return now.mapInPandas(finish, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host())
    own = stored(wrappers(rows), "html-wrappers")
    size = own.agg(F.count("*").alias("n"), F.sum(F.length("wrapper") + F.length("host")).alias("b")).first()
    if size["n"] <= BROADCAST_HOSTS and (size["b"] or 0) <= BROADCAST_BYTES:
        held = rows.join(F.broadcast(own), "host", "left")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
        held = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALT)).cast("int")).join(own.withColumn("salt", salt), ["host", "salt"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str | None, Wrapper] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch["html"], batch["wrapper"], strict=True):
                if wrapper not in read:
                    if len(read) > 200:
                        read.clear()
                    read[wrapper] = Wrapper(json.loads(wrapper) if wrapper else {})
                texts.append(read[wrapper].text(page))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    return held.select("page_id", "url", "html", "wrapper").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
