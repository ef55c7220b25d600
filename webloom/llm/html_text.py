"""Main-text extraction by tag-path ratios.

A page is cut into text nodes, each at the end of a root-to-leaf path of tags. For every path the text
length, the punctuation and the number of nodes are summed; length per node less the share of text in links
is the path's text ratio, punctuation per node its mark ratio (after content extraction via path ratios,
CEPR). The ratios, set along the page in node order, are smoothed by a Gaussian window and fused, and nodes
over a threshold of a share of their spread are content.

The content nodes vote. The innermost <article> or <main> with half of their text is the article, else the
innermost element with nearly all of it; of the latter the text from the first content block to the last one
counts, with the headings before them, and without blocks in between whose path is under the threshold and
mostly links. Subtrees that are menus, headers, footers, sidebars, notices, adverts, forms or comments go:
by their tag or role always, by a class or id only where the votes agree that the page is elsewhere. A
marked subtree that holds nearly all content is taken as unmarked.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import text

#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that close an open <p>, and tags that close an open tag of their own family.
CLOSES_P = BLOCK - frozenset("body head html caption tbody td tfoot th thead tr option optgroup legend summary".split()) | {"table"}
FAMILY = {t: f for f in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",), ("optgroup",), ("thead", "tbody", "tfoot")) for t in f}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Tags and roles whose subtrees are no part of an article; a form counts as marked, as some hold a whole page.
SKIP_TAGS = frozenset("nav aside footer script style noscript template iframe object svg button select textarea input dialog menu head title noembed noframes canvas audio video".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
#: Words of a class or id that say so: what a subtree is, and what it is made for or about.
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus footer "
    "sidebar sidebars aside widget widgets share sharing social related recommended recommendations newsletter subscribe subscription signup login promo promotion sponsor sponsored sponsors outbrain taboola pagination "
    "pager toolbar masthead topbar skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
#: Nouns that name a container or an item and leave it to the word before them to say of what.
HOLDERS = frozenset("area bar block body box button buttons card column container content form group holder icons inner item items link links list panel posts section slot stories thread unit widget wrap wrapper".split())
#: First words of a class that tells of the page around, not of the subtree; whole names that are spelt apart.
ABOUT = frozenset("has no with without show hide is not".split())
SPELT = {"sign-up": "signup", "side-bar": "sidebar", "sr-only": "hidden", "visually-hidden": "hidden", "screen-reader-text": "hidden", "skip-link": "skip"}
#: A paragraph, and elements that a paragraph above them doesn't reach into.
P_SCOPE = frozenset("p td th button article div section table".split())
#: Depth from which elements stand beside one another; a page nested deeper is no document.
DEPTH = 500
#: Share of the content, and characters of it, that other subtrees have at most for a marked one to be unmarked.
LEFT_SHARE, LEFT_CHARS = 0.1, 140
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)?\s*")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass(eq=False)
class Element:
    """mark: the class that says that the subtree is no part, 'comment' or 'other'; skip: its tag or role says so.

    scope: the element itself or the nearest above it that is a paragraph or keeps one in.
    """

    tag: str
    path: int
    up: Element | None
    skip: bool
    mark: str
    link: bool
    depth: int
    number: int
    scope: Element | None = None


@dataclass
class Node:
    """A text node: its element, its text decoded, and the block that it is in."""

    at: Element
    text: str
    block: int


@dataclass
class Page:
    """Text nodes in order, elements with parents before children, the number of different paths."""

    nodes: list[Node] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    paths: int = 0


def marked(value: str, inside_article: bool) -> str:
    """What a class or id says: 'comment', 'other' or ''. The last word of a name counts, holders aside."""
    for name in _WORDS.findall(value.lower().replace("_", "-")):
        words = SPELT.get(name, name).split("-")
        if words[0] in ABOUT and len(words) > 1:
            continue
        while len(words) > 1 and words[-1] in HOLDERS:
            words.pop()
        if words[-1] in COMMENT_WORDS:
            return "comment"
        if words[-1] in SKIP_WORDS or (words[-1] == "header" and not inside_article):
            return "other"
    return ""


class _Scanner:
    """Tags of a page; what isn't found once is not looked for again, so malformed pages take linear time."""

    def __init__(self, page: str) -> None:
        self.page, self.none = page, set()

    def find(self, what: str, pos: int) -> int:
        if what in self.none:
            return -1
        at = self.page.find(what, pos)
        if at < 0:
            self.none.add(what)
        return at

    def attributes(self, pos: int) -> tuple[list[tuple[str, str]], bool, int]:
        """(attributes, whether the tag closes itself, where it ends) from behind a tag's name.

        A quote opens a value only after =; one that is never closed ends with the tag.
        """
        page, out, n = self.page, [], len(self.page)
        while pos < n:
            m = _ATTR_NAME.match(page, pos)
            name, pos = m[1], m.end()
            if pos >= n:
                break
            if page[pos] == ">":
                if name is not None:
                    out.append((name.lower(), ""))
                return out, page[pos - 1] == "/", pos + 1
            if name is None:
                pos += 1
                continue
            value = ""
            if page[pos] == "=":
                pos += 1
                while pos < n and page[pos].isspace():
                    pos += 1
                quote = page[pos : pos + 1]
                end = self.find(quote, pos + 1) if quote in ('"', "'") else -1
                if end >= 0:
                    value, pos = page[pos + 1 : end], end + 1
                else:
                    start = pos
                    while pos < n and page[pos] != ">" and not page[pos].isspace():
                        pos += 1
                    value = page[start:pos]
            out.append((name.lower(), value))
        return out, False, n


def _skips(tag: str, attrs: list[tuple[str, str]], inside_article: bool) -> tuple[bool, str]:
    """(whether tag, role or style say that a subtree is no part of an article, what its class or id says)."""
    skip, mark = tag in SKIP_TAGS or (tag == "header" and not inside_article), "other" if tag == "form" else ""
    for name, value in attrs:
        value = html.unescape(value).lower() if "&" in value else value.lower()
        if name == "role":
            skip |= value.strip() in SKIP_ROLES
        elif name in ("class", "id") and tag not in ("html", "body", "main", "article"):
            mark = mark or marked(value, inside_article)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDES.search(value)):
            skip = True
    return skip, mark


def parse(page: str) -> Page:
    """The page's text nodes in order, with implied end tags and stray end tags taken care of."""
    out, scan = Page(), _Scanner(page)
    root = Element("#root", 0, None, False, "", False, 0, 0)
    out.elements.append(root)
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    nodes, now, block, pos, end, articles = out.nodes, root, 0, 0, len(page), 0

    def add(s: str) -> None:
        if s and not (s := html.unescape(s)).isspace():
            nodes.append(Node(now, s, block))
        elif s and nodes and nodes[-1].block == block:
            nodes.append(Node(now, " ", block))

    def close(e: Element) -> None:
        """Leave e and all in it."""
        nonlocal now
        while now is not e.up:
            opened[now.tag] -= 1
            now = now.up

    while pos < end:
        at = scan.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        if at > pos:
            add(page[pos:at])
        if page.startswith("<!--", at):
            stop = scan.find("-->", at + 4)
            pos = end if stop < 0 else stop + 3
            continue
        if page.startswith("<![CDATA[", at):
            stop = scan.find("]]>", at)
            pos = end if stop < 0 else stop + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            stop = scan.find(">", at)
            pos = end if stop < 0 else stop + 1
            continue
        ends = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + ends)
        if m is None:
            if ends:  # </ and no name is a comment
                stop = scan.find(">", at)
                pos = end if stop < 0 else stop + 1
            else:
                add("<")
                pos = at + 1
            continue
        if scan.find(">", m.end()) < 0:  # the page ends within a tag
            break
        tag = m[0].lower()
        attrs, itself, pos = scan.attributes(m.end())
        if ends:
            if opened[tag] > 0:
                e = now
                while e.tag != tag:
                    e = e.up
                close(e)
            if tag in BLOCK:
                block += 1
            continue
        if tag in CLOSES_P and now.scope is not None and now.scope.tag == "p":
            close(now.scope)
        if tag in FAMILY and any(opened[x] > 0 for x in FAMILY[tag]):
            e, fence, family = now, FENCE[tag], FAMILY[tag]
            while e is not root and e.tag not in family and e.tag not in fence:
                e = e.up
            if e is not root and e.tag in family:
                close(e)
        if tag in BLOCK:
            block += 1
        if tag == "br" and nodes and nodes[-1].block == block:
            nodes.append(Node(now, " ", block))
        if tag in VOID:
            continue
        if now.depth >= DEPTH:
            close(now)
        skip, mark = _skips(tag, attrs, opened["article"] + opened["main"] > 0)
        path = paths.setdefault((now.path, tag), len(paths) + 1)
        new = Element(tag, path, now, now.skip or skip, mark, now.link or tag == "a", now.depth + 1, len(out.elements))
        new.scope = new if tag in P_SCOPE else now.scope
        out.elements.append(new)
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            inner = page[pos : shut.start() if shut else end]
            pos = shut.end() if shut else end
            if not new.skip and inner.strip():
                nodes.append(Node(new, html.unescape(inner), block))
            continue
        if itself and tag in ("svg", "path", "math"):
            continue
        opened[tag] += 1
        now = new
    out.paths = len(paths) + 1
    return out


@dataclass
class Ratios:
    """What the paths of a page's nodes sum up to, and its nodes' own lengths."""

    texts: np.ndarray  # of each node its path's text ratio
    marks: np.ndarray  # its path's mark ratio
    in_links: np.ndarray  # its path's share of text in links
    length: np.ndarray
    free: np.ndarray  # whether it has text and is in no link

    @staticmethod
    def of(page: Page) -> Ratios:
        of = np.array([x.at.path for x in page.nodes])
        length = np.array([len(x.text.strip()) for x in page.nodes], float)
        punct = np.array([len(_PUNCT.findall(x.text)) for x in page.nodes], float)
        link = np.array([x.at.link for x in page.nodes])
        count = np.maximum(np.bincount(of, minlength=page.paths), 1)
        total, linked = np.bincount(of, length, page.paths), np.bincount(of, length * link, page.paths)
        in_links = linked / np.maximum(total, 1)
        return Ratios((total / count * (1 - in_links))[of], (np.bincount(of, punct, page.paths) / count)[of], in_links[of], length, ~link & (length > 0))

    def content(self, live: np.ndarray) -> np.ndarray:
        """Which of the live nodes are content by their paths' smoothed, fused ratios."""
        if not live.any():
            return live
        fused = np.where(live, _smooth(self.texts) * (1 + _smooth(self.marks)), 0)
        return live & self.free & (fused >= 0.5 * fused[live].std()) & (fused > 0)


_REACH = 2
_WINDOW = np.exp(-(np.arange(-_REACH, _REACH + 1) ** 2) / 2.0)
_WINDOW /= _WINDOW.sum()


def _smooth(x: np.ndarray) -> np.ndarray:
    """By the Gaussian window; the first and last values go on beyond the ends."""
    return np.convolve(np.concatenate([np.full(_REACH, x[0]), x, np.full(_REACH, x[-1])]), _WINDOW, "valid")


def _below(page: Page, own: np.ndarray) -> np.ndarray:
    """For each element the sum of `own` over its subtree."""
    total = own.astype(float)
    for e in reversed(page.elements[1:]):
        total[e.up.number] += total[e.number]
    return total


def _inherited(page: Page, own: list[bool]) -> np.ndarray:
    """For each element whether it or an element above it has its entry set."""
    out = np.array(own)
    for e in page.elements[1:]:
        out[e.number] |= out[e.up.number]
    return out


def _text_of(page: Page, which: np.ndarray) -> np.ndarray:
    """For each element the characters of those of its own nodes that are set."""
    out = np.zeros(len(page.elements))
    for x, w in zip(page.nodes, which.tolist(), strict=True):
        if w:
            out[x.at.number] += len(x.text.strip())
    return out


def left_out(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for each element whether it is left out, content nodes, their paths' share of text in links).

    Marks hold unless they leave next to no content: then the outermost marked subtree that has the most of
    it is taken as unmarked, and so on. Comments need all content in them for that.
    """
    r, marks = Ratios.of(page), [e.mark for e in page.elements]
    skips = _inherited(page, [e.skip for e in page.elements])
    at = np.array([x.at.number for x in page.nodes], int)
    picked = r.content(~skips[at])
    if not any(marks):
        return skips, picked, r.in_links
    whole = r.length[picked].sum()
    while True:
        out = skips | _inherited(page, list(map(bool, marks)))
        left = r.length[picked & ~out[at]].sum()
        best = None
        if left <= min(LEFT_SHARE * whole, LEFT_CHARS):
            below = _below(page, _text_of(page, picked))
            above = _inherited(page, [False] + [bool(marks[e.up.number]) for e in page.elements[1:]])
            tops = [e for e in page.elements if marks[e.number] and not above[e.number] and not skips[e.number] and below[e.number]]
            best = max(tops, key=lambda e: below[e.number], default=None)
        if best is None or (left and marks[best.number] == "comment"):
            # the vote is of what is not left out, against the spread of that alone
            return out, r.content(~out[at]), r.in_links
        most = 0.9 * below[best.number] if 2 * below[best.number] > below[0] else np.inf
        for e in tops if most == np.inf else page.elements:
            if e is best or (marks[e.number] and below[e.number] >= most):
                marks[e.number] = ""


def article(page: Page, out: np.ndarray, picked: np.ndarray) -> Element | None:
    """The innermost element that holds nearly all content text, with wrappers that add little to it.

    An <article> or <main> that holds half of it goes before.
    """
    weight = _below(page, _text_of(page, picked))
    whole = weight[0]
    if not whole:
        return None
    named = [e for e in page.elements if e.tag in ("article", "main") and weight[e.number] >= 0.5 * whole]
    if named:
        return max(named, key=lambda e: e.depth)
    best = max((e for e in page.elements if weight[e.number] >= 0.9 * whole), key=lambda e: e.depth)
    while best.up is not None and best.tag not in BLOCK:
        best = best.up
    # one paragraph isn't an article: its heading and its neighbours stand beside it
    while best.up is not None and best.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "tr", "blockquote", "pre", "ul", "ol", "table", "tbody"):
        best = best.up
    # a wrapper that adds little, such as a heading over the body of a post, belongs to it
    plain = np.array([not (out[x.at.number] or x.at.link) for x in page.nodes], bool)
    total = _below(page, _text_of(page, plain))
    while best.up is not None and best.up.tag not in ("body", "html", "#root") and total[best.up.number] <= 1.3 * total[best.number]:
        best = best.up
    return best


def _heading(e: Element | None) -> bool:
    while e is not None:
        if e.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return True
        e = e.up
    return False


def main_text(page: str | None) -> str:
    """The article's blocks in page order, white space collapsed, joined by line feeds."""
    if not page:
        return ""
    p = parse(page)
    if not p.nodes:
        return ""
    out, picked, in_links = left_out(p)
    within = article(p, out, picked)
    if within is None:
        return ""
    inside = _inherited(p, [e is within for e in p.elements])
    blocks: list[list[int]] = []
    last = None
    for k, x in enumerate(p.nodes):
        if inside[x.at.number] and not out[x.at.number]:
            if x.block != last:
                blocks.append([])
                last = x.block
            blocks[-1].append(k)
    texts = [_SPACE.sub(" ", "".join(p.nodes[k].text for k in b)).strip() for b in blocks]
    blocks, texts = [b for b, t in zip(blocks, texts, strict=True) if t], [t for t in texts if t]
    if within.tag not in ("article", "main"):
        good = [any(picked[k] for k in b) for b in blocks]
        first, stop = good.index(True), len(good) - good[::-1].index(True)
        while first > 0 and all(_heading(p.nodes[k].at) for k in blocks[first - 1]):
            first -= 1
        menu = [not g and min(in_links[k] for k in b) > 0.5 for g, b in zip(good, blocks, strict=True)]
        texts = [texts[k] for k in range(first, stop) if not menu[k]]
    return "\n".join(texts)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = text.strings(b.column(2))
        for x, y in text.slices(column):
            got = [main_text(p) for p in column[x:y].to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0)[x:y], b.column(1)[x:y], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    A malformed page gives what can be read of it: a quote that is never closed ends with its tag, elements
    past DEPTH stand beside one another, and a page that ends within a tag ends before it. Time is linear in
    a page's length.

    A null or empty page, or one without content, has an empty text. Repeated rows repeat; an empty table
    gives an empty one; other columns play no part.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(_run, T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
