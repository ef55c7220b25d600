"""A small HTML tree: the standard library's tokenizer with implied and recovered tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_P_ENDS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: What an opening tag closes, and what stops the search for it.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
_HEAD = frozenset("title meta link base style script noscript template".split())


class Node:
    """An element. Children are elements and strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(n.elements()[::-1])

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        """All text below, as it stands."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skip:
                stack.extend(n.children[::-1])
        return "".join(out)

    def html(self) -> str:
        """The markup inside."""
        return "".join(c.outer() if isinstance(c, Node) else (c if self.tag in ("script", "style") else c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) for c in self.children)

    def outer(self) -> str:
        attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{self.html()}</{self.tag}>"

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html = Node("html", parent=self.root)
        self.head, self.body = Node("head", parent=self.html), Node("body", parent=self.html)
        self.html.children += [self.head, self.body]
        self.root.children.append(self.html)
        self.at, self.in_body = self.head, False

    def _closest(self, tags: tuple[str, ...], fence: tuple[str, ...]) -> Node | None:
        n = self.at
        while n is not None and n.tag not in fence and n not in (self.body, self.head):
            if n.tag in tags:
                return n
            n = n.parent
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {}
        for k, v in attrs:
            own.setdefault(k, "" if v is None else v)
        if tag in ("html", "head", "body"):
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in own.items():
                target.attrs.setdefault(k, v)
            if tag == "body":
                self.in_body, self.at = True, self.body
            return
        if not self.in_body and tag not in _HEAD:
            self.in_body, self.at = True, self.body
        if tag in _P_ENDS and (p := self._closest(("p",), ("button", "td", "th", "table", "caption", "object"))):
            self.at = p.parent
        if tag in _ENDS and (n := self._closest(*_ENDS[tag])):
            self.at = n.parent
        if tag == "tr" and self.at.tag == "table":
            self._open("tbody", {})
        if tag in ("td", "th") and self.at.tag in ("table", "tbody", "thead", "tfoot"):
            if self.at.tag == "table":
                self._open("tbody", {})
            self._open("tr", {})
        if tag == "a" and (n := self._closest(("a",), ("td", "th", "table"))):
            self.at = n.parent
        self._open(tag, own)
        if tag in VOID:
            self.at = self.at.parent

    def _open(self, tag: str, attrs: dict) -> None:
        n = Node(tag, attrs, self.at)
        self.at.children.append(n)
        self.at = n

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            if tag == "br":
                self.handle_starttag("br", [])
            return
        if tag == "head":
            if not self.in_body:
                self.in_body, self.at = True, self.body
            return
        n = self.at
        while n is not None and n not in (self.body, self.head) and n.tag != tag:
            n = n.parent
        if n is not None and n not in (self.body, self.head):
            self.at = n.parent
        elif tag == "p":
            self.handle_starttag("p", [])
            self.at = self.at.parent

    def handle_data(self, data: str) -> None:
        if not self.in_body and self.at is self.head:
            if not data.strip():
                return
            self.in_body, self.at = True, self.body
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The document of a page; html, head and body are always there."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_XML = re.compile(r"<!\[CDATA\[(.*?)\]\]>|<!--.*?-->|<[?!][^>]*>|<(/?)([A-Za-z_][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|([^<]+)", re.S)
_ATTR = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def parse_xml(text: str | None) -> Node:
    """A lenient XML tree: names as they are, CDATA as text, stray ends skipped."""
    import html as entities

    root = Node("#document")
    at = root
    for m in _XML.finditer(text or ""):
        if m[1] is not None:
            at.children.append(m[1])
        elif m[6] is not None:
            at.children.append(entities.unescape(m[6]))
        elif m[3] is not None and m[2]:
            n = at
            while n is not root and n.tag != m[3]:
                n = n.parent
            if n is not root:
                at = n.parent
        elif m[3] is not None:
            n = Node(m[3], {k: entities.unescape(a or b) for k, a, b in _ATTR.findall(m[4])}, at)
            at.children.append(n)
            if not m[5]:
                at = n
    return root
