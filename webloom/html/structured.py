"""What pages tell without a schema: JSON-LD, microdata, data attributes, scripts, tables, links, forms, lists."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F

from webloom.functions.udf import vectorized
from webloom.functions.url import absolute
from webloom.html import css
from webloom.html.tree import Node, parse

_SPACE = re.compile(r"\s+")
_HIDDEN = frozenset(("script", "style", "noscript", "template"))


def dumps(v: Any) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def json_ld(root: Node) -> list[Any]:
    """Every parsable application/ld+json script; arrays are flattened."""
    out: list[Any] = []
    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type", "").strip().lower() == "application/ld+json":
            try:
                v = json.loads(n.text())
            except ValueError:
                continue
            out += v if isinstance(v, list) else [v]
    return out


def _item(n: Node) -> dict:
    out: dict[str, Any] = {}
    if kind := n.attrs.get("itemtype"):
        out["@type"] = kind.rstrip("/").split("/")[-1]
    stack = n.elements()[::-1]
    while stack:
        c = stack.pop()
        name, scope = c.attrs.get("itemprop"), "itemscope" in c.attrs
        if name:
            v = _item(c) if scope else c.attrs.get("content") or c.attrs.get("href") or c.attrs.get("src") or c.text().strip()
            if name in out:
                out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), v]
            else:
                out[name] = v
        if not scope:
            stack += c.elements()[::-1]
    return out


def microdata(root: Node) -> list[dict]:
    """Items that stand in no other item, with their nested ones."""
    out = []
    for n in root.walk():
        if "itemscope" in n.attrs:
            p = n.parent
            while p is not None and "itemscope" not in p.attrs:
                p = p.parent
            if p is None:
                out.append(_item(n))
    return out


def data_attributes(root: Node, selector: str = "*") -> list[dict[str, str]]:
    """data-* of each match that has some, names in camel case."""
    out = []
    for n in css.select(root, selector):
        own = {re.sub(r"-([a-z])", lambda m: m[1].upper(), k[5:]): v for k, v in n.attrs.items() if k.startswith("data-")}
        if own:
            out.append(own)
    return out


def scripts(root: Node, base: str | None = None) -> list[dict]:
    """Inline content or absolute source of each script."""
    out = []
    for n in root.walk():
        if n.tag == "script":
            src = n.attrs.get("src")
            out.append({"type": n.attrs.get("type") or "text/javascript", "src": absolute(base, src) if src else None, "content": None if src else n.text()})
    return out


def _cells(row: Node) -> list[str]:
    return [_SPACE.sub(" ", c.text()).strip() for c in row.elements() if c.tag in ("td", "th")]


def _rows(table: Node) -> list[Node]:
    """Rows of the table itself, not of tables in it."""
    out, stack = [], table.elements()[::-1]
    while stack:
        n = stack.pop()
        if n.tag == "tr":
            out.append(n)
        elif n.tag in ("thead", "tbody", "tfoot"):
            stack += n.elements()[::-1]
    return out


def table_rows(table: Node) -> list[dict[str, str]]:
    """Body rows keyed by the header: thead's cells, else the first row's; more cells are column_i."""
    rows = _rows(table)
    head = next((r for r in rows if r.parent.tag == "thead"), None)
    names = _cells(head) if head is not None else []
    body = [r for r in rows if r.parent.tag != "thead"]
    if not names and body:
        names, body = _cells(body[0]), body[1:]
    out = []
    for r in body:
        cells = _cells(r)
        if cells:
            out.append({(names[k] if k < len(names) and names[k] else f"column_{k + 1}"): v for k, v in enumerate(cells)})
    return out


def tables(root: Node) -> list[list[dict[str, str]]]:
    return [t for t in (table_rows(n) for n in root.walk() if n.tag == "table") if t]


def body_text(root: Node, most: int | None = None, with_scripts: bool = False) -> str:
    """The body's text, white space collapsed; scripts and styles are left out unless asked for."""
    body = next((n for n in root.walk() if n.tag == "body"), root)
    t = _SPACE.sub(" ", body.text(frozenset() if with_scripts else _HIDDEN)).strip()
    return t if most is None else t[:most]


#: What auto-extraction looks for.
ITEM_TAGS = ("div", "li", "article", "section", "tr")
IGNORED_CLASS = re.compile(r"^(js-|is-|has-|no-)")
DATA_SELECTOR = "[data-id],[data-title],[data-name],[data-price],[data-href]"
LIMIT_CONTAINERS, LIMIT_ITEMS, ITEM_TEXT, MAX_TEXT = 3, 50, 200, 2000


def _summary(n: Node) -> dict[str, str]:
    """What an item has of title, url, image and price; its text where it has none of them."""
    first = lambda s: next(iter(css.select(n, s)), None)
    out: dict[str, str] = {}
    heading, link = first("h1,h2,h3,h4,[class*=title i],[class*=name i]"), first("a[href]")
    image, price = first("img[src],img[data-src]"), first("[class*=price i]")
    if heading is not None:
        out["title"] = heading.text().strip()
    if link is not None:
        out["url"] = link.attrs["href"]
        if not out.get("title"):
            out["title"] = link.text().strip()
    if image is not None:
        out["image"] = image.attrs.get("src", image.attrs.get("data-src", ""))
    if price is not None:
        out["price"] = price.text().strip()
    return out or {"text": n.text(_HIDDEN).strip()[:ITEM_TEXT]}


def repeating(root: Node) -> tuple[str, list[dict[str, str]]] | None:
    """(class, items) of the most frequent class of containers that fills enough of them.

    Every element of the class is an item, the first LIMIT_ITEMS of them; addresses stay as they are written.
    """
    counts: Counter[str] = Counter()
    of: dict[str, list[Node]] = {}
    for n in root.walk():
        mine = dict.fromkeys(n.classes())
        for c in mine:
            of.setdefault(c, []).append(n)
        if n.tag in ITEM_TAGS:
            counts.update(c for c in n.classes() if len(c) > 2 and not IGNORED_CLASS.match(c))
    for c, k in counts.most_common(LIMIT_CONTAINERS):
        if k < 3 or len(of[c]) < 3:
            continue
        items = [x for x in map(_summary, of[c][:LIMIT_ITEMS]) if any(x.values())]
        if sum(bool(x.get("title") or x.get("text")) for x in items) >= min(3, math.ceil(len(items) / 2)):
            return c, items
    return None


def repeating_items(root: Node) -> list[dict[str, str]]:
    found = repeating(root)
    return found[1] if found else []


def _score(item: dict) -> int:
    """Scalars that aren't blank count one, arrays and objects that aren't empty two."""
    return sum((2 if v else 0) if isinstance(v, list | dict) else int(str(v).strip() != "") for v in item.values() if v is not None)


def _entities(blocks: list[Any]) -> list[dict]:
    out = []
    for b in blocks:
        if isinstance(b, dict):
            graph = b.get("@graph")
            out += [x for x in graph if isinstance(x, dict)] if isinstance(graph, list) else [b]
    return out


def auto(root: Node, max_text: int = MAX_TEXT) -> dict:
    """Title, description, best entity, items, table rows, text, and where they came from."""
    first = lambda s: next(iter(css.select(root, s)), None)
    meta = lambda s: (n.attrs["content"].strip() if (n := first(s)) is not None and "content" in n.attrs else None)
    title = first("title")
    linked, micro = _entities(json_ld(root)), microdata(root)
    item, sources = None, []
    if linked:
        item = dict(max(linked, key=lambda x: _score(x) + (3 if x.get("@type") else 0)))
        item.pop("@context", None)
        sources.append("json-ld")
    elif micro:
        item = max(micro, key=_score)
        sources.append("microdata")
    rows = [row for t in tables(root) for row in t]
    if rows:
        sources.append("tables")
    found, items = repeating(root), []
    if found:
        items = found[1]
        sources.append("repeating:." + re.sub(r"([^\w-])", r"\\\1", found[0]))
    if not items and (attrs := data_attributes(root, DATA_SELECTOR)):
        items = attrs
        sources.append("data-attributes")
    description = meta('meta[name="description"]')
    return {
        "title": (_SPACE.sub(" ", title.text()).strip() if title is not None else "") or meta('meta[property="og:title"]') or None,
        "description": description if description is not None else meta('meta[property="og:description"]'),
        "item": item,
        "items": items,
        "tables": rows,
        "sources": sources,
        "text": body_text(root, max_text),
    }


def links(root: Node, base: str | None = None, pattern: str | None = None, same_origin: bool = False) -> list[str]:
    """Absolute targets of a[href], each once in order; script, mail and phone links go."""
    from urllib.parse import urldefrag, urlsplit

    out: dict[str, None] = {}
    for n in root.walk():
        if n.tag != "a" or "href" not in n.attrs:
            continue
        raw = n.attrs["href"].strip()
        if raw.lower().startswith(("javascript:", "mailto:", "tel:")):
            continue
        u = absolute(base, raw)
        if u is None or (pattern and not re.search(pattern, u)):
            continue
        if same_origin and base and urlsplit(u)[:2] != urlsplit(base)[:2]:
            continue
        out.setdefault(urldefrag(u).url)
    return list(out)


#: What a link to the next page says.
NEXT_TEXT = re.compile(r"^(next|next\s*›?|»|›|more|load more|selanjutnya)$", re.I)
NEXT_CLASS = re.compile(r"next|pagination-next|pager-next", re.I)
PAGE_NUMBERS = ".page-numbers, .pagination a, .pagination li, .nav-links a, .pager a"


def next_link(root: Node, url: str | None) -> dict | None:
    """{url, method}: rel, then link text, then class. The URL pattern is next_page's."""
    for s in ('link[rel="next"][href]', 'a[rel="next"][href]'):
        if found := css.select(root, s):
            u = absolute(url, found[0].attrs["href"])
            return {"url": u, "method": "rel"} if u else None
    for n in root.walk():
        if n.tag == "a" and "href" in n.attrs:
            by_text = bool(NEXT_TEXT.match(n.text().strip()))
            if by_text or NEXT_CLASS.search(n.attrs.get("class", "")):
                if u := absolute(url, n.attrs["href"]):
                    return {"url": u, "method": "text" if by_text else "class"}
    return None


def total_pages(root: Node) -> int:
    """The largest number in a page widget, 1 at least."""
    return max([1, *(int(x) for n in css.select(root, PAGE_NUMBERS) for x in re.findall(r"[0-9]+", n.text()))])


def form(root: Node, selector: str = "form", base: str | None = None) -> dict | None:
    """{action, method, fields}: what submitting the first match would send by default."""
    found = css.select(root, selector)
    if not found:
        return None
    f = found[0]
    fields: dict[str, str] = {}
    for n in f.walk():
        name = n.attrs.get("name")
        if not name or n.tag not in ("input", "select", "textarea"):
            continue
        kind = n.attrs.get("type", "text").lower()
        if n.tag == "textarea":
            fields[name] = n.text()
        elif n.tag == "select":
            options = [o for o in n.walk() if o.tag == "option"]
            chosen = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
            fields[name] = "" if chosen is None else chosen.attrs.get("value", chosen.text().strip())
        elif kind in ("checkbox", "radio"):
            if "checked" in n.attrs:
                fields[name] = n.attrs.get("value", "on")
        elif kind not in ("submit", "button", "image", "reset", "file"):
            fields[name] = n.attrs.get("value", "")
    return {"action": absolute(base, f.attrs.get("action") or base or "") or f.attrs.get("action", ""), "method": f.attrs.get("method", "GET").upper(), "fields": fields}


#: Where a CSRF token may be.
CSRF_META = ("csrf-token", "csrf_token", "_csrf", "xsrf-token")
CSRF_INPUT = ("_token", "csrf_token", "_csrf", "csrfmiddlewaretoken", "authenticity_token", "__RequestVerificationToken")
CSRF_COOKIE = ("XSRF-TOKEN", "csrftoken", "_csrf")


def csrf_token(root: Node, cookies: dict[str, str] | None = None) -> dict | None:
    """{token, source} of the first hit: meta tags, hidden inputs, cookies."""
    for name in CSRF_META:
        if (found := css.select(root, f'meta[name="{name}"]')) and found[0].attrs.get("content"):
            return {"token": found[0].attrs["content"], "source": "meta"}
    for name in CSRF_INPUT:
        if (found := css.select(root, f'input[name="{name}"]')) and found[0].attrs.get("value"):
            return {"token": found[0].attrs["value"], "source": "input"}
    for name in CSRF_COOKIE:
        if (cookies or {}).get(name):
            return {"token": cookies[name], "source": "cookie"}
    return None


#: Scores of candidates for inferred fields.
HINTS = {
    "title": r"title|^h1$|^h2$|name|heading",
    "price": "price|cost|amount|harga",
    "image": "image|photo|thumbnail|avatar|^img$",
    "link": "link|url|href",
    "date": "date|time|published|created|tanggal",
    "description": "desc|summary|excerpt|content|body",
    "rating": "rating|star|score",
    "author": "author|by-?line|writer|penulis",
    "category": "categor|genre|tag|kategori",
}
PRICE_VALUE = re.compile(r"^\s*[£$€Rp]\s?[\d.,]+\s*$", re.A)
DATE_VALUE = re.compile(r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}$|^[A-Z][a-z]{2,8}\s\d{1,2},?\s\d{4}$", re.A)
NUMBER_VALUE = re.compile(r"^-?\d+([.,]\d+)?$", re.A)
LEAST_SCORE, MAX_DEPTH, MAX_CANDIDATE = 0.3, 40, 400


def selector_of(n: Node) -> str:
    """#id, else tag.firstClass, else tag."""
    if n.attrs.get("id"):
        return f"#{n.attrs['id']}"
    return f"{n.tag}.{n.classes()[0]}" if n.classes() else n.tag


def field_score(n: Node, text: str, name: str) -> float:
    s = 0.5 * bool(n.attrs.get("class") and re.search(HINTS[name], n.attrs["class"], re.I)) + 0.3 * bool(n.attrs.get("id") and re.search(HINTS[name], n.attrs["id"], re.I))
    if (name == "price" and PRICE_VALUE.match(text)) or (name == "date" and DATE_VALUE.match(text)):
        s += 0.4
    if name == "rating" and NUMBER_VALUE.match(text) and float(text.split(",")[0]) <= 5:
        s += 0.24
    if name == "title" and n.tag in ("h1", "h2", "h3"):
        s += 0.3
    if name == "image" and n.tag == "img":
        s += 0.5
    if name == "link" and n.tag == "a":
        s += 0.3
    return min(1.0, s)


def _below(root: Node) -> list[Node]:
    out, stack = [], [(c, 0) for c in root.elements()[::-1]]
    while stack:
        n, d = stack.pop()
        out.append(n)
        if d < MAX_DEPTH:
            stack += [(c, d + 1) for c in n.elements()[::-1]]
    return out


def infer_fields(root: Node, names: list[str] | None = None) -> dict[str, dict]:
    """For each field its best candidate: the first of the highest score, 0.3 at least."""
    candidates = []
    for n in _below(root):
        if n.tag in ("script", "style"):
            continue
        t = n.text().strip()
        if (t or n.attrs.get("src") or n.attrs.get("href")) and len(t) <= MAX_CANDIDATE:
            candidates.append((n, t))
    out = {}
    for name in names or list(HINTS):
        best, top = None, 0.0
        for n, t in candidates:
            s = field_score(n, t, name) if name in HINTS else 0.0
            if s > top:
                best, top = n, s
        if best is not None and top >= LEAST_SCORE:
            field: dict[str, Any] = {"selector": selector_of(best), "confidence": math.floor(top * 100 + 0.5) / 100}
            if best.tag == "img" and best.attrs.get("src"):
                field["attr"] = "src"
            if best.tag == "a" and best.attrs.get("href"):
                field["attr"] = "href"
            out[name] = field
    return out


def containers(root: Node) -> list[dict]:
    """tag.firstClass of three elements or more, most frequent first, then in document order."""
    counts = Counter(f"{n.tag}.{n.classes()[0]}" for n in _below(root) if n.classes())
    return [{"selector": s, "count": k} for s, k in sorted(counts.items(), key=lambda x: -x[1]) if k >= 3]


def infer_schema(root: Node, names: list[str] | None = None, as_list: bool = True) -> dict:
    """{type: list, container, item_count, schema} where something repeats, else {type: single, schema}."""
    found = containers(root)
    if found and as_list:
        first = css.select(root, found[0]["selector"])[0]
        return {"type": "list", "container": found[0]["selector"], "item_count": found[0]["count"], "schema": infer_fields(first, names)}
    return {"type": "single", "schema": infer_fields(root, names)}


def page_udf(kind: str, f: Callable[[Node, str | None], Any]):
    """A function of (page, its URL) as a vectorised UDF; each page is parsed once, a null page counts as empty."""

    @vectorized(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, url in batches:
            yield pd.Series([f(parse(h), u) for h, u in zip(html, url, strict=True)], dtype=object)

    return run


links_of = page_udf("array<string>", lambda r, u: links(r, u))
scripts_of = page_udf("array<struct<type:string,src:string,content:string>>", lambda r, u: scripts(r, u))
json_ld_of = page_udf("array<string>", lambda r, u: [dumps(x) for x in json_ld(r)])
microdata_of = page_udf("array<string>", lambda r, u: [dumps(x) for x in microdata(r)])
data_attributes_of = page_udf("array<map<string,string>>", lambda r, u: data_attributes(r))
tables_of = page_udf("array<array<map<string,string>>>", lambda r, u: tables(r))
auto_of = page_udf("string", lambda r, u: dumps(auto(r)))
infer_of = page_udf("string", lambda r, u: dumps(infer_schema(r)))
text_of = page_udf("string", lambda r, u: body_text(r))
form_of = page_udf("string", lambda r, u: None if (f := form(r, base=u)) is None else dumps(f))
csrf_of = page_udf("string", lambda r, u: (csrf_token(r) or {}).get("token"))
total_pages_of = page_udf("int", lambda r, u: total_pages(r))
next_link_of = page_udf("string", lambda r, u: None if (x := next_link(r, u)) is None else dumps(x))
