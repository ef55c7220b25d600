"""Trees, selectors, extraction and what pages tell by themselves."""

import json

import pytest

from webloom.html import css, extract, structured
from webloom.html.tree import parse, parse_xml

BOATS = '<section class="berth" data-slip="N4"><em class="hull">Grey Heron</em></section><section class="berth" data-slip="S9"><em class="hull">Tern</em></section>'


def texts(page, selector):
    return [n.text() for n in css.select(parse(page), selector)]


@pytest.mark.parametrize(
    ("page", "selector", "want"),
    [
        ("<ul><li>a<li id=q>b<li>c</ul>", "ul > li", ["a", "b", "c"]),
        ("<ul><li>a<li>b<li>c</ul>", "li:nth-child(2n+1)", ["a", "c"]),
        ("<ul><li>a<li>b<li>c</ul>", "li:gt(0)", ["b", "c"]),
        ("<p>a<p class='x y'>b", "p.y", ["b"]),
        ("<p>a<p class='Big'>b", '[class*="big" i]', ["b"]),
        ("<p>a<p class='Big'>b", '[class*="big"]', []),
        ("<p>a<p class=x>b", "p:not(.x)", ["a"]),
        ("<b>x</b><i>y</i><u>z</u>", "b + i, u", ["y", "z"]),
        ("<b>x</b><i>y</i><u>z</u>", "b ~ u", ["z"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "table > tbody > tr", ["12", "3"]),
        ("<script>var a = '</p>';</script><p>x", "p", ["x"]),
    ],
)
def test_selectors(page, selector, want):
    assert texts(page, selector) == want


@pytest.mark.parametrize("bad", ["", "p >", "p[", "p:nope", "p:not("])
def test_bad_selectors(bad):
    with pytest.raises(css.SelectorError):
        css.compile_selector(bad)


def one(page, schema, strict=True):
    return extract.extract_one(parse(page), {k: extract.FieldSpec.of(v) for k, v in schema.items()}, strict)


def test_fields():
    data, health, _ = one(BOATS, {"hulls": [".hull"], "slips": {"selector": ".berth", "attr": "data-slip", "multiple": True}, "nearest": ".hull", "markup": {"selector": ".berth", "type": "html"}})
    assert data["hulls"] == ["Grey Heron", "Tern"]
    assert data["slips"] == ["N4", "S9"]
    assert data["nearest"] == "Grey Heron"
    assert data["markup"] == '<em class="hull">Grey Heron</em>'
    assert health[0] == {"field": "hulls", "selector": ".hull", "tried": [".hull"], "empty": False, "count": 2, "pattern_mismatch": None}


def test_later_selector_default_pattern_transform():
    page = "<dl><dt>Draught<dd class=metres> 1,8 M </dl>"
    data, health, _ = one(page, {"draught": {"selector": [".feet", ".metres"], "pattern": r"^\d+$"}, "beam": {"selector": ".beam", "default": "unknown"}, "shout": {"selector": ".metres", "transform": str.lower}})
    assert data == {"draught": "1,8 M", "beam": "unknown", "shout": "1,8 m"}
    assert health[0]["tried"] == [".feet", ".metres"] and health[0]["pattern_mismatch"]


def test_required():
    with pytest.raises(extract.ExtractionError, match=r"\.a, \.b"):
        one("<p>", {"x": {"selector": [".a", ".b"], "required": True}})
    assert len(one("<p>", {"x": {"selector": ".a", "required": True}}, strict=False)[2]) == 1


def test_structured():
    page = parse(
        """<script type="application/ld+json">[{"@type":"Event","location":{"berths":7}}]</script><script type="application/ld+json">[1,</script>
        <p itemscope itemtype="https://schema.org/Vessel"><b itemprop=callSign>QX7</b><i itemprop=homePort>Marstal</i></p><hr data-tide-metres="0.4" data-lit="no">"""
    )
    assert structured.json_ld(page) == [{"@type": "Event", "location": {"berths": 7}}]
    assert structured.microdata(page) == [{"@type": "Vessel", "callSign": "QX7", "homePort": "Marstal"}]
    assert {"tideMetres": "0.4", "lit": "no"} in structured.data_attributes(page)


def test_tables():
    assert structured.tables(parse("<table><tr><th>a<th>b<tr><td>1<td>2<td>3</table>")) == [[{"a": "1", "b": "2", "column_3": "3"}]]


def test_links():
    page = parse('<a href="/a#x">1</a><a href="/a">2</a><a href="javascript:x">3</a><a href="http://o.example/b">4</a>')
    assert structured.links(page, "http://h.example/") == ["http://h.example/a", "http://o.example/b"]
    assert structured.links(page, "http://h.example/", same_origin=True) == ["http://h.example/a"]


@pytest.mark.parametrize(
    ("page", "want"),
    [('<link rel="next" href="/p2">', ("rel", "http://h.example/p2")), ("<a href=/n>Next</a>", ("text", "http://h.example/n")), ("<a class=pager-next href=/n>go</a>", ("class", "http://h.example/n"))],
)
def test_next_link(page, want):
    got = structured.next_link(parse(page), "http://h.example/")
    assert (got["method"], got["url"]) == want


def test_total_pages():
    assert structured.total_pages(parse("<div class=pagination><a>1</a><a>3</a></div>")) == 3
    assert structured.total_pages(parse("<p>9")) == 1


def test_form_and_token():
    page = parse("<form action=/go method=post><input name=a value=1><input type=checkbox name=b checked><input type=radio name=c value=x><select name=s><option>p<option selected>q</select><input type=hidden name=_csrf value=t></form>")
    assert structured.form(page, base="http://h.example/") == {"action": "http://h.example/go", "method": "POST", "fields": {"a": "1", "b": "on", "s": "q", "_csrf": "t"}}
    assert structured.csrf_token(page) == {"token": "t", "source": "input"}


def test_inference():
    berth = '<div class="berth"><h2 class="ship">x</h2><span class="price">$30</span></div>'
    got = structured.infer_schema(parse(berth * 3))
    assert (got["type"], got["container"], got["item_count"]) == ("list", "div.berth", 3)
    assert got["schema"]["title"]["selector"] == "h2.ship" and got["schema"]["price"]["selector"] == "span.price"
    single = structured.infer_schema(parse("<h1 class=log-title>a</h1><span class=log-date>2024-01-02</span>"))
    assert single["type"] == "single" and "title" in single["schema"]


def test_auto():
    ships = "".join(f"<div class='ship is-moored'><h3>Hull {k}</h3><a href='/s/{k}'>log</a><b class=priceTag>{k} kr</b></div>" for k in range(4))
    got = structured.auto(parse(f"<title> Quay </title><meta name=description content=' all ships '>{ships}<table><tr><th>depth<tr><td>3 m<tr><td>4 m</table>"))
    assert (got["title"], got["description"]) == ("Quay", "all ships")
    assert got["items"][2] == {"title": "Hull 2", "url": "/s/2", "price": "2 kr"} and len(got["items"]) == 4
    assert got["tables"] == [{"depth": "3 m"}, {"depth": "4 m"}] and got["sources"] == ["tables", "repeating:.ship"]


@pytest.mark.parametrize(
    ("item", "want"),
    [
        ("<li class=entry><h3>Low tide</h3>", {"title": "Low tide"}),
        ("<li class=entry><img data-src=/late.png>at noon", None),
        ("<li class=entry>" + "w" * 300, {"text": "w" * 200}),
        ("<li class=entry><h3> </h3><a href=/x>Chart</a>", {"title": "Chart", "url": "/x"}),
        ("<li class=entry>", None),
    ],
)
def test_repeating_items(item, want):
    """A heading is enough; text stands in for all else; an item without title and text doesn't fill a list."""
    assert structured.repeating_items(parse(f"<ul>{item * 4}</ul>")) == ([want] * 4 if want else [])


def test_item_scores():
    entities = [{"@type": "Thing"}, {"a": 1, "b": False, "c": "x", "d": " ", "e": None}, {"a": [], "b": {}, "c": [1]}]
    assert [structured._score(e) for e in entities] == [1, 3, 2]


def test_xml_is_lenient():
    assert [n.text() for n in css.select(parse_xml("<a><b>1</b></x><b><![CDATA[<2>]]></b></a>"), "b")] == ["1", "<2>"]


def test_null_page(spark):
    df = spark.createDataFrame([(1, None), (2, "<h1>x</h1>")], "url int, html string")
    rows = {r.url: r.t for r in extract.extract_rows(df, {"t": "h1"}).collect()}
    assert rows == {1: None, 2: "x"}
    with pytest.raises(Exception, match="not found"):
        extract.extract_rows(df, {"t": {"selector": "h1", "required": True}}, on_error="raise").collect()


def test_json_dumps_keeps_unicode():
    assert structured.dumps({"é": 1}) == json.dumps({"é": 1}, ensure_ascii=False, separators=(",", ":"))
