"""Texts in known formats: CSV, feeds, JSON lines, sitemaps, robots.txt, cookie files, API pages, stored values."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import headers as H
from webloom.functions import url as U
from webloom.functions.udf import vectorized
from webloom.html import css
from webloom.html.tree import Node, parse_xml
from webloom.session import checkpointed


def csv_rows(text: str) -> list[dict[str, str]]:
    """Rows of CSV text, all strings.

    Quoted fields may hold commas, line feeds and doubled quotes; empty lines go; short rows are filled,
    long ones cut; of equal header names the last counts.
    """
    rows: list[list[str]] = []
    row: list[str] = []
    cell, quoted, touched, k = "", False, False, 0
    while k < len(text):
        c = text[k]
        if quoted:
            if c == '"' and text[k + 1 : k + 2] == '"':
                cell += '"'
                k += 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"':
            quoted = touched = True
        elif c == ",":
            row.append(cell)
            cell, touched = "", True
        elif c in "\r\n":
            if c == "\r" and text[k + 1 : k + 2] == "\n":
                k += 1
            if touched or cell:
                rows.append([*row, cell])
            row, cell, touched = [], "", False
        else:
            cell += c
            touched = True
        k += 1
    if touched or cell:
        rows.append([*row, cell])
    if not rows:
        return []
    head = rows[0]
    return [{h: (r[i] if i < len(r) else "") for i, h in enumerate(head)} for r in rows[1:]]


@vectorized("array<map<string,string>>")
def parse_csv(text: pd.Series) -> pd.Series:
    """Each text's rows as maps."""
    return pd.Series([None if t is None else csv_rows(t) for t in text], dtype=object)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files by the same rules."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def _child(n: Node, *names: str) -> Node | None:
    return next((c for c in n.elements() if c.tag in names), None)


def _said(n: Node, *names: str) -> str | None:
    for name in names:
        if (c := _child(n, name)) is not None:
            return c.text().strip()
    return None


def feed(xml: str | None) -> dict:
    """An RSS or Atom feed; anything else is of type unknown without items."""
    root = parse_xml(xml)
    if channel := css.select(root, "channel"):
        items = css.select(root, "item")
        out = [{"title": _said(i, "title"), "link": _said(i, "link"), "published": _said(i, "pubDate", "dc:date"), "body": _said(i, "description"), "id": _said(i, "guid") or _said(i, "link")} for i in items]
        return {"type": "rss", "title": _said(channel[0], "title"), "items": out}
    if found := css.select(root, "feed"):
        out = []
        for e in css.select(found[0], "entry"):
            links = [c for c in e.elements() if c.tag == "link"]
            link = next((x for x in links if x.attrs.get("rel", "alternate") == "alternate"), links[0] if links else None)
            href = None if link is None else link.attrs.get("href") or link.text().strip()
            out.append({"title": _said(e, "title"), "link": href, "published": _said(e, "published", "updated"), "body": _said(e, "summary", "content"), "id": _said(e, "id")})
        return {"type": "atom", "title": _said(found[0], "title"), "items": out}
    return {"type": "unknown", "title": None, "items": []}


@vectorized("type string, title string, items array<struct<title:string,link:string,published:string,body:string,id:string>>")
def parse_feed(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([feed(x) for x in xml], columns=["type", "title", "items"])


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON value in each line that isn't blank; a bad line fails the read and is named in the error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def parse_jsonl(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, value) of JSON-lines text, value as JSON text; a bad line raises with its number."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("k", "value")).withColumn("line", F.col("k") + 1).filter(F.trim("value") != "")
    checked = F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("invalid JSON in line "), F.col("line").cast("string"))).cast("string"))
    return lines.select(key, "line", checked.alias("value"))


def sitemap(xml: Column | str) -> Column:
    """struct(is_index, locs) of a sitemap."""
    c = F.col(xml) if isinstance(xml, str) else xml
    locs = F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<loc[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>"), F.lit(1)), lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")))
    return F.struct(c.rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"), locs.alias("locs"))


def expand_sitemaps(maps: DataFrame, roots: list[str], max_depth: int = 1, max_entries: int | None = 5000, pattern: str | None = None) -> DataFrame:
    """(loc): locations of maps(url, xml) under the roots, each once, in the order of depth and place.

    Index files are followed max_depth levels down; at most max_entries locations that match the pattern, None for all.
    """
    parsed = maps.select("url", sitemap("xml").alias("m")).select("url", "m.is_index", F.posexplode("m.locs").alias("pos", "loc"))
    now = maps.sparkSession.createDataFrame([(u, f"{k:09d}") for k, u in enumerate(dict.fromkeys(roots))], "url string, place string")
    out = None
    for depth in range(max_depth + 1):
        found = checkpointed(parsed.join(now, "url").select("is_index", "loc", F.concat_ws(".", "place", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("place")))
        leaves = found.filter(~F.col("is_index")).select("loc", "place")
        out = leaves if out is None else out.unionAll(leaves)
        if depth < max_depth:
            now = found.filter("is_index").select(F.col("loc").alias("url"), "place")
            if now.isEmpty():
                break
    if pattern:
        out = out.filter(F.col("loc").rlike(pattern))
    out = out.groupBy("loc").agg(F.min("place").alias("place")).orderBy("place")
    return (out if max_entries is None else out.limit(max_entries)).select("loc")


def robots_rules(texts: DataFrame, host: str = "host", text: str = "robots") -> DataFrame:
    """(host, group_id, agent, type, pattern, regex, crawl_delay_ms) of robots.txt texts.

    Agents in a row share a group until a rule comes; an empty Disallow is no rule; an agent without rules has
    one row with a null pattern. The delay is in milliseconds.
    """
    lines = texts.select(F.col(host).alias("host"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("n", "raw"))
    lines = lines.select("host", "n", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("line")).filter(F.col("line").contains(":"))
    lines = lines.select("host", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_extract("line", ":(.*)$", 1)).alias("value"))
    lines = lines.filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("host").orderBy("n")
    first = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    lines = lines.withColumn("group_id", F.sum(first.cast("int")).over(w)).filter("group_id > 0")
    agents = lines.filter("field = 'user-agent'").select("host", "group_id", F.col("n").alias("agent_at"), F.lower("value").alias("agent"))
    delays = lines.filter("field = 'crawl-delay'").groupBy("host", "group_id").agg((F.max_by(F.col("value").try_cast("double"), "n") * 1000).alias("crawl_delay_ms"))
    rules = lines.filter("field in ('allow', 'disallow') and value <> ''").select("host", "group_id", F.col("n").alias("rule_at"), F.col("field").alias("type"), F.col("value").alias("pattern"))
    return agents.join(rules, ["host", "group_id"], "left").join(delays, ["host", "group_id"], "left").select("host", "group_id", "agent_at", "agent", "rule_at", "type", "pattern", robots_regex(F.col("pattern")).alias("regex"), "crawl_delay_ms")


def robots_regex(pattern: Column) -> Column:
    """* is any text, $ at the end anchors, the start is always anchored."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^{}()|\[\]\\$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """urls with allowed, rule and crawl_delay_ms for an agent.

    A group whose agent name is in the agent's goes before *, the first of several counts. Of the rules that
    match path and query the longest counts, allow before disallow; without one the URL is allowed.
    """
    name = agent.lower()
    named = (F.col("agent") != "*") & F.lit(name).contains(F.col("agent"))
    groups = rules.filter(named | (F.col("agent") == "*")).select("host", "group_id", F.when(named, 0).otherwise(1).alias("rank"), "agent_at").groupBy("host").agg(F.min_by("group_id", F.struct("rank", "agent_at")).alias("group_id"))
    mine = rules.join(groups, ["host", "group_id"]).select("host", "group_id", "type", "pattern", "regex", "crawl_delay_ms").distinct()
    delays = mine.groupBy("host").agg(F.max("crawl_delay_ms").alias("crawl_delay_ms"))
    each = urls.select(F.col(url).alias("_url")).distinct().select("_url", U.authority("_url").alias("host"), F.concat(U.path("_url"), F.when(U.query("_url") == "", "").otherwise(F.concat(F.lit("?"), U.query("_url")))).alias("_target"))
    hits = each.join(mine.filter("pattern is not null"), "host").filter(F.expr("_target rlike regex"))
    best = hits.groupBy("_url").agg(F.max_by(F.struct("type", "pattern"), F.struct(F.length("pattern"), F.when(F.col("type") == "allow", 1).otherwise(0))).alias("rule"))
    told = each.join(best, "_url", "left").join(delays, "host", "left").select("_url", F.coalesce(F.col("rule.type") == "allow", F.lit(True)).alias("allowed"), F.col("rule.pattern").alias("rule"), "crawl_delay_ms")
    return urls.join(told, F.col(url) == F.col("_url"), "left").drop("_url")


def robots_sitemaps(texts: DataFrame, host: str = "host", text: str = "robots") -> DataFrame:
    """(host, sitemap) of the Sitemap: lines."""
    found = F.transform(F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: s.rlike(r"(?i)^\s*sitemap\s*:")), lambda s: F.trim(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)))
    return texts.select(F.col(host).alias("host"), F.explode(found).alias("sitemap"))


def netscape_cookies(lines: DataFrame, line: str = "line", now_ms: int = 0) -> DataFrame:
    """Cookies of Netscape lines (tabs, #HttpOnly_), or Set-Cookie values where a line has no tabs."""
    c = F.col(line)
    http_only = c.startswith("#HttpOnly_")
    body = F.regexp_replace(c, "^#HttpOnly_", "")
    p = F.split(body, "\t")
    tsv = F.struct(
        p[5].alias("name"), F.array_join(F.slice(p, 7, F.greatest(F.size(p), F.lit(1))), "\t").alias("value"), F.regexp_replace(p[0], r"^\.", "").alias("domain"), p[2].alias("path"),
        H.to_expiry(p[4]).alias("expires"), (F.upper(p[3]) == "TRUE").alias("secure"), http_only.alias("http_only"),
    )
    usable = lines.filter((F.trim(c) != "") & (http_only | ~c.startswith("#")))
    return usable.select(F.when(F.size(p) >= 7, tsv).otherwise(H.set_cookie(c, F.lit(now_ms).cast("bigint"))).alias("c")).filter("c is not null").select("c.*")


def json_cookies(texts: DataFrame, text: str = "json") -> DataFrame:
    """Cookies of a JSON array, or of an object's cookies."""
    item = "array<struct<name:string,value:string,domain:string,path:string,expirationDate:string,expires:string,expiry:string,secure:boolean,httpOnly:boolean>>"
    c = F.col(text)
    array = F.when(F.ltrim(c).startswith("["), F.from_json(c, item)).otherwise(F.from_json(F.get_json_object(c, "$.cookies"), item))
    return texts.select(F.explode(array).alias("c")).select(
        "c.name", "c.value", F.regexp_replace("c.domain", r"^\.", "").alias("domain"), F.coalesce("c.path", F.lit("/")).alias("path"), H.to_expiry(F.coalesce("c.expirationDate", "c.expires", "c.expiry")).alias("expires"),
        F.coalesce("c.secure", F.lit(False)).alias("secure"), F.coalesce("c.httpOnly", F.lit(False)).alias("http_only"),
    )


def live_cookies(cookies: DataFrame, now_ms: Column, domains: list[str] | None = None) -> DataFrame:
    """Cookies that have not expired, of the allowed domains and what is below them. (F16, Q39)"""
    out = cookies.filter(F.col("expires").isNull() | (F.col("expires") >= now_ms))
    if domains is not None:
        d = F.lower("domain")
        hit = F.lit(False)
        for x in domains:
            hit |= (d == x.lower()) | d.endswith("." + x.lower())
        out = out.filter(hit)
    return out


def rest_pages(pages: DataFrame, max_pages: int | None = 20) -> DataFrame:
    """(endpoint, page, pos, item) of stored pages(endpoint, page, total_pages, body): JSON arrays joined up.

    An endpoint's first page tells how many there are; at most max_pages count, all of them where it is None.
    """
    total = pages.filter("page = 1").groupBy("endpoint").agg(F.max(F.coalesce("total_pages", F.lit(1))).alias("_total"))
    use = pages.join(total, "endpoint").filter(F.col("page") <= F.least("_total", F.lit(max_pages)))  # least() passes over null
    return use.select("endpoint", "page", F.posexplode(F.from_json("body", "array<string>")).alias("pos", "item"))


def graphql_nodes(pages: DataFrame, connection: str, max_pages: int | None = 20, key: str | None = None) -> DataFrame:
    """([key, ]page_no, pos, node) along the cursors of stored pages([key, ]cursor, body).

    The first page's cursor is null. Cursors are followed within a `key`, the connection that they belong to;
    without one all pages are of one connection. At most max_pages pages of each; None for all.
    """
    from webloom.operators.flow import chained

    path = "$.data." + connection
    of = F.col(key).cast("string") if key else F.lit("")
    node = lambda cursor: F.to_json(F.array(of, cursor))
    info = lambda name: F.get_json_object("body", f"{path}.pageInfo.{name}")
    # bodies stay behind while cursors are followed
    links = pages.select(node(F.coalesce("cursor", F.lit(""))).alias("node"), F.when(info("hasNextPage") == "true", node(info("endCursor"))).alias("next"))
    starts = pages.filter("coalesce(cursor, '') = ''").select(node(F.lit("")).alias("start"), node(F.lit("")).alias("node"))
    found = chained(links, starts, max_pages).select("node", (F.col("step") + 1).cast("int").alias("page_no"))
    met = pages.withColumn("_node", node(F.coalesce("cursor", F.lit("")))).join(found, F.col("_node") == F.col("node"))
    edges = F.from_json(F.get_json_object("body", f"{path}.edges"), "array<string>")
    return met.select(*([key] if key else []), "page_no", F.posexplode(F.transform(edges, lambda e: F.get_json_object(e, "$.node"))).alias("pos", "node"))


def graphql_catalog(texts: DataFrame, text: str = "json") -> DataFrame:
    """(type, kind, field, field_type) of introspection results; a wrapped type has its inner name, else its kind."""
    inner = "struct<name:string,kind:string,ofType:struct<name:string,kind:string>>"
    types = F.from_json(F.coalesce(F.get_json_object(text, "$.data.__schema.types"), F.get_json_object(text, "$.__schema.types")), f"array<struct<name:string,kind:string,fields:array<struct<name:string,type:{inner}>>>>")
    t = texts.select(F.explode(types).alias("t")).filter("t.fields is not null and size(t.fields) > 0")
    return t.select(F.col("t.name").alias("type"), F.col("t.kind").alias("kind"), F.explode("t.fields").alias("f")).select("type", "kind", F.col("f.name").alias("field"), F.coalesce("f.type.name", "f.type.ofType.name", "f.type.kind").alias("field_type"))


#: Where a page keeps a nonce.
NONCE = (r'"nonce"\s*:\s*"([A-Za-z0-9]+)"', r"wpApiSettings\s*=\s*\{[^}]*[\"']nonce[\"']\s*:\s*[\"']([A-Za-z0-9]+)[\"']", r"name=[\"']_wpnonce[\"']\s+value=[\"']([A-Za-z0-9]+)[\"']")


def wp_nonce(html: Column | str) -> Column:
    """The first nonce that a pattern finds, else null."""
    c = F.col(html) if isinstance(html, str) else html
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in NONCE))


def kv_latest(history: DataFrame, key: str = "key", ts: str = "ts", data: str = "data") -> DataFrame:
    """The last write of each key; a last write of null is a deletion."""
    return history.groupBy(key).agg(F.max(ts).alias(ts), F.max_by(F.struct(data), F.struct(ts, data))[data].alias(data)).filter(F.col(data).isNotNull())


def kv_get(history: DataFrame, name: str, key: str = "key") -> DataFrame:
    """One key's snapshot; the filter reaches the scan."""
    return kv_latest(history.filter(F.col(key) == name), key)


