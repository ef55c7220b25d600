"""Analytics over captured entries: endpoints, summaries, observability, exports and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import headers as H
from webloom.functions import url as U
from webloom.functions.encoding import truncate
from webloom.jsonx import schema as S
from webloom.session import checkpointed

MAX_SAMPLE, SAMPLES = 4000, 3


def endpoints(entries: DataFrame, include_static: bool = False, with_schema: bool = False, with_sample: bool = False, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Entries grouped by method and URL template.

    count, statuses, params, mime_types, sources and resource_types as sorted arrays, average_time rounded
    half up, the first three ids, and on request the merged schema and the first body.
    """
    api = H.is_api(F.col("resource_type"), F.col("mime_type"), F.col("method"))
    e = (entries if include_static else entries.filter(api)).withColumn("template", U.template("url"))
    k = ["method", "template"]
    distinct = lambda c: F.array_sort(F.collect_set(c))
    # one row for each different combination: all histograms and sets are made of these few
    mime = F.nullif(F.trim(F.substring_index("mime_type", ";", 1)), F.lit(""))
    base = e.groupBy(*k, F.col("status").cast("string").alias("status"), mime.alias("mime"), "source", "resource_type", F.array_sort(F.array_distinct(U.query_params("url"))).alias("names")).agg(
        F.count("*").alias("n"), F.sum("time").alias("time"), F.min(F.struct(F.col("ordinal").alias("o"), U.authority("url").alias("h"))).alias("first")
    )
    base = checkpointed(base)
    # the first ids: a bounded ordered list by partial aggregation of minima is not built in, so by rank
    w = Window.partitionBy(*k).orderBy("ordinal")
    firsts = e.select(*k, "id", "ordinal").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= SAMPLES).groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias("sample_ids"))
    g = base.groupBy(*k).agg(
        F.sum("n").alias("count"),
        F.min("first")["h"].alias("host"),
        distinct("mime").alias("mime_types"),
        distinct("source").alias("sources"),
        distinct("resource_type").alias("resource_types"),
        F.floor(F.sum("time") / F.sum("n") + 0.5).cast("bigint").alias("average_time"),
        F.max(F.col("resource_type") != "document").alias("api"),
    )
    statuses = base.groupBy(*k, F.col("status").alias("_v")).agg(F.sum("n").alias("_n")).groupBy(*k).agg(F.array_sort(F.collect_list(F.struct(F.col("_v").alias("value"), F.col("_n").alias("n")))).alias("statuses"))
    params = base.select(*k, F.explode("names").alias("_p")).groupBy(*k).agg(distinct("_p").alias("params"))
    out = g.join(statuses, k).join(firsts, k).join(params, k, "left")
    out = out.withColumn("params", F.coalesce("params", F.array().cast("array<string>"))).withColumn("path", F.regexp_replace("template", "(?i)^[a-z]+://[^/]+", ""))
    if with_schema:
        bodies = e.filter("response_body is not null and response_body <> ''")
        out = out.join(S.merged_schemas(bodies, k, "response_body", "ordinal"), k, "left")
    if with_sample:
        first = e.filter("response_body is not null and response_body <> ''").groupBy(*k).agg(F.min_by("response_body", "ordinal").alias("_body"))
        out = out.join(first, k, "left").withColumn("sample", F.when(F.col("_body").isNotNull(), truncate("_body", max_sample))).drop("_body")
    return out.orderBy(F.desc("count"), "template", "method")


def schemas(entries: DataFrame) -> DataFrame:
    """(endpoint, schema): 'METHOD template' to the merged schema of its bodies. (A3)"""
    e = entries.filter(H.is_api(F.col("resource_type"), F.col("mime_type"), F.col("method")) & (F.col("response_body") != ""))
    e = e.withColumn("endpoint", F.concat_ws(" ", "method", U.template("url")))
    return S.merged_schemas(e, ["endpoint"], "response_body", "ordinal")


def summary(entries: DataFrame) -> DataFrame:
    """(facet, value, n): counts by resource type, status and source, the total, failures, cut bodies. (A2)"""
    facets = {"resource_type": F.col("resource_type"), "status": F.col("status").cast("string"), "source": F.col("source"), "total": F.lit("all"), "failed": F.when(F.col("failed"), "all"), "truncated": F.when(F.col("truncated"), "all") if "truncated" in entries.columns else F.lit(None).cast("string")}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in facets.items()))).alias("p")
    return entries.select(pairs).select("p.*").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def report(entries: DataFrame, source: str, meta: dict | None = None) -> DataFrame:
    """One JSON document: source, meta, summary and endpoints."""
    import json

    s = summary(entries).agg(F.to_json(F.array_sort(F.collect_list(F.struct("facet", "value", "n")))).alias("summary"))
    e = endpoints(entries).agg(F.to_json(F.array_sort(F.collect_list(F.struct("method", "template", "count", "average_time")))).alias("endpoints"))
    joined = s.join(F.broadcast(e))  # one row each
    return joined.select(F.concat(F.lit(f'{{"source":{json.dumps(source)},"meta":{json.dumps(meta or {})},"summary":'), "summary", F.lit(',"endpoints":'), F.coalesce("endpoints", F.lit("[]")), F.lit("}")).alias("document"))


def har_export(entries: DataFrame, redact: bool = True) -> DataFrame:
    """(ordinal, entry): each entry as the JSON text of a HAR 1.2 entry."""
    head = lambda c: F.transform(F.array_sort(F.map_entries(H.redact(c) if redact else F.col(c))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    query = F.transform(F.array_sort(F.map_entries(U.query_map("url"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    request = F.struct(
        "method", "url", F.col("http_version").alias("httpVersion"), head("request_headers").alias("headers"), query.alias("queryString"),
        F.when(F.col("request_body").isNotNull(), F.struct(F.coalesce(F.col("request_headers")["content-type"], F.lit("")).alias("mimeType"), F.col("request_body").alias("text"))).alias("postData"), F.lit(-1).alias("headersSize"), F.col("request_size").alias("bodySize"),
    )
    response = F.struct(
        "status", F.col("status_text").alias("statusText"), F.col("http_version").alias("httpVersion"), head("response_headers").alias("headers"),
        F.struct(F.col("response_size").alias("size"), F.col("mime_type").alias("mimeType"), F.col("response_body").alias("text")).alias("content"), F.coalesce("redirect_url", F.lit("")).alias("redirectURL"), F.lit(-1).alias("headersSize"), F.col("response_size").alias("bodySize"),
    )
    entry = F.struct(F.col("started").alias("startedDateTime"), "time", request.alias("request"), response.alias("response"), F.col("resource_type").alias("_resourceType"), F.col("error_text").alias("_error"))
    return entries.select("ordinal", F.to_json(entry).alias("entry"))


def har_document(entries: DataFrame, redact: bool = True, creator: str = "webloom") -> DataFrame:
    """One HAR document of a capture. A single document is gathered in one row: for captures of a size that one may be read in."""
    rows = har_export(entries, redact).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "entry"))), lambda x: x["entry"]), ",").alias("e"))
    return rows.select(F.concat(F.lit(f'{{"log":{{"version":"1.2","creator":{{"name":"{creator}","version":"1.0"}},"entries":['), "e", F.lit("]}}")).alias("har"))


def _quote(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("'\\''"))


def to_curl(redact: bool = True) -> Column:
    """An entry as a curl command."""
    heads = F.transform(F.array_sort(F.map_entries(H.safe("request_headers", redact))), lambda e: F.concat(F.lit("  -H '"), e["key"], F.lit(": "), _quote(e["value"]), F.lit("'")))
    first = F.concat(F.lit("curl -X "), "method", F.lit(" '"), _quote(F.col("url")), F.lit("'"))
    body = F.when(F.col("request_body") != "", F.array(F.concat(F.lit("  --data-raw '"), _quote(F.col("request_body")), F.lit("'")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(first), heads, body), " \\\n")


def _js(c: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def to_fetch(redact: bool = True) -> Column:
    """An entry as a script that fetches it again."""
    heads = F.transform(F.array_sort(F.map_entries(H.safe("request_headers", redact))), lambda e: F.concat(F.lit("    "), _js(e["key"]), F.lit(": "), _js(e["value"]), F.lit(",")))
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.concat(F.lit("const response = await fetch("), _js(F.col("url")), F.lit(", {")), F.concat(F.lit("  method: "), _js(F.col("method")), F.lit(","))),
        F.when(F.size(heads) > 0, F.concat(F.array(F.lit("  headers: {")), heads, F.array(F.lit("  },")))).otherwise(none),
        F.when(F.col("request_body") != "", F.array(F.concat(F.lit("  body: "), _js(F.col("request_body")), F.lit(",")))).otherwise(none),
        F.array(F.lit("});"), F.concat(F.lit("const data = await response."), F.when(H.is_json_mime("mime_type"), "json").otherwise("text"), F.lit("();"))),
    )
    return F.array_join(lines, "\n")


def endpoint_script() -> Column:
    """An endpoint (a row of endpoints()) as a runnable script: its template's ids and its params become arguments."""
    args = F.array_join(F.concat(F.transform(F.filter(F.split("template", "/"), lambda s: s == ":id"), lambda s, i: F.concat(F.lit("id"), (i + 1).cast("string"))), "params"), ", ")
    return F.concat(F.lit("async function call("), args, F.lit(") {\n  // "), "method", F.lit(" "), "template", F.lit("\n}\n"))


#: Categories of errors.
CATEGORIES = ("timeout", "network", "security", "circuit", "validation", "http5xx", "http4xx", "other")


def error_category(code: Column, name: Column, status: Column) -> Column:
    """(A5)"""
    return (
        F.when(code == "TIMEOUT", "timeout").when(code == "NETWORK_ERROR", "network").when(code == "SECURITY_BLOCKED", "security").when(code == "CIRCUIT_OPEN", "circuit").when(name == "ValidationError", "validation").when(status >= 500, "http5xx").when(status >= 400, "http4xx").otherwise("other")
    )


def observability(outcomes: DataFrame, elapsed_sec: float | None = None) -> DataFrame:
    """(domain, requests, success, failed, success_rate[, rps]) of outcomes(url, ok), for each domain and for '*'. (A4, Q37)"""
    o = outcomes.select(U.domain("url").alias("domain"), F.col("ok"))
    each = o.groupBy("domain").agg(F.count("*").alias("requests"), F.count_if("ok").alias("success"))
    whole = each.agg(F.lit("*").alias("domain"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("success"), F.lit(0)).alias("success"))
    out = each.unionByName(whole).withColumn("failed", F.col("requests") - F.col("success"))
    out = out.withColumn("success_rate", F.when(F.col("requests") > 0, F.floor(F.col("success") / F.col("requests") * 1000 + 0.5) / 10).otherwise(0.0))
    if elapsed_sec is not None:
        out = out.withColumn("rps", F.floor(F.col("requests") / F.lit(float(max(1, elapsed_sec))) * 100 + 0.5) / 100)
    return out


def errors(outcomes: DataFrame) -> DataFrame:
    """(code, category, n) of failed outcomes(ok, code, name, status), most frequent first. (A4, A5, T5)"""
    bad = outcomes.filter(~F.col("ok"))
    return bad.select(F.coalesce("code", F.col("status").cast("string"), F.lit("UNKNOWN")).alias("code"), error_category(F.col("code"), F.col("name"), F.col("status")).alias("category")).groupBy("code", "category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code", "category")


def totals(outcomes: DataFrame, elapsed_sec: float) -> DataFrame:
    """One row: total, success, failed, success_rate, rps, sent, received and errors by category. (A4)

    outcomes(ok, code, name, status[, sent, received]); errors is a map with every category.
    """
    size = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) if c in outcomes.columns else F.lit(0).cast("bigint").alias(c)
    kind = error_category(F.col("code"), F.col("name"), F.col("status"))
    each = [x for c in CATEGORIES for x in (F.lit(c), F.count_if(~F.col("ok") & (kind == c)))]
    out = outcomes.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), size("sent"), size("received"), F.create_map(*each).alias("errors"))
    rate = F.when(F.col("total") > 0, F.floor(F.col("success") / F.col("total") * 1000 + 0.5) / 10).otherwise(0.0)
    return out.withColumns({"success_rate": rate, "rps": F.floor(F.col("total") / F.lit(float(max(1, elapsed_sec))) * 100 + 0.5) / 100})


def prometheus(report: DataFrame, prefix: str = "webloom", whole: DataFrame | None = None) -> DataFrame:
    """(metrics): the report of observability(), and the row of totals() if given, in the text exposition format.

    One text: a line for each domain and metric.
    """
    label = lambda d: F.replace(F.replace(d, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = lambda m: F.concat(F.lit(f'{prefix}_{m}_total{{domain="'), label(F.col("domain")), F.lit('"} '), F.col(m).cast("string"))
    parts = []
    for m in ("requests", "success", "failed"):
        all_ = F.max(F.when(F.col("domain") == "*", F.concat(F.lit(f"{prefix}_{m}_total "), F.col(m).cast("string"))))
        parts.append(F.concat_ws("\n", F.lit(f"# TYPE {prefix}_{m}_total counter"), all_, F.array_join(F.array_sort(F.collect_list(F.when(F.col("domain") != "*", line(m)))), "\n")))
    out = report.agg(F.concat_ws("\n", *parts).alias("metrics"))
    if whole is None:
        return out
    more = []
    for name, kind, c in (("success_rate_percent", "gauge", "success_rate"), ("requests_per_second", "gauge", "rps")):
        more += [F.lit(f"# TYPE {prefix}_{name} {kind}"), F.concat(F.lit(f"{prefix}_{name} "), F.col(c).cast("string"))]
    more.append(F.lit(f"# TYPE {prefix}_bytes_total counter"))
    more += [F.concat(F.lit(f'{prefix}_bytes_total{{dir="{c}"}} '), F.col(c).cast("string")) for c in ("sent", "received")]
    more.append(F.lit(f"# TYPE {prefix}_errors_total counter"))
    more += [F.concat(F.lit(f'{prefix}_errors_total{{category="{c}"}} '), F.col("errors")[c].cast("string")) for c in CATEGORIES]
    # one row each
    return out.join(F.broadcast(whole.select(F.concat_ws("\n", *more).alias("_more")))).select(F.concat_ws("\n", "metrics", "_more").alias("metrics"))


# --- counters by key, of recorded requests (A16) -------------------------------------------------------------


def proxy_stats(requests: DataFrame, max_failures: int = 3) -> DataFrame:
    """(proxy, failures, healthy, sessions) of requests(proxy, ok, session, at): failures since the last success."""
    w = requests.groupBy("proxy").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("_last"), F.countDistinct("session").alias("sessions"))
    bad = requests.join(w, "proxy").groupBy("proxy", "sessions").agg(F.count_if(~F.col("ok") & (F.col("_last").isNull() | (F.col("at") > F.col("_last")))).alias("failures"))
    return bad.select("proxy", "failures", (F.col("failures") < max_failures).alias("healthy"), "sessions")


def session_stats(requests: DataFrame) -> DataFrame:
    """(id, use_count, created_at) of requests(session, at)."""
    return requests.filter("session is not null").groupBy(F.col("session").alias("id")).agg(F.count("*").alias("use_count"), F.min("at").alias("created_at"))


def throttle_stats(replayed: DataFrame, key: str = "key", order: str = "at") -> DataFrame:
    """(key, slots, delay_ms, backoffs) of a throttle's replay: the last state of each host."""
    return replayed.groupBy(key).agg(F.max_by("slots", order).alias("slots"), F.max_by("delay_ms", order).alias("delay_ms"), F.count_if(~F.col("ok")).alias("backoffs"))


def dns_stats(lookups: DataFrame, now_ms: int, ttl_ms: int = 300_000) -> DataFrame:
    """(hostname, addresses, age_ms) of lookups(hostname, addresses, at) that are not older than ttl_ms: the last of each."""
    last = lookups.filter(F.col("at") <= now_ms).groupBy("hostname").agg(F.max("at").alias("at"), F.max_by("addresses", "at").alias("addresses"))
    return last.select("hostname", "addresses", (F.lit(now_ms) - F.col("at")).alias("age_ms")).filter(F.col("age_ms") <= ttl_ms)
