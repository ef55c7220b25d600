"""Captured HTTP traffic: HAR, DevTools events, WebSocket frames, merged into entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from webloom.functions import headers as H
from webloom.functions.udf import vectorized
from webloom.session import checkpointed

_PAIRS = "array<struct<name:string,value:string>>"
HAR = (
    "log struct<version:string,entries:array<struct<startedDateTime:string,time:double,_resourceType:string,_initiator:string,_error:string,_fromCache:string,"
    f"request:struct<method:string,url:string,httpVersion:string,headers:{_PAIRS},postData:struct<mimeType:string,text:string,params:{_PAIRS}>>,"
    f"response:struct<status:int,statusText:string,httpVersion:string,headers:{_PAIRS},redirectURL:string,content:struct<size:bigint,mimeType:string,text:string,encoding:string>>>>>"
)
FRAMES = "array<struct<direction:string,opcode:int,payload_data:string,size:bigint,timestamp:double>>"
ENTRY = (
    "id string, source string, method string, url string, status int, status_text string, http_version string, resource_type string, mime_type string, request_headers map<string,string>, "
    "response_headers map<string,string>, request_body string, response_body string, request_size bigint, response_size bigint, started string, time double, initiator string, from_cache boolean, "
    f"failed boolean, error_text string, redirect_url string, body_base64 boolean, frames {FRAMES}, frames_truncated boolean, ordinal bigint"
)


def create_entries(raw: DataFrame) -> DataFrame:
    """Fill in what raw entries leave out: defaults, upper-case method, sizes, MIME and resource types.

    raw may have any of ENTRY's columns; headers are maps of lower-case names; ids come from the ordinal.
    """
    fields = dict(x.strip().split(" ", 1) for x in _split_fields(ENTRY))
    have = {c: F.col(c) for c in raw.columns}
    c = lambda n: have.get(n, F.lit(None)).cast(fields[n])
    empty = F.create_map().cast("map<string,string>")
    req, res = F.coalesce(c("request_headers"), empty), F.coalesce(c("response_headers"), empty)
    declared = c("resource_type")
    derived = F.coalesce(c("mime_type"), res["content-type"], req["content-type"], F.lit(""))
    # with a declared but unknown type the given MIME type alone decides
    kind = F.when(declared.isNotNull() & (declared != ""), H.resource_type(declared, c("mime_type"), c("url"))).otherwise(H.resource_type(F.lit(None).cast("string"), derived, c("url")))
    return raw.select(
        F.coalesce(c("id"), F.concat(F.lit("req-"), c("ordinal").cast("string"))).alias("id"),
        F.coalesce(c("source"), F.lit("memory")).alias("source"),
        F.upper(F.coalesce(c("method"), F.lit("GET"))).alias("method"),
        F.coalesce(c("url"), F.lit("")).alias("url"),
        F.coalesce(c("status"), F.lit(0)).alias("status"),
        F.coalesce(c("status_text"), F.lit("")).alias("status_text"),
        F.coalesce(c("http_version"), F.lit("HTTP/1.1")).alias("http_version"),
        kind.alias("resource_type"),
        derived.alias("mime_type"),
        req.alias("request_headers"),
        res.alias("response_headers"),
        c("request_body").alias("request_body"),
        c("response_body").alias("response_body"),
        F.coalesce(c("request_size"), F.octet_length(c("request_body")), F.lit(0)).alias("request_size"),
        F.coalesce(c("response_size"), F.octet_length(c("response_body")), F.lit(0)).alias("response_size"),
        c("started").alias("started"),
        F.coalesce(c("time"), F.lit(0.0)).alias("time"),
        c("initiator").alias("initiator"),
        F.coalesce(c("from_cache"), F.lit(False)).alias("from_cache"),
        F.coalesce(c("failed"), F.lit(False)).alias("failed"),
        c("error_text").alias("error_text"),
        F.nullif(c("redirect_url"), F.lit("")).alias("redirect_url"),
        F.coalesce(c("body_base64"), F.lit(False)).alias("body_base64"),
        c("frames").alias("frames"),
        F.coalesce(c("frames_truncated"), F.lit(False)).alias("frames_truncated"),
        c("ordinal").alias("ordinal"),
    )


def _split_fields(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def from_pages(pages: DataFrame, url: str = "url", html: str = "html", status: Column | None = None, headers: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages as responses: (kept columns, url, final_url, status, headers, body, charset, charset_source, text, ok).

    html is text, or bytes as they came. Without headers a page is text/html in UTF-8, or of the charset that
    its bytes tell; without a status it is 200. A null page has a null body and text.
    """
    from webloom.functions import content as C

    raw = isinstance(pages.schema[html].dataType, T.BinaryType)
    body = F.col(html) if raw else F.col(html).cast("binary")
    own = F.create_map(F.lit("content-type"), F.lit("text/html" if raw else "text/html; charset=utf-8"))
    out = pages.select(*keep, F.col(url).alias("url"), F.col(url).alias("final_url"), F.coalesce(status if status is not None else F.lit(None).cast("int"), F.lit(200)).alias("status"), (headers if headers is not None else own).cast("map<string,string>").alias("headers"), body.alias("body"))
    out = out.withColumn("_c", C.charset("body", F.col("headers")["content-type"]))
    return out.select(*keep, "url", "final_url", "status", "headers", "body", F.col("_c.charset").alias("charset"), F.col("_c.source").alias("charset_source"), C.decode("body", F.col("_c.charset")).alias("text"), F.col("status").between(200, 299).alias("ok"))


def parse_har(text: DataFrame, column: str = "har", source: str = "har", max_entries: int | None = None) -> DataFrame:
    """Entries of HAR documents, one document in each row.

    A document without log.entries raises. max_entries keeps each document's first ones.
    """
    doc = F.from_json(F.col(column), HAR)
    entries = F.when(F.get_json_object(F.col(column), "$.log.entries").startswith("["), doc["log"]["entries"]).otherwise(F.raise_error(F.lit("HAR has no log.entries array")).cast(f"array<{_entry_type()}>"))
    if max_entries is not None:
        entries = F.slice(entries, 1, max_entries)
    e = text.select(F.posexplode(entries).alias("ordinal", "e")).select("ordinal", "e.*")
    content, post = F.col("response.content"), F.col("request.postData")
    encoded = F.lower(F.coalesce(content["encoding"], F.lit(""))) == "base64"
    body = F.when(encoded, F.decode(F.try_to_binary(content["text"], F.lit("base64")), "UTF-8")).otherwise(content["text"])
    form = F.array_join(F.transform(post["params"], lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["value"], F.lit("")))), "&")
    failed = F.col("_error").isNotNull() | ((F.coalesce(F.col("response.status"), F.lit(0)) == 0) & content["text"].isNull())
    return create_entries(
        e.select(
            F.concat(F.lit(f"{source}-"), F.col("ordinal").cast("string")).alias("id"),
            F.lit(source).alias("source"),
            F.col("request.method").alias("method"),
            F.col("request.url").alias("url"),
            F.col("response.status").alias("status"),
            F.col("response.statusText").alias("status_text"),
            F.coalesce("response.httpVersion", "request.httpVersion").alias("http_version"),
            F.col("_resourceType").alias("resource_type"),
            F.nullif(content["mimeType"], F.lit("")).alias("mime_type"),
            H.header_map("request.headers").alias("request_headers"),
            H.header_map("response.headers").alias("response_headers"),
            F.coalesce(post["text"], F.nullif(form, F.lit(""))).alias("request_body"),
            body.alias("response_body"),
            F.when(content["size"] >= 0, content["size"]).alias("response_size"),
            F.col("startedDateTime").alias("started"),
            "time",
            F.col("_initiator").alias("initiator"),
            ((F.col("response.status") == 304) | F.coalesce(F.col("_fromCache").isNotNull(), F.lit(False))).alias("from_cache"),
            failed.alias("failed"),
            F.col("_error").alias("error_text"),
            F.col("response.redirectURL").alias("redirect_url"),
            F.lit(False).alias("body_base64"),
            F.col("ordinal").cast("bigint").alias("ordinal"),
        )
    )


def _entry_type() -> str:
    return HAR[HAR.index("array<struct<startedDateTime") + len("array<") : -2]


def read_har(spark: SparkSession, path: str, **options) -> DataFrame:
    """Entries of HAR files, each read whole."""
    return parse_har(spark.read.text(path, wholetext=True).withColumnRenamed("value", "har"), **options)


def merge(*captures: DataFrame) -> DataFrame:
    """Captures one after the other; of an id its first entry stays."""
    out = None
    for k, c in enumerate(captures):
        c = c.withColumn("_part", F.lit(k))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy("_part", "ordinal")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_part")


def frames_of(entries: DataFrame, cap: int = 500) -> DataFrame:
    """(id, frame_no, direction, opcode, payload_data, size, timestamp, frames_truncated) of each entry's frames."""
    return entries.select("id", (F.col("frames_truncated") | (F.coalesce(F.size("frames"), F.lit(0)) > cap)).alias("frames_truncated"), F.posexplode(F.slice("frames", 1, cap)).alias("frame_no", "f")).select("id", "frame_no", "f.*", "frames_truncated")


MAX_PAYLOAD = 16 * 1024 * 1024


def decoded_frames(data: bytes) -> tuple[list[dict], bytes]:
    """(frames, bytes of an unfinished one) of a WebSocket stream: 7, 16 and 64 bit lengths, masks."""
    out, pos = [], 0
    while len(data) - pos >= 2:
        a, b = data[pos], data[pos + 1]
        size, at = b & 0x7F, pos + 2
        extra = {126: 2, 127: 8}.get(size, 0)
        if len(data) < at + extra:
            break
        if extra:
            size = int.from_bytes(data[at : at + extra], "big")
            at += extra
        if size > MAX_PAYLOAD:
            raise ValueError(f"frame of {size} bytes is over {MAX_PAYLOAD}")
        masked = b & 0x80
        if len(data) < at + 4 * bool(masked) + size:
            break
        payload = data[at + 4 : at + 4 + size] if masked else data[at : at + size]
        if masked:
            mask = data[at : at + 4]
            payload = bytes(x ^ mask[k % 4] for k, x in enumerate(payload))
            at += 4
        out.append({"fin": bool(a & 0x80), "opcode": a & 0x0F, "payload": payload})
        pos = at + size
    return out, data[pos:]


@vectorized("array<struct<fin:boolean,opcode:int,payload:binary>>")
def decode_frames(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in data:
        yield pd.Series([None if d is None else decoded_frames(bytes(d))[0] for d in batch], dtype=object)


def messages(frames: DataFrame, key: str, order: str) -> DataFrame:
    """Whole messages of frames(key, order, fin, opcode, payload): (key, first, opcode, payload, kind).

    Control frames are skipped, a continuation without a start goes, a new start discards what was open;
    text that is JSON is a message, all else raw.
    """
    data = frames.filter(F.col("opcode").isin(0, 1, 2))
    w = Window.partitionBy(key).orderBy(order)
    data = data.withColumn("_start", F.sum((F.col("opcode") != 0).cast("int")).over(w))
    inside = Window.partitionBy(key, "_start").orderBy(order)
    data = data.withColumn("_fins", F.sum(F.col("fin").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    whole = data.filter("_start > 0 and coalesce(_fins, 0) = 0").groupBy(key, "_start").agg(
        F.min(order).alias("first"), F.max_by("opcode", F.col("opcode")).alias("opcode"), F.max("fin").alias("_fin"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("payload").alias("p")))).alias("_parts")
    )
    payload = F.unhex(F.array_join(F.transform("_parts", lambda x: F.hex(x["p"])), ""))  # each byte is written once
    out = whole.filter("_fin").select(key, "first", "opcode", payload.alias("payload"))
    text = F.when(F.col("opcode") == 1, F.try_validate_utf8(F.col("payload").cast("string")))
    return out.withColumn("kind", F.when(F.try_parse_json(text).isNotNull(), "message").otherwise("raw"))


def fold_events(events: DataFrame, source: str = "cdp", max_entries: int | None = None, max_frames: int = 500, capture: str | None = None) -> DataFrame:
    """Entries of DevTools events(request_id, seq, type, ts, url, method, status, mime_type, headers, body, error[, opcode]).

    Types: requestWillBeSent, responseReceived, loadingFinished, loadingFailed, webSocketCreated,
    webSocketFrameSent, webSocketFrameReceived (the frame's payload is the body). A second requestWillBeSent of
    an id is a redirect: it closes the entry before it, which keeps the id with its hop number. A socket's
    first max_frames frames stay, and the entry tells if there were more. Of each `capture` (a column; else
    of all events) the first max_entries entries stay.
    """
    w = Window.partitionBy("request_id").orderBy("seq")
    sent = F.col("type").isin("requestWillBeSent", "webSocketCreated")
    e = events.withColumn("_hop", F.sum(sent.cast("int")).over(w)).filter("_hop > 0")
    is_frame = F.col("type").isin("webSocketFrameSent", "webSocketFrameReceived")
    of = lambda kinds, c: F.max_by(F.when(F.col("type").isin(*kinds), F.col(c)), F.when(F.col("type").isin(*kinds) & F.col(c).isNotNull(), F.col("seq")))
    keys = ["request_id", "_hop", *([capture] if capture else [])]
    g = e.filter(~is_frame).groupBy(*keys).agg(
        F.min("seq").alias("ordinal"),
        of(("requestWillBeSent", "webSocketCreated"), "url").alias("url"),
        of(("requestWillBeSent",), "method").alias("method"),
        of(("responseReceived",), "status").alias("status"),
        of(("responseReceived",), "mime_type").alias("mime_type"),
        of(("loadingFinished",), "body").alias("response_body"),
        of(("loadingFailed",), "error").alias("error_text"),
        F.max(F.col("type") == "loadingFailed").alias("failed"),
        F.max(F.col("type") == "webSocketCreated").alias("_socket"),
        (F.max("ts") - F.min("ts")).cast("double").alias("time"),
    )
    opcode = F.coalesce(F.col("opcode"), F.lit(0)).cast("int") if "opcode" in events.columns else F.lit(0)
    payload = F.coalesce("body", F.lit(""))
    frame = F.struct("seq", F.struct(F.when(F.col("type") == "webSocketFrameSent", "sent").otherwise("received").alias("direction"), opcode.alias("opcode"), payload.alias("payload_data"), F.octet_length(payload).cast("bigint").alias("size"), F.col("ts").cast("double").alias("timestamp")).alias("f"))
    # one frame more than stays, so a long-lived socket is never gathered whole
    first = e.filter(is_frame).withColumn("_no", F.row_number().over(Window.partitionBy("request_id", "_hop").orderBy("seq"))).filter(F.col("_no") <= max_frames + 1)
    framed = first.groupBy(F.col("request_id").alias("_r"), F.col("_hop").alias("_h")).agg(F.slice(F.transform(F.array_sort(F.collect_list(frame)), lambda x: x["f"]), 1, max_frames).alias("_frames"), (F.count("*") > max_frames).alias("frames_truncated"))
    g = g.join(framed, (F.col("request_id") == F.col("_r")) & (F.col("_hop") == F.col("_h")), "left")
    if max_entries is not None and capture:
        g = g.withColumn("_no", F.row_number().over(Window.partitionBy(capture).orderBy("ordinal"))).filter(F.col("_no") <= max_entries)
    elif max_entries is not None:
        g = g.orderBy("ordinal").limit(max_entries)
    name = F.when(F.col("_hop") == 1, F.col("request_id")).otherwise(F.concat_ws("#", "request_id", F.col("_hop").cast("string")))
    frames = F.when(F.col("_socket"), F.coalesce("_frames", F.array().cast(FRAMES)))
    return create_entries(
        g.select(name.alias("id"), F.lit(source).alias("source"), "url", "method", "status", "mime_type", "response_body", "error_text", "failed", "time", "ordinal", frames.alias("frames"), "frames_truncated", F.when(F.col("_socket"), "websocket").alias("resource_type"))
    )


def pair_har(requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests with their responses, by id."""
    return requests.join(responses, key, "left")


def redirects(chain: DataFrame, start: DataFrame, max_hops: int = 5, max_cross: int = 3) -> DataFrame:
    """Follow chain(url, status, location) from start(id, url, method): one row for each hop.

    301, 302 and 303 turn a method other than GET or HEAD into GET; a hop to another origin strips sensitive
    headers. Past max_hops hops or max_cross changes of host an id stops with a reason.
    """
    from webloom.functions import url as U

    now = start.select("id", "url", "method", F.lit(0).alias("hop"), F.lit(0).alias("crossed"), F.lit(False).alias("stripped"), F.lit(None).cast("string").alias("reason"))
    out = now
    for _ in range(max_hops + 1):
        step = now.filter("reason is null").join(chain.select(F.col("url").alias("_u"), "status", "location"), F.col("url") == F.col("_u"))
        cross = U.origin("url") != U.origin("location")
        hop, crossed = F.col("hop") + 1, F.col("crossed") + F.when(U.host("url") != U.host("location"), 1).otherwise(0)
        method = F.when(F.col("status").isin(301, 302, 303) & ~F.col("method").isin("GET", "HEAD"), "GET").otherwise(F.col("method"))
        reason = F.when(hop > max_hops, "too many redirects").when(crossed > max_cross, "too many hosts")
        now = checkpointed(step.select("id", F.col("location").alias("url"), method.alias("method"), hop.alias("hop"), crossed.alias("crossed"), (F.col("stripped") | cross).alias("stripped"), reason.alias("reason")))
        if now.isEmpty():
            break
        out = out.unionAll(now)
    return out


def conjunction(entries: DataFrame, **want) -> DataFrame:
    """Entries that meet all of method, type, status, since, host, url, body, api, failed. (F1, V4)

    url and body are regular expressions; host counts its port; `where` is any Column.
    """
    from webloom.functions import url as U

    def listed(c: str, v) -> Column:
        return F.col(c).isin(*v) if isinstance(v, list | tuple | set) else F.col(c) == v

    tests = {
        "method": lambda v: listed("method", [x.upper() for x in v] if isinstance(v, list | tuple) else v.upper()),
        "type": lambda v: listed("resource_type", v),
        "status": lambda v: listed("status", v),
        "since": lambda v: F.col("started") >= F.lit(v),
        "host": lambda v: U.authority("url") == v,
        "url": lambda v: F.col("url").rlike(v),
        "body": lambda v: F.coalesce(F.col("response_body").rlike(v), F.lit(False)),
        "api": lambda v: H.is_api(F.col("resource_type"), F.col("mime_type"), F.col("method")) == v,
        "failed": lambda v: F.col("failed") == v,
        "where": lambda v: v,
    }
    for k, v in want.items():
        entries = entries.filter(tests[k](v))
    return entries


def find(entries: DataFrame, target: str) -> DataFrame:
    """The first entry of an id or, failing that, of a URL."""
    return entries.filter((F.col("id") == target) | (F.col("url") == target)).orderBy((F.col("id") != target), "ordinal").limit(1)
