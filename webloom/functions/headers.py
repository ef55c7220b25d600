"""Headers, cookies, resource types and redaction as Column expressions over map<string,string>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import url as U

#: Names whose values are redacted, hop-by-hop names, known resource types.
SENSITIVE = ("authorization", "cookie", "set-cookie", "proxy-authorization", "x-api-key", "x-auth-token")
HOP_BY_HOP = ("connection", "keep-alive", "transfer-encoding", "upgrade", "host", "content-length", "accept-encoding")
CLIENT_HINTS = "^sec-ch-ua|^sec-fetch|^user-agent|^accept$|^accept-language"
RESOURCE_TYPES = ("document", "script", "stylesheet", "image", "font", "media", "xhr", "fetch", "websocket", "manifest", "prefetch", "other")
JSON_MIME = r"(?i)(application|text)/(?:.+\+)?(json|graphql)|application/graphql"
TEXT_MIME = r"(?i)^text/|json|xml|javascript|graphql|x-www-form-urlencoded|csv"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def header_map(pairs: Column | str) -> Column:
    """array<struct<name,value>> as a map of lower-case names; the first of repeats counts, nameless ones go."""
    low = F.transform(_col(pairs), lambda h: F.struct(F.lower(h["name"]).alias("k"), F.coalesce(h["value"], F.lit("")).alias("v")))
    low = F.filter(low, lambda h: h["k"].isNotNull() & (h["k"] != ""))
    first = F.filter(low, lambda h, i: (i == 0) | (F.size(F.filter(F.slice(low, F.lit(1), F.greatest(i, F.lit(0))), lambda o: o["k"] == h["k"])) == 0))
    return F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>"))


def lower_keys(headers: Column | str) -> Column:
    """A map with names in lower case and null values dropped."""
    return F.transform_keys(F.map_filter(_col(headers), lambda k, v: v.isNotNull()), lambda k, v: F.lower(k))


def redact(headers: Column | str, names: tuple[str, ...] = SENSITIVE) -> Column:
    """Values of sensitive names become <redacted>."""
    return F.transform_values(_col(headers), lambda k, v: F.when(F.lower(k).isin(*names), F.lit("<redacted>")).otherwise(v))


def safe(headers: Column | str, redacted: bool = True) -> Column:
    """Redacted, without hop-by-hop and client-hint names."""
    h = redact(headers) if redacted else _col(headers)
    return F.map_filter(h, lambda k, v: ~k.isin(*HOP_BY_HOP) & ~k.rlike(CLIENT_HINTS))


def is_json_mime(mime: Column | str) -> Column:
    return F.coalesce(_col(mime).rlike(JSON_MIME), F.lit(False))


def is_text_mime(mime: Column | str) -> Column:
    return F.coalesce(_col(mime).rlike(TEXT_MIME), F.lit(False))


def resource_type(declared: Column, mime: Column, url: Column) -> Column:
    """A declared type if it is known, else by MIME type, then by extension, else other."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(F.lower(declared).isin(*RESOURCE_TYPES), F.lower(declared))
        .when(is_json_mime(m), "fetch")
        .when(m.rlike("javascript|ecmascript"), "script")
        .when(m.rlike("css"), "stylesheet")
        .when(m.rlike("^image/"), "image")
        .when(m.rlike("^font/|woff"), "font")
        .when(m.rlike("^video/|^audio/"), "media")
        .when(m.rlike("html|xml"), "document")
        .otherwise(F.coalesce(U.extension_type(url), F.lit("other")))
    )


def type_from_request(headers: Column, mime: Column) -> Column:
    """The resource type that request headers tell, then the response's MIME type; else null."""
    dest = F.lower(headers["sec-fetch-dest"])
    return (
        F.when(F.lower(headers["x-requested-with"]) == "xmlhttprequest", "xhr")
        .when(dest == "empty", "fetch")
        .when(dest == "style", "stylesheet")
        .when(dest.isin("audio", "video", "track"), "media")
        .when(dest.isin(*RESOURCE_TYPES), dest)
        .when(is_json_mime(mime), "fetch")
    )


def entry_kind(status: Column, failed: Column) -> Column:
    """failed, success, redirect, client-error, server-error or unknown."""
    return F.when(failed, "failed").when((status >= 200) & (status < 300), "success").when((status >= 300) & (status < 400), "redirect").when((status >= 400) & (status < 500), "client-error").when(status >= 500, "server-error").otherwise("unknown")


def is_api(resource: Column, mime: Column, method: Column) -> Column:
    """Whether an entry is an API call. (F2)"""
    return F.when(resource == "websocket", False).when(resource.isin("xhr", "fetch"), True).when((resource == "document") & is_json_mime(mime), True).when(is_json_mime(mime) & (method != "GET"), True).otherwise(False)


def _int_prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def rate_limit(headers: Column) -> Column:
    """struct(limit, remaining, reset) of ratelimit-* before x-ratelimit-*; null if none is there."""
    one = lambda n: _int_prefix(F.coalesce(headers[f"ratelimit-{n}"], headers[f"x-ratelimit-{n}"]))
    got = F.struct(one("limit").alias("limit"), one("remaining").alias("remaining"), one("reset").alias("reset"))
    return F.when(F.coalesce(got["limit"], got["remaining"], got["reset"]).isNotNull(), got)


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Retry-After in milliseconds: seconds, or an HTTP date less now, 0 at least; else null."""
    seconds = F.trim(value).try_cast("double")
    stamp = F.try_to_timestamp(F.regexp_extract(value, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0), F.round(seconds * 1000)).cast("bigint")).when(stamp.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.unix_millis(stamp) - now_ms))


def set_cookie(line: Column, now_ms: Column) -> Column:
    """struct(name, value, domain, path, expires, secure, http_only) of a Set-Cookie value.

    max-age counts from now and goes before expires.
    """
    parts = F.transform(F.split(line, ";"), lambda x: F.trim(x))
    first = parts[0]
    attrs = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    attr = lambda n: F.try_element_at(F.filter(F.transform(attrs, lambda a: F.when(F.lower(F.trim(F.substring_index(a, "=", 1))) == n, F.trim(F.regexp_extract(a, "=(.*)$", 1)))), lambda x: x.isNotNull()), F.lit(1))
    flag = lambda n: F.exists(attrs, lambda a: F.lower(a) == n)
    age = attr("max-age").try_cast("bigint")
    stamp = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(attr("expires"), r"(\d{1,2}[ -][A-Za-z]{3}[ -]\d{4} \d{2}:\d{2}:\d{2})", 1), "-", " "), F.lit("d MMM yyyy HH:mm:ss"))
    return F.when(
        first.contains("=") & ~first.startswith("="),
        F.struct(
            F.trim(F.substring_index(first, "=", 1)).alias("name"),
            F.trim(F.regexp_extract(first, "=(.*)$", 1)).alias("value"),
            F.regexp_replace(attr("domain"), r"^\.", "").alias("domain"),
            F.coalesce(attr("path"), F.lit("/")).alias("path"),
            F.coalesce(now_ms + age * 1000, F.unix_millis(stamp)).alias("expires"),
            flag("secure").alias("secure"),
            flag("httponly").alias("http_only"),
        ),
    )


def to_expiry(value: Column) -> Column:
    """An expiry in milliseconds: seconds if under 1e12; 0, negative or empty is null; else a date."""
    n = value.cast("string").try_cast("double")
    date = F.unix_millis(F.try_to_timestamp(value.cast("string")))
    return F.when(n.isNotNull(), F.when(n <= 0, None).when(n < 1e12, F.round(n * 1000)).otherwise(F.round(n)).cast("bigint")).otherwise(date)


def cookie_header(cookies: Column, now_ms: Column) -> Column:
    """'n=v; ...' of the cookies in an array that have not expired, in order."""
    live = F.filter(cookies, lambda c: c["expires"].isNull() | (c["expires"] >= now_ms))
    return F.array_join(F.transform(live, lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ")


def robots_tag_allows(headers: Column) -> Column:
    """False where X-Robots-Tag says none or noindex."""
    return ~F.coalesce(F.lower(headers["x-robots-tag"]).rlike(r"\b(none|noindex)\b"), F.lit(False))
