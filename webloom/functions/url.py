"""URL functions as Column expressions. http(s) URLs in ASCII; others pass through where noted."""

from __future__ import annotations

import ipaddress
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.udf import vectorized

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
#: Path segments that stand for an id.
NUMERIC, UUID, HEX, OPAQUE = r"^[0-9]+$", "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "(?i)^[0-9a-f]{16,}$", "^[A-Za-z0-9_-]{20,}$"
#: Default ports.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_url(url: Column | str) -> Column:
    return _col(url).rlike(_ABSOLUTE)


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column | str) -> Column:
    """Host and port, without user and default port, in lower case; '' if there is none."""
    raw = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    s = scheme(url)
    port = F.regexp_extract(raw, r":([0-9]+)$", 1)
    default = F.lit(False)
    for name, p in PORTS.items():
        default |= (s == name) & (port == p)
    return F.lower(F.when(default, F.regexp_replace(raw, ":[0-9]+$", "")).otherwise(raw))


def host(url: Column | str) -> Column:
    """The host name without port."""
    return F.regexp_replace(authority(url), r":[0-9]*$", "")


def domain(url: Column | str) -> Column:
    """The host name, 'unknown' for what is no URL."""
    return F.when(is_url(url), host(url)).otherwise(F.lit("unknown"))


def origin(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path(url: Column | str) -> Column:
    """The path, '/' where it is empty."""
    p = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column | str) -> Column:
    """The query without its question mark, '' if there is none."""
    return F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)


def _pairs(url: Column | str) -> Column:
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def base_domain(name: Column | str) -> Column:
    """The last two labels of a host; an address stays as it is."""
    name = _col(name)
    return F.when(name.rlike(r"^[0-9.]+$") | name.contains(":"), name).otherwise(F.substring_index(name, ".", -2))


def site_relation(source: Column | str, target: Column | str) -> Column:
    """none, same-origin, same-site or cross-site."""
    return (
        F.when(_col(source).isNull() | ~is_url(source), "none").when(origin(source) == origin(target), "same-origin").when((scheme(source) == scheme(target)) & (base_domain(host(source)) == base_domain(host(target))), "same-site").otherwise("cross-site")
    )


def template(url: Column | str, placeholder: str = ":id") -> Column:
    """Origin and path with ids replaced; query and hash go; what is no URL stays."""

    def dynamic(s: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(s), s)
        return s.rlike(NUMERIC) | s.rlike(UUID) | s.rlike(HEX) | (plain.rlike(OPAQUE) & plain.rlike("[0-9]") & plain.rlike("[A-Za-z]"))

    parts = F.transform(F.split(path(url), "/"), lambda s: F.when(s == "", s).when(dynamic(s), F.lit(placeholder)).otherwise(s))
    return F.when(is_url(url), F.concat(origin(url), F.array_join(parts, "/"))).otherwise(_col(url))


def _decoded(s: Column) -> Column:
    return F.coalesce(F.try_url_decode(s), s)


def query_params(url: Column | str) -> Column:
    """Parameter names, sorted, repeats kept. (S3)"""
    return F.array_sort(F.transform(_pairs(url), lambda p: _decoded(F.substring_index(p, "=", 1))))


def query_map(url: Column | str) -> Column:
    """Parameter names to values; of repeats the last counts."""
    pairs = F.transform(_pairs(url), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), _decoded(F.regexp_extract(p, "=(.*)$", 1))).otherwise("").alias("v")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda o: o["k"] == p["k"])) == 0)
    return F.map_from_entries(last)


def strip_query(url: Column | str) -> Column:
    """Without query and hash."""
    return F.regexp_replace(_col(url), r"[?#].*$", "")


def normalize(url: Column | str, strip_hash: bool = True, strip_trailing_slash: bool = False, sort_query: bool = True, strip_params: tuple[str, ...] = ()) -> Column:
    """A URL's canonical form: lower-case host, no default port, sorted query, no hash.

    Names sort by code point, equal names keep their order. What is no URL stays as it is.
    """
    u = _col(url)
    pairs = _pairs(u)
    if sort_query:
        keyed = F.transform(pairs, lambda p, i: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), p.alias("p")))
        pairs = F.transform(F.array_sort(keyed), lambda x: x["p"])
    if strip_params:
        pairs = F.filter(pairs, lambda p: ~_decoded(F.substring_index(p, "=", 1)).isin(*strip_params))
    pairs = F.transform(pairs, lambda p: F.replace(F.replace(p, F.lit("%20"), F.lit("+")), F.lit(" "), F.lit("+")))
    line = F.array_join(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    p = path(u)
    if strip_trailing_slash:
        p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    tail = F.lit("") if strip_hash else F.regexp_extract(u, "(#.*)$", 1)
    return F.when(is_url(u), F.concat(origin(u), p, F.when(line == "", "").otherwise(F.concat(F.lit("?"), line)), tail)).otherwise(u)


def next_page(url: Column | str) -> Column:
    """The next page by ?page=, ?p=, ?pg=, /page/n or a last segment n; null if none fits."""
    u = _col(url)
    n = lambda pattern: F.expr("bigint(1)") + F.regexp_extract(u, pattern, 2).try_cast("bigint")
    out = F.lit(None).cast("string")
    for pattern in (r"^([^#?]*?/)([0-9]+)(/?(?:[?#].*)?)$", r"^([^#?]*/page/)([0-9]+)(.*)$", r"^([^#]*[?&]pg=)([0-9]+)(.*)$", r"^([^#]*[?&]p=)([0-9]+)(.*)$", r"^([^#]*[?&]page=)([0-9]+)(.*)$"):
        out = F.when(u.rlike(pattern), F.concat(F.regexp_extract(u, pattern, 1), n(pattern).cast("string"), F.regexp_extract(u, pattern, 3))).otherwise(out)
    return F.when(is_url(u), out)


@vectorized("string")
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link made absolute against its page; null if it can't be."""
    return pd.Series([absolute(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def absolute(base: str | None, link: str | None) -> str | None:
    if link is None:
        return None
    try:
        out = urljoin(base or "", link.strip())
        parts = urlsplit(out)
        if not parts.scheme:
            return None
        if parts.scheme in ("http", "https") and not parts.netloc:
            return None
        if parts.netloc and not parts.path:
            parts = parts._replace(path="/")
        return urlunsplit(parts._replace(netloc=parts.netloc.lower() if "@" not in parts.netloc else parts.netloc))
    except ValueError:
        return None


@vectorized("string")
def apply_params(url: pd.Series, params: pd.Series) -> pd.Series:
    """A URL with the parameters of a map (as JSON) set or replaced."""
    import json

    out = []
    for u, p in zip(url, params, strict=True):
        parts = urlsplit(u)
        own = parse_qsl(parts.query, keep_blank_values=True)
        new = json.loads(p or "{}")
        kept = [(k, v) for k, v in own if k not in new]
        out.append(urlunsplit(parts._replace(query=urlencode(kept + [(k, str(v)) for k, v in new.items()]))))
    return pd.Series(out, dtype=object)


def extension(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(path(url), r"[^/.][^/]*(\.[A-Za-z0-9_-]+)$", 1))


#: File extensions by resource type.
EXTENSIONS = {
    "script": (".js", ".mjs", ".cjs", ".jsx"),
    "stylesheet": (".css",),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".svg", ".ico"),
    "font": (".woff", ".woff2", ".ttf", ".otf", ".eot"),
    "media": (".mp4", ".webm", ".mp3", ".ogg", ".wav"),
    "fetch": (".json", ".jsonl", ".ndjson"),
    "document": (".html", ".htm"),
}


def extension_type(url: Column | str) -> Column:
    """The resource type of a path's extension, else null."""
    e, out = extension(url), F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.when(e.isin(*names), kind).otherwise(out)
    return F.when(is_url(url), out)


def glob(pattern: str) -> str:
    """A domain glob as an anchored regular expression without case."""
    import re

    return "(?i)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def domain_allowed(name: Column | str, allow: tuple[str, ...] = (), block: tuple[str, ...] = ()) -> Column:
    """Whether a host passes the lists: blocked names fail, and with an allow list only its names pass."""
    name = _col(name)
    hit = lambda globs: F.lit(False) if not globs else name.rlike("|".join(f"(?:{glob(g)})" for g in globs))
    return ~hit(block) & (F.lit(True) if not allow else hit(allow))


def port_blocked(url: Column | str, ports: tuple[int, ...]) -> Column:
    """Whether a URL's port, explicit or by scheme, is on a list."""
    raw = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1)
    default = F.lit(None).cast("string")
    for s, p in PORTS.items():
        default = F.when(scheme(url) == s, p).otherwise(default)
    return F.coalesce(F.when(raw != "", raw), default).cast("int").isin(*ports)


def classify_ip(address: Column | str) -> Column:
    """The label of a private or reserved address, else null.

    IPv4 by ranges; IPv6 loopback, link-local, unique-local, and IPv4 mapped in dotted or hex form.
    """
    raw = F.lower(F.regexp_replace(_col(address), r"^\[|\]$", ""))
    dotted = F.regexp_extract(raw, r"^(?:0*:)*:?ffff:([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
    hexed = r"^(?:0*:)*:?ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    hi, lo = (F.conv(F.regexp_extract(raw, hexed, k), 16, 10).cast("int") for k in (1, 2))
    byte = lambda x, n: F.shiftright(x, n).bitwiseAND(255).cast("string")
    v4 = F.when(dotted != "", dotted).when(raw.rlike(hexed), F.concat_ws(".", byte(hi, 8), byte(hi, 0), byte(lo, 8), byte(lo, 0))).otherwise(raw)
    four = v4.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    one, two = (F.element_at(F.split(v4, r"\."), k).try_cast("int") for k in (1, 2))
    return (
        F.when(four & (one == 127), "loopback")
        .when(four & (one == 10), "private-a")
        .when(four & (one == 172) & two.between(16, 31), "private-b")
        .when(four & (one == 192) & (two == 168), "private-c")
        .when(four & (one == 169) & (two == 254), "link-local")
        .when(four & (one == 0), "unspecified")
        .when(~four & raw.rlike("^(0*:)+0*1$|^::1$"), "loopback")
        .when(~four & raw.rlike("^fe[89ab][0-9a-f]:"), "link-local")
        .when(~four & raw.rlike("^f[cd][0-9a-f]{2}:"), "unique-local")
    )


def is_address(name: str) -> bool:
    try:
        ipaddress.ip_address(name.strip("[]"))
    except ValueError:
        return False
    return True
