"""Bytes, charsets and content types."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.udf import vectorized

#: Magic bytes in the order in which they are tried, as hex.
MAGIC = (
    ("89504E47", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("47494638", "image/gif"),
    ("25504446", "application/pdf"),
    ("504B0304", "application/zip"),
    ("1F8B", "application/gzip"),
    ("425A68", "application/x-bzip2"),
    ("52494646", "audio/wav"),
    ("4F676753", "audio/ogg"),
    ("494433", "audio/mpeg"),
    ("0000001866747970", "video/mp4"),
    ("28B52FFD", "application/zstd"),
    ("377ABCAF271C", "application/x-7z-compressed"),
    ("424D", "image/bmp"),
    ("664C6143", "audio/flac"),
    ("774F4646", "font/woff"),
    ("774F4632", "font/woff2"),
)
#: Other names of charsets.
ALIASES = {"shift-jis": "shift_jis", "sjis": "shift_jis", "gb2312": "gbk", "big5hkscs": "big5-hkscs", "latin1": "iso-8859-1"}
_META = r"(?i)<meta[^>]+charset\s*=\s*[\"']?([a-z0-9_-]+)"
_DECLARED_TEXT = r"^(text/|application/(json|xml|javascript|x-www-form-urlencoded)|.*\+(json|xml))"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sniff_type(content: Column | str) -> Column:
    """The type of the first magic bytes that fit; RIFF must say WAVE. Null if none fits. (B1)"""
    head = F.hex(F.substring(_col(content), 1, 12))
    out = F.lit(None).cast("string")
    for sig, kind in reversed(MAGIC):
        fits = head.startswith(sig)
        if kind == "audio/wav":
            fits &= F.substring(head, 17, 8) == "57415645"
        out = F.when(fits, kind).otherwise(out)
    return out


def is_binary(content: Column | str, sample: int = 2048) -> Column:
    """Any NUL, or control bytes (under 7, 14-31, 127) over a tenth, in the first bytes. (B2)"""
    head = F.substring(_col(content), 1, sample)
    # one code point for each byte, so that counting characters counts bytes
    text = F.decode(head, "ISO-8859-1")
    odd = F.length(F.regexp_replace(text, r"[^\x00-\x06\x0E-\x1F\x7F]", ""))
    return F.when(F.octet_length(head) == 0, False).otherwise(text.contains("\x00") | (odd / F.octet_length(head) > 0.1))


def bom(content: Column | str) -> Column:
    """utf-8, utf-16le or utf-16be by a byte order mark, else null."""
    head = F.hex(F.substring(_col(content), 1, 3))
    return F.when(head == "EFBBBF", "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be")


def normalize_charset(name: Column | str) -> Column:
    """Lower case, trimmed, other names replaced."""
    low = F.lower(F.trim(_col(name)))
    out = low
    for a, b in ALIASES.items():
        out = F.when(low == a, b).otherwise(out)
    return out


def charset_of_type(content_type: Column | str) -> Column:
    """charset= of a Content-Type, else null."""
    return F.nullif(F.lower(F.regexp_extract(_col(content_type), "(?i)charset=([a-z0-9_-]+)", 1)), F.lit(""))


def charset_of_meta(text: Column | str) -> Column:
    """The charset that a page's meta tags tell, else null."""
    return F.nullif(F.lower(F.regexp_extract(_col(text), _META, 1)), F.lit(""))


def charset(content: Column | str, content_type: Column | str) -> Column:
    """struct(charset, source): byte order mark, then header, then meta in the first 4096 bytes, then utf-8."""
    content = _col(content)
    mark, head = bom(content), normalize_charset(charset_of_type(content_type))
    meta = normalize_charset(charset_of_meta(F.decode(F.substring(content, 1, 4096), "ISO-8859-1")))
    return F.struct(F.coalesce(mark, head, meta, F.lit("utf-8")).alias("charset"), F.when(mark.isNotNull(), "bom").when(head.isNotNull(), "header").when(meta.isNotNull(), "meta").otherwise("default").alias("source"))


def decoded(content: bytes | None, name: str | None) -> tuple[str | None, str]:
    """(text, charset used): malformed bytes become U+FFFD, an unknown charset counts as utf-8; a mark goes."""
    if content is None:
        return None, "utf-8"
    kind = {"iso-8859-1": "cp1252", "utf-8": "utf-8-sig", "big5-hkscs": "big5hkscs"}.get(name or "utf-8", name or "utf-8")
    try:
        text = content.decode(kind, "replace")
    except LookupError:
        return content.decode("utf-8-sig", "replace"), "utf-8"
    return text.removeprefix("﻿"), name or "utf-8"


@vectorized("string")
def decode(content: pd.Series, name: pd.Series) -> pd.Series:
    """Text of bytes in a charset, lossy."""
    return pd.Series([decoded(c, n)[0] for c, n in zip(content, name, strict=True)], dtype=object)


def inspect(content: Column | str, content_type: Column | str) -> Column:
    """What bytes are against what they are declared to be."""
    content, declared = _col(content), _col(content_type)
    kind, binary = sniff_type(content), is_binary(content)
    text = declared.isNull() | (declared == "") | declared.rlike(_DECLARED_TEXT)
    return F.struct(
        binary.alias("is_binary"),
        kind.alias("sniffed_type"),
        declared.alias("declared_type"),
        F.coalesce(kind.isNotNull() & (declared != "") & ~declared.contains(F.substring_index(kind, "/", 1)), F.lit(False)).alias("mismatch"),
        (binary & charset_of_type(declared).isNotNull()).alias("charset_overridden"),
        (text & ~binary).alias("should_treat_as_text"),
        F.octet_length(content).alias("size"),
    )


@vectorized("binary")
def decompress(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bytes of a Content-Encoding: gzip, deflate (zlib or raw), zstd where a codec is installed, identity.

    Another encoding raises.
    """
    for content, encoding in batches:
        out = []
        for c, e in zip(content, encoding, strict=True):
            kind = (e or "identity").strip().lower()
            if c is None or kind in ("identity", ""):
                out.append(c)
            elif kind in ("gzip", "x-gzip"):
                out.append(gzip.decompress(c))
            elif kind == "deflate":
                try:
                    out.append(zlib.decompress(c))
                except zlib.error:
                    out.append(zlib.decompress(c, -15))
            elif kind == "zstd":
                import zstandard

                out.append(zstandard.ZstdDecompressor().decompressobj().decompress(c))
            else:
                raise ValueError(f"unsupported content encoding: {kind}")
        yield pd.Series(out, dtype=object)


def truncated(content: Column | str, declared: Column) -> Column:
    """Whether fewer bytes came than were declared."""
    return declared.isNotNull() & (F.octet_length(_col(content)) < declared)


def response_type(content_type: Column, body: Column) -> Column:
    """feed, csv, json or html by content type, then by the body's start."""
    kind, head = F.lower(F.coalesce(content_type, F.lit(""))), F.ltrim(F.coalesce(body, F.lit("")))
    feed = kind.rlike("rss|atom") | (head.startswith("<?xml") & head.rlike("(?i)<(rss|feed)[\\s>]"))
    return F.when(feed, "feed").when(kind.rlike("text/csv"), "csv").when(kind.rlike("json") | head.startswith("{") | head.startswith("["), "json").otherwise("html")
