"""Entities, escapes and simple encodings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.udf import vectorized

#: The named entities that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "hellip": "\u2026",
    "mdash": "\u2014", "ndash": "\u2013", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "bull": "\u2022", "deg": "\u00b0",
}
BASE64, HEX = "^[A-Za-z0-9+/]+={0,2}$", "(?i)^[0-9a-f]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _point(n: int, whole: str) -> str:
    return chr(n) if 0 <= n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else whole


def entities_decoded(s: str) -> str:
    s = re.sub(r"&#x([0-9a-f]+);", lambda m: _point(int(m[1], 16), m[0]), s, flags=re.I)
    s = re.sub(r"&#([0-9]+);", lambda m: _point(int(m[1]), m[0]), s)
    return re.sub(r"&([a-z]+);", lambda m: ENTITIES.get(m[1].lower(), m[0]), s, flags=re.I | re.A)


def escapes_decoded(s: str) -> str:
    s = re.sub(r"\\u\{([0-9a-f]+)\}", lambda m: _point(int(m[1], 16), m[0]), s, flags=re.I)
    s = re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), s, flags=re.I)
    s = re.sub(r"\\x([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), s, flags=re.I)
    # two halves of one character written as two escapes belong together
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _mapped(f):
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return run


decode_entities = vectorized("string")(_mapped(entities_decoded))  # S21: hex, decimal, then named; unknown ones stay
decode_escapes = vectorized("string")(_mapped(escapes_decoded))  # S22: \u{…}, \uXXXX, \xXX


def looks_like_base64(s: Column | str) -> Column:
    """(S23)"""
    t = F.trim(_col(s))
    return (F.length(t) > 0) & (F.length(t) % 4 == 0) & t.rlike(BASE64)


def looks_like_hex(s: Column | str) -> Column:
    """(S23)"""
    t = F.trim(_col(s))
    return (F.length(t) > 0) & (F.length(t) % 2 == 0) & t.rlike(HEX)


def decode_base64(s: Column | str) -> Column:
    """UTF-8 text of base64, null where it isn't base64."""
    return F.decode(F.try_to_binary(F.trim(_col(s)), F.lit("base64")), "UTF-8")


def decode_hex(s: Column | str) -> Column:
    """UTF-8 text of hex digits."""
    return F.decode(F.unhex(F.trim(_col(s))), "UTF-8")


def detect_and_decode(s: Column | str) -> Column:
    """struct(encoding, decoded): hex goes before base64, anything else stays."""
    s = _col(s)
    return F.struct(F.when(looks_like_hex(s), "hex").when(looks_like_base64(s), "base64").alias("encoding"), F.when(looks_like_hex(s), decode_hex(s)).when(looks_like_base64(s), decode_base64(s)).otherwise(s).alias("decoded"))


@vectorized("binary")
def xor_decode(data: pd.Series, key: pd.Series) -> pd.Series:
    """Bytes XOR a repeated key."""
    out = []
    for d, k in zip(data, key, strict=True):
        if d is None or not k:
            out.append(d)
            continue
        raw, pad = np.frombuffer(bytes(d), np.uint8), np.frombuffer(str(k).encode(), np.uint8)
        out.append((raw ^ np.resize(pad, len(raw))).tobytes())
    return pd.Series(out, dtype=object)


def caesar_decode(s: Column | str, shift: int) -> Column:
    """ASCII letters moved back by `shift`."""
    turn = lambda a: "".join(a[(k - shift) % 26] for k in range(26))
    return F.translate(_col(s), _UPPER + _LOWER, turn(_UPPER) + turn(_LOWER))


def rot13(s: Column | str) -> Column:
    """(S27)"""
    return caesar_decode(s, 13)


_JSONP = r"(?s)^(?:/\*\*/\s*)?([a-zA-Z_$][\w$.]*)\s*\((.*)\)\s*;?\s*$"


def parse_jsonp(s: Column | str) -> Column:
    """struct(callback, data): the JSON text of a JSONP call; null if it is none or its JSON is invalid."""
    t = F.trim(_col(s))
    data = F.regexp_extract(t, _JSONP, 2)
    return F.when(t.rlike(_JSONP) & F.try_parse_json(data).isNotNull(), F.struct(F.regexp_extract(t, _JSONP, 1).alias("callback"), data.alias("data")))


def storage_key(s: Column | str) -> Column:
    """base64 with /, + and = as underscores."""
    return F.translate(F.base64(_col(s).cast("binary")), "/+=", "___")


def truncate(s: Column | str, most: int) -> Column:
    """At most `most` characters, then a line that says so."""
    s = _col(s)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("\n... (truncated)"))).otherwise(F.coalesce(s, F.lit("")))


def flatten_value(c: Column, kind) -> Column:
    """A value as text: null empty, arrays joined by ' | ', structs and maps as JSON."""
    from pyspark.sql import types as T

    if isinstance(kind, T.ArrayType):
        item = (lambda x: F.to_json(x)) if isinstance(kind.elementType, T.StructType | T.MapType | T.ArrayType) else (lambda x: F.coalesce(x.cast("string"), F.lit("")))
        return F.coalesce(F.array_join(F.transform(c, item), " | "), F.lit(""))
    if isinstance(kind, T.StructType | T.MapType):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def csv_field(s: Column) -> Column:
    """Quoted where a comma, a quote or a line feed is in it."""
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def source_map_url(s: Column | str) -> Column:
    """The URL after the first //# sourceMappingURL= (or //@), else null."""
    return F.nullif(F.regexp_extract(_col(s), r"//[#@]\s*sourceMappingURL=(\S+)", 1), F.lit(""))


def beautified(code: str, indent: int = 2) -> str:
    """Script text broken after ; { and }, indented by its braces; strings stay whole."""
    out: list[str] = []
    line, depth, quote, k, parens = "", 0, "", 0, 0

    def end(text: str, level: int) -> None:
        if text.strip():
            out.append(" " * (indent * max(level, 0)) + text.strip())

    while k < len(code):
        c = code[k]
        if quote:
            line += c
            if c == "\\" and k + 1 < len(code):
                k += 1
                line += code[k]
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote, line = c, line + c
        elif c == "{":
            end(line + c, depth)
            line, depth = "", depth + 1
        elif c == "}":
            end(line, depth)
            depth -= 1
            line = c
            if k + 1 < len(code) and code[k + 1] in ";,)":
                k += 1
                line += code[k]
            end(line, depth)
            line = ""
        elif c == ";" and not parens:
            end(line + c, depth)
            line = ""
        elif c in "\r\n":
            line += " " if line and not line.endswith(" ") else ""
        else:
            parens = max(0, parens + (c == "(") - (c == ")"))
            line += c
        k += 1
    end(line, depth)
    return "\n".join(out)


beautify = vectorized("string")(_mapped(beautified))
