"""Declarative field extraction: one fused Python function for a whole schema, each page parsed once."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.html import css, tree


class ExtractionError(ValueError):
    code = "EXTRACTION_FAILED"


@dataclass(frozen=True)
class FieldSpec:
    """Where a field is: selectors in the order in which they are tried. (D3)"""

    selectors: tuple[str, ...]
    multiple: bool = False
    required: bool = False
    attr: str | None = None
    type: str = "text"
    default: Any = None
    pattern: str | None = None
    transform: Callable[[str], Any] | None = None

    @staticmethod
    def of(spec: Any) -> FieldSpec:
        """'css' is one text, ['css'] all texts of its first selector, a dict has every option."""
        if isinstance(spec, FieldSpec):
            return spec
        if isinstance(spec, str):
            return FieldSpec((spec,))
        if isinstance(spec, list):
            return FieldSpec((spec[0],), multiple=True, default=[])
        own = dict(spec)
        s = own.pop("selector")
        many = bool(own.get("multiple"))
        own.setdefault("default", [] if many else None)
        return FieldSpec(tuple(s) if isinstance(s, list | tuple) else (s,), **own)


def _value(n: tree.Node, spec: FieldSpec) -> Any:
    if spec.attr:
        v = n.attrs.get(spec.attr.lower())
        v = v.strip() if v is not None else None
    elif spec.type == "html":
        v = n.html()
    else:
        v = n.text().strip()
    # falsy values pass the transform by (Q5)
    return spec.transform(v) if spec.transform and v else v


def _empty(v: Any) -> bool:
    return v is None or v == "" or v == []


def extract_one(root: tree.Node, fields: dict[str, FieldSpec], strict: bool = True) -> tuple[dict, list[dict], list[str]]:
    """(data, health of each field, errors) of a parsed page."""
    data, health, errors = {}, [], []
    for name, spec in fields.items():
        value, used, tried, count = None, None, [], 0
        for s in spec.selectors:
            tried.append(s)
            found = css.select(root, s)
            if not found:
                continue
            got = [_value(n, spec) for n in found] if spec.multiple else _value(found[0], spec)
            if not _empty(got):
                value, used, count = got, s, len(found)
                break
        empty = _empty(value)
        mismatch = None
        if empty:
            if spec.required:
                errors.append(f'Required field "{name}" not found. Selectors tried: {", ".join(tried)}')
            value = spec.default
        elif spec.pattern:
            first = value[0] if isinstance(value, list) else value
            mismatch = re.search(spec.pattern, str(first)) is None
        data[name] = value
        health.append({"field": name, "selector": used, "tried": tried, "empty": empty, "count": count, "pattern_mismatch": mismatch})
    if errors and strict:
        raise ExtractionError("; ".join(errors))
    return data, health, errors


HEALTH = T.ArrayType(
    T.StructType(
        [T.StructField("field", T.StringType()), T.StructField("selector", T.StringType()), T.StructField("tried", T.ArrayType(T.StringType())), T.StructField("empty", T.BooleanType()), T.StructField("count", T.IntegerType()), T.StructField("pattern_mismatch", T.BooleanType())]
    )
)


def _text(v: Any, multiple: bool) -> Any:
    s = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    return [s(x) for x in v] if multiple and v is not None else s(v)


def extract(html: Column | str, schema: dict[str, Any], on_error: str = "null") -> Column:
    """struct<data, health, errors> of a page by a schema field -> spec.

    data has a string for each field, an array of strings where it is `multiple`. Of several selectors the
    first whose result isn't empty counts. A required field that stays empty raises with on_error='raise';
    with 'null' it is listed in errors. A null page counts as an empty one.
    """
    fields = {k: FieldSpec.of(v) for k, v in schema.items()}
    row = T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if s.multiple else T.StringType()) for k, s in fields.items()])
    kind = T.StructType([T.StructField("data", row), T.StructField("health", HEALTH), T.StructField("errors", T.ArrayType(T.StringType()))])

    @F.pandas_udf(kind)
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            out = {"data": [], "health": [], "errors": []}
            for page in batch:
                data, health, errors = extract_one(tree.parse(page), fields, on_error == "raise")
                out["data"].append({k: _text(v, fields[k].multiple) for k, v in data.items()})
                out["health"].append(health)
                out["errors"].append(errors)
            yield pd.DataFrame({"data": pd.Series(out["data"], dtype=object), "health": pd.Series(out["health"], dtype=object), "errors": pd.Series(out["errors"], dtype=object)})

    return run(F.col(html) if isinstance(html, str) else html)


def extract_rows(pages: DataFrame, schema: dict[str, Any], html: str = "html", keep: tuple[str, ...] = ("url",), on_error: str = "null") -> DataFrame:
    """`keep` columns, a column for each field, and _health and _errors.

    Only what is kept and the page itself reach Python; filters on other columns stay before it.
    """
    out = pages.select(*keep, extract(html, schema, on_error).alias("_x"))
    return out.select(*keep, *(F.col("_x.data")[k].alias(k) for k in schema), F.col("_x.health").alias("_health"), F.col("_x.errors").alias("_errors"))


def mask(df: DataFrame, fields: list[str]) -> DataFrame:
    """Named top-level columns that are there become '[redacted]'."""
    return df.withColumns({f: F.lit("[redacted]") for f in fields if f in df.columns})


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """(E27)"""
    return df.withColumnsRenamed(names)


def stamp(df: DataFrame, at: Column | None = None, name: str = "scraped_at") -> DataFrame:
    """A time stamp as ISO text."""
    return df.withColumn(name, F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def logged(df: DataFrame, path: str) -> DataFrame:
    """Append the rows as lines of JSON to the files at a path, and give the rows back."""
    from webloom.sinks.core import write_files

    write_files(df, path)
    return df


def rendered(urls: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """urls with the html that a renderer left in pages(url, html); null where there is none."""
    return urls.join(pages.groupBy(url).agg(F.max("html").alias("html")), url, "left")
