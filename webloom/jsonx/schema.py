"""JSON schemas inferred from samples and merged."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.udf import vectorized


def infer(v: Any) -> dict:
    """The schema of one value: type, with properties and required of objects, items of arrays."""
    if v is None:
        return {"type": "null"}
    if isinstance(v, bool):
        return {"type": "boolean"}
    if isinstance(v, int) or (isinstance(v, float) and v.is_integer()):
        return {"type": "integer"}
    if isinstance(v, float):
        return {"type": "number"}
    if isinstance(v, str):
        return {"type": "string"}
    if isinstance(v, list):
        return {"type": "array", "items": merge([infer(x) for x in v]) if v else {"type": "unknown"}}
    return {"type": "object", "properties": {k: infer(x) for k, x in v.items()}, "required": list(v)}


def merge(schemas: list[dict]) -> dict:
    """One schema of several, in their order."""
    if not schemas:
        return {"type": "unknown"}
    types = list(dict.fromkeys(s["type"] for s in schemas))
    if len(types) > 1:
        return {"type": "number"} if set(types) == {"integer", "number"} else {"type": "|".join(types)}
    if types[0] == "array":
        return {"type": "array", "items": merge([s["items"] for s in schemas if s.get("items")])}
    if types[0] != "object":
        return {"type": types[0]}
    properties: dict[str, dict] = {}
    declared: dict[str, int] = {}
    for s in schemas:
        for k, p in s.get("properties", {}).items():
            properties[k] = merge([properties[k], p]) if k in properties else p
        for k in s.get("required", s.get("properties", {})):
            declared[k] = declared.get(k, 0) + 1
    return {"type": "object", "properties": properties, "required": [k for k, n in declared.items() if n == len(schemas)]}


def dumps(s: dict | None) -> str | None:
    return None if s is None else json.dumps(s, ensure_ascii=False, separators=(",", ":"))


@vectorized("string")
def infer_schema(docs: pd.Series) -> pd.Series:
    """The schema of each row's JSON, as JSON; null where it is no JSON."""

    def one(d: str | None) -> str | None:
        try:
            return None if d is None else dumps(infer(json.loads(d)))
        except ValueError:
            return None

    return pd.Series([one(d) for d in docs], dtype=object)


def merged_schemas(samples: DataFrame, keys: list[str], body: str, order: str) -> DataFrame:
    """keys and `schema`: the merged schema of each group's JSON bodies, in the order of `order`.

    A merge depends on order, so it can't be summed in any order; but equal schemas that follow one another
    merge to themselves. Each body becomes its schema first; of each different schema of a group only its
    first place and its number go on, so a group's size in the last step is its number of shapes.
    """
    one = samples.select(*keys, F.col(order).alias("_order"), infer_schema(F.col(body)).alias("_schema")).filter("_schema is not null")
    shapes = one.groupBy(*keys, "_schema").agg(F.min("_order").alias("_first"))
    grouped = shapes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_schema"))), lambda x: x["_schema"]).alias("_shapes"))

    @F.pandas_udf("string")
    def fold(shapes: pd.Series) -> pd.Series:
        return pd.Series([dumps(merge([json.loads(x) for x in s])) for s in shapes], dtype=object)

    return grouped.select(*keys, fold("_shapes").alias("schema"))


def flat_paths(schema: dict) -> dict[str, str]:
    """Short unique names to dotted paths of the leaves; a[].b for arrays; a scalar root gives none."""
    paths: list[str] = []

    def walk(s: dict, at: str) -> None:
        if s.get("type") == "object" and s.get("properties"):
            for k, p in s["properties"].items():
                walk(p, f"{at}.{k}" if at else k)
        elif s.get("type") == "array" and at is not None:
            walk(s.get("items") or {}, f"{at}[]")
        elif at:
            paths.append(at)

    walk(schema, "")
    out: dict[str, str] = {}
    for p in paths:
        parts = [re.sub(r"\W+", "_", x.replace("[]", "")).strip("_") for x in p.split(".")]
        parts = [x for x in parts if x] or ["items"]
        name = parts[-1]
        for k in range(2, len(parts) + 1):
            if name not in out:
                break
            name = "_".join(parts[-k:])
        base, n = name, 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out[name] = p
    return out


def to_fields(schema: Column) -> Column:
    """flat_paths of a schema column, as map<string,string>."""

    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else flat_paths(json.loads(x)) for x in s], dtype=object)

    return run(schema)
