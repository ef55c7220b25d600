"""Tables that several queries share, in Spark and as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.capture import create_entries


Query = Callable[[SparkSession, str], DataFrame]


def registered() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    """A module's queries and their SQL, by name, and the decorator that puts them there."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log made of events: one request for each, its URL, method, status and duration."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("https://api.example.com/v1/users/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit("?k="), k).alias("url"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("time"), "props",
    )


LOG = """(select event_id, ts, user_id, event_type, case when event_type in ('purchase', 'signup') then 'POST' else 'GET' end as method,
  'https://api.example.com/v1/users/' || user_id || '/' || event_type || '?k=' || json_extract_string(props, '$.k') as url,
  case when event_type = 'error' then 500 else 200 end as status, value as time, props from events)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as captured entries with a JSON body."""
    raw = log(spark, sf_dir).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_type") == "view", "proxy").otherwise("har").alias("source"), "method", "url", "status", F.lit("application/json; charset=utf-8").alias("mime_type"),
        F.col("props").alias("response_body"), "time", (F.col("status") == 500).alias("failed"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("started"), F.col("event_id").alias("ordinal"),
    )
    return create_entries(raw)
