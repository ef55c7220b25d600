"""Keyed upserts, sinks by name, SQL statements and exports."""

from __future__ import annotations

import functools
import hashlib
import hmac
import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.encoding import csv_field, flatten_value
from webloom.session import checkpointed

BATCH = 500


class SinkError(ValueError):
    code = "SINK_ERROR"


def collapse(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of one key the last, at the place of the first. A null in a key raises. (K2, Q17)

    The place is the column _position. The last row is an aggregate, so rows are combined before the shuffle.
    """
    checked = df
    for k in keys:
        checked = checked.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"key field {k} is missing")).cast(df.schema[k].dataType)).otherwise(F.col(k)))
    rest = [c for c in df.columns if c not in keys]
    got = checked.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"), F.min(order).alias("_position"))
    return got.select(*(F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns), "_position")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, place: bool = False) -> DataFrame:
    """old with new's rows put in: of each key the last row, those of new after those of old.

    Rows come in no order; with `place` the column _position tells it: an old key's place, new keys after.
    """
    a = old.withColumn("_gen", F.lit(0))
    b = new.withColumn("_gen", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_order", F.struct("_gen", F.col(order)))
    return collapse(both, keys, "_order").drop("_gen", "_order", *([] if place else ["_position"]))


def union_all(*parts: DataFrame) -> DataFrame:
    """Columns in first-seen order, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --- SQL (K7, S36) -------------------------------------------------------------------------------------------


def quote_identifier(name: str, dialect: str = "postgres") -> str:
    q = "`" if dialect == "mysql" else '"'
    return ".".join(q + p.replace(q, q * 2) + q for p in name.split("."))


def placeholders(rows: int, columns: int, dialect: str = "postgres") -> str:
    one = lambda r: ", ".join("?" if dialect == "mysql" else f"${r * columns + c + 1}" for c in range(columns))
    return ", ".join(f"({one(r)})" for r in range(rows))


def upsert_statement(table: str, columns: list[str], rows: int, keys: list[str] = (), dialect: str = "postgres") -> str:
    """INSERT of several rows with the dialect's upsert. (K7)"""
    q = lambda n: quote_identifier(n, dialect)
    sql = f"INSERT INTO {q(table)} ({', '.join(map(q, columns))}) VALUES {placeholders(rows, len(columns), dialect)}"
    if not keys:
        return sql
    rest = [c for c in columns if c not in keys]
    if dialect == "mysql":
        sets = ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest or list(keys)[:1])
        return f"{sql} ON DUPLICATE KEY UPDATE {sets}"
    if not rest:
        return f"{sql} ON CONFLICT ({', '.join(map(q, keys))}) DO NOTHING"
    return f"{sql} ON CONFLICT ({', '.join(map(q, keys))}) DO UPDATE SET " + ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in rest)


def write_sql(df: DataFrame, connect: Callable[[], Any], table: str, keys: list[str] = (), dialect: str = "postgres", batch: int = BATCH) -> None:
    """Rows by multi-row upserts, a connection for each partition. `connect` gives a DB-API connection. (K8)

    A task that is run again writes the same keys again, so a retry changes nothing; without keys it may repeat rows.
    """
    columns = df.columns

    def send(rows: Iterator) -> None:
        connection = connect()
        try:
            cursor, held = connection.cursor(), []

            def flush() -> None:
                sql = upsert_statement(table, columns, len(held), keys, dialect)
                sql = re.sub(r"\$\d+|\?", "%s", sql)
                cursor.execute(sql, [v for r in held for v in r])
                held.clear()

            for r in rows:
                held.append(tuple(r))
                if len(held) >= batch:
                    flush()
            if held:
                flush()
            connection.commit()
        finally:
            connection.close()

    df.foreachPartition(send)


# --- exports (K13-K17, Q24) ----------------------------------------------------------------------------------


def flat(df: DataFrame) -> DataFrame:
    """Every value as text: null empty, arrays joined, objects as JSON."""
    return df.select(*(flatten_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema))


def csv_line(df: DataFrame) -> Column:
    """(K13)"""
    return F.array_join(F.array(*(csv_field(flatten_value(F.col(f.name), f.dataType)) for f in df.schema)), ",")


def csv_header(df: DataFrame) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if re.search('[,"\n]', c) else c for c in df.columns)


def json_line(df: DataFrame) -> Column:
    """(K14)"""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def markdown_line(df: DataFrame) -> Column:
    """(K15)"""
    cell = lambda f: F.replace(F.replace(flatten_value(F.col(f.name), f.dataType), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("| "), F.array_join(F.array(*(cell(f) for f in df.schema)), " | "), F.lit(" |"))


def markdown_head(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |"


LINES = {"csv": csv_line, "ndjson": json_line, "jsonl": json_line, "markdown": markdown_line, "json": json_line}


def export_lines(df: DataFrame, kind: str, order: str | None = None) -> DataFrame:
    """(ordinal?, line): the body's lines in a format; an unknown format raises."""
    if kind not in LINES:
        raise SinkError(f"unknown export format: {kind}")
    body = df.drop(order) if order else df
    return df.select(*([F.col(order).alias("ordinal")] if order else []), LINES[kind](body).alias("line"))


def export_text(df: DataFrame, kind: str, order: str) -> str:
    """One text of a table that one may read in whole; larger ones go to files."""
    body = df.drop(order)
    lines = [r[0] for r in df.orderBy(order).select(LINES[kind](body)).collect()] if kind in LINES else export_lines(df, kind)
    if kind == "csv":
        return "\n".join([csv_header(body), *lines])
    if kind == "markdown":
        return "\n".join([markdown_head(body), *lines])
    if kind == "json":
        return json.dumps([json.loads(x) for x in lines], indent=2, ensure_ascii=False)
    return "\n".join(lines)


def write_files(df: DataFrame, path: str, kind: str = "jsonl", mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Files of JSON lines or CSV, keys as directories where they are given."""
    if kind in ("jsonl", "ndjson", "json"):
        w = df.write.mode(mode).option("ignoreNullFields", "false")
        (w.partitionBy(*partition_by) if partition_by else w).json(path)
    elif kind == "csv":
        body = df if partition_by is None else df.select(*partition_by, *(c for c in df.columns if c not in partition_by))
        flatten = flat(body) if partition_by is None else body.select(*partition_by, *(flatten_value(F.col(f.name), f.dataType).alias(f.name) for f in body.schema if f.name not in partition_by))
        w = flatten.write.mode(mode).option("header", True).option("escape", '"')
        (w.partitionBy(*partition_by) if partition_by else w).csv(path)
    else:
        raise SinkError(f"unknown file format: {kind}")


def _files(spark: SparkSession, path: str):
    """(Hadoop path maker, file system) of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def upsert_files(spark: SparkSession, new: DataFrame, path: str, keys: list[str], order: str, kind: str = "jsonl") -> None:
    """Load, put in, write beside, and swap the directories by Spark's own file system. (K6)

    The target is renamed aside before the new folder takes its name, and is deleted last. So at every moment
    one of the two is whole; a run that finds only the one aside puts it back first. Rows are in no order: the
    order column tells it.
    """
    at, fs = _files(spark, path)
    aside = at(f"{path}.before")
    if fs.exists(aside):
        if fs.exists(at(path)):
            fs.delete(aside, True)  # the swap was done, and only the clearing up was not
        elif not fs.rename(aside, at(path)):
            raise SinkError(f"could not put {path}.before back")
    staged = at(f"{path}.{uuid.uuid4().hex}")
    if fs.exists(at(path)):
        old = spark.read.json(path) if kind != "csv" else spark.read.csv(path, header=True, escape='"')
        if order not in old.columns:
            old = old.withColumn(order, F.lit(None).cast(new.schema[order].dataType))
        rows = upsert(old, new, keys, order)
    else:
        rows = collapse(new, keys, order).drop("_position")
    write_files(rows, staged.toString(), kind, "errorifexists")
    if fs.exists(at(path)) and not fs.rename(at(path), aside):
        raise SinkError(f"could not move {path} aside")
    if not fs.rename(staged, at(path)):
        if fs.exists(aside):
            fs.rename(aside, at(path))
        raise SinkError(f"could not give {path} its new rows")
    if fs.exists(aside):
        fs.delete(aside, True)


def json_each_row(df: DataFrame, insert: Callable[[str, bytes], Any], table: str, batch: int = BATCH) -> None:
    """Rows as lines of JSON, a statement and a body for each batch of a partition. (K9)

    insert(query, body) sends them; null values stay, so that every row has all columns.
    """
    query = f"INSERT INTO {quote_identifier(table)} ({', '.join(map(quote_identifier, df.columns))}) FORMAT JSONEachRow"

    def send(rows: Iterator) -> None:
        held: list[str] = []
        for r in rows:
            held.append(r[0])
            if len(held) >= batch:
                insert(query, "\n".join(held).encode())
                held.clear()
        if held:
            insert(query, "\n".join(held).encode())

    df.select(json_line(df)).foreachPartition(send)


def object_key(df: DataFrame, keys: list[str], prefix: str = "", kind: str = "json") -> Column:
    """prefix/name=value/name=value.json, values percent-encoded."""
    prefix = f"{prefix}/" if prefix and not prefix.endswith("/") else prefix
    # url_encode is for forms; an address keeps these marks, and writes a space as %20
    value = lambda c: functools.reduce(lambda e, m: F.replace(e, F.lit(m[0]), F.lit(m[1])), (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")), F.url_encode(F.col(c).cast("string")))
    return F.concat(F.lit(prefix), F.array_join(F.array(*(F.concat(F.lit(f"{k}="), value(k)) for k in keys)), "/"), F.lit(".csv" if kind == "csv" else ".json"))


def put_objects(df: DataFrame, put: Callable[[str, bytes, str], Any], keys: list[str], prefix: str = "", kind: str = "json") -> None:
    """One object for each row, by put(key, body, content type); a row that is written again replaces itself."""
    if kind not in CONTENT_TYPES:
        raise SinkError(f"unknown object format: {kind}")
    body = F.concat(F.lit(csv_header(df) + "\n"), csv_line(df)) if kind == "csv" else json_line(df)

    def send(rows: Iterator) -> None:
        for key, text in rows:
            put(key, (text if kind == "csv" else json.dumps(json.loads(text), indent=2, ensure_ascii=False)).encode(), CONTENT_TYPES[kind])

    df.select(object_key(df, keys, prefix, kind), body).foreachPartition(send)


# --- sinks by name (K1, K3-K5, K11, K24, A13) ----------------------------------------------------------------

KINDS = {"memory": "memory", "file": "file", "jsonl": "file", "csv": "file", "postgres": "sql", "postgresql": "sql", "pg": "sql", "mysql": "sql", "mariadb": "sql", "clickhouse": "sql", "s3": "file"}
CONTENT_TYPES = {"json": "application/json", "jsonl": "application/x-ndjson", "csv": "text/csv"}
COUNTERS = ("written", "batches", "failed", "retried", "duplicates")


@dataclass
class Sink:
    """Where rows go: `write` takes rows; keys make them an upsert, else they are appended.

    Rows are checkpointed as they come and held until there are `batch_size` of them, `flush_interval_ms` has
    passed since the last batch, or flush() or close() is called; without either each write is a batch. A
    batch that fails is tried again `retries` times, after retry_delay_ms, twice that, and so on; then its rows
    count as failed and the error is raised, or goes to on_error where a write was due by time.
    """

    kind: str
    options: dict[str, Any] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    held: DataFrame | None = None
    pending: list[DataFrame] = field(default_factory=list)
    buffered: int = 0
    closed: bool = False
    flushed: float = field(default_factory=time.monotonic)

    @property
    def stats(self) -> dict[str, Any]:
        """(A13)"""
        return {**self.counts, "buffered": self.buffered, "closed": self.closed}

    def write(self, df: DataFrame) -> int:
        """The number of rows taken. Rows of which the transform leaves nothing but nulls are dropped."""
        if self.closed:
            raise SinkError("the sink is closed")
        o = self.options
        if transform := o.get("transform"):
            df = df.transform(transform)
        df = checkpointed(df.filter(functools.reduce(lambda a, c: a | F.col(c).isNotNull(), df.columns, F.lit(False))))
        n = df.count()
        if n:
            self.pending.append(df)
            self.buffered += n
        size, interval = o.get("batch_size"), o.get("flush_interval_ms")
        due = interval is not None and (time.monotonic() - self.flushed) * 1000 >= interval
        if (size is None and interval is None) or (size is not None and self.buffered >= size):
            self.flush()
        elif due:
            try:
                self.flush()
            except Exception as e:  # as a timer would: the caller's own write did not fail
                if o.get("on_error") is None:
                    raise
                o["on_error"](e)
        return n

    def flush(self) -> int:
        """The number of rows written."""
        self.flushed = time.monotonic()
        if not self.pending:
            return 0
        o, n = self.options, self.buffered
        df, self.pending, self.buffered = union_all(*self.pending), [], 0
        keys = o.get("keys") if o.get("replace", True) else None
        if keys:
            df = checkpointed(collapse(df, keys, o["order"]).drop("_position"))
            kept = df.count()
            self.counts["duplicates"] += n - kept
            n = kept
        retries, wait = o.get("retries", 2), o.get("retry_delay_ms", 200)
        for attempt in range(retries + 1):
            try:
                self._deliver(df, keys)
            except Exception:
                if attempt == retries:
                    self.counts["failed"] += n
                    raise
                self.counts["retried"] += 1
                time.sleep(wait * 2**attempt / 1000)
            else:
                self.counts["written"] += n
                self.counts["batches"] += 1
                return n
        return 0

    def close(self) -> dict[str, Any]:
        if not self.closed:
            try:
                self.flush()
            finally:
                self.closed = True
        return self.stats

    def _deliver(self, df: DataFrame, keys: list[str] | None) -> None:
        o, how = self.options, KINDS[self.kind]
        if send := o.get("send"):
            send(df)
        elif how == "memory":
            if self.held is None:
                self.held = df
            else:
                self.held = checkpointed(upsert(self.held, df, keys, o["order"]) if keys else union_all(self.held, df))
        elif self.kind == "clickhouse":
            json_each_row(df, o["insert"], o["table"], o.get("rows", BATCH))
        elif how == "sql":
            write_sql(df, o["connect"], o["table"], keys or (), "mysql" if self.kind in ("mysql", "mariadb") else "postgres", o.get("rows", BATCH))
        elif self.kind == "s3" and keys and "put" in o:
            put_objects(df, o["put"], keys, o.get("prefix", ""), o.get("format", "json"))
        elif keys and self.kind != "s3":
            upsert_files(df.sparkSession, df, o["path"], keys, o["order"], "csv" if self.kind == "csv" else "jsonl")
        else:
            write_files(df, o["path"], "csv" if self.kind == "csv" else o.get("format", "jsonl"), "append" if self.kind != "s3" or not keys else "overwrite", keys if self.kind == "s3" else None)


def create_sink(kind: str | Sink, **options) -> Sink:
    """A sink by name; a sink passes through; an unknown name raises."""
    if isinstance(kind, Sink):
        return kind
    if kind not in KINDS:
        raise SinkError(f"unknown sink: {kind}")
    return Sink(kind, options)


@contextmanager
def sink_of(kind: str | Sink, **options):
    """A sink for a with-block, closed at its end; a sink of the caller's own is only flushed."""
    sink = create_sink(kind, **options)
    yield sink
    if sink is kind:
        sink.flush()
    else:
        sink.close()


def sign(payload: str, secret: str) -> str:
    """The HMAC-SHA256 signature of a payload."""
    return "sha256=" + hmac.new(secret.encode(), payload.encode(), hashlib.sha256).hexdigest()


def post(url: str, body: bytes, headers: dict[str, str], timeout: float = 8.0) -> int:
    """The status of a POST; 0 where there is no response."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code
    except (OSError, ValueError):
        return 0


def deliver(events: DataFrame, urls: dict[str, str], send: Callable[[str, bytes, dict[str, str]], int] = post, retries: int = 2, backoff_ms: int = 500, secret: str | None = None, header: str = "X-Webloom") -> DataFrame:
    """(event, payload, url, delivered, status, attempts) of events(event, payload) sent to their webhooks.

    An event without an address is skipped: its url is null. payload is the JSON text that is sent. A status
    under 400 is a delivery; others are tried again `retries` times, after backoff_ms, twice that, and so on.
    Each row is sent where its partition runs, and at least once: a task that is run again sends again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for event, payload in zip(b["event"], b["payload"], strict=True):
                url, status, n = urls.get(event), None, 0
                body = (payload or "").encode()
                headers = {"Content-Type": "application/json", f"{header}-Event": str(event)} | ({f"{header}-Signature": sign(payload or "", secret)} if secret else {})
                while url and n <= retries:
                    if n:
                        time.sleep(backoff_ms * 2 ** (n - 1) / 1000)
                    status, n = send(url, body, headers), n + 1
                    if 0 < status < 400:
                        break
                out.append((event, payload, url, status is not None and 0 < status < 400, status, n))
            found = pd.DataFrame(out, columns=["event", "payload", "url", "delivered", "status", "attempts"])
            yield found.astype({"status": "Int32", "attempts": "int32"})

    return events.select("event", "payload").mapInPandas(run, "event string, payload string, url string, delivered boolean, status int, attempts int")


class Store:
    """Snapshots by key in files: every write and deletion is kept, the last of a key counts.

    The same four calls over any other backend take its place.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame) -> None:
        """rows(key, ts, data); null data deletes."""
        rows.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("bigint").alias("ts"), F.col("data").cast("string").alias("data")).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        from webloom.sources.formats import kv_latest

        at, fs = _files(self.spark, self.path)
        kind = "key string, ts bigint, data string"
        return kv_latest(self.spark.read.schema(kind).parquet(self.path) if fs.exists(at(self.path)) else self.spark.createDataFrame([], kind))

    def get(self, key: str) -> DataFrame:
        return self.all().filter(F.col("key") == key)

    def delete(self, keys: DataFrame, ts: int) -> None:
        self.put(keys.select("key", F.lit(ts).alias("ts"), F.lit(None).cast("string").alias("data")))
