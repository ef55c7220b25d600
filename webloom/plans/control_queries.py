"""Queries of sinks, deliveries, captured sockets, counters and hooks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.html import extract as X
from webloom.operators import flow as W
from webloom.operators import quality as Q
from webloom.operators import traffic as T
from webloom.plans.data_queries import DAY, _outcomes
from webloom.plans.tables import read, registered
from webloom.session import checkpoint_folder
from webloom.sinks import core as K
from webloom.sources import capture as CAP

QUERIES, ORACLES, query = registered()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


class _Flaky:
    """A target that fails the first so many times."""

    def __init__(self, times: int) -> None:
        self.times = times

    def __call__(self, df: DataFrame) -> None:
        self.times -= 1
        if self.times >= 0:
            raise OSError("the target is away")


@query(
    """with u as (select count(*) as n, count(distinct user_id) as k from events) select 'tried again' as sink, k as written, 1 as batches, 0 as failed, 2 as retried, n - k as duplicates, 0 as buffered, true as closed from u
union all select 'given up', 0, 0, k, 1, n - k, 0, false from u union all select 'held', 0, 0, 0, 0, 0, n, false from u"""
)
def sink_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a sink whose third try succeeds, of one that gives up, and of one that still holds its rows."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    nothing = e.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema))
    keys = {"keys": ["user_id"], "order": "event_id", "retry_delay_ms": 1}
    good, bad, held = (K.create_sink("memory", **keys, **o) for o in ({"send": _Flaky(2)}, {"send": _Flaky(9), "retries": 1}, {"batch_size": 1 << 40}))
    good.write(e.unionByName(nothing))  # rows of nulls alone are dropped
    good.close()
    try:
        bad.write(e)
    except OSError:
        pass
    held.write(e)
    return spark.createDataFrame([(name, *(s.stats[c] for c in (*K.COUNTERS, "buffered", "closed"))) for name, s in (("tried again", good), ("given up", bad), ("held", held))], "sink string, written long, batches int, failed long, retried int, duplicates long, buffered long, closed boolean")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def file_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three upserts into files, the last of rows that are there already."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    path, third = _folder(spark, "file-upsert"), e.agg(F.max("event_id")).first()[0] // 3
    with K.sink_of("jsonl", path=path, keys=["user_id"], order="event_id") as sink:
        for part in (F.col("event_id") <= third, F.col("event_id") > third, F.col("event_id") > 2 * third):
            sink.write(e.filter(part))
    return spark.read.schema("user_id long, event_id long, event_type string").json(path)


@query("select 'out/name=' || replace(c_name, '#', '%23') || '/seg=' || c_mktsegment || '%20%26%20' || c_custkey || '.json' as key from customer")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit(" & "), F.col("c_custkey").cast("string")).alias("seg"))
    return c.select(K.object_key(c, ["name", "seg"], "out").alias("key"))


def _endpoint(url: str, body: bytes, headers: dict[str, str]) -> int:
    """A stand-in for a receiver: addresses say what they answer."""
    return int(url.rsplit("/", 1)[-1]) if headers["X-Webloom-Signature"] == K.sign(body.decode(), "s") else 401


@query(
    """select event_id, case event_type when 'click' then 'http://hook.example/204' when 'error' then 'http://hook.example/503' end as url, event_type = 'click' as delivered, case event_type when 'click' then 204 when 'error' then 503 end::int as status, case event_type when 'click' then 1 when 'error' then 3 else 0 end::int as attempts from events"""
)
def webhook_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.to_json(F.struct("event_id")).alias("payload"))
    got = K.deliver(e, {"click": "http://hook.example/204", "error": "http://hook.example/503"}, _endpoint, backoff_ms=0, secret="s")
    return got.select(F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"), "url", "delivered", "status", "attempts")


@query(
    """with f as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as total from events)
select 'ws' || user_id as id, 'websocket' as type, list(case when event_type = 'click' then 'sent:' else 'received:' end || event_type order by event_id) as frames, max(total) > 5 as frames_truncated from f where n <= 5 and user_id in (select distinct user_id from events order by 1 limit 10) group by user_id"""
)
def devtools_sockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the frames of a socket; of the capture's sockets the first ten, of each five frames."""
    e = read(spark, sf_dir, "events")
    opened = e.select("user_id").distinct().select(F.concat(F.lit("ws"), F.col("user_id").cast("string")).alias("request_id"), F.col("user_id").alias("seq"), F.lit("webSocketCreated").alias("type"), F.lit("ws://s.example/").alias("url"), F.lit(None).cast("string").alias("body"))
    frame = F.when(F.col("event_type") == "click", "webSocketFrameSent").otherwise("webSocketFrameReceived")
    frames = e.select(F.concat(F.lit("ws"), F.col("user_id").cast("string")).alias("request_id"), (F.col("event_id") + 1_000_000_000).alias("seq"), frame.alias("type"), F.lit(None).cast("string").alias("url"), F.col("event_type").alias("body"))
    rows = opened.unionByName(frames).withColumns({"ts": F.col("seq"), **{c: F.lit(None).cast(k) for c, k in (("method", "string"), ("status", "int"), ("mime_type", "string"), ("error", "string"))}})
    got = CAP.fold_events(rows, max_entries=10, max_frames=5)
    return got.select("id", F.col("resource_type").alias("type"), F.transform("frames", lambda f: F.concat_ws(":", f["direction"], f["payload_data"])).alias("frames"), "frames_truncated")


@query("select page_id, url, 200 as status, 'text/html; charset=utf-8' as content_type, 'utf-8' as charset, octet_length(encode(html)) as size, html as text from pages")
def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = CAP.from_pages(read(spark, sf_dir, "pages"), keep=("page_id",))
    return r.select("page_id", "url", "status", F.col("headers")["content-type"].alias("content_type"), "charset", F.octet_length("body").cast("bigint").alias("size"), "text")


@query("select count(*) as total, sum((event_type <> 'error')::int)::bigint as success, sum((event_type = 'error')::int)::bigint as failed, floor(sum((event_type <> 'error')::int) / count(*) * 1000 + 0.5) / 10 as success_rate, floor(count(*) / 60.0 * 100 + 0.5) / 100 as rps, sum(user_id)::bigint as sent, count(*) filter (where event_type = 'error' and event_id % 3 = 0) as timeout, count(*) filter (where event_type = 'error' and event_id % 3 <> 0) as http4xx from events")
def observability_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3 == 0
    o = read(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok"), F.when(k, "TIMEOUT").alias("code"), F.lit(None).cast("string").alias("name"), F.lit(418).alias("status"), F.col("user_id").alias("sent"))
    return T.totals(o, 60).select("total", "success", "failed", "success_rate", "rps", "sent", F.col("errors")["timeout"].alias("timeout"), F.col("errors")["http4xx"].alias("http4xx"))


@query(
    """with p as (select user_id % 5 as proxy, user_id as session, event_id as t, event_type <> 'error' as ok from events), l as (select proxy, max(t) filter (where ok) as last from p group by 1)
select proxy, count(*) filter (where not ok and (last is null or t > last)) as failures, count(*) filter (where not ok and (last is null or t > last)) < 3 as healthy, count(distinct session) as sessions from p join l using (proxy) group by 1"""
)
def proxy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return T.proxy_stats(e.select((F.col("user_id") % 5).alias("proxy"), F.col("user_id").alias("session"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok")))


@query("select user_id as id, count(*) as use_count, min(event_id) as created_at from events group by 1")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.session_stats(read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("at")))


@query("select user_id::varchar as key, count(*) filter (where event_type = 'error') as backoffs from events group by 1")
def throttle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = W.fold(_outcomes(spark, sf_dir), "key", ["at", "event_id"], W.throttle_step(), W.THROTTLE)
    return T.throttle_stats(done, order="event_id").select("key", "backoffs")


@query("select 'h' || user_id as hostname, 'a' || max(event_id) as address, (select max(event_id) from events) - max(event_id) as age_ms from events group by user_id having (select max(event_id) from events) - max(event_id) <= 50")
def dns_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    looked = e.select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("hostname"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("addresses"), F.col("event_id").alias("at"))
    return T.dns_stats(looked, e.agg(F.max("event_id")).first()[0], 50).select("hostname", F.col("addresses").alias("address"), "age_ms")


@query("with j as (select count(*) as n from customer), t as (select count(*) as ticks, sum((event_type = 'click')::int)::bigint as started, sum((event_type = 'error')::int)::bigint as errors, sum((event_type = 'view')::int)::bigint as skipped, arg_max(user_id, event_id) as running from events) select n as jobs, n as enabled, 0::bigint as runs, t.* from j, t")
def scheduler_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read(spark, sf_dir, "customer").select(F.lit(True).alias("enabled"), F.lit(0).alias("runs"))
    one = lambda kind: (F.col("event_type") == kind).cast("bigint")
    return W.job_stats(jobs, read(spark, sf_dir, "events").select(F.col("event_id").alias("at"), one("click").alias("started"), one("error").alias("errors"), one("view").alias("skipped"), F.col("user_id").alias("running")))


@query("select c_custkey::varchar as id, case when c_custkey % 2 = 0 then 'scan' else 'prune' end as handler, c_custkey % 3 <> 0 as ok from customer where c_custkey * 10 <= 5000 and c_custkey % 5 <> 0")
def scheduler_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due jobs go through their handler; those of a handler that isn't there don't run."""
    k = F.col("c_custkey")
    jobs = read(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.when(k % 5 == 0, "none").when(k % 2 == 0, "scan").otherwise("prune").alias("handler"), F.lit("interval").alias("kind"), F.lit(None).cast("string").alias("cron"), F.lit(1000).cast("bigint").alias("every_ms"), F.lit(None).cast("bigint").alias("at_ms"),
        F.lit(True).alias("enabled"), (k * 10).alias("next_run_at"), F.lit(None).cast("bigint").alias("last_run_at"), F.lit(0).alias("runs"),
    )
    ran = lambda df: df.withColumns({"ok": F.col("id").cast("bigint") % 3 != 0, "error": F.when(F.col("id").cast("bigint") % 3 == 0, "failed")})
    return W.run_jobs(jobs, 5000, {"scan": ran, "prune": ran})[1].select("id", "handler", "ok")


@query("select o_orderkey as item, o_orderkey % 4 <> 0 as ok, case when o_orderkey % 4 = 0 then 3 when o_orderkey % 4 = 1 then 2 else 1 end::int as attempts from orders")
def queue_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is visited; some succeed at the second try, some never."""
    tried = {"n": 0}

    def visit(items: DataFrame) -> DataFrame:
        tried["n"] += 1
        k = F.col("item") % 4
        return items.withColumn("ok", F.when(k == 0, False).when(k == 1, F.lit(tried["n"] >= 2)).otherwise(True))

    return W.work(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item")), visit)


@query("select user_id, count(*) filter (where event_id % 6 <> 0) as n, count(*) filter (where event_id % 6 = 3) as recovered from events where event_type <> 'view' group by 1")
def hook_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks before, after and on errors: one drops requests, one recovers every other failure, one was taken out again."""
    drop, twice = (lambda r: r.filter("event_type <> 'view'")), (lambda r: r.unionAll(r))
    mend = lambda r: r.filter("event_id % 6 = 3").withColumn("recovered", F.lit(True))
    hooks = Q.Hooks().use(drop, "before_request").use(mend, "on_error").use(lambda r: None).use(twice).eject(twice)
    work = lambda r: r.withColumns({"error": F.when(F.col("event_id") % 3 == 0, "E"), "recovered": F.lit(False)})
    return hooks.extract(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), work).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("recovered").alias("recovered"))


@query("select page_id, html from pages")
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), "html")
    return X.rendered(p.select("page_id", "url"), p.select("url", "html")).select("page_id", "html")


@query("select event_id, event_type, true as stamped from events")
def logged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a plugin stamped and appended to a log, read back from it."""
    path = _folder(spark, "log")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    X.logged(X.stamp(read(spark, sf_dir, "events").select("event_id", "event_type"), at), path)
    return spark.read.schema("event_id long, event_type string, scraped_at string").json(path).select("event_id", "event_type", (F.col("scraped_at") == "2024-01-02T03:04:05.000Z").alias("stamped"))


@query("select user_id::varchar as key, max(event_id) as ts, arg_max(event_type, event_id) as data from events group by 1 having max(event_id) % 2 = 0")
def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written, written again, and some deleted."""
    store, e = K.Store(spark, _folder(spark, "store")), read(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("ts"), F.col("event_type").alias("data"))
    half = e.agg(F.max("event_id")).first()[0]
    store.put(rows.filter(F.col("ts") <= half // 2))
    store.put(rows.filter(F.col("ts") > half // 2))
    store.delete(store.all().filter("ts % 2 = 1"), half + 1)
    return store.all()


@query("select count(*) as n, count(*) as places, min(turn) as first, max(turn) as last from (select row_number() over () - 1 as turn from customer)")
def shuffled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order is drawn, so what is told is that it is one: each place once."""
    s = W.shuffled(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)
    return s.agg(F.count("*").alias("n"), F.countDistinct("turn").alias("places"), F.min("turn").alias("first"), F.max("turn").alias("last"))


@query(f"with f as (select user_id, count(*) as n from events group by 1) select sum(n - 1)::bigint as joined, count(*) as started, 0 as bypassed, (select count(*) from (select event_type, row_number() over (partition by user_id order by epoch_us(ts), event_id) as k from events) where k = 1 and event_type = 'error') as failures from f, (select {DAY} as d)")
def single_flight_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that never end: each user's first one flies, the others join it."""
    e = _outcomes(spark, sf_dir).withColumn("end", F.lit(1 << 60))
    return W.single_flight_stats(W.single_flight(e, "key", "at", "end", "event_id"), ok="ok").withColumn("bypassed", F.col("bypassed").cast("int"))
