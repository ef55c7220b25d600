"""Queries of the smaller operators: texts, cookies, lookups, transforms, snippets and folds' totals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import content as C
from webloom.functions import encoding as E
from webloom.functions import headers as H
from webloom.functions import url as U
from webloom.html import extract as X
from webloom.operators import flow as W
from webloom.operators import quality as Q
from webloom.operators import traffic as T
from webloom.plans.data_queries import _CHANGES, DAY, _links, _timed, queue_replay, snapshots
from webloom.plans.tables import LOG, entries, read, registered
from webloom.session import checkpoint_folder
from webloom.sinks import core as K
from webloom.sources import capture as CAP
from webloom.streaming import runners as ST

QUERIES, ORACLES, query = registered()


@query("select doc_id, case when length(text) > 80 then left(text, 80) || chr(10) || '... (truncated)' else text end as cut from documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", E.truncate("text", 80).alias("cut"))


@query("select c_custkey, case c_custkey % 4 when 0 then 'utf-8' when 1 then 'utf-16le' when 2 then 'utf-16be' end as mark, case c_custkey % 4 when 0 then 'iso-8859-1' when 1 then 'shift_jis' when 2 then 'gbk' else 'koi8-r' end as charset from customer")
def byte_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    head = F.when(k == 0, "EFBBBF41").when(k == 1, "FFFE4100").when(k == 2, "FEFF0041").otherwise("4142")
    name = F.when(k == 0, " Latin1 ").when(k == 1, "Shift-JIS").when(k == 2, "GB2312").otherwise("KOI8-R")
    return read(spark, sf_dir, "customer").select("c_custkey", C.bom(F.unhex(head)).alias("mark"), C.normalize_charset(name).alias("charset"))


@query("select user_id, coalesce(string_agg(event_type || event_id || '=' || user_id, '; ' order by event_id) filter (where event_type <> 'error' or event_id >= 500), '') as header from events group by 1")
def cookie_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("event_id", F.concat("event_type", F.col("event_id").cast("string")).alias("name"), F.col("user_id").cast("string").alias("value"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("expires"))
    jars = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("jar"))
    return jars.select("user_id", H.cookie_header(F.col("jar"), F.lit(500)).alias("header"))


@query("with recursive e as (select o_custkey as src, o_orderkey % 1500 as dst from orders where o_custkey <> o_orderkey % 1500 and o_orderkey % 3 = 0), r as (select 0 as depth, (select min(o_custkey) from orders where o_custkey <> o_orderkey % 1500) as url union select r.depth + 1, e.dst from r join e on e.src = r.url where r.depth < 4) select url, min(depth)::int as depth from r group by 1")
def crawl_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl to depth four along every third link."""
    edges, seeds = _links(spark, sf_dir)
    return W.crawl(edges, seeds, max_depth=4, follow=F.col("pos") % 3 == 0).select("url", "depth")


@query("select c_custkey, c_name from customer")
def strict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are valid, so none raises."""
    return Q.strict(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": {"required": True, "minLength": 3}})


@query("select c_custkey, c_name like '%5' as fine from customer")
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = Q.quarantine(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": {"pattern": "5$"}})
    return good.select("c_custkey", F.lit(True).alias("fine")).unionByName(bad.select("c_custkey", F.lit(False).alias("fine")))


@query(f"select * from (select 'e' || event_id as id, url from {LOG} where event_id = (select max(event_id) from events)) union all select * from (select 'e' || event_id as id, url from {LOG} where url = (select url from {LOG} where event_id = (select max(event_id) from events)) order by event_id limit 1)")
def entry_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry by its id, and the first of its URL."""
    e = entries(spark, sf_dir)
    last = e.orderBy(F.desc("ordinal")).select("id", "url").first()
    return CAP.find(e, last["id"]).select("id", "url").unionAll(CAP.find(e, last["url"]).select("id", "url"))


@query("select event_id as request_id, event_type as method, case when event_type <> 'error' then 200 end::int as status from events")
def har_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their responses; errors have none."""
    e = read(spark, sf_dir, "events").withColumn("request_id", F.col("event_id"))
    return CAP.pair_har(e.select("request_id", F.col("event_type").alias("method")), e.filter("event_type <> 'error'").select("request_id", F.lit(200).alias("status")))


@query("select distinct user_id as id from events where user_id in (select c_custkey from customer where c_mktsegment like '%A%')")
def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = read(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return W.with_records(index, read(spark, sf_dir, "customer").filter(F.col("c_mktsegment").contains("A")).select(F.col("c_custkey").alias("id")))


@query("select user_id::varchar as key, count(*) filter (where event_type = 'click') as dequeues from events group by 1")
def queue_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last counts of each queue; what is told is how many queues were asked how often."""
    e = _timed(spark, sf_dir).select("event_id", "key", "event_type")
    done = queue_replay(spark, sf_dir).join(e, "event_id")
    sizes = W.queue_totals(done, "key", "event_id")
    asked = done.groupBy("key").agg(F.count_if(F.col("event_type") == "click").alias("dequeues"))
    return sizes.filter("n_waiting >= 0 and n_leased >= 0 and n_done >= n_dead").join(asked, "key").select("key", "dequeues")


@query(f"select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as n from {_CHANGES}) where n <= 20 and len(changes) > 0")
def changed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's last twenty runs those with changes; the number kept is the feature."""
    d = Q.snapshot_diffs(snapshots(read(spark, sf_dir, "events")), "user_id", "event_id", values=True)
    return Q.changed(d, "user_id", "event_id", most=20).select("user_id", "event_id")


@query("select n_nationkey, upper(n_name) as shout, n_name as plain from nation")
def field_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<b>"), F.initcap("n_name"), F.lit("</b><i>"), "n_name", F.lit("</i>"))
    rows = X.extract_rows(read(spark, sf_dir, "nation").select("n_nationkey", html.alias("html")), {"shout": {"selector": "b", "transform": str.upper}, "plain": "i"}, keep=("n_nationkey",))
    return rows.select("n_nationkey", "shout", "plain")


@query("select user_id, max(event_id) as event_id from events where event_type <> 'view' group by 1")
def sink_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows pass a function before they are keyed; those it empties don't count."""
    keep = lambda df: df.select(*(F.when(F.col("event_type") != "view", F.col(c)).alias(c) for c in ("user_id", "event_id")))
    sink = K.create_sink("memory", keys=["user_id"], order="event_id", transform=keep)
    sink.write(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"))
    return sink.held


@query("select 'n,name' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) order by n_nationkey) as csv, '[' || chr(10) || string_agg('  {' || chr(10) || '    \"n\": ' || n_nationkey || ',' || chr(10) || '    \"name\": \"' || n_name || '\"' || chr(10) || '  }', ',' || chr(10) order by n_nationkey) || chr(10) || ']' as json from nation")
def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that one may read in whole, as one text of two formats."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("_o"))
    return spark.createDataFrame([(K.export_text(n, "csv", "_o"), K.export_text(n, "json", "_o"))], "csv string, json string")


@query("select event_id, event_type from events")
def stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch of a stream through a sink's write."""
    at = f"{checkpoint_folder(spark)}/stream-sink-{uuid.uuid4().hex}"
    with K.sink_of("jsonl", path=f"{at}/rows", keys=["event_id"], order="event_id") as sink:
        ST.foreach_batch(ST.stream_table(spark, sf_dir, "events").select("event_id", "event_type"), sink.write, f"{at}/progress")
    return spark.read.schema("event_id long, event_type string").json(f"{at}/rows")


@query(f"""select event_id, 'const response = await fetch("' || url || '", {{' || chr(10) || '  method: "' || method || '",' || chr(10) || '}});' || chr(10) || 'const data = await response.json();' as code from {LOG}""")
def fetch_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(F.col("ordinal").alias("event_id"), T.to_fetch().alias("code"))


@query(f"""select distinct 'async function call(id1, k) {{' || chr(10) || '  // ' || method || ' ' || regexp_replace(regexp_replace(url, '[?].*$', ''), '/users/[0-9]+/', '/users/:id/') || chr(10) || '}}' || chr(10) as code from {LOG}""")
def endpoint_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.endpoints(entries(spark, sf_dir)).select(T.endpoint_script().alias("code"))


@query("select c_custkey, case c_custkey % 4 when 0 then true when 1 then true else false end as blocked from customer")
def blocked_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    url = F.when(k == 0, "http://h.example:25/x").when(k == 1, "ftp://h.example/").when(k == 2, "https://u:25@h.example/:25").otherwise("http://h.example/?p=:25")
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(U.port_blocked(url, (25, 21)), F.lit(False)).alias("blocked"))


@query(f"select user_id::varchar as key, count(*) as n, {DAY} as window_ms from events group by 1")
def alerts_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert's function gets the rows that meet its test, and all rows go on."""
    told: list[DataFrame] = []
    rows = _timed(spark, sf_dir)
    kept = Q.alert(rows, F.col("event_type") == "error", told.append)
    assert len(told) == 1
    return kept.groupBy("key").agg(F.count("*").alias("n")).withColumn("window_ms", F.lit(DAY))


@query("select c_custkey, case when c_custkey % 3 = 0 then greatest(0, 100000 - c_custkey * 1000) when c_custkey % 3 = 1 then c_custkey * 1000 end as wait_ms from customer")
def retry_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry-After as a date, as seconds, and as neither; the time of the answer moves with the customer."""
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, "Wed, 21 Oct 2015 07:28:00 GMT").when(k % 3 == 1, k.cast("string")).otherwise("soon")
    return read(spark, sf_dir, "customer").select("c_custkey", H.retry_after_ms(value, F.lit(1445412480000 - 100_000) + k * 1000).alias("wait_ms"))
