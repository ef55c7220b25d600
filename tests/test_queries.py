"""Each registered query of the reference operators against its SQL, by DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from webloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert columns
        return
    cursor = tables.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


def against_sql(spark, folder, name, table):
    """A query's rows and its SQL's, over one table of a folder."""
    got = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return sorted(map(tuple, got.collect())), sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall())


def test_cron_times_within_a_millisecond(spark, tmp_path):
    """Times whose microseconds round up to a quarter or to three o'clock, and those beside them."""
    at = [f"2024-05-{d:02d} {t}" for d in (1, 31) for t in ("00:14:59.999499", "00:14:59.999500", "00:14:59.999999", "00:15:00", "02:59:59.999600", "03:00:00", "03:00:00.000400", "23:59:59.999700")]
    rows = ", ".join(f"({k}, timestamp '{t}', 1, 'view', 1.0, '{{}}')" for k, t in enumerate(at))
    duckdb.sql(f"copy (select * from (values {rows}) t(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet' (format parquet)")
    got, want = against_sql(spark, tmp_path, "cron_next", "events")
    assert got == want and len(got) == len(at)


@pytest.mark.parametrize("name", ["html_extract_basic", "html_fallback_default", "page_text"])
def test_references_without_a_semicolon(spark, tmp_path, name):
    """Texts that are cut within a reference."""
    cut = ["a &amp;&amp;&amp", "b &quo", "c &am", "d &a", "e &quot", "f &lt", "g & h", "i &amp;lt;", "&amp;copy", "j &amp;"]
    pages = [f'<html><head><title>{c}</title></head><body><nav><ul><li><a href="/a">x</a></li></ul></nav><div class="ad">{c}</div><h1>{c}</h1><p>t {c}</p></body></html>' for c in cut]
    spark.createDataFrame([(k, f"https://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    got, want = against_sql(spark, tmp_path, name, "pages")
    assert got == want and len(got) == len(cut)


def test_every_query_has_a_home():
    assert set(ORACLES) <= set(QUERIES)


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    """Leaders and folds read rows in another order and dealt otherwise."""
    from webloom.operators import dedup, flow

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = {tuple(r) for r in dedup.leaders(dedup.fingerprints(docs.repartition(7))).collect()}
    assert one == {tuple(r) for r in dedup.leaders(dedup.fingerprints(docs.coalesce(1))).collect()}
    e = spark.range(400).selectExpr("id % 7 as key", "id as at", "id % 5 <> 0 as ok")
    fold = lambda d: {tuple(r) for r in flow.fold(d, "key", ["at"], flow.breaker_step(2, 30), flow.BREAKER).collect()}
    assert fold(e.repartition(5)) == fold(e.orderBy(e["at"].desc()))
