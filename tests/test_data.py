"""JSON, captures, quality, deduplication, replays and sinks on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from webloom.jsonx import paths, schema
from webloom.operators import dedup, flow, quality, traffic
from webloom.plans import registry
from webloom.sinks import core
from webloom.sources import capture, formats
from webloom.streaming import monitors, runners

STORE = {"store": {"book": [{"title": "A", "price": 10, "author": {"name": "x"}}, {"title": "B", "price": 20}, {"title": "C", "price": 30}]}, "total": 3}


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$.store.book[*].title", ["A", "B", "C"]),
        ("$.store.book[0].title", ["A"]),
        ("$.store.book[-1].title", ["C"]),
        ("$.store.book[0:2].title", ["A", "B"]),
        ("$.store.book[0,2].title", ["A", "C"]),
        ("$.store.book[?(@.price > 15)].title", ["B", "C"]),
        ("$.store.book[?(@.title == 'B')].price", [20]),
        ("$.store.book[?(@.title =~ /a/i)].price", [10]),
        ("$..name", ["x"]),
        ("$.total", [3]),
        ("$.missing", []),
        ("$['store']['book'][1]['title']", ["B"]),
    ],
)
def test_json_path(path, want):
    assert paths.evaluate(paths.parse(path), STORE) == want


@pytest.mark.parametrize("bad", ["a.b", "$.a[", "$.a[?(nonsense)]", "$."])
def test_bad_path(bad):
    with pytest.raises(paths.JsonPathError):
        paths.parse(bad)


def test_native_subset():
    assert paths.native_path("$.a.b[0]") == "$.a.b[0]"
    assert paths.native_path("$.a[-1]") is None and paths.native_path("$..a") is None


def test_json_extract(spark):
    df = spark.createDataFrame([(json.dumps({"data": {"items": [{"t": "a"}, {"t": "b"}], "s": ""}}),), (None,), ("{bad",)], "j string")
    got = [r.m for r in df.select(paths.extract("j", {"ts": "data.items[].t", "star": "data.items[*].t", "one": "$.data.items[0].t", "s": "data.s", "d": {"path": ["x", "y"], "default": 1}}).alias("m")).collect()]
    assert got[0] == {"ts": '["a","b"]', "star": '["a","b"]', "one": '"a"', "s": '""', "d": "1"}
    assert got[1]["ts"] is None and got[2]["d"] == "1"


def test_schema_merge():
    a, b = {"id": 1, "tags": ["x"], "total": 1}, {"id": 2, "tags": [], "total": 1.5, "extra": None}
    s = schema.merge([schema.infer(a), schema.infer(b)])
    assert s["required"] == ["id", "tags", "total"]
    assert s["properties"]["total"] == {"type": "number"} and s["properties"]["id"] == {"type": "integer"}
    assert schema.merge([{"type": "string"}, {"type": "null"}]) == {"type": "string|null"}
    assert schema.flat_paths(schema.infer({"items": [{"id": 1}], "data": {"id": 2}})) == {"id": "items[].id", "data_id": "data.id"}
    assert schema.flat_paths({"type": "string"}) == {}


HAR = {
    "log": {
        "entries": [
            {"time": 5.0, "_resourceType": "xhr", "request": {"method": "get", "url": "https://h.example/a?x=1", "headers": [{"name": "Authorization", "value": "s"}]}, "response": {"status": 200, "headers": [], "content": {"mimeType": "application/json", "text": "eyJhIjoxfQ==", "encoding": "base64"}}},
            {"time": 1.0, "_error": "net", "request": {"method": "POST", "url": "https://h.example/b", "headers": [], "postData": {"params": [{"name": "p", "value": "q"}]}}, "response": {"status": 0, "headers": [], "content": {}}},
        ]
    }
}


def test_har(spark):
    rows = capture.parse_har(spark.createDataFrame([(json.dumps(HAR),)], "har string")).orderBy("ordinal").collect()
    assert (rows[0].method, rows[0].response_body, rows[0].resource_type, rows[0].failed) == ("GET", '{"a":1}', "xhr", False)
    assert (rows[1].request_body, rows[1].failed) == ("p=q", True)
    with pytest.raises(Exception, match="entries"):
        capture.parse_har(spark.createDataFrame([("{}",)], "har string")).collect()


def test_frames():
    data = bytes([0x81, 0x02]) + b"hi" + bytes([0x82, 0x83, 1, 2, 3, 4]) + bytes(x ^ m for x, m in zip(b"abc", (1, 2, 3), strict=True)) + bytes([0x81, 0x05]) + b"x"
    frames, rest = capture.decoded_frames(data)
    assert [(f["fin"], f["opcode"], f["payload"]) for f in frames] == [(True, 1, b"hi"), (True, 2, b"abc")]
    assert rest == bytes([0x81, 0x05]) + b"x"


def test_messages(spark):
    rows = [(1, 1, False, 1, b'{"a"'), (1, 2, True, 9, b""), (1, 3, True, 0, b":1}"), (1, 4, True, 0, b"orphan"), (1, 5, False, 1, b"lost"), (1, 6, True, 1, b"x")]
    got = capture.messages(spark.createDataFrame(rows, "k int, n int, fin boolean, opcode int, payload binary"), "k", "n").orderBy("first").collect()
    assert [(bytes(r.payload), r.kind) for r in got] == [(b'{"a":1}', "message"), (b"x", "raw")]


def test_csv():
    assert formats.csv_rows('name,price\r\n"Buku B, edisi ""2""",75000\n\nx\n') == [{"name": 'Buku B, edisi "2"', "price": "75000"}, {"name": "x", "price": ""}]
    assert formats.csv_rows("") == []


def test_feeds():
    rss = formats.feed("<rss><channel><title>T</title><item><title>a</title><link>l</link></item></channel></rss>")
    assert (rss["type"], rss["title"], rss["items"][0]["link"]) == ("rss", "T", "l")
    atom = formats.feed("<feed><title>T</title><entry><title>a</title><link href='h'/><content>c</content></entry></feed>")
    assert (atom["type"], atom["items"][0]["link"], atom["items"][0]["body"]) == ("atom", "h", "c")
    assert formats.feed("<html></html>")["type"] == "unknown"


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private/\nAllow: /private/public-page\nCrawl-delay: 2\nDisallow:\n\nUser-agent: badbot\nDisallow: /"
    rules = formats.robots_rules(spark.createDataFrame([("h.example", text)], "host string, robots string"))
    urls = spark.createDataFrame([("http://h.example/private/x",), ("http://h.example/private/public-page",), ("http://o.example/",)], "url string")
    ask = lambda agent: {r.url.rsplit("/", 1)[-1]: r.allowed for r in formats.robots_allowed(urls, rules, agent).collect()}
    assert ask("mybot") == {"x": False, "public-page": True, "": True}
    assert ask("BadBot/1.0") == {"x": False, "public-page": False, "": True}


def test_validation(spark):
    df = spark.createDataFrame([("a", "12abc", "  ", ["x"]), (None, "x", "ok", [])], "a string, n string, s string, t array<string>")
    rows = quality.validated(df, {"a": {"required": True, "minLength": 2}, "n": {"type": "number"}, "s": {"notEmpty": True}, "t": {"minItems": 2}}).collect()
    first, second = (r["_validation"] for r in rows)
    assert [e["rule"] for e in first["errors"]] == ["notEmpty"] and [w["rule"] for w in first["warnings"]] == ["minLength", "minItems"]
    assert [(e["field"], e["rule"]) for e in second["errors"]] == [("a", "required"), ("n", "type")]
    with pytest.raises(Exception, match="validation failed"):
        quality.strict(df, {"a": {"required": True}}).collect()


def test_health(spark):
    runs = spark.createDataFrame([("u", "f", k, c == 0, c, False) for k, c in enumerate([10, 10, 10, 1])], "url string, field string, seq long, empty boolean, cnt int, pattern_mismatch boolean")
    assert quality.health(runs).orderBy("seq").collect()[-1].alerts == ["count_drop"]
    empty = spark.createDataFrame([("u", "f", k, True, 0, False) for k in range(3)], "url string, field string, seq long, empty boolean, cnt int, pattern_mismatch boolean")
    assert quality.health(empty).orderBy("seq").collect()[-1].alerts == ["high_empty_rate"]


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [
        ('{"a":1,"b":"x","d":null}', '{"a":2,"e":"y","d":3}', [("keys_added", "info", "e"), ("keys_removed", "critical", "b"), ("fields_recovered", "info", "d"), ("value_changed", "info", "a"), ("value_changed", "info", "d")]),
        ('{"a":"x"}', '{"a":"","n":null}', [("keys_added", "info", "n"), ("fields_became_null", "warn", "a,n"), ("value_changed", "info", "a")]),
        ("""{"it's":1,"a.b":{"x":[1]}}""", """{"it's":2,"a.b":{"x":[1]}}""", [("value_changed", "info", "it's")]),
        ('[{"a":1},{"a":2}]', '[{"b":1}]', [("count_changed", "warn", None), ("item_schema_changed", "critical", None)]),
        ("[1,2,3]", "[1,2]", [("count_changed", "info", None)]),
        ("[]", "[[5]]", [("count_changed", "warn", None), ("item_schema_changed", "critical", None)]),
        ("[1]", "{}", [("type_changed", "critical", None)]),
        ("null", "{}", [("type_changed", "critical", None)]),
        ("1", "2", []),
        ('{"a":[1,2]}', '{"a":[1,2]}', []),
    ],
)
def test_diff(spark, before, after, want):
    """In a table and in a stream's step alike."""
    h = spark.createDataFrame([("k", 1, before), ("k", 2, None), ("k", 3, after)], "key string, seq int, data string")
    got = quality.snapshot_diffs(h, values=True).orderBy("seq").collect()
    assert got[0].first_run and got[0].changes == [] and got[0].has_warn is None and got[1].changes == []
    assert [(c["type"], c["severity"], c["field"]) for c in got[2].changes] == want
    assert got[2].has_critical == any(s == "critical" for _, s, _ in want) and got[2].has_warn == any(s != "info" for _, s, _ in want)
    step, s = monitors.diff_step(values=True), {}
    told = [step(s, {"data": d}) for d in (before, None, after)]
    assert [(c["type"], c["severity"], c.get("field") or (",".join(c["keys"]) if "keys" in c else None)) for c in json.loads(told[2]["changes"])] == want
    assert (told[0]["first_run"], told[2]["has_critical"], told[2]["has_warn"]) == (True, got[2].has_critical, got[2].has_warn)
    for c in got[2].changes:
        same = next(x for x in json.loads(told[2]["changes"]) if x["type"] == c["type"] and x.get("field", c["field"]) == c["field"])
        assert (c["from"], c["to"], c["delta"]) == (same.get("from"), same.get("to"), same.get("delta"))


def test_diff_of_what_is_not_json(spark):
    h = spark.createDataFrame([("k", 1, "{bad"), ("k", 2, "{}")], "key string, seq int, data string")
    assert [c["from"] for r in quality.snapshot_diffs(h).collect() for c in r.changes] == ["undefined"]


def test_simhash():
    assert dedup.simhash_of("") == 0 and dedup.simhash_of(None) == 0 and dedup.simhash_of("!!!") == 0
    # one gram: the fingerprint is its hash
    assert dedup.simhash_of("Hello, World") == dedup.fnv1a64("hello world")
    assert dedup.fnv1a64("") == 0xCBF29CE484222325 and dedup.fnv1a64("a") == 0xAF63DC4C8601EC8C


@pytest.mark.parametrize("n", [10, 1 << 22, 1 << 36])
@pytest.mark.parametrize("threshold", [0, 1, 3, 6])
def test_near_fingerprints_share_a_band(n, threshold):
    rng, masks = random.Random(n), [m & (2**64 - 1) for m in dedup.bands(n, threshold)]
    for _ in range(300):
        apart = sum(1 << b for b in rng.sample(range(64), threshold))
        assert any(apart & m == 0 for m in masks)


def test_simhashes_of_a_batch():
    rng = random.Random(2)
    texts = [None, "", "!", "one", "one two", "x" * 3000 + " y z", "😀 x😀"] + ["".join(rng.choice("abC 1\n\té.-") for _ in range(rng.randrange(200))) for _ in range(150)]

    def slow(t):
        w = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789 \n\t" or ord(c) >= 0xC0 else " " for c in (t or "").lower()).split()
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        votes = [sum(1 if dedup.fnv1a64(g) >> b & 1 else -1 for g in grams) for b in range(64)]
        return sum(1 << b for b in range(64) if votes[b] > 0)

    assert dedup.simhashes(texts).tolist() == list(map(slow, texts))


def test_leaders_equal_the_sequential_choice(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = [(k, base[rng.randrange(12)] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))) for k in range(300)]
    held, want = [], {}
    for k, fp in prints:
        want[k] = any((fp ^ o).bit_count() <= 3 for o in held)
        if not want[k]:
            held.append(fp)
    signed = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in prints]
    got = {r.doc_id: r.is_duplicate for r in dedup.leaders(spark.createDataFrame(signed, "doc_id long, fingerprint long")).collect()}
    assert got == want


def test_block_verdict(spark):
    ask = lambda status, headers, body, **k: spark.range(1).select(quality.block_verdict(F.lit(status), F.create_map(*[F.lit(x) for kv in headers.items() for x in kv]).cast("map<string,string>"), F.lit(body), **k).alias("v")).first()["v"]
    assert (ask(200, {"server": "cloudflare"}, "hello")["vendor"], ask(200, {"server": "cloudflare"}, "hello")["confidence"]) == ("cloudflare", "high")
    assert ask(404, {"a": "b"}, "gone")["blocked"] is False
    assert ask(403, {"a": "b"}, "no")["kind"] == "denied"
    assert ask(200, {"a": "b"}, "<div class=h-captcha>")["kind"] == "captcha"
    assert ask(429, {"a": "b"}, "x")["retryable"] is True


def test_breaker():
    step, s = flow.breaker_step(2, 1000), {}
    ask = lambda at, ok: step(s, {"at": at, "ok": ok})["next_state"]
    assert [ask(0, False), ask(1, False), ask(500, True), ask(1001, True)] == ["closed", "open", "open", "closed"]


def test_throttle():
    step, s = flow.throttle_step(initial=4, every=2), {}
    assert [step(s, {"ok": ok})["slots"] for ok in (False, False, True, True)] == [2, 1, 1, 2]


def test_queue():
    step, s = flow.queue_step(40, 2), {}
    do = lambda at, op, item=None, p=None: step(s, {"at": at, "op": op, "item": item, "priority": p})
    do(0, "enqueue", "low", 10)
    do(1, "enqueue", "high", 0)
    assert do(2, "dequeue")["leased_item"] == "high" and do(3, "dequeue")["leased_item"] == "low"
    assert do(4, "complete", "high")["n_done"] == 1
    # a lease ends at a dequeue, not before
    assert do(50, "enqueue", "other", 10)["n_leased"] == 1
    # what comes back does so as of now: behind others of its priority
    assert do(51, "dequeue")["leased_item"] == "other" and do(52, "dequeue")["leased_item"] == "low"
    do(53, "enqueue", "new", 0)
    assert do(54, "fail", "low")["n_waiting"] == 2
    assert do(55, "dequeue")["leased_item"] == "new" and do(56, "dequeue")["leased_item"] == "low"
    last = do(57, "fail", "low")
    assert (last["n_dead"], last["n_done"]) == (1, 2)  # a dead letter counts as done
    assert do(58, "enqueue", "low", 0)["n_waiting"] == 0
    # a leased item may be put in again, and is passed over while its lease lasts
    do(59, "enqueue", "new", 0)
    assert do(60, "dequeue") | {"n_dead": 0} == {"leased_item": None, "n_waiting": 0, "n_leased": 2, "n_done": 2, "n_dead": 0}
    assert json.loads(json.dumps(s)) == s


def test_near_dup_step_forgets_the_oldest():
    step, s = monitors.near_dup_step(3, 2), {}
    ask = lambda x: step(s, {"fingerprint": x - (1 << 64) if x >> 63 else x})
    assert ask(1 << 63) == {"duplicate": False, "distance": None}
    assert ask((1 << 63) | 7) == {"duplicate": True, "distance": 3}
    assert ask(0xFFFF)["duplicate"] is False and ask(0xFFFF0000)["duplicate"] is False
    assert ask(1 << 63)["duplicate"] is False  # its like went when the third came


def test_near_dup_stream_forgets_nothing(spark, tmp_path):
    """The query finds a text again after more than ten thousand others; its state goes through JSON."""
    step, s = monitors.near_dup_step(max_entries=None), {}
    rng = random.Random(4)
    for k in range(10_100):
        step(s, {"fingerprint": rng.getrandbits(64) - (1 << 63)})
        if k == 5000:
            s = json.loads(json.dumps(s, default=lambda v: v.tolist()))
    assert len(s["held"]) > 10_000
    words = lambda k: " ".join(f"w{(k * 7919 + j * 104729) % 1_000_003}" for j in range(12))
    rows = [(k, "s", words(k)) for k in range(10_500)] + [(10_500, "s", words(0)), (10_501, "t", words(0))]
    spark.createDataFrame(rows, "doc_id long, source string, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    got = {r.doc_id: (r.duplicate, r.distance) for r in registry.queries()["stream_near_dup"](spark, str(tmp_path)).collect()}
    assert sum(not d for d, _ in got.values()) > 10_001
    assert got[10_500] == (True, 0) and got[10_501] == (False, None)


def test_streams_read_folders_of_files(spark, tmp_path):
    """Of a table that is one file and of one that is a folder of several all rows come."""
    spark.range(40).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(5).toPandas().to_parquet(tmp_path / "one.parquet")
    for name, n in (("many", 40), ("one", 5)):
        assert runners.drain(runners.stream_table(spark, str(tmp_path), name), name, "append").count() == n


def test_health_step_equals_the_window(spark):
    rng = random.Random(3)
    runs = [(k, rng.random() < 0.4, rng.choice([0, 3, 40]), rng.choice([True, False, None])) for k in range(60)]
    df = spark.createDataFrame([("u", "f", *r) for r in runs], "url string, field string, seq long, empty boolean, cnt int, pattern_mismatch boolean")
    step, s = monitors.health_step(), {}
    for r in quality.health(df).orderBy("seq").collect():
        got = step(s, {"empty": r.empty, "cnt": r.cnt, "pattern_mismatch": r.pattern_mismatch})
        assert (got["n_runs"], got["alerts"]) == (r.n_runs, ",".join(r.alerts)) and got["empty_rate"] == pytest.approx(r.empty_rate)


def test_chains(spark):
    """Lines, a loop, a fork of which the least counts, and a start that leads nowhere."""
    links = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("f", "h"), ("f", "g")] + [(f"n{k}", f"n{k + 1}") for k in range(40)]
    starts = [(x, x) for x in ("a", "b", "x", "f", "n0", "zz")]
    run = lambda most: {(r.start, r.step): r.node for r in flow.chained(spark.createDataFrame(links, "node string, next string"), spark.createDataFrame(starts, "start string, node string"), most).collect()}
    after = {}
    for n, x in links:
        if x and (n not in after or x < after[n]):
            after[n] = x

    def slow(most):
        want = {}
        for s, n in starts:
            k = 0
            while n is not None and k < most:
                want[s, k], n, k = n, after.get(n), k + 1
        return want

    assert run(5) == slow(5) and run(41) == slow(41) and run(1) == slow(1)
    assert run(None) == slow(len(after) + 1)


def test_cursors_belong_to_their_connection(spark):
    page = lambda name, nxt: json.dumps({"data": {"c": {"edges": [{"node": {"n": name}}], "pageInfo": {"endCursor": nxt, "hasNextPage": nxt is not None}}}})
    rows = [(k, c, page(f"{k}{c}", n)) for k in "pq" for c, n in ((None, "1"), ("1", "2"), ("2", None), ("9", None))]
    got = formats.graphql_nodes(spark.createDataFrame(rows, "api string, cursor string, body string"), "c", key="api").collect()
    assert sorted((r.api, r.page_no, json.loads(r.node)["n"]) for r in got) == [(k, i + 1, f"{k}{c}") for k in "pq" for i, c in enumerate((None, "1", "2"))]


def test_crawl_visits(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("c", "e", 1)], "src string, dst string, pos int")
    visit = lambda f: f.withColumns({"ok": F.col("url") != "b", "title": F.upper("url")})
    got = flow.crawl(edges, spark.createDataFrame([("a", 0)], "url string, pos int"), visit=visit).collect()
    assert {(r.url, r.depth, r.ordinal, r.ok, r.title) for r in got} == {("a", 0, 0, True, "A"), ("b", 1, 1, False, "B"), ("c", 1, 2, True, "C"), ("e", 2, 3, True, "E")}


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("d", "a", 1)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("a", 0)], "url string, pos int")
    order = lambda **k: [r.url for r in flow.crawl(edges, seeds, **k).orderBy("ordinal").collect()]
    assert order() == ["a", "b", "c", "d"]
    assert order(max_urls=2) == ["a", "b"]
    assert order(failed=spark.createDataFrame([("b",)], "url string")) == ["a", "b", "c"]


def test_collapse(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (1, "c", 2)], "id int, v string, n int")
    assert [(r.id, r.v) for r in core.collapse(df, ["id"], "n").orderBy("_position").collect()] == [(1, "c"), (2, "b")]
    with pytest.raises(Exception, match="missing"):
        core.collapse(spark.createDataFrame([(None, "a", 0)], "id int, v string, n int"), ["id"], "n").collect()


def test_statements():
    assert core.upsert_statement("s.t", ["id"], 1, ["id"]) == 'INSERT INTO "s"."t" ("id") VALUES ($1) ON CONFLICT ("id") DO NOTHING'
    with pytest.raises(core.SinkError):
        core.create_sink("nowhere")


def test_file_upsert(spark, tmp_path):
    path = tmp_path / "rows"
    new = lambda rows: spark.createDataFrame(rows, "id int, tide string, n int")
    rows = lambda: sorted((r.id, r.tide) for r in spark.read.json(str(path)).collect())
    core.upsert_files(spark, new([(1, "ebb", 0), (2, "flow", 1)]), str(path), ["id"], "n")
    core.upsert_files(spark, new([(2, "slack", 2), (3, "neap", 3)]), str(path), ["id"], "n")
    assert rows() == [(1, "ebb"), (2, "slack"), (3, "neap")]
    # a run that ended between the two renames left the rows aside: they are put back before anything else
    path.rename(tmp_path / "rows.before")
    core.upsert_files(spark, new([(3, "spring", 4)]), str(path), ["id"], "n")
    assert rows() == [(1, "ebb"), (2, "slack"), (3, "spring")]
    # one that ended after them left only the old rows to clear away
    (tmp_path / "rows.before").mkdir()
    core.upsert_files(spark, new([(4, "king", 5)]), str(path), ["id"], "n")
    assert len(rows()) == 4 and [x.name for x in tmp_path.iterdir()] == ["rows"]


def test_sink_holds_rows_until_they_are_enough(spark):
    rows = lambda *ids: spark.createDataFrame([(k, f"v{n}", n) for n, k in enumerate(ids)], "id int, v string, n int")
    sent = []
    sink = core.create_sink("memory", keys=["id"], order="n", batch_size=4, send=lambda df: sent.append(sorted(r.id for r in df.collect())))
    assert sink.write(rows(1, 2)) == 2 and sink.stats["buffered"] == 2 and not sent
    sink.write(rows(2, 3, 4))
    assert sent == [[1, 2, 3, 4]] and sink.stats["duplicates"] == 1
    sink.write(rows(9))
    assert sink.close() == {"written": 5, "batches": 2, "failed": 0, "retried": 0, "duplicates": 1, "buffered": 0, "closed": True}
    with pytest.raises(core.SinkError):
        sink.write(rows(1))


def test_sink_appends_without_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "id int, v string")
    for kind in ("jsonl", "csv"):
        with core.sink_of(kind, path=str(tmp_path / kind)) as sink:
            sink.write(df)
            sink.write(df)
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 4 and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4


def _put(root):
    def put(key, body, kind):
        path = root / key.replace("/", "~")
        path.write_bytes(body + b"|" + kind.encode())

    return put


def test_objects_and_json_rows(spark, tmp_path):
    df = spark.createDataFrame([("N 4", 1, None), ("é/x", 2, "w")], "slip string, n int, z string").coalesce(1)
    with core.sink_of("s3", keys=["slip", "n"], order="n", prefix="quay", put=_put(tmp_path)) as sink:
        sink.write(df)
    assert (tmp_path / "quay~slip=N%204~n=1.json").read_text() == '{\n  "slip": "N 4",\n  "n": 1,\n  "z": null\n}|application/json'
    assert (tmp_path / "quay~slip=%C3%A9%2Fx~n=2.json").exists()
    core.put_objects(df, _put(tmp_path), ["n"], kind="csv")
    assert (tmp_path / "n=2.csv").read_text() == "slip,n,z\né/x,2,w|text/csv"
    log = tmp_path / "log"

    def insert(query, body):
        with open(log, "ab") as f:
            f.write(query.encode() + b"\n" + body + b"\n")

    with core.sink_of("clickhouse", table="db.quay", insert=insert, rows=1) as sink:
        sink.write(df)
    query = 'INSERT INTO "db"."quay" ("slip", "n", "z") FORMAT JSONEachRow'
    assert log.read_text().splitlines() == [query, '{"slip":"N 4","n":1,"z":null}', query, '{"slip":"é/x","n":2,"z":"w"}']


def test_statements_over_a_connection(spark, tmp_path):
    """Through a DB-API connection, one for each partition, with its placeholders."""
    import sqlite3

    path = str(tmp_path / "db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (id int primary key, v text)")

    class Cursor:
        def __init__(self, inner):
            self.inner = inner

        def execute(self, sql, values):
            self.inner.execute(sql.replace("%s", "?"), values)

    class Connection:
        def __init__(self):
            self.inner = sqlite3.connect(path, timeout=30)
            self.commit, self.close = self.inner.commit, self.inner.close

        def cursor(self):
            return Cursor(self.inner.cursor())

    for v in ("a", "b"):
        with core.sink_of("postgres", table="t", keys=["id"], order="id", connect=Connection, rows=2) as sink:
            sink.write(spark.createDataFrame([(k, f"{v}{k}") for k in range(5)], "id int, v string").coalesce(1))
    with sqlite3.connect(path) as c:
        assert c.execute("select * from t order by id").fetchall() == [(k, f"b{k}") for k in range(5)]


def test_delivery_to_a_server(spark):
    """Signed, with its event; a server error is tried again, and no address is none."""
    import http.server
    import threading

    seen = []

    class Receiver(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.headers["X-Webloom-Event"], self.headers["X-Webloom-Signature"] == core.sign(body.decode(), "k"), body.decode()))
            self.send_response(500 if len(seen) < 2 else 204)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    events = spark.createDataFrame([("moored", '{"slip":"é4"}'), ("other", "{}")], "event string, payload string").coalesce(1)
    got = {r.event: (r.delivered, r.status, r.attempts) for r in core.deliver(events, {"moored": f"http://127.0.0.1:{server.server_port}/"}, backoff_ms=1, secret="k").collect()}
    server.shutdown()
    assert got == {"moored": (True, 204, 2), "other": (False, None, 0)}
    assert seen == [("moored", True, '{"slip":"é4"}')] * 2
    assert core.post("http://127.0.0.1:1/", b"", {}) == 0


def test_counters_by_key(spark):
    rows = [("p", "s1", 1, False), ("p", "s1", 2, True), ("p", "s2", 3, False), ("q", "s3", 1, False), ("q", "s3", 2, False), ("q", "s3", 3, False)]
    got = {r.proxy: (r.failures, r.healthy, r.sessions) for r in traffic.proxy_stats(spark.createDataFrame(rows, "proxy string, session string, at int, ok boolean")).collect()}
    assert got == {"p": (1, True, 2), "q": (3, False, 1)}


def test_shuffle_is_drawn_by_the_seed(spark):
    items = spark.range(50).withColumnRenamed("id", "item")
    order = lambda df, seed: [r.item for r in flow.shuffled(df, "item", seed).orderBy("turn").collect()]
    assert order(items, 1) == order(items.repartition(7), 1) != order(items, 2) != list(range(50))


def test_exports(spark):
    df = spark.createDataFrame([(1, 'a,"b"', ["x", "y"], None)], "n int, s string, t array<string>, z string").withColumn("o", F.lit(0))
    assert core.export_text(df, "csv", "o") == 'n,s,t,z\n1,"a,""b""",x | y,'
    assert core.export_text(df, "ndjson", "o") == '{"n":1,"s":"a,\\"b\\"","t":["x","y"],"z":null}'
    assert json.loads(core.export_text(df, "json", "o")) == [{"n": 1, "s": 'a,"b"', "t": ["x", "y"], "z": None}]
    assert core.export_text(df, "markdown", "o").startswith("| n | s | t | z |\n| --- |")
    with pytest.raises(core.SinkError):
        core.export_text(df, "xls", "o")


def test_near_dup_pairs_hold_every_near_document(spark, sf_dir):
    """Each two near documents have one first holder, or first holders that are a pair; and no others have."""
    from webloom.plans import registry

    prints = dict(map(tuple, dedup.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()))
    got = [tuple(r) for r in registry.queries()["near_dup_pairs"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and all(a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() == d for a, b, d in got)
    first = {k: k for k in prints} | {b: a for a, b, d in got if d == 0}
    pairs = {(a, b) for a, b, d in got if d}
    assert all(first[a] == a == first[first[a]] and first[b] == b for a, b in pairs)
    near = {(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= dedup.THRESHOLD}
    assert any(prints[a] == prints[b] for a, b in near)
    assert near == {(a, b) for a in prints for b in prints if a < b and (first[a] == first[b] or (first[a], first[b]) in pairs or (first[b], first[a]) in pairs)}
