"""Crawls, pagination, queues and per-host policies, replayed over tables."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.session import checkpointed


def crawl(edges: DataFrame, seeds: DataFrame, max_urls: int | None = None, max_depth: int | None = None, failed: DataFrame | None = None, follow: Column | None = None, visited: DataFrame | None = None, visit: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(url, depth, ordinal, ok) in breadth-first order over edges(src, dst, pos) from seeds(url, pos).

    A frontier is joined with its links and cut by what has been visited; each depth is checkpointed. Within a
    depth the order is that of the parent, then of the link. max_urls is exact. Failed URLs count as visited,
    are not followed, and have ok = false. `visited` (the same columns) resumes an earlier crawl. Without
    max_depth and max_urls the crawl ends where no link leads to a new URL. `visit`, a function of a depth's
    DataFrame(url, depth, ordinal), returns it with a column ok and whatever else it found: it takes the place
    of `failed`, and what it found is in the result. (V7)
    """
    out = None
    if visited is not None:
        out = checkpointed(visited)
        start = out.agg(F.max("depth")).first()[0] or 0
        frontier = out.filter(F.col("depth") == start)
        depth, done = start, out.count()
    else:
        first = seeds.groupBy("url").agg(F.struct(F.min("pos"), F.col("url")).alias("_at"))
        frontier = _numbered(first, "_at", 0).select("url", F.lit(0).alias("depth"), "ordinal")
        depth, done = 0, 0
    bad = failed.select(F.col("url").alias("_bad")).distinct() if failed is not None else None
    links = edges if follow is None else edges.filter(follow)
    while True:
        if visited is None or depth > start:
            if max_urls is not None:
                frontier = frontier.filter(F.col("ordinal") < max_urls)
            if visit is not None:
                frontier = visit(frontier)
            elif bad is not None:
                frontier = frontier.join(bad, F.col("url") == F.col("_bad"), "left").withColumn("ok", F.col("_bad").isNull()).drop("_bad")
            else:
                frontier = frontier.withColumn("ok", F.lit(True))
            frontier = checkpointed(frontier if visit is not None else frontier.select("url", "depth", "ordinal", "ok"))
            n = frontier.count()
            out = frontier if out is None else out.unionByName(frontier)
            done += n
            if not n:
                break
        if (max_depth is not None and depth >= max_depth) or (max_urls is not None and done >= max_urls):
            break
        found = frontier.filter("ok").select(F.col("url").alias("src"), "ordinal").join(links, "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("ordinal", "pos", F.col("src"))).alias("_at"))
        fresh = found.join(out.select("url"), "url", "left_anti")
        depth += 1
        frontier = _numbered(fresh, "_at", done).select("url", F.lit(depth).alias("depth"), "ordinal")
    return out


def _numbered(df: DataFrame, order: str, start: int) -> DataFrame:
    """df with an ordinal by `order`: ranks within range partitions, after the sizes of those before."""
    ranged = checkpointed(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("_part").orderBy(order)
    return ranged.join(before, "_part").withColumn("ordinal", (F.row_number().over(w) - 1 + F.col("_before") + start).cast("bigint")).drop("_part", "_before")


def crawl_stats(crawled: DataFrame, edges: DataFrame) -> DataFrame:
    """visited, queued and results of a crawl."""
    seen = crawled.select("url")
    queued = edges.join(crawled.filter("ok").select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
    return crawled.agg(F.count("*").alias("visited"), F.count_if("ok").alias("results")).join(queued.agg(F.count("*").alias("queued")))


def chained(links: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, step) along links(node, next) from starts(start, node), step 0 first, fewer than `most` steps.

    Of several links of a node the least counts. Steps are found by doubling: what is reached by n steps and a
    table of jumps of n steps give what is reached by 2n, so a chain of a million takes twenty rounds. A chain
    without an end goes on to `most`, else to as many steps as there are links.
    """
    jump = checkpointed(links.filter("next is not null").groupBy("node").agg(F.min("next").alias("next")))
    most = jump.count() + 1 if most is None else most
    out, reach = checkpointed(starts.select("start", "node", F.lit(0).cast("bigint").alias("step")).distinct()), 1
    while reach < most:
        more = checkpointed(out.join(jump, "node").select("start", F.col("next").alias("node"), (F.col("step") + reach).alias("step")).filter(F.col("step") < most))
        if more.isEmpty():
            break
        out, reach = checkpointed(out.unionAll(more)), reach * 2
        ahead = jump.select(F.col("node").alias("_n"), F.col("next").alias("_x"))
        jump = checkpointed(jump.join(ahead, jump["next"] == ahead["_n"]).select("node", F.col("_x").alias("next")))
    return out.filter(F.col("step") < most)


def paginate(pages: DataFrame, starts: DataFrame, max_pages: int | None = 10) -> DataFrame:
    """(start, page_no, url, items) along pages(url, next_url, items) from starts(url), until a page repeats the one before.

    At most max_pages pages of each start; None for all.
    """
    from webloom.operators.dedup import until_repeat

    found = chained(pages.select(F.col("url").alias("node"), F.col("next_url").alias("next")), starts.select(F.col("url").alias("start"), F.col("url").alias("node")), max_pages)
    met = found.join(pages.select(F.col("url").alias("node"), "items"), "node").select("start", (F.col("step") + 1).cast("int").alias("page_no"), F.col("node").alias("url"), "items")
    return until_repeat(met, "start", "page_no", "items")


# --- pure window replays -------------------------------------------------------------------------------------


def rate_limit(requests: DataFrame, gap_ms: int, key: str = "host", at: str = "arrival", order: str = "seq") -> DataFrame:
    """start of each request, `gap_ms` apart for each host: gap*i + max over earlier j of arrival - gap*j."""
    w = Window.partitionBy(key).orderBy(at, order)
    i = (F.row_number().over(w) - 1).cast("bigint")
    return requests.withColumn("_i", i).withColumn("start", F.col("_i") * gap_ms + F.max(F.col(at) - F.col("_i") * gap_ms).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i")


def single_flight(requests: DataFrame, key: str = "key", start: str = "start", end: str = "end", order: str = "seq") -> DataFrame:
    """requests with flight number and joined: one that starts before all earlier ones of its key have ended joins them."""
    w = Window.partitionBy(key).orderBy(start, order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = requests.withColumn("joined", F.coalesce(F.col(start) < before, F.lit(False)))
    return out.withColumn("flight", F.sum((~F.col("joined")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def single_flight_stats(flights: DataFrame, ok: str | None = None, bypass: str | None = None) -> DataFrame:
    """started, joined, bypassed and failures of single_flight's rows; ok and bypass name boolean columns.

    A request with bypass goes alone: it isn't part of a flight, and should not be among the rows given to
    single_flight.
    """
    alone = F.coalesce(F.col(bypass), F.lit(False)) if bypass else F.lit(False)
    bad = ~F.coalesce(F.col(ok), F.lit(False)) if ok else F.lit(False)
    return flights.agg(F.count_if(~F.col("joined") & ~alone).alias("started"), F.count_if(F.col("joined") & ~alone).alias("joined"), F.count_if(alone).alias("bypassed"), F.count_if(bad & ~F.col("joined")).alias("failures"))


def cache_ttl(requests: DataFrame, ttl_ms: int, stale_ms: int = 0, key: str = "key", at: str = "at", order: str = "seq") -> DataFrame:
    """requests with outcome hit, stale or miss, and age.

    A miss and a stale hit (refreshed in the background) store anew. A store's time depends on the store
    before it, so a key's requests pass in order; no rows of a key are gathered.
    """
    def stores(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, stored = object(), None
        for b in rows:
            out, age = [], []
            for k, t in zip(b[key], b[at], strict=True):
                if k != last_key:
                    last_key, stored = k, None
                a = None if stored is None else int(t) - stored
                kind = "miss" if a is None or a > ttl_ms + stale_ms else "hit" if a <= ttl_ms else "stale"
                out.append(kind)
                age.append(a)
                if kind != "hit":
                    stored = int(t)
            yield b.assign(outcome=out, age=pd.array(age, "Int64"))

    # one key's rows stream through in order, batch by batch, with one number of state
    dealt = requests.repartition(F.col(key)).sortWithinPartitions(key, at, order)
    return dealt.mapInPandas(stores, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", outcome string, age bigint")


def cache_stats(outcomes: DataFrame) -> DataFrame:
    """hits, misses, stale and hit_rate in percent; stale hits count."""
    return outcomes.agg(F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome") == "miss").alias("misses"), F.count_if(F.col("outcome") == "stale").alias("stale"), F.coalesce(F.floor(F.count_if(F.col("outcome") != "miss") / F.count("*") * 100 + 0.5), F.lit(0)).cast("bigint").alias("hit_rate"))


def incremental(responses: DataFrame, key: str = "url", order: str = "seq", data: str = "data") -> DataFrame:
    """responses with `result`: its own data, or after a 304 the last stored. (X11, Q53)"""
    w = Window.partitionBy(key).orderBy(order)
    stored = F.last(F.when((F.col("status") != 304) & F.col(data).isNotNull(), F.col(data)), ignorenulls=True).over(w)
    return responses.withColumn("result", F.when(F.col("status") == 304, stored).otherwise(F.col(data)))


# --- sequential state, folded by key -------------------------------------------------------------------------
# One function of (state, event) -> (state, output) serves batch and stream. In batch a key's rows pass in
# order, batch by batch, so a key of any size takes one state and no memory.


def fold(events: DataFrame, key: str, order: list[str], step: Callable[[dict, dict], dict], output: str) -> DataFrame:
    """events with the fields of `output` (a DDL list) that step(state, event) returns; state is a dict that it may change."""
    names = [x.strip().split(" ")[0] for x in output.split(",")]
    own = events.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), {}
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                if r[key] != last:
                    last, state = r[key], {}
                rows.append({**{c: r[c] for c in own}, **step(state, r)})
            yield pd.DataFrame(rows, columns=[*own, *names]) if rows else pd.DataFrame(columns=[*own, *names])

    dealt = events.repartition(F.col(key)).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", " + output)


def breaker_step(threshold: int = 5, cooldown_ms: int = 60_000, half_open: int = 1) -> Callable[[dict, dict], dict]:
    """Circuit breaker over events(at, ok): the state before, whether the request passes, the state after."""

    def step(s: dict, e: dict) -> dict:
        s.setdefault("state", "closed")
        s.setdefault("failures", 0)
        now = int(e["at"])
        if s["state"] == "open" and now - s["opened"] >= cooldown_ms:
            s["state"], s["probes"] = "half_open", 0
        before = s["state"]
        passes = before == "closed" or (before == "half_open" and s["probes"] < half_open)
        if passes and e["ok"]:
            s["state"], s["failures"] = "closed", 0
        elif passes:
            s["failures"] += 1
            if before == "half_open":
                s["probes"] += 1
            if before == "half_open" or s["failures"] >= threshold:
                s["state"], s["opened"] = "open", now
        return {"state": before, "passed": passes, "next_state": s["state"]}

    return step


BREAKER = "state string, passed boolean, next_state string"


def throttle_step(initial: int = 4, least: int = 1, most: int = 16, every: int = 10, base_ms: int = 250, cap_ms: int = 60_000) -> Callable[[dict, dict], dict]:
    """Additive increase, multiplicative decrease over events(ok[, retry_after_ms])."""

    def step(s: dict, e: dict) -> dict:
        s.setdefault("slots", initial)
        s.setdefault("delay", 0)
        s.setdefault("good", 0)
        if e["ok"]:
            s["delay"] //= 2
            s["good"] += 1
            if s["good"] >= every and s["slots"] < most:
                s["slots"], s["good"] = s["slots"] + 1, 0
        else:
            s["good"] = 0
            s["slots"] = max(least, math.floor(s["slots"] * 0.5))
            wait = e.get("retry_after_ms")
            s["delay"] = int(min(cap_ms, wait)) if wait is not None and not pd.isna(wait) else min(cap_ms, max(base_ms, s["delay"] * 2))
        return {"slots": s["slots"], "delay_ms": int(s["delay"])}

    return step


THROTTLE = "slots int, delay_ms bigint"


def queue_step(lease_ms: int = 30_000, most: int = 3) -> Callable[[dict, dict], dict]:
    """A queue over events(at, op, item, priority) in the order of time: enqueue, dequeue, complete, fail.

    The lowest priority number goes first, then the earliest, then the first put in. A waiting or done item
    isn't put in again; a leased one may be, and is passed over while its lease lasts. A dequeue first gives
    back the items of leases that have run out, with their priority and as of now. A failed item comes back
    with priority 0 as of now, and at its `most`-th failure goes to the dead letters, which count as done.
    """

    def put(s: dict, item: str, priority: int, at: int) -> None:
        if item not in s["queued"] and item not in s["done"]:
            heapq.heappush(s["heap"], [priority, at, s["seq"], item])
            s["queued"][item] = True
            s["seq"] += 1

    def finish(s: dict, item: str) -> None:
        s["leased"].pop(item, None)
        s["done"][item] = True

    def step(s: dict, e: dict) -> dict:
        for name, empty in (("heap", []), ("queued", {}), ("leased", {}), ("done", {}), ("dead", {}), ("failures", {}), ("seq", 0)):
            s.setdefault(name, empty)
        now, op, item, got = int(e["at"]), e["op"], e["item"], None
        if op == "enqueue":
            p = e.get("priority")
            put(s, item, 0 if p is None or pd.isna(p) else int(p), now)
        elif op == "dequeue":
            # leases stand in the order of their times
            for k in list(s["leased"]):
                since, priority = s["leased"][k]
                if now - since < lease_ms:
                    break
                del s["leased"][k]
                put(s, k, priority, now)
            while s["heap"] and got is None:
                priority, _, _, k = heapq.heappop(s["heap"])
                del s["queued"][k]
                if k not in s["leased"] and k not in s["done"]:
                    s["leased"][k], got = [now, priority], k
        elif op == "complete":
            finish(s, item)
            s["failures"].pop(item, None)
        elif op == "fail":
            s["failures"][item] = s["failures"].get(item, 0) + 1
            if s["failures"][item] >= most:
                finish(s, item)
                s["dead"][item] = s["failures"][item]
            else:
                s["leased"].pop(item, None)
                put(s, item, 0, now)
        return {"leased_item": got, "n_waiting": len(s["heap"]), "n_leased": len(s["leased"]), "n_done": len(s["done"]), "n_dead": len(s["dead"])}

    return step


def work(queue: DataFrame, visit: Callable[[DataFrame], DataFrame], most: int = 3, key: str = "item") -> DataFrame:
    """(key, ok, attempts, result...) of visiting every item of a queue, a failed one up to `most` times.

    visit takes the items still open and returns their rows with a column ok and whatever else it found. Items
    are independent, so a round visits all open ones at once; each round is checkpointed.
    """
    open_, out = checkpointed(queue.dropDuplicates([key])), None
    for n in range(1, most + 1):
        seen = checkpointed(visit(open_).withColumn("attempts", F.lit(n)))
        last = seen if n == most else seen.filter("ok")
        out = last if out is None else out.unionByName(last)
        open_ = open_.join(seen.filter("not ok").select(key), key, "left_semi")
        if n < most and open_.isEmpty():
            break
    return out


QUEUE = "leased_item string, n_waiting int, n_leased int, n_done int, n_dead int"


def queue_totals(replayed: DataFrame, key: str, order: str) -> DataFrame:
    """The last counts of each queue."""
    return replayed.groupBy(key).agg(*(F.max_by(c, F.col(order)).alias(c) for c in ("n_waiting", "n_leased", "n_done", "n_dead")))


def lru_step(capacity: int = 1000) -> Callable[[dict, dict], dict]:
    """A cache of `capacity` items over events(item): hit, and what was evicted. (H9)"""

    def step(s: dict, e: dict) -> dict:
        held = s.setdefault("held", {})
        hit = e["item"] in held
        held.pop(e["item"], None)
        held[e["item"]] = None
        evicted = None
        if len(held) > capacity:
            evicted = next(iter(held))
            del held[evicted]
        return {"hit": hit, "evicted": evicted}

    return step


LRU = "hit boolean, evicted string"


# --- jobs ----------------------------------------------------------------------------------------------------


def due(jobs: DataFrame, now_ms: int, handlers: list[str] | None = None) -> DataFrame:
    """Enabled jobs whose time has come, in the order of their times."""
    out = jobs.filter("enabled").filter(F.col("next_run_at") <= now_ms)
    if handlers is not None:
        out = out.filter(F.col("handler").isin(*handlers))
    return out.orderBy(F.asc_nulls_last("next_run_at"), "id")


def tick(jobs: DataFrame, now_ms: int, running: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(jobs after, runs started) at a time.

    jobs: id, kind, cron, every_ms, at_ms, enabled, next_run_at, last_run_at, runs. A job that still runs is
    moved on to its next time without a run; one that runs once is disabled.
    """
    from webloom.functions.schedule import next_run

    now = F.lit(now_ms).cast("bigint")
    j = jobs.join(running.select(F.col("id").alias("_r")).distinct(), F.col("id") == F.col("_r"), "left") if running is not None else jobs.withColumn("_r", F.lit(None).cast("string"))
    ripe = F.col("enabled") & F.coalesce(F.col("next_run_at") <= now_ms, F.lit(False))
    go = ripe & F.col("_r").isNull()
    ahead = next_run(F.col("kind"), F.col("cron"), F.col("every_ms"), F.col("at_ms"), now, F.col("next_run_at"))
    after = j.select(
        *(c for c in jobs.columns if c not in ("next_run_at", "last_run_at", "runs", "enabled")),
        F.when(go & (F.col("kind") == "once"), False).otherwise(F.col("enabled")).alias("enabled"),
        F.when(ripe & (F.col("kind") == "once"), None).when(ripe, ahead).otherwise(F.col("next_run_at")).alias("next_run_at"),
        F.when(go, now).otherwise(F.col("last_run_at")).alias("last_run_at"),
        (F.col("runs") + F.when(go, 1).otherwise(0)).alias("runs"),
    ).select(*jobs.columns)
    return after, j.filter(go).select("id", now.alias("started_at"))


def catch_up(jobs: DataFrame, now_ms: int, run_missed: bool = False) -> DataFrame:
    """Jobs at start: an overdue one runs at once, or counts as missed and waits for its next time."""
    from webloom.functions.schedule import next_run

    now = F.lit(now_ms).cast("bigint")
    late = F.col("enabled") & F.coalesce(F.col("next_run_at") < now_ms, F.lit(False))
    if run_missed:
        return jobs.withColumn("next_run_at", F.when(late, now).otherwise(F.col("next_run_at")))
    ahead = next_run(F.col("kind"), F.col("cron"), F.col("every_ms"), F.col("at_ms"), now, F.col("next_run_at"))
    return jobs.withColumns({"missed": F.col("missed") + F.when(late, 1).otherwise(0), "next_run_at": F.when(late, ahead).otherwise(F.col("next_run_at"))})


def job_stats(jobs: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """jobs, enabled and runs; with ticks(at, started, errors, skipped, running) also what they add up to.

    running is that of the last tick.
    """
    out = jobs.agg(F.count("*").alias("jobs"), F.count_if("enabled").alias("enabled"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"))
    if ticks is None:
        return out
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return out.join(F.broadcast(ticks.agg(F.count("*").alias("ticks"), total("started"), total("errors"), total("skipped"), F.coalesce(F.max_by("running", "at"), F.lit(0)).alias("running"))))


def run_jobs(jobs: DataFrame, now_ms: int, handlers: dict[str, Callable[[DataFrame], DataFrame]], running: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """tick(), and each started job's handler: (jobs after, runs).

    A handler takes its started jobs (id, started_at) and returns them with ok and error; jobs(handler) names
    it. A job whose handler isn't given doesn't run and is left as it was.
    """
    known = F.col("handler").isin(*handlers)
    after, started = tick(jobs.filter(known), now_ms, running)
    started = checkpointed(started.join(jobs.select("id", "handler"), "id"))
    runs = None
    for name, handler in handlers.items():
        done = handler(started.filter(F.col("handler") == name).select("id", "started_at")).select("id", "started_at", F.lit(name).alias("handler"), "ok", "error")
        runs = done if runs is None else runs.unionAll(done)
    return after.unionByName(jobs.filter(~F.coalesce(known, F.lit(False)))), runs


def shuffled(items: DataFrame, key: str, seed: int) -> DataFrame:
    """items with `turn`, their place in an order drawn by a seed: the same for the same keys and seed."""
    drawn = items.withColumn("_drawn", F.struct(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.col(key)))
    return _numbered(drawn, "_drawn", 0).withColumnRenamed("ordinal", "turn").drop("_drawn")


def with_records(index: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Index rows that still have a record."""
    return index.join(records, key, "left_semi")
