"""SimHash near-duplicates over vantage-point trees.

A fingerprint has 64 bits, and two documents link when their fingerprints differ in at most `radius`
bits. The 64 bits are cut into blocks, and every choice of so many blocks makes a mask. By the pigeonhole
principle two linked fingerprints differ in at most `reach` bits under some mask, and Hamming distance under
a mask is a metric of its own. For each mask a vantage-point tree over a sample deals fingerprints to shards:
a node keeps those within `mu` of its pivot inside, the others outside. A fingerprint has one home shard,
and by the triangle inequality it visits each shard whose side of a node lies within the reach of its own
distance; all other branches are pruned. Pivot and mu are those of several whose boundary holds the fewest
fingerprints for the balance that they give. Inside a shard the tree goes on, vectorised: first under the
mask, then, among those that are equal under it, over all 64 bits, where branches overlap by the radius, down
to leaves whose pairs are verified on all 64 bits.

Each level of a tree copies what lies at its boundary, so with a reach the copies grow with the depth: with
three single blocks (reach 1) to 38 copies of each of 2^24 fingerprints. SCHEME, pairs of six blocks, has
reach 0: no shard overlaps another, and there are fifteen copies at any size.

Equal fingerprints are merged first, and a shard returns the links of a spanning forest of what it
verified, so a group of copies costs rows in proportion to its size. No link between different
fingerprints is lost: a component stays connected by its forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import graph, text
from webloom.session import checkpointed

SHINGLE = 4
RADIUS = 4
#: How the 64 bits are cut: so many blocks, and how many of them make a mask.
SCHEME = (6, 2)
#: Fingerprints for which a shard is meant, its visitors included, and a leaf within it.
SHARD = 50_000
LEAF = 192
#: The cost, of 1 without a cut, up to which a cut inside a shard is worth it: beyond, both sides hold nearly all.
WORTH = 0.9
#: Sampled fingerprints for each shard that is meant, at least in all, and at most in all: 8 bytes each, on
#: the driver. Past SAMPLE_MOST / SAMPLE_SHARD shards, shards grow with the input instead.
SAMPLE_SHARD, SAMPLE_LEAST, SAMPLE_MOST = 48, 8192, 1 << 20
#: Fingerprints that are dealt in one step, so that a node's cost is shared by many.
DEAL = 1 << 18


def fingerprint(doc: bytes) -> int:
    """The fingerprint of one text's UTF-8 bytes."""
    w = doc.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    n = max(1, len(w) - SHINGLE + 1)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    last = ends[min(SHINGLE, len(w)) - 1 :].tolist()
    h = np.array([digest(line[a:b], 42) for a, b in zip(starts, last, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = text.strings(b.column(1))
        data, at = text.view(column)
        raw = data.tobytes()
        got = np.array([fingerprint(raw[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got.view(np.int64), pa.int64())], ["doc_id", "version", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, fp) for each row: a hash of the text, and the 64 bits as a signed number. Null counts as empty."""
    words = F.col(text_col).cast("string")
    kind = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("version", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), words.alias("text"), F.xxhash64(words).alias("version")).mapInArrow(_fingerprints, kind)


def masks_of(blocks: int, chosen: int, radius: int) -> tuple[np.ndarray, int]:
    """The masks of a scheme, and the bits that linked fingerprints differ in under one of them at most."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    each = [sum(1 << k for k in range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    # at worst the bits that differ are spread evenly, and the blocks that have the fewest are chosen
    every, more = divmod(radius, blocks)
    return np.array([sum(c) for c in combinations(each, chosen)], np.uint64), chosen * every + max(0, chosen - (blocks - more))


@dataclass
class Tree:
    """Nodes as arrays: a child under zero is the shard -1 - child. A tree of one shard has no node."""

    pivot: np.ndarray
    mu: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    shards: int


def _cut(values: np.ndarray, reach: int, rng: np.random.Generator, pivots: int) -> tuple[float, np.uint64, int, np.ndarray] | None:
    """(cost, pivot, mu, distances) of the cheapest cut, None where no pivot parts the values.

    A side weighs what it holds and what visits it, to a power: balance pays, and so does a thin boundary.
    """
    best = None
    for pivot in values[rng.integers(0, len(values), pivots)]:
        d = np.bitwise_count(values ^ pivot)
        held = np.cumsum(np.bincount(d, minlength=66)) / len(values)
        for mu in np.flatnonzero((held[:-2] > 0) & (held[:-2] < 1)).tolist():
            inner, outer = held[min(mu + reach, 65)], 1 - (held[mu - reach] if mu >= reach else 0)
            cost = inner**1.7 + outer**1.7
            if best is None or cost < best[0]:
                best = (cost, pivot, mu, d)
    return best


def grow(sample: np.ndarray, most: float, reach: int, rng: np.random.Generator) -> Tree:
    """A tree whose shards, visitors included, get at most `most` of the sample, but for equal values."""
    pivot, mu, inside, outside, n = [], [], [], [], 0
    stack = [(sample, sample, None)]
    while stack:
        home, visit, of = stack.pop()
        cut = _cut(home, reach, rng, 6) if len(visit) > max(2, most) and len(home) > 1 else None
        here = -1 - n if cut is None else len(pivot)
        if of is not None:
            (inside if of[1] else outside)[of[0]] = here
        if cut is None:
            n += 1
            continue
        _, at, edge, d = cut
        pivot.append(at)
        mu.append(edge)
        inside.append(0)
        outside.append(0)
        far = np.bitwise_count(visit ^ at).astype(np.int64)
        stack.append((home[d > edge], visit[far > edge - reach], (here, False)))
        stack.append((home[d <= edge], visit[far <= edge + reach], (here, True)))
    return Tree(np.array(pivot, np.uint64), np.array(mu, np.int64), np.array(inside, np.int64), np.array(outside, np.int64), n)


def route(values: np.ndarray, tree: Tree, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is home) for each shard that a masked value visits."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    stack = [(0 if len(tree.pivot) else -1, np.arange(len(values)), np.ones(len(values), bool))]
    while stack:
        node, rows, home = stack.pop()
        if not len(rows):
            continue
        if node < 0:
            out.append((rows, -1 - node, home))
            continue
        d = np.bitwise_count(values[rows] ^ tree.pivot[node]).astype(np.int64)
        mu = int(tree.mu[node])
        far, near = d > mu - reach, d <= mu + reach
        stack.append((int(tree.outside[node]), rows[far], home[far] & (d[far] > mu)))
        stack.append((int(tree.inside[node]), rows[near], home[near] & (d[near] <= mu)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), s, np.int32) for r, s, _ in out]), np.concatenate([h for _, _, h in out])


def plan(sample: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, int, list[Tree]]:
    """(masks, reach, a tree for each mask) for n fingerprints, of which sample holds some."""
    masks, reach = masks_of(*SCHEME, radius)
    return masks, reach, [grow(sample & m, SHARD * len(sample) / max(1, n), reach, np.random.default_rng(k)) for k, m in enumerate(masks)]


class _Forest:
    """Union by least row over the rows of one shard."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            over = up[up]
            if np.array_equal(over, up):
                self.up = up
                return up
            up = over

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.roots()
            a, b = up[a], up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, hi, lo)


def _leaf(fp: np.ndarray, home: np.ndarray, visit: np.ndarray, radius: int, forest: _Forest) -> None:
    """Verify each home fingerprint against all that visit.

    Rows of one component already are skipped together: from a row that still has unmet visitors, the
    search takes in every visitor in reach, so a dense group settles in a few sweeps over it.
    """
    if len(home) <= 4 * LEAF:
        step = max(1, (1 << 22) // max(1, len(visit)))
        for a in range(0, len(home), step):
            i, j = np.nonzero(np.bitwise_count(fp[home[a : a + step]][:, None] ^ fp[visit][None, :]) <= radius)
            forest.join(home[a : a + step][i], visit[j])
        return
    is_home, taken = np.zeros(len(fp), bool), np.zeros(len(fp), bool)
    is_home[home] = True
    for root in home:
        if taken[root]:
            continue
        taken[root] = True
        # visitors from elsewhere come back for each component: they may link several
        left, waiting = visit[~taken[visit]], [root]
        while waiting and len(left):
            r = waiting.pop()
            met = np.bitwise_count(fp[left] ^ fp[r]) <= radius
            if met.any():
                got = left[met]
                forest.join(np.full(len(got), r), got)
                left = left[~met]
                inner = got[is_home[got]]
                taken[inner] = True
                waiting.extend(inner)


def _search(fp: np.ndarray, is_home: np.ndarray, mask: np.uint64, reach: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root) of a spanning forest of one shard."""
    forest, rng = _Forest(len(fp)), np.random.default_rng(7)
    # under the mask first; what is equal there goes on over all bits, with the radius for reach
    stack = [(np.flatnonzero(is_home), np.arange(len(fp)), fp & mask, reach)]
    while stack:
        home, visit, values, near = stack.pop()
        if not len(home) or len(visit) < 2:
            continue
        cut = _cut(values[home], near, rng, 4) if len(home) > LEAF else None
        if cut is None and len(home) > LEAF and values is not fp:
            values, near = fp, radius
            cut = _cut(values[home], near, rng, 4)
        if cut is None or cut[0] > WORTH:
            _leaf(fp, home, visit, radius, forest)
            continue
        _, pivot, mu, d = cut
        far = np.bitwise_count(values[visit] ^ pivot).astype(np.int64)
        stack.append((home[d <= mu], visit[far <= mu + near], values, near))
        stack.append((home[d > mu], visit[far > mu - near], values, near))
    up = forest.roots()
    kept = np.flatnonzero(up != np.arange(len(up)))
    return kept, up[kept]


def _sample(prints: DataFrame, n: int) -> np.ndarray:
    """The fingerprints whose hash falls under a share, in the order of their hashes: all, where they are few."""
    want = min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_SHARD * n // SHARD))
    part = prints.select("fp", F.xxhash64("fp").alias("h"))
    if n > want:
        part = part.filter(F.pmod("h", F.lit(1 << 30)) < (1 << 30) * want // n)
    got = part.toArrow()
    return got["fp"].to_numpy().view(np.uint64)[np.argsort(got["h"].to_numpy(), kind="stable")]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between fingerprints of prints(fp long), distinct, that connect whatever is in reach."""
    masks, reach, trees = plan(_sample(prints, n := prints.count()), n, radius)
    sent = prints.sparkSession.sparkContext.broadcast(trees)  # under 20 bytes a sampled fingerprint and mask

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            fp = np.concatenate(held).view(np.uint64)
            held.clear()
            for k, m in enumerate(masks):
                row, shard, home = route(fp & m, sent.value[k], reach)
                for a in range(0, len(row), 1 << 16):
                    r = row[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), k, np.int32)), pa.array(shard[a : a + (1 << 16)]), pa.array(home[a : a + (1 << 16)]), pa.array(fp[r].view(np.int64))], ["mask", "shard", "home", "fp"])

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= DEAL:
                yield from flush()
        if held:
            yield from flush()

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp", kind="stable")
        fp = rows["fp"].to_numpy()
        a, b = _search(fp.view(np.uint64), rows["home"].to_numpy(), masks[int(key[0])], reach, radius)
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    dealt = prints.select("fp").mapInArrow(deal, "mask int, shard int, home boolean, fp long")
    return dealt.groupBy("mask", "shard").applyInPandas(search, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(doc_id, version, fp, root, component_id) of each row; version is a hash of its text, root names the component."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    merged = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # fingerprints are the nodes: rows of one doc_id with different texts are no link
    found = graph.components(links(merged.select("fp"), radius))
    members = found.select(F.col("node").alias("fp"), F.col("component").alias("root")).unionAll(found.select("component", "component").distinct())
    # tables of their own: the joins below may then split a component or a fingerprint of many rows
    named = checkpointed(members.join(merged, "fp").groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed(merged.join(members, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least").join(named, "root", "left").select(F.col("fp").alias("fp_"), "root", F.coalesce("component_id", "least").alias("component_id")))
    return prints.join(named, prints["fp"] == named["fp_"], "left").drop("fp_")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; doc_id of any type that has an order.

    Texts of fewer than four words have one shingle, the whole sequence; a text without words, empty or
    null has fingerprint zero and links like any other. Rows that repeat a doc_id come out once each, each in
    the component of its own text. A null doc_id keeps its fingerprint and names no component: where no row
    of a component has a doc_id, component_id is null. An empty table gives an empty table; other columns,
    whatever their names, play no part.
    """
    return _grouped(docs, id_col, text_col, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs without those that near-duplicate another: one row stays of each component.

    It is the row of the least doc_id, of several texts of that doc_id the one of the least hash, and of rows
    that repeat both the first by their other columns. Rows without an id stay and stand for no other.
    """
    rows = _grouped(docs, id_col, text_col, radius).filter("doc_id is not null").select("root", F.struct("doc_id", "version").alias("me"))
    rows = checkpointed(rows)
    firsts = rows.groupBy("root").agg(F.min("me").alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = rows.join(checkpointed(firsts), "root")
    gone = checkpointed(met.filter("me <> first").select(F.col("me.doc_id").alias("__wl_id"), F.col("me.version").alias("__wl_version")).distinct())
    key, hashed = docs[id_col], F.xxhash64(docs[text_col].cast("string"))
    kept = docs.join(gone, (key == gone["__wl_id"]) & (hashed == gone["__wl_version"]), "left_anti")
    again = met.filter("me = first").groupBy("me").count().filter("count > 1").select(F.col("me.doc_id").alias("__wl_id"), F.col("me.version").alias("__wl_version"))
    again = checkpointed(again)
    if again.isEmpty():
        return kept
    same = (kept[id_col] == again["__wl_id"]) & (F.xxhash64(kept[text_col].cast("string")) == again["__wl_version"])
    whole = F.struct(*docs.columns)
    one = kept.join(again, same, "left_semi").groupBy(F.col(id_col).alias("__wl_id"), F.xxhash64(F.col(text_col).cast("string")).alias("__wl_version")).agg(F.min_by(whole, F.to_json(whole)).alias("__wl_row"))
    return kept.join(again, same, "left_anti").unionByName(one.select(*(F.col("__wl_row")[c].alias(c) for c in docs.columns)))
