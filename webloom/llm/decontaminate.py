"""Benchmark decontamination by a size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles, a partition for each power of two u. For each
partition a document is seen through windows of 2 * u shingles, one starting every u shingles, so a passage
of an item's size lies whole in a window of comparable size, and an item's containment in a long document
becomes a similarity that MinHash can see. Each window has HASHES minima, each item too, and one minimum in
common makes a candidate: for an item at the threshold, half as large as its partition allows, a window
misses all minima with probability under 2e-6. Candidates are verified by exact containment of the item's
shingles in the whole document, on the words themselves.

The benchmark goes to the workers in parts of about PART_ITEMS rows and PART_CHARS characters; a larger
benchmark takes one pass over the documents for each part. The parts share out items, so their number changes
nothing in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import text

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 64
PART_ITEMS, PART_CHARS = 20_000, 32_000_000
_RNG = np.random.default_rng(977)
_XOR = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LUT = 1 << 16


def _split(doc: bytes) -> list[bytes]:
    return doc.lower().split()


def shingle_set(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


@dataclass
class Partition:
    """The items of one shingle length and one size, with their minima."""

    length: int
    size: int
    lut: np.ndarray  # (HASHES, _LUT): whether some item's minimum ends in these bits
    minima: np.ndarray  # (HASHES, items), sorted
    order: np.ndarray  # (HASHES, items): which item
    items: list[int]


@dataclass
class Benchmark:
    ids: list
    shingles: list[set[bytes]]
    hashes: list[np.ndarray]
    lengths: list[int]
    partitions: list[Partition]


def _hash_shingles(words: list[bytes], n: int) -> np.ndarray:
    column = pa.array([b" ".join(words).decode("utf-8", "replace")])
    data, at = text.view(column)
    starts, ends = text.words(data, at)
    return np.unique(text.shingles(text.hashes(data, starts, ends), n))


def index(rows: list[tuple]) -> Benchmark:
    """An index of (item_id, text) rows. Items without words match nothing and are left out."""
    b = Benchmark([], [], [], [], [])
    groups: dict[tuple[int, int], list[int]] = {}
    for item, t in rows:
        w = _split((t or "").encode())
        if not w:
            continue
        n = min(SHINGLE, len(w))
        h = _hash_shingles(w, n)
        size = 1 << max(2, int(len(h) - 1).bit_length())
        groups.setdefault((n, size), []).append(len(b.ids))
        b.ids.append(item)
        b.shingles.append(shingle_set(w, n))
        b.hashes.append(h)
        b.lengths.append(n)
    for (n, size), items in sorted(groups.items()):
        with np.errstate(over="ignore"):
            minima = np.array([[((b.hashes[i] ^ x) * o).min() for i in items] for x, o in zip(_XOR, _ODD, strict=True)], np.uint64)
        order = np.argsort(minima, axis=1, kind="stable")
        lut = np.zeros((HASHES, _LUT), bool)
        for k in range(HASHES):
            lut[k, (minima[k] & np.uint64(_LUT - 1)).astype(np.int64)] = True
        b.partitions.append(Partition(n, size, lut, np.take_along_axis(minima, order, 1), order, items))
    return b


def _blocks(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of blocks of `size` in consecutive runs of `counts` elements, blocks of each run)."""
    n = -(-counts // size)
    firsts = np.cumsum(counts) - counts
    run = np.repeat(np.arange(len(counts)), n)
    return firsts[run] + (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)) * size, n


def candidates(b: Benchmark, sh: np.ndarray, counts: np.ndarray, length: int) -> set[tuple[int, int]]:
    """(text, item) pairs with a minimum in common; sh: the texts' shingle hashes, counts: how many each has."""
    parts = [p for p in b.partitions if p.length == length]
    some = np.flatnonzero(counts)
    counts = counts[some]
    found: set[tuple[int, int]] = set()
    if not len(some) or not parts:
        return found
    for k in range(HASHES):
        with np.errstate(over="ignore"):
            h = (sh ^ _XOR[k]) * _ODD[k]
        size, starts, n = 0, None, counts
        for p in parts:
            if not size:
                starts, n = _blocks(counts, p.size)
                low = np.minimum.reduceat(h, starts)
            while size and size < p.size:
                starts, n = _blocks(n, 2)
                low = np.minimum.reduceat(low, starts)
                size *= 2
            size = p.size
            pair = low.copy()
            pair[:-1] = np.minimum(low[:-1], low[1:])
            ends = np.cumsum(n) - 1
            pair[ends] = low[ends]
            hit = np.flatnonzero(p.lut[k][(pair & np.uint64(_LUT - 1)).astype(np.int64)])
            if not len(hit):
                continue
            a, z = np.searchsorted(p.minima[k], pair[hit], "left"), np.searchsorted(p.minima[k], pair[hit], "right")
            run = some[np.searchsorted(ends, hit, "left")]
            for r, x, y in zip(run[z > a].tolist(), a[z > a].tolist(), z[z > a].tolist(), strict=True):
                found.update((r, p.items[i]) for i in p.order[k][x:y].tolist())
    return found


def search(b: Benchmark, column: pa.Array, threshold: float) -> list[tuple[int, object, float]]:
    """(text, item_id, containment) for each pair at or over the threshold, in order."""
    data, at = text.view(column)
    starts, ends = text.words(text.lowered(data), at)
    h = text.hashes(text.lowered(data), starts, ends)
    owner = text.owners(starts, at)
    best: dict[tuple[int, object], float] = {}
    for n in sorted(set(b.lengths)):
        sh = text.shingles(h, n)
        whole = owner[: len(sh)] == owner[n - 1 : n - 1 + len(sh)]
        sh, of = sh[whole], owner[: len(sh)][whole]
        counts = np.bincount(of, minlength=len(at) - 1)
        firsts = np.cumsum(counts) - counts
        exact: dict[int, set[bytes]] = {}
        for r, i in sorted(candidates(b, sh, counts, n)):
            own = sh[firsts[r] : firsts[r] + counts[r]]
            if np.isin(b.hashes[i], own).mean() < threshold:
                continue
            if r not in exact:
                exact[r] = shingle_set(_split(column[r].as_py().encode()), n)
            share = len(b.shingles[i] & exact[r]) / len(b.shingles[i])
            if share >= threshold:
                best[r, b.ids[i]] = max(share, best.get((r, b.ids[i]), 0))
    return [(r, i, s) for (r, i), s in best.items()]


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Benchmark]:
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null").distinct()
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // PART_ITEMS), -(-chars // PART_CHARS))
    for k in range(parts):
        # all texts of an item are in one part, where the best of them counts
        part = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        yield index(sorted((tuple(r) for r in part.collect()), key=str))


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, containment): each document with each item whose shingles it holds to `threshold` or more.

    Shingles are of five words, A-Z in lower case; an item of fewer words is one shingle of its length. Null
    and empty texts, and items without an id, match nothing. Rows that repeat a document repeat its pairs;
    of an item's repeated rows, or several texts of one item, the best counts, once. Empty tables give an
    empty table; other columns play no part.
    """
    out_type = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("containment", T.DoubleType())])
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for part in _parts(benchmark, item_col, item_text_col):
        found = source.mapInArrow(_searcher(docs, part, threshold), out_type)
        out = found if out is None else out.unionAll(found)
    return out


def _searcher(docs: DataFrame, part: Benchmark, threshold: float):
    sent = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        for batch in batches:
            column = text.strings(batch.column(1))
            for x, y in text.slices(column):
                if found := search(b, column[x:y], threshold):
                    r, i, s = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[x:y].take(pa.array(r)), pa.array(i), pa.array(s, pa.float64())], ["doc_id", "item_id", "containment"])

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item to `threshold` or more."""
    place = docs.columns.index(text_col)
    for part in _parts(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = text.strings(batch.column(place))
                for x, y in text.slices(column):
                    keep = [True] * (y - x)
                    for r, _, _ in search(sent.value, column[x:y], threshold):
                        keep[r] = False
                    yield batch.slice(x, y - x).filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
