"""Line dedup by pairwise alignment.

Lines are hashed, and so are windows: the shortest runs of consecutive lines that reach MIN_WORDS words from
a line on, or back from a line. A document meets an earlier one where they share a window: each window names
the first document that holds it, and every later holder is paired with that first one, so a passage in a
third of all documents makes one pair for each of them, not one for each two of them. Each line of a block
that could go lies in a window within the block, so it meets a holder of that whole window, whoever held its
single lines before. A pair's lines are aligned by patience diff: common head and tail, then lines unique on
both sides in longest increasing order, then the gaps in between. An aligned block of consecutive lines with
MIN_WORDS words or more goes from the later document. Where lines of the earlier one are left, which stand
twice or in another order, the pair's equal windows are looked up, and what they cover goes too. So a line goes
from each document where it lies in a block of MIN_WORDS words that an earlier document holds. A line's first
holder keeps it, so nothing is lost from the corpus.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import text
from webloom.session import checkpointed

#: Words of an aligned block from which it is deleted.
MIN_WORDS = 20


def windows(lines: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, hash) of the shortest runs of min_words words or more from each line on, and back from each.

    Lines without words begin and end no window, so a line lies in few of them.
    """
    n, least = len(lines), max(1, min_words)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    own = np.flatnonzero(words > 0)
    on = np.searchsorted(total, total[own] + least, "left")
    back = np.searchsorted(total, total[own + 1] - least, "right") - 1
    spans = np.concatenate([np.stack([own, on], 1)[on <= n], np.stack([back, own + 1], 1)[back >= 0]])
    spans = np.unique(spans, axis=0)
    raw = lines.tobytes()
    found = np.array([xxhash.xxh64_intdigest(raw[8 * x : 8 * y]) for x, y in spans.tolist()], np.uint64).view(np.int64)
    return spans[:, 0], spans[:, 1], found


def _hashed(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, version, hashes of the lines, words of the lines, hashes of the windows).

        Lines are compared without space at their ends.
        """
        for b in (whole.slice(x, y - x) for whole in batches for x, y in text.slices(text.strings(whole.column(1)))):
            column = text.strings(b.column(1))
            data, at = text.view(column)
            raw = data.tobytes()
            digest = xxhash.xxh64_intdigest
            version, lines, counts, runs = [], [], [], []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                doc = raw[x:y]
                split = [z.strip() for z in doc.split(b"\n")]
                version.append(digest(doc, 42))
                lines.append(np.array([digest(z) for z in split], np.uint64).view(np.int64))
                counts.append(np.array([len(z.split()) for z in split], np.int32))
                runs.append(np.unique(windows(lines[-1], counts[-1], min_words)[2]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(version, np.uint64).view(np.int64)), pa.array(lines, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.int64()))], ["doc_id", "version", "lines", "words", "windows"])

    return run


def patience(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Blocks (start in a, start in b, length) of two line sequences aligned by patience diff, in order."""
    out: list[tuple[int, int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        n = min(a1 - a0, b1 - b0)
        if n <= 0:
            continue
        differ = np.flatnonzero(a[a0 : a0 + n] != b[b0 : b0 + n])
        head = int(differ[0]) if len(differ) else n
        if head:
            out.append((a0, b0, head))
            a0, b0, n = a0 + head, b0 + head, n - head
        if n > 0:
            differ = np.flatnonzero(a[a1 - n : a1][::-1] != b[b1 - n : b1][::-1])
            tail = int(differ[0]) if len(differ) else n
            if tail:
                out.append((a1 - tail, b1 - tail, tail))
                a1, b1, n = a1 - tail, b1 - tail, n - tail
        if n <= 0:
            continue
        once_a, at_a, times_a = np.unique(a[a0:a1], return_index=True, return_counts=True)
        once_b, at_b, times_b = np.unique(b[b0:b1], return_index=True, return_counts=True)
        _, i, j = np.intersect1d(once_a[times_a == 1], once_b[times_b == 1], assume_unique=True, return_indices=True)
        if not len(i):
            continue
        pa_, pb_ = at_a[times_a == 1][i], at_b[times_b == 1][j]
        order = np.argsort(pa_)
        pa_, pb_ = pa_[order], pb_[order]
        tops: list[int] = []
        at: list[int] = []
        back = [-1] * len(pb_)
        for k, v in enumerate(pb_.tolist()):
            p = bisect_left(tops, v)
            back[k] = at[p - 1] if p else -1
            if p == len(tops):
                tops.append(v)
                at.append(k)
            else:
                tops[p], at[p] = v, k
        k, chain = at[-1], []
        while k >= 0:
            chain.append((a0 + int(pa_[k]), b0 + int(pb_[k])))
            k = back[k]
        pa0, pb0 = a0, b0
        for x, y in chain[::-1]:
            out.append((x, y, 1))
            # the gap before an anchor; common lines next to the anchor are its tail
            stack.append((pa0, x, pb0, y))
            pa0, pb0 = x + 1, y + 1
        stack.append((pa0, a1, pb0, b1))
    out.sort()
    merged: list[tuple[int, int, int]] = []
    for x, y, n in out:
        if merged and merged[-1][0] + merged[-1][2] == x and merged[-1][1] + merged[-1][2] == y:
            merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + n)
        else:
            merged.append((x, y, n))
    return merged


def common(earlier: np.ndarray, later: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Spans of later that lie in equal runs of consecutive lines with min_words words or more, in order.

    Patience diff finds most; lines that it leaves and that earlier holds are looked up by windows, which
    needs no order and no line that is unique.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    gone = np.zeros(len(later) + 2, bool)
    for _, y, n in patience(earlier, later):
        if total[y + n] - total[y] >= min_words:
            gone[y + 1 : y + n + 1] = True
    if np.isin(later[~gone[1:-1] & (words > 0)], earlier).any():
        size = {int(h): int(w) for h, w in zip(later, words, strict=True)}  # equal lines have equal words
        start, stop, run = windows(later, words, min_words)
        held = windows(earlier, np.array([size.get(h, min_words) for h in earlier.tolist()], np.int32), min_words)[2]
        for x, y in zip(start[np.isin(run, held)].tolist(), stop[np.isin(run, held)].tolist(), strict=True):
            gone[x + 1 : y + 1] = True
    edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def _aligned(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs (doc_id, version, lines, words, earlier's lines): the spans that go."""
        for b in batches:
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in b.columns]
            value = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in cols[2:5]]
            gone = []
            for r in range(b.num_rows):
                later, words, earlier = (v[o[r] : o[r + 1]] for v, o in value)
                gone.append([{"start": x, "stop": y} for x, y in common(earlier, later, words, min_words)])
            yield pa.RecordBatch.from_arrays([cols[0], cols[1], pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["doc_id", "version", "gone"])

    return run


def removals(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, gone): spans of lines that each later document loses; version is a hash of its text.

    A document without such a span has no row. Rows without a doc_id or a text take no part.
    """
    kind = docs.schema[id_col].dataType
    line = T.StructType([T.StructField("doc_id", kind), T.StructField("version", T.LongType()), T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("windows", T.ArrayType(T.LongType()))])
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    lines = checkpointed(source.mapInArrow(_hashed(min_words), line))
    me = F.struct("doc_id", "version")
    held = lines.select(me.alias("me"), F.explode("windows").alias("window"))
    first = held.groupBy("window").agg(F.min("me").alias("owner"), F.max("me").alias("last")).filter("owner <> last").select("window", "owner")
    first = checkpointed(first)  # a table of its own: the join below may then split a window that many documents hold
    pairs = held.join(first, "window").filter("owner < me").select("me", "owner").distinct()
    later = lines.dropDuplicates(["doc_id", "version"]).select(me.alias("me"), "lines", "words")
    met = pairs.join(later, "me").join(later.select(F.col("me").alias("owner"), F.col("lines").alias("earlier")), "owner")
    spans = met.select("me.doc_id", "me.version", "lines", "words", "earlier").mapInArrow(_aligned(min_words), T.StructType([T.StructField("doc_id", kind), T.StructField("version", T.LongType()), T.StructField("gone", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))]))
    return spans.filter("size(gone) > 0").groupBy("doc_id", "version").agg(F.flatten(F.collect_set("gone")).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated blocks deleted from the later document, all columns and rows kept, and two more.

    _n_lines: lines of the text before (null text: 0). _n_removed: lines that went. The earlier document is
    the one of the smaller doc_id; of two different texts of one doc_id, the one of the smaller hash. Rows
    that repeat doc_id and text lose the same lines. A text that loses all its lines becomes empty; null
    and empty texts, and rows without a doc_id, stay as they are. An empty table gives an empty one. Columns
    of docs that have the two new names give way to them.
    """
    gone = removals(docs, min_words, id_col, text_col).select(F.col("doc_id").alias("__wl_id"), F.col("version").alias("__wl_version"), F.col("gone").alias("__wl_gone"))
    columns = [c for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    docs = docs.select(*columns)
    place = columns.index(text_col)
    names = [*columns, "_n_lines", "_n_removed"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(x, y - x) for whole in batches for x, y in text.slices(text.strings(whole.column(place)))):
            texts, n_lines, n_gone = [], [], []
            for t, s in zip(b.column(place).to_pylist(), b.column(len(columns)).to_pylist(), strict=True):
                parts = t.split("\n") if t is not None else []
                keep = [True] * len(parts)
                for x in s or ():
                    keep[x["start"] : x["stop"]] = [False] * (x["stop"] - x["start"])
                n_lines.append(len(parts))
                n_gone.append(keep.count(False))
                texts.append(t if all(keep) else "\n".join(p for p, k in zip(parts, keep, strict=True) if k))
            cols = [b.column(k) for k in range(len(columns))]
            cols[place] = pa.array(texts, cols[place].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names)

    met = docs.withColumn("__wl_key", F.xxhash64(F.col(text_col).cast("string"))).join(gone, (F.col(id_col) == F.col("__wl_id")) & (F.col("__wl_key") == F.col("__wl_version")), "left")
    return met.select(*columns, "__wl_gone").mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType())]))
