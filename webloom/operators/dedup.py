"""SimHash of shingles, near-duplicate leaders, URL and content deduplication."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from webloom.functions import url as U
from webloom.session import checkpointed

BITS, GRAM, THRESHOLD = 64, 3, 3
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3
_DROP = re.compile(r"[^a-z0-9À-￿\s]")


def tokens(text: Column | str) -> Column:
    """Lower case, letters a-z, digits, U+00C0 and on; all else separates."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9À-￿\s]", " "), r"\s+"), lambda t: t != "")


def shingles(words: Column, n: int = GRAM) -> Column:
    """n-grams; n tokens or fewer are one."""
    size = F.size(words)
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(F.array_join(words, " "))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))


def hamming(a: Column, b: Column) -> Column:
    """(S31)"""
    return F.bit_count(a.bitwiseXOR(b))


def _fnv1a(units: list[int]) -> int:
    h = _OFFSET
    for unit in units:
        h = ((h ^ unit) * _PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a64(s: str) -> int:
    """FNV-1a over UTF-16 code units."""
    return _fnv1a(np.frombuffer(s.encode("utf-16-le", "surrogatepass"), "<u2").tolist())


def _tokens(s: str) -> list[str]:
    # characters past the basic plane are pairs of code units, both in the kept range
    return re.sub(_DROP, lambda m: m[0] if ord(m[0]) > 0xFFFF else " ", s.lower()).split()


#: Code units past which a gram is hashed by itself, UTF-8 bytes of texts and grams of one vectorised step.
_LONG, _STEP, _VOTES = 512, 1 << 20, 1 << 17


def simhashes(texts: list[str | None]) -> np.ndarray:
    """The fingerprint of each text: 64 equal votes of 3-grams; a tie is 0, and so is an empty text.

    All texts' tokens stand in one buffer of code units, a space after each, so a gram is a range of it and
    FNV-1a goes over all grams at once, unit by unit.
    """
    words = [_tokens(t or "") for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    units = np.frombuffer("".join(" ".join(w) + " " for w in words if w).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    ends = np.flatnonzero(units == 32)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    n_grams = np.where(n_words > 0, np.maximum(1, n_words - GRAM + 1), 0)
    owner = np.repeat(np.arange(len(texts)), n_grams)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
    first = np.repeat(np.cumsum(n_words) - n_words, n_grams) + inner
    lo = starts[first] if len(first) else first
    hi = ends[first + np.minimum(n_words, GRAM)[owner] - 1] if len(first) else first
    size = hi - lo
    order = np.argsort(-size, kind="stable")
    at, size = lo[order], size[order]
    h = np.full(len(order), _OFFSET, np.uint64)
    long = int(np.searchsorted(-size, -_LONG, "left"))
    with np.errstate(over="ignore"):
        live = np.searchsorted(-size, -np.arange(1, min(_LONG, int(size[0])) + 1), "right") if len(size) else []
        for c, k in enumerate(live):
            h[:k] = (h[:k] ^ units[at[:k] + c]) * np.uint64(_PRIME)
    for k in range(long):
        h[k] = _fnv1a(units[at[k] : at[k] + size[k]].tolist())
    hashed = np.empty(len(h), np.uint64)
    hashed[order] = h
    votes = np.zeros((len(texts), BITS), np.int64)
    for a in range(0, len(hashed), _VOTES):
        bits = np.unpackbits(hashed[a : a + _VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[a : a + _VOTES]
        edge = np.flatnonzero(np.diff(mine, prepend=-1))
        votes[mine[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n_grams[:, None], axis=1, bitorder="little").view("<u8").ravel()


def simhash_of(s: str | None) -> int:
    """The fingerprint of one text."""
    return int(simhashes([s])[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, fingerprint) as a signed long; of a table or a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            a = 0
            while a < len(texts):
                z, room = a, _STEP
                while z < len(texts) and (z == a or room > 0):
                    room -= len(texts[z] or "")
                    z += 1
                got = simhashes(texts[a:z])
                yield pa.RecordBatch.from_arrays([*(b.column(k)[a:z] for k in range(b.num_columns - 1)), pa.array(got.view(np.int64))], [key, *keep, "fingerprint"])
                a = z

    return docs.select(key, *keep, text).mapInArrow(run, T.StructType([*(docs.schema[c] for c in (key, *keep)), T.StructField("fingerprint", T.LongType())]))


#: Ways to cut 64 bits: so many blocks, of which so many make a band; near fingerprints share a band.
_CUTS = ((4, 1), (5, 2), (6, 3), (8, 5))
#: Fingerprints that evenly spread ones should have in a bucket, at most.
_BUCKET = 16


def bands(n: int, threshold: int) -> list[int]:
    """Masks of which two fingerprints that differ in `threshold` bits or fewer agree under one at least.

    Of `blocks` blocks, blocks - threshold are untouched; a band is made of so many. The more fingerprints
    there are, the more bits a band has, so that buckets stay small.
    """
    cuts = [(b + threshold - 3, c) for b, c in _CUTS]
    for blocks, chosen in cuts:
        edges = [BITS * k // blocks for k in range(blocks + 1)]
        each = [((1 << (z - a)) - 1) << a for a, z in zip(edges[:-1], edges[1:], strict=True)]
        masks = [sum(c) for c in combinations(each, chosen)]
        if (blocks, chosen) == cuts[-1] or n >> min(m.bit_count() for m in masks) < _BUCKET:
            return [m - (1 << BITS) if m >> 63 else m for m in masks]
    raise AssertionError


def _banded(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(masks)))).alias("band")


def near_pairs(prints: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(a, b, distance), a before b, of keys whose fingerprints differ in `threshold` bits or fewer.

    Two near fingerprints agree in a band. Equal fingerprints are merged first, and pairs of merged ones are
    found once, in the first band that they share, so copies cost nothing in the join: a and b are each the
    least key of their fingerprint, and `copies` links the other holders to it.
    """
    merged = checkpointed(prints.groupBy("fingerprint").agg(F.min(key).alias("node")).filter("node is not null"))
    masks = bands(merged.count(), threshold)
    m = merged.select("fingerprint", "node", _banded(F.col("fingerprint"), masks)).select("fingerprint", "node", "band.*")
    left, right = m.select("k", "v", F.col("node").alias("a"), F.col("fingerprint").alias("fa")), m.select("k", "v", F.col("node").alias("b"), F.col("fingerprint").alias("fb"))
    apart = F.col("fa").bitwiseXOR(F.col("fb"))
    near = left.join(right, ["k", "v"]).filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= threshold))
    earlier = F.lit(False)
    for k, mask in enumerate(masks[:-1]):
        earlier |= (F.lit(k) < F.col("k")) & (apart.bitwiseAND(F.lit(mask).cast("long")) == 0)
    return near.filter(~earlier).select("a", "b", F.bit_count(apart).alias("distance"))


def copies(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(a, b, distance 0): the least key of a fingerprint with each other key that holds it; null keys have no row.

    With near_pairs this is the whole relation: keys are near if their least keys are the same or are a pair.
    """
    first = prints.groupBy("fingerprint").agg(F.min(key).alias("a"), F.max(key).alias("last")).filter("a <> last").select(F.col("fingerprint").alias("_fp"), "a")
    first = checkpointed(first)  # a table of its own: the join below may then split a fingerprint that many keys hold
    held = prints.join(first, prints["fingerprint"] == first["_fp"]).filter(F.col(key) > F.col("a"))
    return held.select("a", F.col(key).alias("b"), F.lit(0).alias("distance")).distinct()


def leaders(prints: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, is_duplicate): in the order of key, a row is a duplicate if an earlier leader is near.

    Copies follow their first row. Among first rows the greedy choice is reached by rounds: a row whose nearer
    earlier ones are all settled is settled; each round settles at least the first open row of each group, so
    there are as many rounds as the longest chain of near rows needs.
    """
    prints = checkpointed(prints.select(key, "fingerprint"))
    pairs = checkpointed(near_pairs(prints, threshold, key).select(F.col("a"), F.col("b")))
    first = prints.groupBy("fingerprint").agg(F.min(key).alias("node"))
    state = checkpointed(first.select("node").join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi").select("node", F.lit(None).cast("boolean").alias("leads")))
    while not (open_ := state.filter("leads is null")).isEmpty():
        # an earlier neighbour without an earlier neighbour of its own is a leader
        before = open_.join(pairs, open_["node"] == pairs["b"]).select("node", "a").join(state.select(F.col("node").alias("a"), "leads", F.lit(True).alias("held")), "a", "left")
        told = before.groupBy("node").agg(F.max(F.col("held").isNull() | F.coalesce("leads", F.lit(False))).alias("hit"), F.max(F.col("held").isNotNull() & F.col("leads").isNull()).alias("wait"))
        state = checkpointed(state.join(told, "node", "left").select("node", F.coalesce("leads", F.when(F.col("hit"), False).when(~F.col("wait"), True)).alias("leads")))
    settled = first.join(state, "node", "left").select(F.col("fingerprint").alias("_fp"), F.col("node").alias("_node"), F.coalesce("leads", F.lit(True)).alias("_leads"))
    return prints.join(settled, prints["fingerprint"] == settled["_fp"]).select(key, "fingerprint", (~((F.col(key) == F.col("_node")) & F.col("_leads"))).alias("is_duplicate"))


def nearest(prints: DataFrame, store: DataFrame, threshold: int, key: str = "doc_id", others: bool = False) -> DataFrame:
    """(key, distance) to the nearest stored fingerprint within threshold; a key without one is not listed.

    With `others` a key's own fingerprint in the store doesn't count, unless another key holds the same one.
    """
    ends = [F.min(key).alias("least"), F.max(key).alias("most")] if others else []
    kept = checkpointed(store.groupBy(F.col("fingerprint").alias("fb")).agg(F.count("*").alias("n"), *ends))
    masks = bands(kept.count(), threshold)
    own = F.min(key).alias("k0"), F.max(key).alias("k1")
    asked = prints.groupBy(F.col("fingerprint").alias("fa")).agg(*own)
    q = asked.select("fa", "k0", "k1", _banded(F.col("fa"), masks)).select("fa", "k0", "k1", "band.*")
    s = kept.select("fb", *(["least", "most"] if others else []), _banded(F.col("fb"), masks)).select("fb", *(["least", "most"] if others else []), "band.*")
    near = q.join(s, ["k", "v"]).withColumn("distance", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))).filter(F.col("distance") <= threshold)
    if others:
        # equal fingerprints, and every holder on both sides is one key
        near = near.filter(~((F.col("fa") == F.col("fb")) & (F.col("least") == F.col("most")) & (F.col("k0") == F.col("least")) & (F.col("k1") == F.col("least"))))
    least = checkpointed(near.groupBy("fa").agg(F.min("distance").alias("distance")))
    return prints.join(least, prints["fingerprint"] == least["fa"]).select(key, "distance")


def first_urls(df: DataFrame, url: str = "url", order: str = "ordinal", **options) -> DataFrame:
    """Of rows whose normalised URLs agree, the first; its URL stays as it came."""
    w = Window.partitionBy("_norm").orderBy(order)
    return df.withColumn("_norm", U.normalize(url, **options)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_norm", "_n")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, n, first): texts that occur more than once."""
    return docs.select(key, F.sha2(F.col(text), 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def until_repeat(pages: DataFrame, key: str, page: str, items: str) -> DataFrame:
    """Pages of each key before the first whose items equal the page before. (H8, Q42)"""
    w = Window.partitionBy(key).orderBy(page)
    digest = F.sha2(F.col(items).cast("string"), 256)
    out = pages.withColumn("_same", F.coalesce(digest == F.lag(digest).over(w), F.lit(False)))
    return out.withColumn("_stop", F.max("_same").over(w)).filter("not _stop").drop("_same", "_stop")
