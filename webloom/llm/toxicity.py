"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is a run of letters, digits, apostrophes and bytes outside ASCII, in lower case. Its vector is the
sum of hashed embeddings of the whole word and of its leading bytes, so inflected forms share what they
learn. Filters of several widths slide over the whole text, each keeps its maximum, and a logistic layer
joins them. A logit threshold is calibrated for each language, told from a text's own function words, on a
fold that the weights don't see; the score is the logistic of the logit above that threshold.

The fit takes every labelled row that may be learnt from, and its whole text. Rows are dealt into shards of
about SHARD characters by a hash of their text. Counts of buckets over all rows give the start; from it each
shard fits a model by itself, and their changes are averaged, those of a bucket over the shards that hold it.
Thresholds are found over the logits of all rows, counted by steps of 1 / STEPS. One shard alone is fitted on
the driver.
"""

from __future__ import annotations

import binascii
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import text

SHARD = 12_000_000
STEPS = 1000
BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 8)
EPOCHS = 3
PRIOR = 8
BATCH = 64
BATCH_WORDS = 200_000
BLOCK = 1024
RATE = 0.05
FOLDS = 5
SEED = 20240501

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with be as by this are from or which",
    "fr": "le la les des et une est pour que qui dans par sur pas au avec du ce il ne",
    "de": "der die und das ist von mit den zu im ein eine nicht auf dem sich des als auch für",
    "es": "el los las del se por con una su para como más al lo y es en no un ie",
}
LANGUAGES = tuple(FUNCTION_WORDS)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z, and the UTF-8 of À to Þ, in lower case."""
    out = text.lowered(data)
    if len(out) > 1:
        second = np.zeros(len(out), bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out = np.where(second, out + np.uint8(32), out)
    return out


def _hash_of(words: str) -> np.ndarray:
    column = pa.array(words.split())
    data, at = text.view(column)
    return text.hashes(data, at[:-1], at[1:])


_MARKS = {k: np.sort(_hash_of(v)) for k, v in FUNCTION_WORDS.items()}


@dataclass
class Words:
    """The words of some texts: distinct ones with their features, and the sequence as indices."""

    features: np.ndarray  # (distinct, 1 + prefixes) buckets; bucket 0 stands for none
    distinct: np.ndarray  # hashes
    index: np.ndarray  # of each word in order
    counts: np.ndarray  # words of each text
    language: np.ndarray  # of each text; len(LANGUAGES) if there is no telling


def words_of(column: pa.Array) -> Words:
    data, at = text.view(column)
    data = _lower(data)
    starts, ends = text.runs(_WORD[data], at)
    h = text.hashes(data, starts, ends)
    owner = text.owners(starts, at)
    counts = np.bincount(owner, minlength=len(at) - 1)
    distinct, first, index = np.unique(h, return_index=True, return_inverse=True)
    features = np.zeros((len(distinct), 1 + len(PREFIXES)), np.int64)
    s, length = starts[first], (ends - starts)[first]
    features[:, 0] = 1 + distinct % np.uint64(BUCKETS - 1)
    for k, p in enumerate(PREFIXES):
        long = np.flatnonzero(length > p)
        if len(long):
            order = long[np.argsort(s[long], kind="stable")]
            salt = text.mixed(np.full(1, p, np.uint64))
            chars = data[s[order][:, None] + np.arange(p)[None, :]]
            with np.errstate(over="ignore"):
                folded = ((chars.astype(np.uint64) + np.uint64(1)) * text.powers(p)[None, :]).sum(1, dtype=np.uint64)
                features[order, k + 1] = 1 + text.mixed(folded + salt) % np.uint64(BUCKETS - 1)
    votes = np.zeros((len(at) - 1, len(LANGUAGES)), np.int64)
    for k, lang in enumerate(LANGUAGES):
        votes[:, k] = np.bincount(owner[np.isin(distinct, _MARKS[lang])[index]], minlength=len(at) - 1)
    language = np.where(votes.max(1, initial=0) > 0, votes.argmax(1), len(LANGUAGES)) if len(at) > 1 else np.zeros(0, np.int64)
    return Words(features, distinct, index, counts, language)


def gathered(parts: list[Words]) -> Words:
    """The words of several blocks of texts as of one."""
    every = np.concatenate([p.distinct for p in parts])
    distinct, first, place = np.unique(every, return_index=True, return_inverse=True)
    base = np.cumsum([0, *(len(p.distinct) for p in parts)])
    index = np.concatenate([place[b + p.index] for b, p in zip(base, parts, strict=False)])
    return Words(np.concatenate([p.features for p in parts])[first], distinct, index, np.concatenate([p.counts for p in parts]), np.concatenate([p.language for p in parts]))


@dataclass
class Model:
    table: np.ndarray  # (BUCKETS, DIM); row 0 is zero
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: np.ndarray  # of each filter
    out: np.ndarray
    prior: float
    thresholds: np.ndarray  # for each language, then for none

    def logits(self, w: Words) -> np.ndarray:
        """Of each text. A text without words has filters over one zero vector."""
        vectors = np.vstack([self.table[w.features].sum(1), np.zeros((1, DIM), np.float32)])
        seq, starts, live = _padded(w)
        best = []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            z = np.zeros((len(seq), FILTERS), np.float32)
            for j in range(width):
                part = (vectors @ f[j])[seq]
                z[: len(seq) - j] += part[j:]
            z[~live] = -np.inf
            best.append(np.maximum.reduceat(z, starts, axis=0))
        return np.maximum(np.hstack(best) + self.bias, 0) @ self.out + self.prior

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        w = words_of(column)
        return 1 / (1 + np.exp(-np.clip(self.logits(w).astype(np.float64) - self.thresholds[w.language], -40, 40)))


def _padded(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word sequence with two zero words after each text, starts of the texts, where a window may start)."""
    pad, none = max(WIDTHS) - 1, len(w.distinct)
    size = np.maximum(w.counts, 1)
    starts = np.cumsum(size + pad) - (size + pad)
    seq = np.full(int((size + pad).sum()), none, np.int64)
    firsts = np.cumsum(w.counts) - w.counts
    place = np.repeat(starts - firsts, w.counts) + np.arange(len(w.index))
    seq[place] = w.index
    live = np.zeros(len(seq), bool)
    live[place] = True
    live[starts] = True
    return seq, starts, live


def _held(w: Words, labels: np.ndarray) -> np.ndarray:
    """(2, BUCKETS): how many texts labelled 0 and 1 hold each bucket."""
    owner = np.repeat(np.arange(len(labels)), w.counts)
    out = np.zeros((2, BUCKETS), np.int64)
    for k in range(w.features.shape[1]):
        pair = np.unique(owner * BUCKETS + w.features[w.index, k])
        for y in (0, 1):
            out[y] += np.bincount(pair[labels[pair // BUCKETS] == y] % BUCKETS, minlength=BUCKETS)
    return out


def _warm(held: np.ndarray, share: float) -> np.ndarray:
    """Shrunken log odds of each bucket by the texts that hold it, as the embeddings' first dimension; share is that of label 1."""
    neg, pos = held
    # counts as if PRIOR more texts had held the bucket, labelled like the others
    odds = np.log((pos + PRIOR * share) / (neg + PRIOR * (1 - share)) * (1 - share) / share)
    odds[0] = 0
    return np.clip(odds, -2, 4)


def fit(texts: list[str], labels: np.ndarray, fold: np.ndarray) -> Model | None:
    """Fit on rows with fold False, calibrate thresholds on the others. None if a label is missing."""
    column = pa.array(texts, pa.string())
    train = np.flatnonzero(~fold)
    if labels[train].sum() in (0, len(train)):
        return None
    taken = column.take(pa.array(train))
    every = gathered([words_of(taken[a:b]) for a, b in text.slices(taken)])
    m, rng = _start(_held(every, labels[train].astype(int)), labels[train].mean())
    _learn(m, every, labels[train], labels[train].mean(), rng)
    pieces = [words_of(column[a:b]) for a, b in text.slices(column)]
    m.thresholds = _thresholds(np.concatenate([m.logits(w) for w in pieces]), labels, np.concatenate([w.language for w in pieces]), fold)
    return m


def _start(held: np.ndarray, share: float) -> tuple[Model, np.random.Generator]:
    """The model that a fit starts from, and the random numbers that follow."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    table[:, 0] = _warm(held, share)
    table[0] = 0
    filters = [rng.normal(0, 0.1, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    for f in filters:
        f[:, 0, :] += 1 / len(f)
    return Model(table, filters, np.full(FILTERS * len(WIDTHS), -1.0, np.float32), np.full(FILTERS * len(WIDTHS), 0.1, np.float32), -1.0, np.zeros(len(LANGUAGES) + 1)), rng


def _batches(order: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of at most BATCH texts, and of at most BATCH_WORDS words where there are several."""
    a = 0
    while a < len(order):
        total = np.cumsum(counts[order[a : a + BATCH]])
        b = a + max(1, int(np.searchsorted(total, BATCH_WORDS, "right")))
        yield order[a:b]
        a = b


def _learn(m: Model, every: Words, labels: np.ndarray, share: float, rng: np.random.Generator) -> None:
    """Epochs over some texts, which change m in place; share is that of label 1 among all texts of the fit."""
    y, filters = labels.astype(np.float64), m.filters
    weight = np.where(y == 1, 1 / (2 * share), 1 / (2 * (1 - share)))
    ends = np.cumsum(every.counts)
    slow = {"table": np.full(BUCKETS, 1e-3), "bias": np.full_like(m.bias, 1e-3), "out": np.full_like(m.out, 1e-3), "prior": 1e-3} | {f"f{k}": np.full_like(f, 1e-3) for k, f in enumerate(filters)}
    feats = np.vstack([every.features, np.zeros((1, every.features.shape[1]), np.int64)])

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        slow[name] += grad**2
        value -= RATE * grad / np.sqrt(slow[name])

    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for rows in _batches(order, every.counts):
            index = np.concatenate([every.index[ends[r] - every.counts[r] : ends[r]] for r in rows])
            part = Words(every.features, every.distinct, index, every.counts[rows], every.language[rows])
            seq, starts, live = _padded(part)
            ids = feats[seq]
            x = m.table[ids].sum(1)
            stops = np.append(starts[1:], len(seq))
            zs, tops = [], []
            for width, f in zip(WIDTHS, filters, strict=True):
                z = np.zeros((len(seq), FILTERS), np.float32)
                for j in range(width):
                    z[: len(seq) - j] += (x @ f[j])[j:]
                z[~live] = -np.inf
                top = np.array([s + z[s:e].argmax(0) for s, e in zip(starts, stops, strict=True)])
                tops.append(top)
                zs.append(np.take_along_axis(z, top, 0))
            pre = np.hstack(zs) + m.bias
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.prior, -30, 30)))
            g = (p - y[rows]) * weight[rows] / len(rows)
            dh = g[:, None] * m.out[None, :] * (pre > 0)
            d_out, d_bias, d_prior = h.T @ g, dh.sum(0), g.sum()
            dx_at, dx = [], []
            for k, (width, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                df = np.zeros_like(f)
                for j in range(width):
                    at = np.minimum(tops[k] + j, len(seq) - 1)
                    df[j] = np.einsum("nfd,nf->df", x[at], d)
                    dx_at.append(at.ravel())
                    dx.append((d[:, :, None] * f[j].T[None, :, :]).reshape(-1, DIM))
                step(f"f{k}", f, df)
            step("bias", m.bias, d_bias)
            step("out", m.out, d_out)
            slow["prior"] += d_prior**2
            m.prior -= RATE * d_prior / np.sqrt(slow["prior"])
            at, grad = np.concatenate(dx_at), np.concatenate(dx)
            touched = grad.any(1)
            at, grad = at[touched], grad[touched]
            buckets = ids[at].ravel()
            spread = np.repeat(grad, ids.shape[1], axis=0)
            some, inverse = np.unique(buckets, return_inverse=True)
            total = np.zeros((len(some), DIM))
            np.add.at(total, inverse, spread)
            slow["table"][some] += (total**2).sum(1)
            m.table[some] -= (RATE * total / np.sqrt(slow["table"][some])[:, None]).astype(np.float32)
            m.table[0] = 0


def _best(logits: np.ndarray, labels: np.ndarray, times: np.ndarray) -> float:
    """The threshold of the best F1, in the middle of the gap around it; each logit stands for so many rows."""
    order = np.argsort(-logits, kind="stable")
    s, y, n = logits[order], labels[order], times[order]
    hits = np.cumsum(y * n)
    f1 = 2 * hits / (np.cumsum(n) + hits[-1])
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    below = s[k + 1] if k + 1 < len(s) else s[k] - 1
    return float((s[k] + below) / 2)


def _thresholds(logits: np.ndarray, labels: np.ndarray, language: np.ndarray, fold: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """A threshold for each language on the fold; where a label is scarce, all its rows; else all languages'."""
    n = np.ones(len(logits), np.int64) if times is None else times
    both = lambda rows: 5 <= (labels * n)[rows].sum() <= n[rows].sum() - 5
    best = lambda rows: _best(logits[rows], labels[rows], n[rows])
    out = np.full(len(LANGUAGES) + 1, best(fold if both(fold) else np.ones(len(fold), bool)))
    for k in range(len(LANGUAGES)):
        here = language == k
        rows = here & fold if both(here & fold) else here
        if both(rows):
            out[k] = best(rows)
    return out


def bucket(doc_id) -> int:
    return binascii.crc32(str(doc_id).encode()) % FOLDS


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, np.ndarray, int, Callable[[Batches, str], DataFrame]]:
    """(rows to learn from: c, id, text, hash, y, fold; how many there are by fold and label; their characters; passed).

    passed(run, schema) is what run makes of batches of these rows. A task has one Python worker for both, where
    mapInArrow over the rows would start a second one beside it.

    Texts don't move for it: ids, hashes and labels are joined, and of each row that counts the driver takes
    a hash, a label and a length, which are 13 bytes.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    known = known.filter(F.crc32(F.col("_id").cast("string")) % FOLDS != 0)
    name, body = F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc, told = F.crc32(name), F.xxhash64(name, body)
    narrow = docs.select(F.col(id_col).alias("_doc"), crc.alias("c"), name.alias("id"), told.alias("hash"), F.sha2(body, 256).alias("sha"), F.length(body).alias("chars")).join(known, F.col("_doc") == F.col("_id"))
    kept = narrow.groupBy("sha", "c", "id", "hash", "_y").agg(F.count("*").alias("times"), F.max("chars").alias("chars"))
    # of a text that stands under several ids the first counts
    kept = kept.groupBy("sha").agg(F.min_by(F.struct("hash", "c", "_y", "times", "chars"), F.struct("c", "id")).alias("k"))
    one = lambda c: c.cast("tinyint")
    kind = one(F.col("k._y") == 1) + 2 * one(F.col("k.c") % FOLDS == 1) + 4 * one(F.col("k.times") > 1)
    there = kept.select("k.hash", kind.cast("tinyint").alias("kind"), "k.chars").toArrow()
    hashes, kinds = (there[k].to_numpy() for k in ("hash", "kind"))
    full = docs.select(crc.alias("c"), name.alias("id"), body.alias("text"), told.alias("hash"))
    once = _taken(full, hashes[kinds < 4], kinds[kinds < 4])
    again = _taken(full, hashes[kinds >= 4], kinds[kinds >= 4]) if (kinds >= 4).any() else None

    def passed(run: Batches, schema: str) -> DataFrame:
        if not again:
            return full.mapInArrow(lambda batches: run(once(batches)), schema)
        # the shuffle parts the two functions of repeated rows
        repeated = full.mapInArrow(again, _ROWS).dropDuplicates(["hash"])
        return full.mapInArrow(lambda batches: run(once(batches)), schema).unionAll(repeated if run is iter else repeated.mapInArrow(run, schema))

    return passed(iter, _ROWS), np.bincount(kinds & 3, minlength=4).reshape(2, 2), int(there["chars"].to_numpy().sum(dtype=np.int64)), passed


_ROWS = "c long, id string, text string, hash long, y int, fold boolean"


def _taken(rows: DataFrame, hashes: np.ndarray, kinds: np.ndarray) -> Batches:
    """Takes those of rows that have one of these hashes, and adds its label and fold."""
    order = np.argsort(hashes)
    sent = rows.sparkSession.sparkContext.broadcast((hashes[order], kinds[order]))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = sent.value
        for b in batches:
            h = b.column("hash").to_numpy()
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            mine = known[at] == h if len(known) else np.zeros(len(h), bool)
            if mine.any():
                k = kind[at[mine]]
                part = b.filter(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((k & 1).astype(np.int32)), pa.array(k & 2 > 0)], [*part.schema.names, "y", "fold"])

    return take


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", shard: int = SHARD) -> Model | None:
    """Learn from all labelled rows of docs whose crc32(doc_id) mod 5 is not 0, in shards of about so many characters.

    Repeated labels of one doc_id count as 1 if one of them is 1; null labels and ids are left out, a null text
    is an empty one, and repeated texts count once.
    """
    rows, n, chars, passed = _labelled(docs, labels, id_col, text_col, label_col)
    if not n[0].all():
        return None
    shards = -(-chars // shard)
    if shards > 1:
        return _fit_shards(rows, passed, shards, n[0, 1] / n[0].sum())
    got = sorted(rows.collect(), key=lambda r: (r["c"], r["id"]))
    return fit([r["text"] for r in got], np.array([r["y"] for r in got]), np.array([r["fold"] for r in got]))


def _fit_shards(rows: DataFrame, passed: Callable[[Batches, str], DataFrame], shards: int, share: float) -> Model:
    """rows and passed are those of _labelled."""
    sc = rows.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            b = b.filter(pc.invert(b.column("fold")))
            column, y = text.strings(b.column("text")), b.column("y").to_numpy(zero_copy_only=False)
            for i, j in text.slices(column):
                total += _held(words_of(column[i:j]), y[i:j])
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0, some]), pa.array(total[1, some])], ["bucket", "neg", "pos"])

    held = np.zeros((2, BUCKETS), np.int64)
    for r in passed(count, "bucket int, neg long, pos long").groupBy("bucket").agg(F.sum("neg"), F.sum("pos")).collect():
        held[:, r[0]] = r[1:]
    start, _ = _start(held, share)
    sent = sc.broadcast(start)

    def learn(part: pa.Table) -> pa.Table:
        part = part.sort_by([("c", "ascending"), ("id", "ascending")]).combine_chunks()
        column, which = text.strings(part["text"].chunk(0)), part["shard"][0].as_py()
        first = sent.value
        m = Model(first.table.copy(), [f.copy() for f in first.filters], first.bias.copy(), first.out.copy(), first.prior, first.thresholds)
        every = gathered([words_of(column[i:j]) for i, j in text.slices(column)])
        _learn(m, every, part["y"].to_numpy(), share, np.random.default_rng([SEED, which]))
        change = m.table - first.table
        blocks = [(k // BLOCK, np.flatnonzero(change[k : k + BLOCK].any(1)), change[k : k + BLOCK]) for k in range(0, BUCKETS, BLOCK)]
        out = [(k, which, len(column), some.astype(np.int64).tobytes(), d[some].astype(np.float64).tobytes()) for k, some, d in blocks if len(some)]
        out.append((-1, which, len(column), b"", _flat(m).tobytes()))
        return pa.Table.from_pylist([dict(zip(_CHANGE.names, r, strict=True)) for r in out], _CHANGE)

    def average(part: pa.Table) -> pa.Table:
        total, weight = None, None
        # one after the other in the order of shards, so that the sums do not depend on how they came
        for r in part.sort_by("shard").to_pylist():
            values = np.frombuffer(r["change"])
            if r["block"] < 0:
                total, weight = (0, 0) if total is None else (total, weight)
                total, weight = total + r["n"] * values, weight + r["n"]
                continue
            total, weight = (np.zeros((BLOCK, DIM)), np.zeros((BLOCK, 1))) if total is None else (total, weight)
            some = np.frombuffer(r["buckets"], np.int64)
            total[some] += r["n"] * values.reshape(-1, DIM)
            weight[some] += r["n"]
        mean = total / np.maximum(weight, 1)
        return pa.table({"block": pa.array([part["block"][0].as_py()], pa.int32()), "mean": pa.array([mean.tobytes()], pa.binary())})

    dealt = rows.filter(~F.col("fold")).select("c", "id", "text", "y", F.pmod("hash", F.lit(shards)).cast("int").alias("shard"))
    changes = dealt.groupBy("shard").applyInArrow(learn, "block int, shard int, n long, buckets binary, change binary")
    m = start
    for block, mean in changes.groupBy("block").applyInArrow(average, "block int, mean binary").collect():
        values = np.frombuffer(mean)
        if block < 0:
            _unflat(m, values)
        else:
            m.table[block * BLOCK : (block + 1) * BLOCK] += values.reshape(BLOCK, DIM).astype(np.float32)
    done = sc.broadcast(m)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = text.strings(b.column("text"))
            for i, j in text.slices(column):
                w = words_of(column[i:j])
                steps = np.rint(done.value.logits(w).astype(np.float64) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("y")[i:j], b.column("fold")[i:j], pa.array(w.language, pa.int32()), pa.array(steps)], ["y", "fold", "language", "step"])

    told = passed(judge, "y int, fold boolean, language int, step long").groupBy("y", "fold", "language", "step").count().toArrow().to_pydict()
    m.thresholds = _thresholds(np.array(told["step"]) / STEPS, np.array(told["y"]), np.array(told["language"]), np.array(told["fold"]), np.array(told["count"]))
    return m


_CHANGE = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("buckets", pa.binary()), ("change", pa.binary())])


def _flat(m: Model) -> np.ndarray:
    """All that a model learns but its table, in one row."""
    return np.concatenate([*(f.ravel() for f in m.filters), m.bias, m.out, [m.prior]]).astype(np.float64)


def _unflat(m: Model, values: np.ndarray) -> None:
    at = 0
    for part in (*m.filters, m.bias, m.out):
        part[...] = values[at : at + part.size].reshape(part.shape)
        at += part.size
    m.prior = float(values[at])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of docs. A null text scores as an empty one; without a model all scores are 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            column = text.strings(b.column(1))
            if m is None:
                got = np.zeros(len(column))
            else:
                got = np.concatenate([m.scores(column[x:y]) for x, y in text.slices(column)]) if len(column) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Empty and null texts score as a text without words; ties at 0.5 predict 1; repeated rows score alike; an
    empty table gives an empty one, and other columns play no part. A null doc_id is not held out.
    """
    out = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if m is None or not b.num_rows:
                yield b
                continue
            column = text.strings(b.column(place))
            for x, y in text.slices(column):
                yield b.slice(x, y - x).filter(pa.array(m.scores(column[x:y]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
