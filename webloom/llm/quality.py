"""Quality rules by distribution divergence.

A document's character classes and its share of common words form two histograms. A language's reference
is the mean of its documents' shares, first of all that have words enough, then of those whose characters
are nearer to the first reference than the median document, or than NEAR; so junk in less than half of the
documents, however long, doesn't set the reference. A document with words enough goes if the Jensen-Shannon
distance of its characters or of its common words to its language's reference is over a limit. Shorter ones
are told by the base rules alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from webloom.llm import text
from webloom.session import checkpointed

WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
#: (least words, limit): the character distance that a document of so many words may have. Short texts scatter more.
CHAR_LIMITS = ((20, 0.42), (40, 0.235), (80, 0.18))
#: The same for common words.
WORD_LIMITS = ((60, 0.45),)
#: Distance to the first reference up to which a document counts for the second in any case.
NEAR = 0.20
#: Steps between distances 0 and 1 by which the median is counted.
STEPS = 10_000
SYMBOLS = b"#*$%&|<>"
#: Common words of the languages, in lower case, in natural order.
COMMON = "the of and to in is that it for was on with as be by a at this from or de la le les des et en un une du que qui est dans pour par sur der die und das den von zu mit ist im ein eine auf dem el los las y se por con del al no es lo".split()
CLASSES = ("lower", "upper", "digit", "stop", "mark", "symbol", "accent", "space", "line", "control")

_CLASS = np.full(256, 9, np.uint8)
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:", b"!?'\"-()/_[]{}=+@\\~^`", SYMBOLS, range(128, 256), b" \t", b"\n\r\v\f")):
    _CLASS[list(_chars)] = _k
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_COMMON = pa.array(COMMON)
_COMMON_HASH = text.hashes(text.view(_COMMON)[0], text.view(_COMMON)[1][:-1], text.view(_COMMON)[1][1:])
_COMMON_ORDER = np.argsort(_COMMON_HASH)


def repeated_words(ids: np.ndarray) -> int:
    """Words in WINDOW-word windows that occur twice or more, the first included."""
    n = len(ids)
    if n <= WINDOW:
        return 0
    h = text.shingles(ids, WINDOW)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def measure(column: pa.Array) -> dict[str, list | np.ndarray]:
    """The base counts and both histograms of each text."""
    data, at = text.view(column)
    docs = len(at) - 1
    starts, ends = text.words(data, at)
    owner = text.owners(starts, at)
    h = text.hashes(data, starts, ends)
    lower = text.hashes(text.lowered(data), starts, ends)
    n_words = np.bincount(owner, minlength=docs)
    first = np.cumsum(n_words) - n_words
    row = np.repeat(np.arange(docs), np.diff(at))
    point = (data & 0xC0) != 0x80
    inside = text._SPACE[data]
    word_chars = np.bincount(row[point & ~inside], minlength=docs)
    n_symbols = np.bincount(row[_SYMBOL[data]], minlength=docs)
    chars = np.bincount(row[point] * len(CLASSES) + _CLASS[data[point]], minlength=docs * len(CLASSES)).reshape(docs, -1)
    place = np.searchsorted(_COMMON_HASH[_COMMON_ORDER], lower)
    place[place == len(COMMON)] = 0
    hit = _COMMON_HASH[_COMMON_ORDER][place] == lower
    kind = np.where(hit, _COMMON_ORDER[place], len(COMMON))
    common = np.bincount(owner * (len(COMMON) + 1) + kind, minlength=docs * (len(COMMON) + 1)).reshape(docs, -1)
    raw = data.tobytes()
    dup, rep = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for d, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        lines = [z for z in raw[x:y].split(b"\n") if z.strip()]
        dup[d] = len(lines) - len(set(lines))
        rep[d] = repeated_words(h[first[d] : first[d] + n_words[d]])
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": rep, "n_chars": chars.sum(1), "chars": chars, "common": common}


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ALL = (*_BASE, "n_chars")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = text.strings(b.column(2))
        for x, y in text.slices(column):
            m = measure(column[x:y])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(y - x + 1, dtype=np.int32) * m[k].shape[1]), pa.array(m[k].ravel().astype(np.int64))) for k in ("chars", "common")]
            yield pa.RecordBatch.from_arrays([b.column(0)[x:y], b.column(1)[x:y], *(pa.array(m[k].astype(np.int64)) for k in _ALL), *lists], ["doc_id", "lang", *_ALL, "chars", "common"])


def _distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (base 2) of an array of counts to an array of shares.

    The total is a column of its own: inside the lambda it would be summed again for every entry.
    """

    def part(n: Column, y: Column) -> Column:
        x = n / total
        m = (x + y) / 2
        log = lambda a: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
        return log(x) + log(y)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(counts, shares, part), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _references(measured: DataFrame, chars: str, common: str) -> DataFrame:
    """(language, mean shares of both histograms); a row for each language, null among them."""
    sums = [F.avg(F.col("chars")[k] / F.col("_points")).alias(f"c{k}") for k in range(len(CLASSES))] + [F.avg(F.col("common")[k] / F.col("_words")).alias(f"w{k}") for k in range(len(COMMON) + 1)]
    found = measured.filter(F.col("n_words") >= CHAR_LIMITS[0][0]).groupBy("lang").agg(*sums)
    return found.select(F.col("lang").alias(f"{chars}_lang"), F.array(*(f"c{k}" for k in range(len(CLASSES)))).alias(chars), F.array(*(f"w{k}" for k in range(len(COMMON) + 1))).alias(common))


#: Languages up to which references are broadcast: under a kilobyte each. More of them take a shuffled join.
BROADCAST_LANGUAGES = 10_000


def _small(table: DataFrame) -> DataFrame:
    """A table of a row for each language, checkpointed and, if its count allows, marked for broadcast."""
    table = checkpointed(table)
    return F.broadcast(table) if table.count() <= BROADCAST_LANGUAGES else table


def _middle(apart: DataFrame) -> DataFrame:
    """(_lang, _reach): the median of _first up to the next step, or NEAR, whichever is larger.

    Distances are counted by steps, so that a language has STEPS + 1 rows at most, however dealt.
    """
    steps = apart.groupBy(F.col("lang").alias("_lang"), F.ceil(F.col("_first") * STEPS).alias("_step")).agg(F.count("*").alias("_n"))
    mine = Window.partitionBy("_lang")
    steps = steps.withColumn("_so_far", F.sum("_n").over(mine.orderBy("_step"))).withColumn("_all", F.sum("_n").over(mine))
    return steps.filter(2 * F.col("_so_far") >= F.col("_all")).groupBy("_lang").agg(F.greatest(F.min("_step") / STEPS, F.lit(NEAR)).alias("_reach"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts, divergences and verdict of each row of docs.

    A null text has no words and fails the base rules, as an empty one does. Rows whose language is null
    share a reference of their own. Repeated rows repeat, and count as often as they occur; ties at a limit
    are kept; an empty table gives an empty one; other columns play no part.
    """
    kind = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang", T.StringType()), *(T.StructField(k, T.LongType()) for k in _ALL), T.StructField("chars", T.ArrayType(T.LongType())), T.StructField("common", T.ArrayType(T.LongType()))])
    measured = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measured, kind))
    points, words = F.greatest("n_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    measured = measured.withColumns({"_points": points.cast("double"), "_words": words.cast("double")})
    first = _small(_references(measured, "all_chars", "all_common"))
    apart = measured.join(first, measured["lang"].eqNullSafe(first["all_chars_lang"])).filter(F.col("n_words") >= CHAR_LIMITS[0][0]).withColumn("_first", _distance(F.col("chars"), F.col("_points"), F.col("all_chars"))).drop("all_chars", "all_common", "all_chars_lang")
    middle = _small(_middle(apart))
    near = apart.join(middle, apart["lang"].eqNullSafe(middle["_lang"])).filter(F.col("_first") <= F.col("_reach"))
    second = _small(_references(near, "ref_chars", "ref_common"))
    met = measured.join(first, measured["lang"].eqNullSafe(first["all_chars_lang"]), "left").join(second, measured["lang"].eqNullSafe(second["ref_chars_lang"]), "left")
    met = met.withColumn("js_chars", F.round(_distance(F.col("chars"), F.col("_points"), F.coalesce("ref_chars", "all_chars")), 9)).withColumn("js_common", F.round(_distance(F.col("common"), F.col("_words"), F.coalesce("ref_common", "all_common")), 9))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    # a language without a document of words enough has no reference: its distances are null, and tell nothing
    off = F.lit(False)
    for distance, limits in (("js_chars", CHAR_LIMITS), ("js_common", WORD_LIMITS)):
        for least, limit in limits:
            off |= F.coalesce((F.col("n_words") >= least) & (F.col(distance) > limit), F.lit(False))
    return met.select("doc_id", *_BASE, base.alias("base_failed"), (~base & ~off).alias("kept"), "js_chars", "js_common")
