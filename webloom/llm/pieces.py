"""SentencePiece BPE encoding by a prefix table, and decoding.

An encoding is right exactly if each token encodes to itself and each two neighbours stay two tokens when
their joined text is encoded. So for each prefix of a unit there is one last token: of the pieces that an
Aho-Corasick automaton finds ending there, the one that is compatible with the last token of the prefix
before it. The table holds that token for each prefix; ids are recovered from the end backwards.

Compatibility replays two pieces' own merges side by side, the higher score first, and asks whether a merge
across the border would come first. Merges never cross a space to its left, nor a character outside the
vocabulary, nor, if no piece of the vocabulary does, the border between letters and other characters; so a
text is encoded in units cut there, and a worker keeps the ids of the units it has met in two tables of
bounded size, of which the older goes when the newer is full.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import text

SPACE = "▁"
#: Units that a worker remembers at most, and characters of a remembered unit.
MEMO, MEMO_CHARS = 250_000, 32
#: Pairs whose compatibility a worker remembers at most.
PAIRS = 400_000
#: Characters that may stand together in a unit of letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts that a model whose rules are not the ones of this encoder encodes otherwise: spaces, forms of letters, marks.
PROBES = ("", " ", "a", "  two  spaces ", "tab\tfeed\n\r", "ﬁ①Ａ", "e\u0301é", "▁x", "\u00a0\u200b\u3000", "The quick brown fox, 12345 times.", "\x00\x01\ufffd😀")
_NONE = float("-inf")


@dataclass
class Encoder:
    """An encoder for one model file; it reads the vocabulary from it and nothing else.

    The file's rules must be: byte-pair merges, a space put before the text, no other normalisation, bytes for
    unknown characters. A file that encodes one of PROBES otherwise is refused.
    """

    path: str
    ids: dict[str, int] = field(default_factory=dict)
    memo: dict[str, str] = field(default_factory=dict)
    older: dict[str, str] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)
    histories: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(k) for k in range(n)]
        self.end = sp.eos_id()
        byte = [k for k in range(n) if sp.is_byte(k)]
        self.byte_ids = {int(self.pieces[k][3:5], 16): k for k in byte}
        self.bytes_of = {k: b for b, k in self.byte_ids.items()}
        self.special = {k for k in range(n) if sp.is_control(k) or sp.is_unknown(k)} | set(byte)
        self.ids = {p: k for k, p in enumerate(self.pieces) if k not in self.special and not sp.is_unused(k)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on past a space")
        # what an id that stands alone decodes to; bytes past ASCII only decode in runs
        self.alone = {str(k): p for p, k in self.ids.items()} | {str(k): "" for k in self.special - set(byte)} | {str(k): chr(b) for b, k in self.byte_ids.items() if b < 128}
        self.score = {p: sp.get_score(k) for p, k in self.ids.items()}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, k in self.ids.items():
            if len(p) == 1 or self._alone(p) == [p]:
                self.automaton.add_word(p, (len(p), k))
        self.automaton.make_automaton()
        self.unit = re.compile(self._unit_pattern())
        for t in PROBES:
            ids = sp.encode(t, add_eos=True)
            if self.encode(t) != ids or self.decode(ids) != sp.decode(ids):
                raise ValueError(f"{self.path} has rules that this encoder doesn't follow: it differs on {t!r}")

    def _unit_pattern(self) -> str:
        """Units: a run of spaces with what follows; line feeds and letters apart where no piece joins them."""
        feed = r"\n|" if "\n" not in self.chars else ""
        no_feed = "\n" if feed else ""
        mixed = re.compile(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}{SPACE}][{LETTERS}]")
        if any(mixed.search(p) for p in self.ids):
            return f"{feed}{SPACE}*[^{SPACE}{no_feed}]+|{SPACE}+"
        return f"{feed}{SPACE}*[{LETTERS}]+|{SPACE}*[^{SPACE}{no_feed}{LETTERS}]+|{SPACE}+"

    def _steps(self, piece: str) -> Iterator[tuple[list[str], int, float]]:
        """The states of a text's own merging: (tokens, place of the next merge, its score)."""
        tokens, score = list(piece), self.score
        while True:
            at, best = -1, _NONE
            for k in range(len(tokens) - 1):
                s = score.get(tokens[k] + tokens[k + 1], _NONE)
                if s > best:
                    at, best = k, s
            yield tokens, at, best
            if at < 0:
                return
            tokens = [*tokens[:at], tokens[at] + tokens[at + 1], *tokens[at + 2 :]]

    def _alone(self, piece: str) -> list[str]:
        *_, (tokens, _, _) = self._steps(piece)
        return tokens

    def _history(self, k: int) -> tuple:
        """Of a token: for each state its first token, its last token, and the score of its next merge."""
        got = self.histories.get(k)
        if got is None:
            states = [(t[0], t[-1], s) for t, _, s in self._steps(self.pieces[k])]
            got = self.histories[k] = tuple(zip(*states, strict=True))
        return got

    def _compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay two tokens."""
        _, lasts, left = self._history(a)
        firsts, _, right = self._history(b)
        score, i, j = self.score, 0, 0
        while True:
            across = score.get(lasts[i] + firsts[j], _NONE)
            # equal scores: the leftmost merge comes first
            if across > left[i] and across >= right[j]:
                return False
            if left[i] == _NONE and right[j] == _NONE:
                return True
            if left[i] >= right[j]:
                i += 1
            else:
                j += 1

    def encode_unit(self, unit: str) -> list[int]:
        """The ids of one unit."""
        out: list[int] = []
        if not self.chars.issuperset(unit):
            part: list[str] = []
            for c in unit:
                if c in self.chars:
                    part.append(c)
                else:
                    out += self._known("".join(part))
                    out += [self.byte_ids[x] for x in c.encode()]
                    part = []
            return out + self._known("".join(part))
        return self._known(unit)

    def _known(self, s: str) -> list[int]:
        if not s:
            return []
        n, pairs = len(s), self.pairs
        if len(pairs) > PAIRS:
            pairs.clear()
        last, length = [-1] * (n + 1), [0] * (n + 1)
        for end, (size, k) in self.automaton.iter(s):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size
            before = last[start]
            if start:
                if before < 0:
                    continue
                key = before << 20 | k
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._compatible(before, k)
                if not fits:
                    continue
            last[end + 1], length[end + 1] = k, size
        out, at = [], n
        while at:
            out.append(last[at])
            at -= length[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: control ids have none, runs of byte ids are read as UTF-8, and the space put before the text goes."""
        parts: list[str] = []
        raw = bytearray()
        for k in ids:
            b = self.bytes_of.get(k)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if k not in self.special:
                parts.append(self.pieces[k])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts).replace(SPACE, " ").removeprefix(" ")

    def _unit(self, unit: str) -> str:
        """The ids, joined by spaces, of a unit that the newer table doesn't hold."""
        got = self.older.get(unit)
        if got is None:
            got = " ".join(map(str, self.encode_unit(unit)))
        if len(unit) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[unit] = got
        return got

    def line(self, doc: str) -> str:
        """All ids of a text, the end id last, as decimals joined by spaces."""
        found = self.unit.findall(SPACE + doc.replace(" ", SPACE)) if doc else []
        out = list(map(self.memo.get, found))
        if None in out:
            # a unit that is new may be met again in the same text
            out = [x or self.memo.get(u) or self._unit(u) for x, u in zip(out, found, strict=True)]
        out.append(str(self.end))
        return " ".join(out)

    def encode(self, doc: str) -> list[int]:
        """All ids of a text, the end id last."""
        return list(map(int, self.line(doc).split(" ")))

    def digest(self, doc: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them)."""
        line = self.line(doc)
        ids = line.split(" ")
        parts = list(map(self.alone.get, ids))
        back = self.decode(list(map(int, ids))) if None in parts else "".join(parts).replace(SPACE, " ").removeprefix(" ")
        return len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each model in a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of docs: all ids, the end id last. A null text counts as empty.

    Repeated rows repeat in the result; an empty table gives an empty one; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            column = text.strings(b.column(1))
            for x, y in text.slices(column):
                yield pa.RecordBatch.from_arrays([b.column(0)[x:y], pa.array([e.encode(t) for t in column[x:y].to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else e.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, T.StructType([T.StructField("doc_id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())]))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, without keeping ids or texts.

    A null text counts as empty: one id, the end. Repeated rows repeat; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            column = text.strings(b.column(1))
            for x, y in text.slices(column):
                n, ids, back = zip(*map(e.digest, column[x:y].to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0)[x:y], pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
