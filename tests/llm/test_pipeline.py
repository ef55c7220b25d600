"""The pipeline's stages against plain versions of them, on varied rows and on none, and run() against both."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_operators as plain
from webloom.llm import toxicity
from webloom.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version string, _gone string, node int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a small corpus: toxic texts, shared passages, copies, benchmark items, nulls, empty and long texts, repeated rows."""
    rng = random.Random(21)
    words = [f"v{k}" for k in range(600)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    shared = ["\n".join(line(13) for _ in range(k)) for k in (2, 3, 5)]
    items = [(k, line(n)) for k, n in enumerate([3, 8, 20, 60])]
    texts = [t for _, t, _ in plain.corpus(160, 5)]
    toxic = [y for _, _, y in plain.corpus(160, 5)]
    for k in range(60):
        parts = [line(rng.choice([4, 9, 15])) for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        if k % 9 == 0:
            parts.append(items[rng.randrange(4)][1])
        texts.append("\n".join(parts))
    texts += [texts[170], texts[180].upper(), texts[181].replace("\n", "\n\n"), shared[0], shared[2] + "\n" + shared[1], None, "", " \n ", "one", None, line(9) + " " + "long " * 30_000 + line(9)]
    rows = [(k, t, "en", "s", None if t is None else len(t), "clash", "clash", k) for k, t in enumerate(texts)]
    rows += [rows[165], rows[190], (190, line(30), "fr", None, 1, None, None, None), (None, shared[1], None, None, 7, None, None, None), (None, None, None, None, None, None, None, None)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    labels = [(k, y) for k, y in enumerate(toxic)] + [(k, 0) for k in range(160, 200)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([*items, (9, None), (None, line(9))], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def slow_toxicity(spark, rows, folder):
    m = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    bad = lambda t: plain.slow_logit(m, t) >= m.thresholds[plain.slow_language(t)]
    return [r for r in rows if len(r[1] or "") > 10_000 or not bad(r[1] or "")]


def slow_lines(spark, rows, folder):
    """A line goes where it lies in a run of 20 words or more that an earlier document holds."""
    signed = lambda t: int(np.array(xxhash.xxh64_intdigest(t.encode(), 42), np.uint64).view(np.int64))
    held, cut = set(), {}
    for _, _, t in sorted({(r[0], signed(r[1]), r[1]) for r in rows if r[0] is not None and r[1] is not None}):
        k = next(r[0] for r in rows if r[1] == t and r[0] is not None and (r[0], t) not in cut)
        x = [y.strip(" \t\r\x0b\x0c") for y in t.split("\n")]
        runs = {(a, b): tuple(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if sum(len(y.split()) for y in x[a:b]) >= 20} if len(x) > 1 or len(x[0]) < 10_000 else {}
        cut[k, t] = {i for (a, b), run in runs.items() if run in held for i in range(a, b)}
        held |= set(runs.values())
    out = []
    for r in rows:
        gone = cut.get((r[0], r[1]))
        if not gone:
            out.append(r)
            continue
        t = "\n".join(y for i, y in enumerate(r[1].split("\n")) if i not in gone)
        if t.split():
            out.append((r[0], t, *r[2:4], len(t), *r[5:]))
    return out


def slow_groups(spark, rows, folder):
    named = [r for r in rows if r[0] is not None]
    roots = plain.slow_roots(np.array([plain.slow_fingerprint(r[1]) for r in named], np.uint64))
    first = {}
    for r, root in zip(named, roots, strict=True):
        first[root] = min(first.get(root, r), r, key=lambda x: (x[0], str(x[1])))
    return [*first.values(), *(r for r in rows if r[0] is None)]


def slow_benchmark(spark, rows, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaky = {k for k, _ in plain.slow_contained([(n, r[1]) for n, r in enumerate(rows)], items, 0.8)}
    return [r for n, r in enumerate(rows) if n not in leaky]


def slow_encoding(spark, rows, folder):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out = []
    for r in rows:
        ids = sp.encode(r[1] or "", add_eos=True)
        out.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return out


SLOW = [slow_toxicity, slow_lines, slow_groups, slow_benchmark, slow_encoding]


def test_every_stage_and_the_whole(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    want = [tuple(r) for r in now.collect()]
    for k, ((name, stage), slow) in enumerate(zip(corpus_pipeline.STAGES, SLOW, strict=True)):
        before = len(want)
        kind = now.schema
        now, want = stage(spark, now, folder), slow(spark, want, folder)
        assert rows_of(now) == sorted(want, key=str), name
        assert k == 4 or (now.schema == kind and len(want) < before), name
        now = spark.createDataFrame(now.collect(), now.schema).repartition(3)
    assert rows_of(corpus_pipeline.run(spark, folder)) == sorted(want, key=str)


def test_every_stage_on_odd_rows_and_on_none(spark, odd, none, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "jumps over the lazy dog and")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # nothing is toxic without labels; no text repeats a block of 20 words, and the long line is its own; groups of 1, 2, 2 and of 3, 4, 5
    left = {"toxicity": 11, "line dedup": 11, "near-duplicates": 7, "decontamination": 8, "encoding": 11}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, odd, str(tmp_path))
        assert got.count() == left[name] and (k == 4 or got.schema == odd.schema), name
        empty = stage(spark, none, str(tmp_path))
        assert empty.count() == 0 and (k == 4 or empty.columns == odd.columns), name


def test_no_document_ends_empty(spark, sf_dir):
    """A document whose lines all went isn't kept, and no other goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r for r in corpus_pipeline.delete_repeated_lines(spark, docs, sf_dir).collect()}
    assert all(r.text.split() and r.n_chars == len(r.text) for r in kept.values() if r.text)
    lines = lambda t: {x.strip() for x in t.split("\n") if x.strip()}
    held = {x for r in kept.values() for x in lines(r.text)}
    assert all(lines(r.text) <= held for r in docs.collect())


def test_stages_on_the_tables(spark, sf_dir):
    """The classifier's decisions are those of labels, near enough; decontamination leaves no item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, sf_dir).collect()}
    gone = {r.doc_id for r in docs.collect()} - left
    bad = {k for k, y in labels.items() if y == 1 and toxicity.bucket(k) != 0}
    assert len(gone & bad) >= 0.8 * len(bad) and len([k for k in gone if labels.get(k) == 0]) <= 0.05 * len(labels)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = corpus_pipeline.remove_benchmark(spark, docs, sf_dir).collect()
    leaky = {k for k, _ in plain.slow_contained([(r.doc_id, r.text) for r in docs.collect()], items, 0.8)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in docs.filter(~F.col("doc_id").isin(*leaky)).collect()}
