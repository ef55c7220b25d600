"""Token counts of documents in flat token files, by a separator scan.

A token file is nothing but ids in little-endian order, two or four bytes each; every document ends with the
end-of-document id, and no index says where. Files come as numbered blocks of whole ids. Within a block a
vectorised comparison finds the ends. A document may cross blocks: each block tells how many ends it holds,
the ids before its first end and those after its last one, and a prefix scan over a file's blocks gives each
block the number of documents before it and the ids that an unfinished document brings along.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from webloom.llm import text
from webloom.session import checkpointed

#: Ids of a block. Any other number gives the same counts.
BLOCK = 1 << 18
END = 50256


@cache
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_blocks(docs: DataFrame, path: str, pattern: str, end: int = END, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, block, data, ids): the documents of each partition as one flat token file, cut into blocks.

    data holds little-endian 32-bit ids, or 16-bit ones where the vocabulary allows. The rows of block -1 have
    no data: they list, in file order, the doc_ids that the file itself doesn't know, `first` of them before.
    """
    kind = "<u2" if end < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, file = _encoding(path, pattern), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size, number, before = 0, 0, 0
        named = pa.list_(pa.int64())
        row = lambda n, data, ids, first: pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], named), pa.array([first], pa.int64())], ["file", "block", "data", "ids", "first"])
        for b in batches:
            named = pa.list_(b.column(0).type)
            column = text.strings(b.column(1))
            for x, y in text.slices(column):
                for t in column[x:y].to_pylist():
                    ids = np.array([*e.encode_ordinary(t), end], kind)
                    held.append(ids)
                    size += len(ids)
                while size >= block:
                    flat = np.concatenate(held)
                    yield row(number, flat[:block].tobytes(), None, None)
                    number += 1
                    held, size = [flat[block:]], size - block
            yield row(-1, None, b.column(0).to_pylist(), before)
            before += b.num_rows
        if size:
            yield row(number, np.concatenate(held).tobytes(), None, None)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _schema(("data", T.BinaryType()), ("ids", T.ArrayType(docs.schema[id_col].dataType)), ("first", T.LongType())))


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in (("file", T.LongType()), ("block", T.LongType()), *fields)])


def _opened(url: str):
    """A file of a store that Arrow knows (local, HDFS, S3, GCS), by its Hadoop address; else None."""
    from pyarrow import fs

    url = re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "file:///", url))
    try:
        store, path = fs.FileSystem.from_uri(url)
    except pa.ArrowInvalid:
        return None
    return store.open_input_file(path)


def read_blocks(spark: SparkSession, path: str, id_bytes: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of flat token files at `path`, any store that Spark reads; file is a hash of the path.

    Spark lists the files with their lengths, each block is a range of bytes, and the task of a block reads
    that range alone. So a file may have any size, and many tasks share it. Of stores that Arrow can't open
    a file is read as one binary value by Spark, which ends at 2 GiB. An empty file has one empty block; a
    last id that is cut off is left out.
    """
    kind, size = "file long, block long, data binary", block * id_bytes
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    if first is not None and _reachable(first[0]):

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for file, url, k, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    with _opened(url) as f:
                        data = f.read_at(max(0, min(size, length - k * size)) // id_bytes * id_bytes, k * size)
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([k], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

        each = files.select(F.xxhash64("path").alias("file"), "path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)))).alias("block"), "length")
        # the rows are addresses: dealt by their hash, the blocks of one file go to many tasks
        return each.repartition("file", "block").mapInArrow(ranges, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = memoryview(content.as_buffer())
                raw = raw[: len(raw) // id_bytes * id_bytes]
                for k in range(0, max(1, -(-len(raw) // size))):
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([k], pa.int64()), pa.array([bytes(raw[k * size : (k + 1) * size])], pa.binary())], ["file", "block", "data"])

    return files.select(F.xxhash64("path").alias("file"), "content").mapInArrow(cut, kind)


def _reachable(url: str) -> bool:
    try:
        f = _opened(url)
    except (OSError, pa.ArrowException):
        return False
    if f is not None:
        f.close()
    return f is not None


def _scanner(end: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, block, gaps, tail, ids, first): gaps are the ids up to and with each end, tail those after the last."""
        for b in batches:
            gaps, tails = [], []
            for data in b.column(2).to_pylist():
                if data is None:
                    gaps.append(None)
                    tails.append(0)
                    continue
                flat = np.frombuffer(data, f"<u{id_bytes}")
                at = np.flatnonzero(flat == end)
                gaps.append(np.diff(at, prepend=-1))
                tails.append(len(flat) - (int(at[-1]) + 1 if len(at) else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gaps, pa.list_(pa.int64())), pa.array(tails, pa.int64()), b.column(3), b.column(4)], ["file", "block", "gaps", "tail", "ids", "first"])

    return run


def scan(blocks: DataFrame, end: int = END, id_bytes: int = 2) -> DataFrame:
    """(file, block, gaps, tail, ids, first) of each block; `ids` and `first` as write_blocks gave them, else null."""
    for name, kind in (("ids", "array<long>"), ("first", "long")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    return blocks.select("file", "block", "data", "ids", "first").mapInArrow(_scanner(end, id_bytes), _schema(("gaps", T.ArrayType(T.LongType())), ("tail", T.LongType()), ("ids", blocks.schema["ids"].dataType), ("first", T.LongType())))


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, doc_no, n_tokens): each document of each file, in file order, its end id counted.

    Ids after a file's last end are a document that has not ended: it has no row. An empty file has none.
    """
    order = W.Window.partitionBy("file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = scanned.filter("block >= 0").withColumn("ends", F.size("gaps")).withColumn("whole", F.aggregate("gaps", F.lit(0).cast("long"), lambda s, x: s + x))
    # ids since the last end before a block: all ids so far, less those up to the last block with an end, plus its tail
    sums = sums.withColumn("docs_before", F.coalesce(F.sum("ends").over(order), F.lit(0)))
    sums = sums.withColumn("ids_before", F.coalesce(F.sum(F.col("whole") + F.col("tail")).over(order), F.lit(0)))
    # where the last end before a block stands in the file
    sums = sums.withColumn("end_here", F.when(F.col("ends") > 0, F.col("ids_before") + F.col("whole")))
    sums = sums.withColumn("open", F.col("ids_before") - F.coalesce(F.max("end_here").over(order), F.lit(0)))
    one = sums.filter("ends > 0").select("file", "docs_before", "open", F.posexplode("gaps").alias("k", "gap"))
    n = F.col("gap") + F.when(F.col("k") == 0, F.col("open")).otherwise(F.lit(0))
    return one.select("file", (F.col("docs_before") + F.col("k")).alias("doc_no"), n.alias("n_tokens"))


def count(docs: DataFrame, path: str, pattern: str, end: int = END, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, file, doc_no, n_tokens) for each row of docs, through flat token files; n_tokens counts the end.

    doc_id is of any type. A null text counts as empty: its end alone. Repeated rows repeat; a null doc_id stays null; an empty
    table gives an empty one; other columns play no part.
    """
    # one pass writes, scans and forgets the ids: what is kept of a block is its gaps
    found = checkpointed(scan(write_blocks(docs, path, pattern, end, block, id_col, text_col), end, 2 if end < 1 << 16 else 4))
    named = found.filter("block < 0").select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("doc_no"), "doc_id")
    return stitch(found).join(named, ["file", "doc_no"]).select("doc_id", "file", "doc_no", "n_tokens")
