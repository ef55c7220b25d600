"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last
return docs' own columns, whatever other columns there are. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import session
from webloom.llm import decontaminate, line_dedup, near_dup, pieces, toxicity
from webloom.llm.registry import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go.

    A null text is judged as an empty one; repeated rows share their fate; without labels of both kinds nothing goes.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds are deleted; n_chars follows the text.

    A document that loses its last word goes: all of it stands in earlier ones. Null and empty texts and rows
    without an id stay as they are; rows that repeat doc_id and text lose the same lines.
    """
    cut = line_dedup.dedup_lines(docs)
    cut = cut.filter((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, that of the least doc_id.

    Texts without words, null ones among them, are one group. Rows without an id stay; of a doc_id with
    several texts each text counts by itself.
    """
    return near_dup.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids and the text decoded from them, as digests; a null text is an empty one, its end id alone."""
    return pieces.digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", delete_repeated_lines),
    ("near-duplicates", keep_one_of_each_group),
    ("decontamination", remove_benchmark),
    ("encoding", encode),
]

#: SQL can express neither the classifier nor the encoder; tests/llm/test_pipeline.py holds every stage and run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of documents, each cut from its predecessor's lineage."""
    session.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = session.checkpointed(docs)
    return docs
