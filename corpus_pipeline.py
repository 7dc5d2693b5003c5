"""The corpus pipeline: documents in, token ids of the documents worth keeping out.

Stages, each on all that the one before kept: quality rules reject documents, lines that many
documents share are dropped, one document of each group of near copies stays, documents that hold a
benchmark item go, and the texts that are left are encoded.  Every stage is one of the operators of
``millrace.llm``; its result is written as Parquet and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from millrace.session import ship
from millrace.staging import Staging

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps."""
    return quality_rules.accepted(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; ``n_chars`` follows the text.

    A text that loses no line stays as it was, NULL included.
    """
    ship(spark)
    columns = docs.columns
    done = line_dedup.drop_shared_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changes = {"text": text}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        changes["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(kind)).otherwise(F.col("n_chars"))
    return done.select(*[changes.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are alone, and the one with the smallest id of each group."""
    ship(spark)
    return jaccard_join.one_per_component(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every document."""
    ship(spark)
    return bpe.encode(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what is between them goes to the shared folder."""
    staging = Staging(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # BPE can't be said in SQL; tests compare with a brute-force version

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
