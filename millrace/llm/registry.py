"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    bpe, decontaminate, jaccard_join, language_id, line_dedup, lm_scoring, merkle, pii, quality_model, quality_rules, sharding,
    token_alignment, winnowing,
)
from millrace.llm.common import ROW, id_crc, lower_ascii, whole_text, with_row
from millrace.llm.oracles import merkle_sql, winnowing_sql
from millrace.session import ship
from millrace.staging import Staging

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, the base policy and the verdict of the current one."""
    entries = quality_rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.failed("base").alias("base_failed"), (~quality_rules.failed()).alias("kept"),
        "n_lines", "n_upper", "failed_bits",
    )


ORACLES["op5_quality_rules"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS lines
  FROM t
), wins AS (
  SELECT r, i, words[i:i + 7] AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS o(k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN covered USING (r)
), b AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
    + 4 * (10 * n_symbols > 3 * n_words AND n_words > 0)::INT
    + 8 * (100 * n_dup_lines > 30 * n_lines AND n_words > 0)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT
    + 64 * (100 * n_upper > 50 * word_chars AND n_words > 0)::INT AS BIGINT) AS failed_bits
  FROM m
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_bits = 0 AS kept FROM b
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least five of them share."""
    kept = line_dedup.drop_shared_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM t)
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5
)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines,
  count(*) FILTER (shared.k IS NOT NULL AND l.doc_id IS DISTINCT FROM keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
    FILTER (shared.k IS NULL OR l.doc_id IS NOT DISTINCT FROM keeper), '')) AS kept_sha256
FROM l LEFT JOIN shared ON l.k = shared.k GROUP BY l.r
"""


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and what they decode to, as hashes."""
    done = bpe.digests(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in 16 written shards of equal numbers of rows."""
    path = Staging(spark).folder("shards")
    written = sharding.write_shards(documents(spark, sf_dir).select("doc_id", "text"), path)
    return written.select(
        "doc_id", "size", F.crc32(whole_text().cast("binary")).alias("text_crc32"), "law", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their five-word shingles."""
    found = jaccard_join.similar_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and backoff-automaton scores of every text."""
    return lm_scoring.score_texts(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every text and a calibrated probability."""
    return language_id.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that a text is of good quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_model.quality_scores(documents(spark, sf_dir).select("doc_id", "text"), labels)


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items found in it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    leaks = decontaminate.find_leaks(docs, items)
    joined = with_row(docs.select("doc_id")).join(leaks, F.col(ROW) == F.col("hit"), "left")
    none = F.array().cast(leaks.schema["item_ids"].dataType)
    return joined.select(
        "doc_id", F.col("hit").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digests, and all spans of personal data, of every text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    spans = pii.find_spans(docs)
    none = F.array().cast(spans.schema["base"].dataType)
    joined = with_row(docs.select("doc_id")).join(spans, F.col(ROW) == F.col("hit"), "left")
    base, added = F.coalesce("base", none), F.coalesce("added", none)

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return joined.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.concat(base, added)).alias("spans"), F.size(added).cast("bigint").alias("n_added"))


@query
def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winnowed fingerprint of every text, of its edit, and their likeness."""
    return winnowing.compare_neighbours(documents(spark, sf_dir).select("doc_id", "text"))


ORACLES["op11_document_fingerprints"] = winnowing_sql()


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers cover every text, weighed by counts over all documents."""
    return token_alignment.align(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered leaf leads to."""
    docs = documents(spark, sf_dir).select(*merkle.FIELDS)
    fields = [lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS]
    seen = {"tampered": F.when(F.pmod(id_crc(), F.lit(5)) == 0, merkle.leaf(fields))}
    rows = merkle.manifest(docs, keep=seen)
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
                       merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLES["op13_merkle_manifest"] = merkle_sql()
