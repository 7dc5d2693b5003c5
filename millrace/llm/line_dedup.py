"""Lines that many documents share, dropped from all of them but one.

Lines are exploded with a 128-bit hash of their normalised form.  One row per (document, line) is
counted with a map-side aggregate, so a line that a third of the corpus holds arrives as one partial
row per task.  Only lines over the threshold are written; the exploded lines meet them in a join
that adaptive execution may split on a hot line, and the places to drop are gathered per document
and joined back to the text, which is put together again by position.

Defined results: NULL and empty texts are one empty line; every row is a document of its own, so
repeated rows count as often as they appear; all rows with the largest id keep the line; rows with
a NULL id count, but never keep a shared line unless no holder has an id (then all drop it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ROW, SPACES, annotate, bind, lower_ascii, whole_text, with_row
from millrace.staging import Staging

MIN_CHARS = 40
MIN_DOCUMENTS = 5


def _hashed(df: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Row, id and an array with the hash pair of every line (NULL for a line that is too short)."""

    def pair(line: Column) -> Column:
        return bind(lower_ascii(F.btrim(line, F.lit(SPACES))), lambda key: F.when(
            F.length(key) >= min_chars,
            F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))))

    return with_row(df).select(
        ROW, F.col(f"`{doc_id}`").alias("__llm_id"),
        F.transform(F.split(whole_text(F.col(f"`{text}`")), "\n"), pair).alias("__llm_keys"),
    )


def shared_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                 min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(a, b, keeper, n_documents)`` of every line held by enough documents."""
    keys = _hashed(df, doc_id, text, min_chars).select(
        "__llm_id", F.explode(F.array_distinct(F.filter("__llm_keys", lambda k: k.isNotNull()))).alias("k"))
    return (
        keys.groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b"))
        .agg(F.max("__llm_id").alias("keeper"), F.count(F.lit(1)).alias("n_documents"))
        .where(F.col("n_documents") >= min_documents)
    )


def drop_shared_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
                      staging: Staging | None = None) -> DataFrame:
    """The input with ``kept_text``, ``n_lines`` (before) and ``n_dropped``."""
    staging = staging or Staging(df.sparkSession)
    shared = staging.keep(shared_lines(df, doc_id, text, min_chars, min_documents), "shared_lines")
    places = _hashed(df, doc_id, text, min_chars).select(
        ROW, "__llm_id", F.posexplode("__llm_keys").alias("__llm_at", "k")).where(F.col("k").isNotNull())
    places = places.select(ROW, "__llm_id", "__llm_at", F.col("k.a").alias("__llm_a"), F.col("k.b").alias("__llm_b"))
    hit = places.join(shared, (F.col("__llm_a") == shared["a"]) & (F.col("__llm_b") == shared["b"]))
    dropped = (
        hit.where(F.coalesce(F.col("__llm_id") != F.col("keeper"), F.lit(True)))
        .groupBy(ROW).agg(F.collect_list("__llm_at").alias("__llm_drop"))
    )
    dropped = staging.keep(dropped.withColumnRenamed(ROW, "__llm_hit"), "dropped_lines")
    # always a shuffle of the text: what is dropped grows with the corpus
    joined = with_row(df).join(dropped.hint("merge"), F.col(ROW) == F.col("__llm_hit"), "left")
    t = whole_text(F.col(f"`{text}`"))

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__llm_drop"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return annotate(joined, {
        "kept_text": F.when(F.col("__llm_drop").isNull(), t).otherwise(bind(F.split(t, "\n"), rest)),
        "n_lines": (F.length(t) - F.length(F.translate(t, "\n", "")) + 1).cast("bigint"),
        "n_dropped": F.when(F.col("__llm_drop").isNull(), 0).otherwise(F.size("__llm_drop")).cast("bigint"),
    }).drop(ROW, "__llm_hit", "__llm_drop")
