"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: ``ledger`` adds the measurements and one ``failed_bits``
number with a bit per failed rule.  Policies are versioned masks over those bits, so a verdict is
one ``&``, and what a rule costs (``ablation``) comes from the counts per distinct bit pattern:
at most ``2 ** len(RULES)`` rows, whatever the number of documents.  All of it is column
expressions; a document never leaves its row, so nothing is shuffled but those counts.

Defined results: a NULL text is the empty text; a text without words fails ``few_words`` only (the
ratio rules need words); repeated rows get the same ledger; input columns that bear the name of a
ledger column give way to it.  Windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, annotate, bind, whole_text

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")

# One bit per rule, in this order; the order is part of the stored ledger, so only append.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words and n_words > 0",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines and n_words > 0",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "shouting": "100 * n_upper > 50 * word_chars and n_words > 0",
}

# Policies by version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "2": tuple(RULES),
}
CURRENT = "2"


def mask(rules: Iterable[str]) -> int:
    """The bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in set(rules))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+"))


def _covered(starts: Column) -> Column:
    """Words covered by windows that start at the given places (in order)."""
    first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        starts, first,
        lambda seen, at: F.struct(
            (seen["n"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("n"), at.alias("last")),
        lambda seen: seen["n"],
    )


def _repeat_words(windows: Column) -> Column:
    """Words in windows found twice or more.  Only texts with such a window pay for the sort."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def starts(found: Column) -> Column:
        twice = F.filter(found, lambda x, i: (
            (i > 0) & (F.get(found, i - 1)["h"] == x["h"])
        ) | (F.coalesce(F.get(found, i + 1)["h"] == x["h"], F.lit(False))))
        return _covered(F.sort_array(F.transform(twice, lambda x: x["at"])))

    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows), bind(pairs, starts)
    ).otherwise(F.lit(0).cast("bigint"))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every whole text."""
    words, hashes, windows = "__llm_words", "__llm_hashes", "__llm_windows"
    t = whole_text(text)
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    found = annotate(df, {
        words: _words(t),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        "n_upper": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("bigint"),
        "__llm_lines": lines,
    })
    found = annotate(found, {
        "n_words": F.size(words).cast("bigint"),
        "n_lines": F.size("__llm_lines").cast("bigint"),
        "n_dup_lines": (F.size("__llm_lines") - F.size(F.array_distinct("__llm_lines"))).cast("bigint"),
        hashes: F.transform(words, lambda w: F.xxhash64(w)),
    }).drop("__llm_lines", words)
    last = F.size(hashes) - WINDOW
    h = F.col(hashes)
    every = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    found = annotate(found, {
        windows: F.when(last > 0, every).otherwise(F.array().cast("array<bigint>"))}).drop(hashes)
    found = annotate(found, {"n_repeat_words": _repeat_words(F.col(windows))})
    # Explode keeps the measurements in one place: a filter on them would else be pushed below, and
    # take a copy of all their expressions along.
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in MEASURES]
    found = found.select(*kept, F.explode(F.array(F.struct(*MEASURES))).alias("__llm_measures"))
    return found.select(*kept, "__llm_measures.*")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with ``MEASURES`` and ``failed_bits``: bit k is set when rule k failed."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return annotate(measure(df, text), {"failed_bits": total.cast("bigint")})


def failed(policy: str | Iterable[str] = CURRENT, bits: str = "failed_bits") -> Column:
    """Whether a policy (a version or a list of rules) rejects the document."""
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(bits).bitwiseAND(F.lit(mask(rules))) != 0


def ablation(entries: DataFrame, policy: str | Iterable[str] = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it rejects."""
    rules = sorted(set(POLICIES[policy] if isinstance(policy, str) else policy), key=list(RULES).index)
    whole = mask(rules)
    patterns = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("failed_bits").bitwiseAND(F.lit(whole))
    named = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("bigint").alias("bit")) for r in rules]))
    return (
        patterns.select(seen.alias("seen"), "n", named.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("seen").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("seen") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )


def accepted(df: DataFrame, policy: str | Iterable[str] = CURRENT, text: str = "text") -> DataFrame:
    """The rows that a policy keeps, with the columns they came with."""
    names = [f"__llm_in_{i}" for i in range(len(df.columns))]
    carried = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
    own = names[[c.lower() for c in df.columns].index(text.lower())]
    return ledger(carried, own).where(~failed(policy)).select(
        *[F.col(n).alias(c) for c, n in zip(df.columns, names)])
