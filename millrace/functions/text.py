"""Text helpers: query strings, escapes, splits, ``k=v`` strings, line cleaning and blocklists."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default token blocklist.
BLOCKED_TOKENS = (
    "rm", "mkfs", "mkfs.ext3", "make.ext2", "make.ext4", "make2fs", "shutdown", "reboot", "init", "dd",
)

# The characters of Unicode white space.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def split_left(text: Column, separator: str) -> Column:
    """``struct(before, after)`` around the first separator; without one, all text is ``before``."""
    at = F.instr(text, separator)
    return F.struct(
        F.when(at == 0, text).otherwise(F.substring(text, F.lit(1), at - 1)).alias("before"),
        F.when(at == 0, F.lit("")).otherwise(
            F.substring(text, at + len(separator), F.length(text))
        ).alias("after"),
    )


def split_right(text: Column, separator: str) -> Column:
    """``struct(before, after)`` around the last separator; without one, all text is ``before``."""
    tail = F.substring_index(text, separator, -1)
    found = F.instr(text, separator) > 0
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail) - len(separator))
    return F.struct(
        F.when(found, head).otherwise(text).alias("before"),
        F.when(found, tail).otherwise(F.lit("")).alias("after"),
    )


def query_escape(text: Column) -> Column:
    """Escape for a query string: a blank becomes ``+``, only ``A-Za-z0-9-_.~`` stay."""
    escaped = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(escaped, F.lit("%7E"), F.lit("~"))


def query_unescape(text: Column, plus_is_blank: bool = True) -> Column:
    """Undo the escape; a malformed ``%`` gives NULL."""
    source = text if plus_is_blank else F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.when(~text.rlike(_BAD_ESCAPE), F.try_url_decode(source))


def query_pairs(query: Column) -> Column:
    """``array<struct<key,value>>`` of a query string, in text order.

    Pieces end at ``&`` or ``;``; empty pieces are skipped and a piece with a bad escape on either
    side is dropped.
    """
    pieces = F.filter(F.split(query, "[&;]"), lambda p: p != "")

    def pair(piece: Column) -> Column:
        halves = split_left(piece, "=")
        return F.struct(
            query_unescape(halves["before"]).alias("key"),
            query_unescape(halves["after"]).alias("value"),
        )

    return F.filter(
        F.transform(pieces, pair), lambda p: p["key"].isNotNull() & p["value"].isNotNull()
    )


def query_values(query: Column) -> Column:
    """``map<key, array<value>>`` of a query string; values of one key keep their order."""

    def grouped(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))

        def values(key: Column) -> Column:
            return F.transform(F.filter(pairs, lambda p: p["key"] == key), lambda p: p["value"])

        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, values(k))))

    return let(query_pairs(query), grouped)


def query_part(url: Column) -> Column:
    """The text between ``?`` and ``#`` of a URL ('' when there is none)."""
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def split_userinfo(text: Column) -> Column:
    """``struct(user, secret)``: split at the first ``:`` or ``/``; ``+`` is kept as it is."""
    cut = F.regexp_instr(text, F.lit("[:/]"))
    user = F.when(cut == 0, text).otherwise(F.substring(text, F.lit(1), cut - 1))
    secret = F.when(cut == 0, F.lit("")).otherwise(F.substring(text, cut + 1, F.length(text)))
    return F.struct(
        query_unescape(user, plus_is_blank=False).alias("user"),
        query_unescape(secret, plus_is_blank=False).alias("secret"),
    )


def kv_string(values: Mapping[str, Column]) -> Column:
    """``k=v,k=v`` in the given order; unassigned (NULL) entries are left out."""
    return F.concat_ws(
        ",", *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in values.items()]
    )


def trim_space(text: Column) -> Column:
    """Strip every kind of Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def tokens_allowed(text: Column, blocked: Sequence[str] = BLOCKED_TOKENS) -> Column:
    """False when a token (lower-cased, cut at single blanks) equals a blocked word."""
    tokens = F.split(F.lower(text), " ")
    return ~F.arrays_overlap(tokens, F.array(*[F.lit(word) for word in blocked]))


def clean_lines(text: Column) -> Column:
    """The trimmed lines of a text without blank lines and ``#`` comments."""
    lines = F.transform(F.split(text, "\n"), trim_space)
    return F.filter(lines, lambda line: (line != "") & ~line.startswith("#"))


def join_clean_lines(text: Column, blocked: Sequence[str] = BLOCKED_TOKENS, force: bool = False,
                     glue: str = "&&") -> Column:
    """``struct(accepted, joined)``; a blocked token in any line rejects the whole text."""

    def outcome(lines: Column) -> Column:
        joined = F.concat_ws(glue, lines)
        if force:
            return F.struct(F.lit(True).alias("accepted"), joined.alias("joined"))
        accepted = ~F.exists(lines, lambda line: ~tokens_allowed(line, blocked))
        return F.struct(accepted.alias("accepted"), F.when(accepted, joined).alias("joined"))

    return let(clean_lines(text), outcome)
