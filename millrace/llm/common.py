"""Small column helpers shared by the operators of this package."""

from __future__ import annotations

import json
from hashlib import md5
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separators of words, and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

ROW = "__llm_row"  # the row number that joins a row with what was found in it


def whole_text(text: str | Column = "text") -> Column:
    """The text, with NULL as the empty text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id written as text; a NULL id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


_MADE_HERE = {"LogicalRDD", "LocalRelation", "Range", "OneRowRelation"}
_KEEPS_ROWS = {"Project", "Filter", "SubqueryAlias", "View"}
_HASH_DIGITS = 15  # hex digits of the MD5 of a file's name, 60 bits
_MIN_BITS = 24  # of the number of a file


def _nodes(plan) -> list:
    found = [plan]
    for node in found:  # grows while it is walked
        children = node.children()
        found.extend(children.apply(k) for k in range(children.size()))
    return found


def _is_parquet(node) -> bool:
    if not node.getClass().getName().endswith(".LogicalRelation"):
        return False
    relation = node.relation()
    return relation.getClass().getName().endswith(".HadoopFsRelation") and relation.fileFormat().toString() == "Parquet"


def _made_in_driver(node) -> bool:
    """Rows that the driver made; an RDD behind a shuffle or a scan may come in another order when read again."""
    if node.nodeName() not in _MADE_HERE:
        return False
    if node.nodeName() != "LogicalRDD":
        return True
    lineage = node.rdd().toDebugString()
    return "+-(" not in lineage and "FileScanRDD" not in lineage and (
        "ParallelCollectionRDD" in lineage or "EmptyRDD" in lineage)


def _file_path(uri: str) -> str:
    """A listed file as ``_metadata.file_path`` writes it."""
    return uri.replace(":///", ":/", 1)


def _inside(paths: list[str]) -> int:
    """How many characters of every path lead to the folder that holds all of them."""
    low, high = min(paths), max(paths)
    same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low.rfind("/", 0, same) + 1


def _file_hash(name: str, bits: int) -> int:
    return int(md5(name.encode()).hexdigest()[:_HASH_DIGITS], 16) >> (4 * _HASH_DIGITS - bits)


def _file_numbers(names: list[str]) -> tuple[int, dict[str, int]]:
    """``(bits, others)``: so many bits of the hash of its name number a file, but for the ``others``.

    The bits grow with the number of files so that some 64 names at most share their hash with one
    before; those get the next free number.
    """
    bits = max(_MIN_BITS, ceil(2 * log2(max(2, len(names)))) - 7)
    used: set[int] = set()
    late = []
    for name in sorted(names):
        number = _file_hash(name, bits)
        late.append(name) if number in used else used.add(number)
    others = {}
    for name in late:
        number = _file_hash(name, bits)
        while number in used:
            number = (number + 1) % (1 << bits)
        used.add(number)
        others[name] = number
    return bits, others


def with_row(df: DataFrame) -> DataFrame:
    """Number the rows by their file and their position in it, which no layout of a scan changes.

    A file goes by its path below the folder that holds all files of the table, so a copy of the table
    in another place has the same numbers.  There may be any number of files; the more there are, the
    fewer rows each may have (2^39 up to 40,000 files, 2^30 at 800,000), and one with more is an error.

    The frame has to be columns and rows of one Parquet table, or made in the driver (those keep
    their order); anything else has to be written first.
    """
    nodes = _nodes(df._jdf.queryExecution().analyzed())
    leaves = [n for n in nodes if not n.children().size()]
    if all(_made_in_driver(n) for n in leaves):
        return df.withColumn(ROW, F.monotonically_increasing_id())
    if len(leaves) != 1 or not _is_parquet(leaves[0]) or any(n.nodeName() not in _KEEPS_ROWS for n in nodes if n not in leaves):
        raise ValueError("rows can be numbered in a Parquet table only; write the frame first")
    # all files of the table, also when the frame reads some of its partitions only
    mapper = df.sparkSession._jvm.com.fasterxml.jackson.databind.ObjectMapper()  # one call, not one a file
    paths = [_file_path(uri) for uri in json.loads(mapper.writeValueAsString(leaves[0].relation().location().inputFiles()))]
    start = _inside(paths) if paths else 0
    bits, others = _file_numbers([p[start:] for p in paths])
    place = df.metadataColumn("_metadata")
    name = F.substring(place["file_path"], start + 1, 1 << 30)
    digits = F.conv(F.substring(F.md5(name.cast("binary")), 1, _HASH_DIGITS), 16, 10).cast("bigint")
    file = F.shiftright(digits, 4 * _HASH_DIGITS - bits)
    if others:
        listed = F.create_map(*[F.lit(x) for name_number in others.items() for x in name_number])
        file = F.coalesce(F.try_element_at(listed, name).cast("bigint"), file)
    room = 63 - bits
    at = F.when(place["row_index"] < F.lit(1 << room), place["row_index"]).otherwise(
        F.raise_error(F.lit(f"a file has more than 2^{room} rows")).cast("bigint"))
    return df.withColumn(ROW, F.shiftleft(file, room) + at)


def annotate(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; input columns of the same names (in any case) give way to them."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[column.alias(name) for name, column in columns.items()])


def without(df: DataFrame, names) -> DataFrame:
    """Drop columns by name, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def bind(value: Column, use) -> Column:
    """Compute ``value`` once and hand it to ``use`` as a name, as a lambda variable."""
    return F.transform(F.array(value), use)[0]
