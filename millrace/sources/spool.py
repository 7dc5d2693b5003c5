"""Spool directories: scan text files, route them by name, give every line its provenance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.numbering import add_run_offsets
from millrace.staging import Staging

# POSIX class names and what Java's patterns call them.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\s",
    "upper": r"\p{Upper}",
    "word": r"\w",
    "xdigit": r"\p{XDigit}",
}

_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")


def java_regex(rule: str) -> str:
    """Rewrite ``[:name:]`` classes, which Java would silently read as a set of letters."""

    def swap(match: re.Match) -> str:
        negated, name = match.groups()
        if name not in POSIX_CLASSES:
            raise ValueError(f"unknown character class [:{name}:]")
        java = POSIX_CLASSES[name]
        return java[0] + java[1].upper() + java[2:] if negated else java

    return _POSIX.sub(swap, rule)


def name_matches(name: Column, rule: str) -> Column:
    """Whether a file name fits the rule; unanchored unless the rule anchors itself."""
    return name.rlike(java_regex(rule))


def strip_line_end(line: Column) -> Column:
    """Lines end at a line feed; one carriage return before it belongs to the line end."""
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def _reader(source, recursive: bool):
    return source.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n")


def scan_lines(spark: SparkSession, path: str, rule: str | None = None,
               recursive: bool = False) -> DataFrame:
    """``(file_name, file_path, file_block_start, value)`` of the files whose name fits the rule.

    The rule is a filter on file metadata, so files that do not fit are never opened.
    """
    return _lines(_reader(spark.read, recursive).text(path), rule)


def _lines(files: DataFrame, rule: str | None) -> DataFrame:
    if rule is not None:
        files = files.where(name_matches(F.col("_metadata.file_name"), rule))
    return files.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        strip_line_end(F.col("value")).alias("value"),
    )


def number_lines(lines: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Replace the file position by a 0-based ``line_num``, for files of any size.

    Files stay split over tasks: each (file, block) is one run, written once with its marks, and
    the number of lines in the blocks before it is added as an offset.  Columns added to the
    scanned lines are kept, so parsed lines can be numbered in place of raw ones.
    """
    staging = staging or Staging(lines.sparkSession)
    marked = staging.keep(lines.withColumn("__mark", F.monotonically_increasing_id()), "lines")
    numbered = add_run_offsets(marked, ["file_path"], ["file_block_start"], "line_num", staging)
    rest = [c for c in lines.columns if c not in ("file_name", "file_path", "file_block_start")]
    return numbered.select("file_name", "line_num", *rest)


def explode_lines(df: DataFrame, name: str | Column, text: str | Column, *keep: str) -> DataFrame:
    """Numbered lines of texts that are held whole in one row."""
    text = F.col(text) if isinstance(text, str) else text
    name = F.col(name) if isinstance(name, str) else name
    pieces = F.split(text, "\n")
    # the piece after the final line feed is not a line
    ended = F.when(text.endswith("\n") | (text == ""), F.slice(pieces, 1, F.size(pieces) - 1))
    lines = F.coalesce(ended, pieces)
    return df.select(
        name.alias("file_name"), *keep, F.posexplode(lines).alias("line_num", "__line")
    ).select("file_name", *keep, "line_num", strip_line_end(F.col("__line")).alias("value"))


def stream_lines(spark: SparkSession, path: str, rule: str | None = None, recursive: bool = False,
                 max_files: int | None = None, clean: str = "off",
                 archive: str | None = None) -> DataFrame:
    """The streaming scan: lines of new files with their position, as ``scan_lines`` gives them.

    Number them per micro-batch with ``number_lines``.  ``clean`` is ``off``, ``delete`` or
    ``archive`` and is applied by the file source once a micro-batch has been committed.
    """
    if rule is not None and clean_options(clean, archive)["cleanSource"] != "off":
        # the source would clean every file it lists, also those that the rule leaves unread
        raise ValueError("a file rule and cleaning by the source don't go together")
    source = spark.readStream.options(**clean_options(clean, archive))
    if max_files:
        source = source.option("maxFilesPerTrigger", str(max_files))
    return _lines(_reader(source, recursive).text(path), rule)


def clean_options(policy: str, archive: str | None = None) -> dict[str, str]:
    """Options of the file source for what happens to a file after it was ingested."""
    aliases = {"immediate": "delete", "delete": "delete", "archive": "archive", "off": "off"}
    if policy not in aliases:
        raise ValueError(f"unknown delete policy {policy!r}")
    options = {"cleanSource": aliases[policy]}
    if options["cleanSource"] == "archive":
        if not archive:
            raise ValueError("archiving needs a target directory")
        options["sourceArchiveDir"] = archive
    return options


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(file_name, file_path, length, modified)`` of a directory; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return files.load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("path").alias("file_path"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def with_route(df: DataFrame, rule: str, name: str = "file_name") -> DataFrame:
    """Add ``matched`` by a file-name rule; an absent name does not match."""
    return df.withColumn("matched", F.coalesce(name_matches(F.col(name), rule), F.lit(False)))


def route(df: DataFrame, rule: str, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Split rows into (matched, skipped) by a file-name rule."""
    tagged = with_route(df, rule, name)
    return tagged.where("matched").drop("matched"), tagged.where("not matched").drop("matched")


def write_spool(lines: DataFrame, path: str, name: str, value: str = "value") -> None:
    """Land text files named ``<name>-…`` in a spool directory, as many as there are partitions."""
    (
        lines.select(F.col(value).alias("value"))
        .write.mode("append")
        .option("mapreduce.output.basename", name)
        .text(path)
    )


LINE_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("line_num", T.LongType()),
    T.StructField("value", T.StringType()),
])
