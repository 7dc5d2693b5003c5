"""A Merkle manifest of a dataset: leaves per row, a tree per source, a tree over the sources.

The rows of a source are numbered by id without gathering them, and cut into aligned blocks of
``FANOUT ** LOCAL_LEVELS`` leaves.  A block hashes its own levels in one task.  The levels above come
from a butterfly exchange of the block roots: in round ``r`` the blocks that differ in digit ``r`` of
their number only (in base ``FANOUT``) meet, at most ``FANOUT`` of them, swap the roots of the subtrees
they stand in, and *each* hashes the common ancestor.  After the last round every block has all
siblings of its path to the top, so nothing is sent down a tree afterwards; a block then writes the
proofs of its leaves.  Where the last subtree has fewer blocks than its neighbours, those it has
stand in for the missing ones, so that every meeting is complete.

The roots of the sources go through the same steps as one more list of nodes.

No task holds more than a block, or ``FANOUT`` roots with their paths; a source with a third of the rows
is many blocks.  Each round is a written table; the driver sees the height of the tallest tree.

Defined results: a NULL in a field is ``-``; a NULL source is a source, the first one; NULL ids come
first, and rows with equal ids follow the order of their leaves; repeated rows are leaves like others;
an empty table has no rows; columns beyond the hashed ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.numbering import dense_index
from millrace.staging import Staging

FANOUT = 16
LOCAL_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<l:string,r:string>>"


def leaf(fields: Sequence[str | Column]) -> Column:
    """The hash of a row: every field as its length in bytes, a colon and its text, or ``-``."""
    parts = []
    for field in fields:
        text = (F.col(f"`{field}`") if isinstance(field, str) else field).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(node: Column, steps: Column) -> Column:
    """The root that a node and the siblings on its path lead to."""
    return F.aggregate(steps, node, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """One hash over all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)


def _up(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i:i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def _levels(nodes: list[str], fanout: int, forced: int | None) -> list[list[str]]:
    """The levels of a block: as many as asked for, or until one node is left."""
    levels = [nodes]
    while len(levels) <= forced if forced is not None else len(levels[-1]) > 1:
        levels.append(_up(levels[-1], fanout))
    return levels


def _block_root(fanout: int, local: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = [n for _, n in sorted(zip(table.column("pos").to_pylist(), table.column("node").to_pylist()))]
        return pa.table({
            "tree": table.column("tree").slice(0, 1), "block": table.column("block").slice(0, 1),
            "inner": [_levels(nodes, fanout, local)[-1][0]], "alone": [_levels(nodes, fanout, None)[-1][0]]})

    return run


def _block_paths(fanout: int, local: int):
    """The path of every node of a block: its own levels, then what the block learnt in the exchange."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        upper, blocks = above.column("steps")[0].as_py(), above.column("blocks")[0].as_py()
        levels = _levels(nodes.column("node").to_pylist(), fanout, local if blocks > 1 else None)[:-1]
        paths = []
        for i in range(nodes.num_rows):
            path = []
            for level in levels:
                start = i - i % fanout
                path.append({"l": "".join(level[start:i]), "r": "".join(level[i + 1:start + fanout])})
                i //= fanout
            paths.append(path + upper)
        rows = nodes.num_rows
        kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        return pa.table({
            "tree": nodes.column("tree"), "pos": nodes.column("pos"), "payload": nodes.column("payload"),
            "node": nodes.column("node"), "steps": pa.array(paths, kind), "top": pa.array([above.column("top")[0].as_py()] * rows, pa.string())})

    return run


def _exchange(blocks: DataFrame, span: int, fanout: int) -> DataFrame:
    """One round: blocks that differ in one digit of their number meet and hash their ancestor.

    ``span`` blocks stand in each of the subtrees that meet.
    """
    settled, moving = blocks.where(F.col("blocks") <= span), blocks.where(F.col("blocks") > span)
    low, subtree = F.expr(f"block % {span}"), F.expr(f"block div {span}")
    here = F.least(F.lit(span).cast("bigint"), F.col("blocks") - subtree * span)  # blocks in this subtree
    sent = moving.select(
        "*", F.expr(f"block div {span * fanout}").alias("group"), (subtree % fanout).alias("digit"),
        F.explode(F.sequence(low, F.lit(span - 1).cast("bigint"), here)).alias("slot"))
    member = F.when(F.col("slot") == low, F.struct("block", "blocks", "digit", "steps"))
    met = sent.groupBy("tree", "group", "slot").agg(
        F.array_sort(F.collect_list(F.struct("digit", "top"))).alias("roots"), F.collect_list(member).alias("members"))
    met = met.select("tree", "roots", F.explode("members").alias("m"))

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter("roots", keep), lambda x: x["top"]), "")

    step = F.struct(side(lambda x: x["digit"] < F.col("m.digit")).alias("l"), side(lambda x: x["digit"] > F.col("m.digit")).alias("r"))
    ancestor = F.sha2(F.array_join("roots.top", "").cast("binary"), 256)
    return settled.unionByName(met.select(
        "tree", "m.block", "m.blocks", F.concat("m.steps", F.array(step)).alias("steps"), ancestor.alias("top")))


def paths(nodes: DataFrame, staging: Staging, fanout: int = FANOUT, local: int = LOCAL_LEVELS) -> tuple[DataFrame, DataFrame]:
    """For nodes ``(tree, pos, node, payload)``, numbered densely per tree: all paths and the tops.

    Returns ``(tree, pos, payload, node, steps, top)`` and ``(tree, top)``.
    """
    spark = nodes.sparkSession
    placed = nodes.withColumn("block", F.expr(f"pos div {fanout ** local}"))
    tree = nodes.schema["tree"].dataType.simpleString()
    roots = staging.keep(placed.select("tree", "block", "pos", "node").groupBy("tree", "block").applyInArrow(
        _block_root(fanout, local), f"tree {tree}, block bigint, inner string, alone string"), "blocks")
    sizes = roots.groupBy(F.col("tree").alias("t")).agg((F.max("block") + 1).alias("blocks"))
    top = F.when(F.col("blocks") > 1, F.col("inner")).otherwise(F.col("alone"))
    now = staging.keep(roots.join(sizes, F.col("tree").eqNullSafe(F.col("t"))).select(
        "tree", "block", "blocks", F.array().cast(_STEPS).alias("steps"), top.alias("top")), "round")
    most, span = now.agg(F.max("blocks")).first()[0] or 0, 1
    while span < most:
        now = staging.keep(_exchange(now, span, fanout), "round")
        span *= fanout
    payload = nodes.schema["payload"].dataType.simpleString()
    found = placed.groupBy("tree", "block").cogroup(now.groupBy("tree", "block")).applyInArrow(
        _block_paths(fanout, local), f"tree {tree}, pos bigint, payload {payload}, node string, steps {_STEPS}, top string")
    return found, now.where("block = 0").select("tree", "top")


def manifest(df: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source",
             keep: dict[str, Column] | None = None, staging: Staging | None = None, fanout: int = FANOUT,
             local: int = LOCAL_LEVELS) -> DataFrame:
    """``(source, doc_id, leaf, subroot, root, steps)`` of every row, and the columns of ``keep``.

    ``steps`` is the path from the leaf to the root: per level the siblings to the left and to the right,
    each side joined.  ``folded(leaf, steps)`` is the root.
    """
    staging = staging or Staging(df.sparkSession)
    keep = keep or {}
    payload = F.struct(F.col(f"`{doc_id}`").alias("doc_id"), *[c.alias(n) for n, c in keep.items()])
    leaves = df.select(F.col(f"`{source}`").cast("string").alias("tree"), leaf(fields).alias("node"), payload.alias("payload"))
    numbered = dense_index(leaves, [F.col("payload.doc_id").asc_nulls_first(), "node"], ["tree"], "pos", staging)
    rows, subroots = paths(numbered, staging, fanout, local)

    listed = subroots.select(F.lit(0).alias("tree"), F.col("top").alias("node"), F.struct(F.col("tree").alias("source")).alias("payload"))
    ordered = dense_index(listed, [F.col("payload.source").asc_nulls_first()], (), "pos", staging)
    above = staging.keep(paths(ordered, staging, fanout, local)[0].select(
        F.col("payload.source").alias("s"), F.col("steps").alias("upper"), F.col("top").alias("root")), "sources")
    joined = rows.join(above, F.col("tree").eqNullSafe(F.col("s")))
    return joined.select(
        F.col("tree").alias("source"), "payload.*", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root",
        F.concat("steps", "upper").alias("steps"))
