"""Quality rules, line dedup and sharding on small tables, against plain Python."""

import hashlib
import re
import shutil
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup, quality_rules, sharding

SPACE = r"[\x20\x09-\x0D]+"
LINE = "This line is long enough to be looked at by the rule"
TEXTS = [
    None, "", " \t ", "one", "a b\n\n a b \na b", LINE, LINE + "\nown words", "  " + LINE.upper() + " \nx",
    LINE + "\n" + LINE, LINE, "y\n" + LINE + "\r\nz", "é" * 40 + "\nß", " ".join(f"w{i % 12}" for i in range(50)),
    "# $ % & | < >" * 9, "LOUD WORDS " * 30, " ".join(f"u{i}" for i in range(30)), "x" * 70_000,
    "\n".join([LINE] * 300 + ["end"]), "\x0b".join(["m"] * 25),
]
SCHEMA = "doc_id bigint, text string, n_words string, SIZE string, kept_text map<string,int>"


def frame(spark, texts=TEXTS, ids=None):
    ids = ids or [i if i % 7 else None for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "clash", "clash", {"a": 1}) for i, t in zip(ids, texts)], SCHEMA)


def measured(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_ledger_measures_every_text(spark):
    got = quality_rules.ledger(frame(spark)).collect()
    assert Counter((r["text"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == \
        Counter((t, *measured(t)) for t in TEXTS)
    assert "kept_text" in got[0].asDict() and got[0]["SIZE"] == "clash"


def test_policies_and_ablation_agree_with_the_bits(spark):
    entries = quality_rules.ledger(frame(spark)).cache()
    bits = [r["failed_bits"] for r in entries.select("failed_bits").collect()]
    assert entries.where(quality_rules.failed("base")).count() == sum(bool(b & 3) for b in bits)
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablation(entries).collect()}
    names = list(quality_rules.RULES)
    assert got == {n: (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits)) for k, n in enumerate(names)}
    entries.unpersist()


def test_accepted_keeps_the_columns(spark):
    df = frame(spark)
    kept = quality_rules.accepted(df)
    assert kept.columns == df.columns
    assert [r["text"] for r in kept.collect()] == [" ".join(f"u{i}" for i in range(30))]
    assert quality_rules.accepted(frame(spark, [], [])).count() == 0


def dedup(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(i)
    shared = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(k) >= 40 and len(ids) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in shared or (i is not None and shared[key(x)] == i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("texts,ids", [(TEXTS, None), (TEXTS, [5] * len(TEXTS)), ([LINE] * 6, [None] * 6), ([LINE] * 4, [1, 2, 3, 4]), ([], [])])
def test_shared_lines_go(spark, staging, texts, ids):
    df = frame(spark, texts, ids)
    got = line_dedup.drop_shared_lines(df, staging=staging)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert Counter((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == dedup(rows)
    assert "SIZE" in got.columns


@pytest.mark.parametrize("bucket_bytes", [1, 2000, 1 << 22])
def test_shards_hold_every_row_once(spark, staging, tmp_path, bucket_bytes):
    texts = TEXTS * 3 + ["same"] * 60
    df = frame(spark, texts, [None] * 30 + list(range(len(texts) - 30)))
    got = sharding.write_shards(df, str(tmp_path / "out"), shards=5, bucket_bytes=bucket_bytes, staging=staging).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_of_an_empty_table(spark, staging, tmp_path):
    assert sharding.write_shards(frame(spark, [], []), str(tmp_path / "out"), staging=staging).count() == 0


def test_query_digests(spark, data_dir):
    from millrace.llm.registry import QUERIES

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_sharding"](spark, data_dir).collect()
    assert {r["doc_id"]: r["text_crc32"] for r in rows} == {i: zlib.crc32(t.encode()) for i, t in docs.items()}
    kept = QUERIES["op9_line_dedup"](spark, data_dir).where("n_dropped = 0").collect()
    assert all(r["kept_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() for r in kept)
    assert QUERIES["op5_quality_rules"](spark, data_dir).where(F.col("kept") & F.col("base_failed")).count() == 0


def test_row_numbers_hold_under_any_layout(spark, tmp_path):
    from millrace.llm.common import ROW, with_row

    path = str(tmp_path / "a b%20ü")
    spark.range(4000).selectExpr("id", "id % 7 as _metadata").repartition(5).write.parquet(path)
    table = spark.read.parquet(path)
    from millrace.llm import common

    listed = {common._file_path(uri) for uri in table.inputFiles()}
    assert listed == {r[0] for r in table.select(table.metadataColumn("_metadata")["file_path"]).distinct().collect()}
    seen = []
    for least, largest in (("1", "128m"), ("64", "128m"), ("1", "2k")):
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        spark.conf.set("spark.sql.files.maxPartitionBytes", largest)
        try:
            seen.append({r["id"]: r[ROW] for r in with_row(table.select("id")).collect()})
            seen.append({r["id"]: r[ROW] for r in with_row(table.where("id > -1")).select("id", ROW).collect()})
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(s == seen[0] for s in seen) and len(set(seen[0].values())) == 4000
    with pytest.raises(ValueError):
        with_row(table.union(table))


def test_row_numbers_go_with_the_table(spark, tmp_path):
    """A copy in another folder has the same numbers, a single file and a pruned partition too."""
    from millrace.llm.common import ROW, with_row

    def numbers(path, where="true"):
        return {(r["id"], r["k"]): r[ROW] for r in with_row(spark.read.parquet(str(path)).where(where)).collect()}

    spark.range(900).selectExpr("id", "id % 3 as k").repartition(4).write.partitionBy("k").parquet(f"{tmp_path}/one/t")
    shutil.copytree(tmp_path / "one" / "t", tmp_path / "a ü%" / "deeper")
    first = numbers(tmp_path / "one" / "t")
    assert len(set(first.values())) == 900
    assert numbers(tmp_path / "a ü%" / "deeper") == first
    assert numbers(tmp_path / "one" / "t", "k = 1") == {i: n for i, n in first.items() if i[1] == 1}
    spark.range(50).selectExpr("id", "id as k").coalesce(1).write.parquet(f"{tmp_path}/single")
    file = next((tmp_path / "single").glob("part-*"))
    (tmp_path / "moved").mkdir()
    shutil.copy(file, tmp_path / "moved" / file.name)
    assert numbers(file) == numbers(tmp_path / "moved" / file.name) == numbers(tmp_path / "single")


def test_names_with_one_hash_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    from millrace.llm import common

    monkeypatch.setattr(common, "_MIN_BITS", 3)
    spark.range(160).repartition(8).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    bits, others = common._file_numbers([f"{i}" for i in range(8)])
    assert bits == 3 and others  # eight names, eight numbers
    rows = common.with_row(table).select(common.ROW).collect()
    assert len({r[0] for r in rows}) == 160 and len({r[0] >> 60 for r in rows}) == len(table.inputFiles())


def test_any_number_of_files():
    from millrace.llm import common

    names = [f"day={i % 365}/part-{i:07d}.parquet" for i in range(800_000)]
    bits, others = common._file_numbers(names)
    assert bits <= 33 and len(others) < 500
    assert len({others.get(n, common._file_hash(n, bits)) for n in names}) == len(names)
    assert common._file_numbers(names[::-1]) == (bits, others)


def test_rows_behind_an_rdd_are_refused(spark, tmp_path):
    from millrace.llm.common import with_row

    spark.range(20).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    for rdd in (read.rdd, spark.range(20).repartition(3).rdd, spark.sparkContext.parallelize([(1,)]).repartition(2)):
        with pytest.raises(ValueError):
            with_row(spark.createDataFrame(rdd, "id bigint"))
    assert with_row(spark.createDataFrame([(1,), (2,)], "id bigint")).count() == 2
    assert with_row(spark.createDataFrame([], "id bigint")).count() == 0
