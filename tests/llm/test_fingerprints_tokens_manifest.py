"""Fingerprints, token alignment and the Merkle manifest against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle, token_alignment, winnowing
from millrace.session import ship

SPACE = " \t\n\x0b\x0c\r"
RNG = random.Random(5)
TEXTS = [
    None, "", " \n", "a", "Abc\tD", "aaaa" * 40, "x" * 15, "x" * 16, "x" * 17, "y" * 46, "y" * 47, "é😀" * 60, "\x00" * 50,
    *("".join(RNG.choice("abcd é\nXY") for _ in range(RNG.randrange(300))) for _ in range(12)), "lorem ipsum dolor " * 400, "a",
]
CLASH = "doc_id bigint, text string, fingerprint int, RANGE string, n_a map<string,int>, closing string"


def frame(spark, texts=TEXTS, ids=None):
    ids = ids or [i if i % 7 else None for i in range(len(texts))]
    return spark.createDataFrame([(i, t, 1, "clash", {"a": 1}, "clash") for i, t in zip(ids, texts)], CLASH)


def naive_fingerprint(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    kept = [(i, ord(c.lower() if "A" <= c <= "Z" else c) + 1) for i, c in enumerate(text) if c not in SPACE]
    if not kept:
        return []
    gram = min(gram, len(kept))
    hashes = [tuple(sum(kept[i + j][1] * b ** j for j in range(gram)) % winnowing.PRIME for b in winnowing.BASES) for i in range(len(kept) - gram + 1)]
    chosen = set()
    for i in range(max(1, len(hashes) - window + 1)):
        inside = range(i, min(i + window, len(hashes)))
        chosen.add(min(inside, key=lambda j: (hashes[j][0], -j)))
    return [(kept[j][0], hashes[j][0] << 31 | hashes[j][1]) for j in sorted(chosen)]


def as_text(entries):
    return ",".join(f"{p:08x}{v:016x}" for p, v in entries)


def jaccard(a, b):
    a, b = {v for _, v in a}, {v for _, v in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("gram, window", [(16, 32), (3, 4), (5, 1), (4, 7)])
def test_selected_grams(gram, window, monkeypatch):
    texts = [t or "" for t in TEXTS[:-2]]
    want = [naive_fingerprint(t, gram, window) for t in texts]
    for chunk in (1 << 20, 60):  # the second cuts long texts into chunks that overlap
        monkeypatch.setattr(winnowing, "CHUNK", chunk)
        assert [list(zip(p.tolist(), v.tolist())) for p, v in winnowing.select_all(texts, gram, window)] == want


def test_shared_passages_share_an_entry():
    """Any run of GRAM + WINDOW - 1 characters that two texts share is seen, at its places."""
    rng = random.Random(3)
    size = winnowing.GRAM + winnowing.WINDOW - 1
    for _ in range(50):
        passage, *others = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (size, rng.randrange(200), rng.randrange(200)))
        (pa, va), (pb, vb) = winnowing.select_all([others[0] + passage, passage.upper() + others[1]])
        places = [(i, j) for i, v in zip(pa.tolist(), va.tolist()) for j, w in zip(pb.tolist(), vb.tolist()) if v == w]
        assert any(i - len(others[0]) == j for i, j in places)


def test_fingerprints_keep_the_rows(spark):
    ship(spark)
    got = winnowing.fingerprints(frame(spark)).select("text", "RANGE", "fingerprint", winnowing.entries(F.col("fingerprint")).alias("e")).collect()
    assert Counter((r["text"], r["fingerprint"]) for r in got) == Counter((t, as_text(naive_fingerprint(t or ""))) for t in TEXTS)
    assert all([tuple(e) for e in r["e"]] == naive_fingerprint(r["text"] or "") for r in got)


@pytest.mark.parametrize("range_rows", [1, 5, 4096])
def test_neighbours(spark, staging, range_rows):
    ship(spark)
    df = frame(spark)
    rows = [(r["doc_id"], r["text"] or "", r["h"]) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = []
    for (i, text, _), (_, following, _) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        a, b, c = map(naive_fingerprint, (text, changed, following))
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(a), as_text(b), jaccard(a, b), jaccard(a, c)))
    got = [tuple(r) for r in winnowing.compare_neighbours(df, range_rows=range_rows, staging=staging).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_neighbours_of_few_rows(spark, staging):
    ship(spark)
    assert winnowing.compare_neighbours(frame(spark, [], []), staging=staging).count() == 0
    (row,) = winnowing.compare_neighbours(frame(spark, ["some text"], [4]), staging=staging).collect()
    assert row["near_next"] == 1.0 and row["fingerprint"]
    rows = winnowing.compare_neighbours(frame(spark, [None] * 9, [None] * 9), range_rows=2, staging=staging).collect()
    assert len(rows) == 9 and {r["near_edited"] for r in rows} == {1.0}
    with pytest.raises(TypeError):
        winnowing.compare_neighbours(frame(spark).withColumn("doc_id", F.lit("x")))


ODD = [None, "", " ", "  ", "a", "▁x", "a▁b", "<|endoftext|> <s> </s> <0x41>", "😀😀 é́\t\n\n  x", "\x00", "字字字", "   \n  " * 50, "a", "end " * 900]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(token_alignment.BYTE_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_alignment.PIECE_FILE))


def naive_groups(text, libraries):
    if not text:
        return None
    letters = token_alignment._byte_letters()
    done = libraries[0].encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(letters[c] for c in t)) for i, t in zip(done.ids, done.tokens)]
    b = []
    for i in libraries[1].encode(text):
        piece = libraries[1].id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        b.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
    if {b"".join(t for _, t in side) for side in (a, b)} != {(" " + text).encode()}:
        return None
    groups, left, right, at, bt = [], [], [], 0, 0
    while a or b:
        side, out = (a, left) if at <= bt and a else (b, right)
        i, token = side.pop(0)
        out.append(i)
        at, bt = (at + len(token), bt) if side is a else (at, bt + len(token))
        if at == bt and left and right:
            groups.append((left, right))
            left, right = [], []
    return groups


def naive_alignment(rows, libraries):
    aligned = [(i, naive_groups(t, libraries)) for i, t in rows]
    held = Counter()
    for _, groups in aligned:
        held.update({(p, q) for a, b in groups or () for p in a for q in b})
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    for i, groups in aligned:
        if not groups:
            yield (i, 0, 0, 0, 0, 0, 0, "")
            continue
        links = [(p, q) for a, b in groups for p in a for q in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
               sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("unit_bytes, at_once", [(1 << 22, 1 << 22), (2000, 1 << 22)])
def test_alignment(spark, staging, data_dir, libraries, unit_bytes, at_once):
    ship(spark)
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, "a")] * 40  # a hot text
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_a", F.lit("clash"))
    got = [tuple(r) for r in token_alignment.align(df, unit_bytes=unit_bytes, staging=staging).collect()]
    assert sorted(got, key=str) == sorted(naive_alignment(rows, libraries), key=str)


def test_links_of_large_groups_are_made_in_runs(monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_alignment, "PAIRS_AT_ONCE", 7)
    ga, gb = np.array([0, 0, 0, 1, 2, 2]), np.array([0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2])
    a, b = np.arange(6), np.arange(12)
    got = np.concatenate(list(token_alignment._linked(ga, a, gb, b, 3))).tolist()
    assert got == [int(x) << token_alignment.ID_BITS | int(y) for x, g in zip(a, ga) for y, h in zip(b, gb) if g == h]


@pytest.mark.parametrize("texts", [[], [None, "", None], ["▁"]])
def test_alignment_of_nothing(spark, staging, texts):
    ship(spark)
    got = token_alignment.align(frame(spark, texts), staging=staging).collect()
    assert len(got) == len(texts) and all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in got)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def naive_tree(nodes, fanout):
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            start = i - i % fanout
            found[k].append(("".join(nodes[start:i]), "".join(nodes[i + 1:start + fanout])))
        at = [i // fanout for i in at]
        nodes = [digest(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], found


def naive_manifest(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)), r[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: naive_tree([leaf for _, _, leaf, _ in sorted(by[s], key=lambda x: x[:3])], fanout) for s in sources}
    root, above = naive_tree([trees[s][0] for s in sources], fanout) if sources else ("", [])
    for s, upper in zip(sources, above):
        for (_, _, leaf, i), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            yield i, leaf, trees[s][0], root, tuple(path + upper)


ROWS = [(i if i % 50 else None, None if i % 3 == 0 else f"s{(i * i) % 7 if i % 5 else i}é", "en" if i % 4 else None, i if i % 9 else None,
         f"Text {i}" if i % 11 else None) for i in range(400)] + [(7, "s1é", "en", 1, "again")] * 3


@pytest.mark.parametrize("fanout, local, rows", [(3, 1, ROWS), (2, 2, ROWS[:90]), (16, 3, ROWS), (16, 1, ROWS[:1]), (4, 1, [ROWS[1]] * 70), (16, 3, [])])
def test_manifest(spark, staging, fanout, local, rows):
    ship(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumn("pos", F.lit("clash"))
    found = merkle.manifest(df, staging=staging, fanout=fanout, local=local).withColumn("same", merkle.folded(F.col("leaf"), F.col("steps")) == F.col("root"))
    got = found.collect()
    assert all(r["same"] for r in got)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["steps"]))) for r in got), key=str) == \
        sorted(naive_manifest(rows, fanout), key=str)
