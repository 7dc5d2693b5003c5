"""BPE, language identification, scoring and quality on small tables, against brute force."""

import math
import random
import shutil
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, hashing, language_id, lm_scoring, quality_model

TEXTS = [None, "", " ", "a", "A b\n\nc  d ", "the cat sat on the mat", "the cat sat on the mat", "é ß 漢字 \x00 　x", "x" * 5000,
         " ".join(["word"] * 3000), "\n\n\n", "<|endoftext|> 's 'll 12345"]


def frame(spark, texts=TEXTS, ids=None):
    ids = ids or [i if i % 5 else None for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "c", 1.0) for i, t in zip(ids, texts)], "doc_id bigint, text string, ids string, score double")


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return bpe.Codec(bpe.read_ranks(bpe.rank_file()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    tokens = bpe.read_ranks(bpe.rank_file())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(tokens) if t})


def unpacked(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_ids_are_those_of_the_library(codec, library):
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "\t", "é", "漢字", "1", "'s", "!", "\x1c", "\x85", " ", "ab", "the", "😀", "Ⅷ", "\r\n", "\x00", "tion"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdet") for _ in range(n)) for n in (31, 32, 33, 64, 4000)]
    for text, packed in zip(texts, codec.encode_all(texts)):
        assert unpacked(packed) == library.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_single_and_joint_merges_agree(codec):
    rng = random.Random(6)
    pieces = ["".join(rng.choice("etaoin sh") for _ in range(rng.randint(1, 32))).encode() for _ in range(2000)]
    for piece, packed in zip(pieces, codec.merge_many(pieces)):
        assert codec.merge(piece) == unpacked(packed)


def test_small_tables_of_words_change_nothing(library):
    import public_tokenizers

    small = bpe.Codec(bpe.read_ranks(bpe.rank_file()), public_tokenizers.PATTERN, kept_words=3)
    texts = ["one two three four five six seven", "one two", "eight nine ten one"] * 3
    assert [unpacked(p) for p in small.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]


def test_encode_and_decode_frames(spark, library):
    done = bpe.decode(bpe.encode(frame(spark))).collect()
    assert Counter((r["text"], tuple(r["ids"]), bytes(r["decoded"])) for r in done) == \
        Counter((t, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for t in TEXTS)
    assert bpe.encode(frame(spark, [], [])).count() == 0


def test_words_and_shingles(monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK", 7)
    texts = [(t or "").encode() for t in TEXTS] + [b"a b c d e", b"A B C d E f"]
    words, bounds = hashing.word_hashes(*hashing.column_bytes(pa.array(texts, pa.binary())))
    names = {}
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        own = text.lower().split()
        assert len(own) == b - a
        assert all(names.setdefault(w, h) == h for w, h in zip(own, words[a:b].tolist()))
    assert len(set(names.values())) == len(names)
    sizes = [len(s) for s in hashing.shingle_sets(words, bounds)]
    assert sizes == [len({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0 for w in (t.lower().split() for t in texts)]
    keys = np.sort(words)
    assert (hashing.unpack_sorted(hashing.pack_sorted(keys)) == keys).all()


def brute_scores(rows, priors):
    words = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in words]
    orders = range(1, len(priors))
    counts = [None, *(Counter() for _ in orders)]
    for (_, w), out in zip(words, held):
        for k in orders:
            counts[k].update(() if out else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])
    total, distinct = sum(counts[1].values()), len(counts[1])
    for (i, w), out in zip(words, held):
        base = score = 0
        for at in range(len(w)):
            p = (counts[1][(w[at],)] + 1) / (total + distinct + 1)
            base += math.log10(p)
            for k in orders[1:]:
                history = counts[k - 1][tuple(w[at - k + 1:at])] if at >= k - 1 else 0
                if history:
                    p = (counts[k][tuple(w[at - k + 1:at + 1])] + priors[k] * p) / (history + priors[k])
            score += math.log10(p)
        yield (i, out, len(w), sum(counts[1][(x,)] > 0 for x in w), total), base, score


@pytest.mark.parametrize("texts", [TEXTS, [], [None] * 3])
def test_language_model(spark, staging, texts):
    df = frame(spark, texts)
    want = sorted(brute_scores([(r["doc_id"], r["text"]) for r in df.collect()], lm_scoring.PRIORS), key=str)
    got = sorted((((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"], r["score"])
                  for r in lm_scoring.score_texts(df, staging=staging).collect()), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted(g[1] for g in got) == pytest.approx(sorted(w[1] for w in want))
    assert sorted(g[2] for g in got) == pytest.approx(sorted(w[2] for w in want))


def test_texts_are_packed_for_their_units():
    """Runs of texts come back whole, and take less than half of their bytes on the way."""
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 10, 800)]
    texts = [" ".join(words[w] for w in rng.integers(0, 800, n)).encode() for n in rng.integers(0, 400, 300)]
    texts += [None, b"", b"\xff\x00\n", (words[0] + " ").encode() * 30000, texts[7]]
    rows, train = [n * 7 + (n % 3 << 40) for n in range(len(texts))], [n % 4 > 0 for n in range(len(texts))]
    kinds = pa.schema([(lm_scoring.ROW, pa.int64()), ("train", pa.bool_()), ("text", pa.binary())])
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(train), pa.array(texts, pa.binary())], schema=kinds)
    empty = pa.RecordBatch.from_arrays([pa.array([9, 8]), pa.array([True, False]), pa.array([None, b""], pa.binary())], schema=kinds)
    packed = pa.Table.from_batches(list(lm_scoring._pack(iter([batch.slice(0, 100), batch.slice(100), empty, batch.slice(0, 0)]))))
    assert packed.num_rows > 4 and packed.nbytes * 2 < sum(len(t or b"") for t in texts)
    got = lm_scoring._unpack(packed)
    assert got[0].tolist() == [*rows, 9, 8] and got[1].tolist() == [*train, True, False]
    assert got[2].to_pylist() == [t or b"" for t in [*texts, None, b""]]
    assert lm_scoring._unpack(packed.slice(packed.num_rows - 1))[2].to_pylist() == [b"", b""]


def test_scores_of_empty_texts_alone(spark, staging):
    df = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    got = lm_scoring.score_texts(df, staging=staging).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1] and len({r["base_score"] for r in got}) == 1


@pytest.mark.parametrize("priors", [(0, 0), (0, 0, 3.0), (0, 0, 9.0, 5.0, 2.0, 1.0)])
def test_language_model_of_other_orders(spark, staging, priors):
    words = "a b c a b d a b c e".split()
    texts = [" ".join(words[i % 7:] + words[:i % 5]) for i in range(40)] + ["a b c " * 3000, None, "q"]
    df = frame(spark, texts)
    want = sorted((w[0], *w[1:]) for w in brute_scores([(r["doc_id"], r["text"]) for r in df.collect()], priors) if w[0][0] is not None)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"], r["score"])
                 for r in lm_scoring.score_texts(df, order=len(priors) - 1, priors=priors, staging=staging).collect()
                 if r["doc_id"] is not None)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def automaton(texts, asked, order, priors):
    """The automaton of the n-grams of ``texts``, as far as ``asked`` can reach it."""
    grams = lm_scoring.Grams(pa.array([t.encode() for t in asked], pa.binary()), order)
    trained = lm_scoring.Grams(pa.array([t.encode() for t in texts], pa.binary()), order)
    counts = {}
    for k in range(1, order + 1):
        found = Counter(trained.keys[k][trained.at[k][trained.at[k] >= 0]].tolist())
        counts[k] = np.array([found[x] for x in grams.keys[k].tolist()])
    return grams, lm_scoring.Automaton(grams, counts, len(trained.tokens), len(trained.keys[1]), priors)


def test_weights_out_of_a_state_sum_to_one():
    """Over all words of the vocabulary and the unknown one, after "the" and after "the cat"."""
    text = "the cat sat the cat ran the dog sat"
    for before in ("the", "the cat"):
        asked = [f"{before} {w}" for w in ["zebra", *sorted(set(text.split()))]]
        grams, model = automaton([text], [*asked, before], 3, (0, 0, 3.0, 2.0))
        ends = {before: model.walk(grams.at[1][grams.bounds[-2]:grams.bounds[-1] - 1], np.array([0, len(before.split())]))[0]}
        chances = []
        for i in range(len(asked)):
            a, b = grams.bounds[i], grams.bounds[i + 1]
            chances.append(10 ** (model.walk(grams.at[1][a:b - 1], np.array([0, b - 1 - a]))[0] - ends[before]))
        a, b = grams.bounds[-2], grams.bounds[-1]  # the end token is a word of the vocabulary, too
        chances.append(10 ** (model.walk(grams.at[1][a:b], np.array([0, b - a]))[0] - ends[before]))
        assert sum(chances) == pytest.approx(1)


def test_states_arcs_and_failure_arcs():
    grams, model = automaton(["a b c"], ["a b c", "a b x", "b c"], 3, (0, 0, 3.0, 2.0))
    name = {w: grams.at[1][i] for w, i in {"a": 0, "b": 1, "c": 2, "x": 6}.items()}
    read = lambda state, w: tuple(x[0] for x in model.step(np.array([state]), np.array([name[w]])))
    a, _ = read(0, "a")
    ab, _ = read(a, "b")
    b, _ = read(0, "b")
    assert len({0, a, b, ab}) == 4
    assert model.fail[ab] == b and model.fail[a] == model.fail[b] == 0
    bc, weight = read(ab, "c")
    c, _ = read(0, "c")
    assert model.fail[bc] == c and 10 ** weight == pytest.approx((1 + 2 * (1 + 3 * (2 / 9)) / 4) / 3)
    # an unseen word falls through every state to the start and stays there
    state, weight = read(ab, "x")
    assert state == 0 and weight == pytest.approx(
        model.fail_weight[ab] + model.fail_weight[b] + model.base[name["x"]])


def test_runs_of_a_long_text_hand_their_state_on():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefg"), n)) for n in (500, 1, 37, 64, 0)]
    grams, model = automaton(texts[:3], texts, 4, (0, 0, 9.0, 4.0, 2.0))
    whole = model.walk(grams.at[1], grams.bounds, 10**6)
    for run in (1, 2, 7, 64):
        assert model.walk(grams.at[1], grams.bounds, run) == pytest.approx(whole)


def test_language_is_learnt_and_held_out(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text", "lang")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(None, "hello there", "en"), (None, "123 456", "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in got) == 5
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(nothing).collect()} == {"und"}
    # the empty label is not NULL, so it is learnt
    empty = language_id.identify(df.withColumn("lang", F.when(df.lang.isNotNull(), ""))).collect()
    assert {r["lang_pred"] for r in empty} == {"", "und"}
    assert language_id.identify(df.limit(0)).count() == 0


def test_language_does_not_depend_on_the_folder(spark, data_dir, tmp_path):
    spark.read.parquet(f"{data_dir}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/a/docs")
    shutil.copytree(tmp_path / "a", tmp_path / "some where else")
    here, there = (
        {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(spark.read.parquet(str(p))).collect()}
        for p in (tmp_path / "a" / "docs", tmp_path / "some where else" / "docs"))
    assert here == there


def test_quality_is_learnt_and_held_out(spark, staging, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.quality_scores(docs, labels, staging=staging).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_quality_edges(spark, staging):
    df = frame(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 0), (1, 1)], "doc_id bigint, quality int")
    got = quality_model.quality_scores(df, labels, staging=staging).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_model.quality_scores(df, labels.limit(0), staging=staging).collect()} == {0.5}
    assert quality_model.quality_scores(frame(spark, [], []), labels, staging=staging).count() == 0


def test_statistics_do_not_depend_on_the_batch():
    column = pa.array([(t or "").encode() for t in TEXTS], pa.binary())
    whole = quality_model.statistics(column)
    assert whole.shape == (len(TEXTS), len(quality_model.FEATURES)) and np.isfinite(whole).all()
    for i in range(len(TEXTS)):
        assert np.allclose(whole[i], quality_model.statistics(column.slice(i, 1))[0])
