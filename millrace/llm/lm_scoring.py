"""Language-model scores by a weighted backoff automaton over counted n-grams.

States are the n-grams seen in training (up to ``order - 1`` words); a state has an arc per word seen
after it, with a smoothed weight, and a failure arc to its longest proper suffix.  Smoothing is by
Dirichlet priors, level by level: ``p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu)``, so the failure
arc of ``h`` weighs ``mu / (c(h) + mu)``, the weights out of a state sum to one, and the lowest level
is the add-one unigram.  A text is walked once from left to right, carrying its state: failure arcs
until the state has an arc for the next word, then that arc, adding up their weights.

The model is never gathered.  Runs of documents are packed and dealt to units of bounded size; each unit asks
for the n-grams it holds and tells how often its training documents have them, range by range of the
hashed key space; a range adds up and answers every unit, which builds the states and arcs that its
texts can reach.  An n-gram that every document holds is one entry per unit.  The ranges also tell
their shares of all tokens and distinct words, so the text is read once, after a pass for its size.

Defined results: NULL and empty texts have the end token only; a NULL id counts as the empty text in
the choice of training documents; repeated rows are counted and scored each; without training
documents all counts are zero.  Words are told apart by 64-bit hashes, longer n-grams by 56 bits of
theirs, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import hashing, key_counts
from millrace.llm.common import ROW, id_crc, with_row
from millrace.staging import Staging

ORDER = 3
PRIORS = (0.0, 0.0, 2000.0, 20.0)  # by order of the n-gram
UNIT_BYTES = 4 << 20
PACK_BYTES = 1 << 16  # of texts that are compressed together, one text at least
KEY_BITS = 56  # of the hash of two words and more
RUN = 1024  # words of a text that are walked in a row
MODULUS, HELD_OUT = 7, 2
_CODEC = "zstd"
END = hashing._stream(97, 1)[0]

_U = np.uint64


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by the end token; and their offsets."""
    words, bounds = hashing.word_hashes(*hashing.column_bytes(column))
    texts = len(bounds) - 1
    ends = bounds[1:] + np.arange(texts)
    out = np.empty(len(words) + texts, _U)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[ends] = END
    out[mask] = words
    return out, np.concatenate([[0], ends + 1])


class Grams:
    """The n-grams of a unit, order by order: a table of distinct keys, and the entry at every position."""

    def __init__(self, column: pa.Array, order: int):
        self.tokens, self.bounds = tokens_of(column)
        self.order = order
        n = len(self.tokens)
        place = np.arange(n) - np.repeat(self.bounds[:-1], np.diff(self.bounds))  # in its text
        self.keys: dict[int, np.ndarray] = {}  # distinct, rising
        self.ends: dict[int, np.ndarray] = {}  # where each of them ends for the first time
        self.at: dict[int, np.ndarray] = {}  # its entry at the position where it ends, -1 without one
        for k in range(1, order + 1):
            ended = np.flatnonzero(place >= k - 1)
            hashed = hashing.mix(self.tokens + _U(1)) if k == 1 else hashing.ngram_hashes(self.tokens, k)
            self.keys[k], first, entry = np.unique(
                hashed[ended - (k - 1)] >> _U(64 - _key_bits(k)), return_index=True, return_inverse=True)
            self.ends[k] = ended[first]
            self.at[k] = np.full(n, -1)
            self.at[k][ended] = entry


def _key_bits(k: int) -> int:
    return 64 if k == 1 else KEY_BITS


_PACKED = pa.schema([("first", pa.int64()), ("rows", pa.binary()), ("train", pa.binary()), ("lengths", pa.binary()), ("texts", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of documents as one row each, so that their texts are compressed together; NULL is packed as empty."""
    for batch in batches:
        out = []
        for run in hashing.slices(batch, "text", PACK_BYTES):
            data, offsets = hashing.column_bytes(run.column("text"))
            rows = run.column(ROW).to_numpy(zero_copy_only=False)
            train = run.column("train").to_numpy(zero_copy_only=False)
            out.append((int(rows[0]), hashing.pack_sorted(rows.astype(_U)), hashing.pack_numbers(train),
                        hashing.pack_numbers(np.diff(offsets)), pa.compress(data, codec=_CODEC, asbytes=True)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PACKED)], schema=_PACKED)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(rows, train, texts)`` of the runs of documents of a unit."""
    rows, train, lengths = (
        np.concatenate([unpack(b) for b in table.column(c).to_pylist()])
        for c, unpack in (("rows", hashing.unpack_sorted), ("train", hashing.unpack_numbers), ("lengths", hashing.unpack_numbers)))
    sizes = [int(hashing.unpack_numbers(b).sum()) for b in table.column("lengths").to_pylist()]
    texts = b"".join(pa.decompress(t, n, codec=_CODEC, asbytes=True) for t, n in zip(table.column("texts").to_pylist(), sizes))
    offsets = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(texts)])
    return rows.astype(np.int64), train.astype(bool), column


def _request(order: int, bits: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        out = {"unit": [], "part": [], "k": [], "keys": [], "counts": []}
        unit = table.column("unit")[0].as_py()
        _, train, texts = _unpack(table)
        grams = Grams(texts, order)
        train = np.repeat(train, np.diff(grams.bounds))
        for k in range(1, order + 1):
            ok = grams.at[k] >= 0
            counts = np.bincount(grams.at[k][ok], train[ok], len(grams.keys[k])).astype("<u8")
            done = 0
            cut = dict(key_counts.cut(grams.keys[k], _key_bits(k), bits))
            # every range is asked about words, as it tells its share of all tokens and distinct ones, too
            for part in range(1 << bits) if k == 1 else cut:
                own = cut.get(part, grams.keys[k][:0])
                out["unit"].append(unit)
                out["part"].append(part)
                out["k"].append(k)
                out["keys"].append(hashing.pack_sorted(own))
                out["counts"].append(hashing.pack_numbers(counts[done:done + len(own)]))
                done += len(own)
        return pa.table(out, _REQUEST)

    return run


_REQUEST = pa.schema([("unit", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


_ANSWER = pa.schema([("unit", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("counts", pa.binary()),
                     ("total", pa.int64()), ("distinct", pa.int64())])


def _answer(table: pa.Table) -> pa.Table:
    """Add up the counts of one range and order; answer every unit in the order of its keys.

    With the answer goes how many n-grams of training the range holds, and how many distinct ones.
    """
    units = table.column("unit").to_pylist()
    keys = [hashing.unpack_sorted(b) for b in table.column("keys").to_pylist()]
    counts = np.concatenate([hashing.unpack_numbers(b) for b in table.column("counts").to_pylist()])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, counts)
    told = sums[at].astype("<u8")
    edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).tolist()
    return pa.table({
        "unit": units, "part": table.column("part"), "k": table.column("k"),
        "counts": [hashing.pack_numbers(told[a:b]) for a, b in zip(edges[:-1], edges[1:])],
        "total": [int(sums.sum())] * len(units), "distinct": [int((sums > 0).sum())] * len(units),
    }, _ANSWER)


class Automaton:
    """The part of the weighted backoff automaton that the texts of a unit can reach.

    A state is a seen n-gram of up to ``order - 1`` words; state 0 is the empty one.  Each state but that
    has a failure arc to its longest proper suffix (``fail``, ``fail_weight``).  There is an arc for every
    seen n-gram, out of the state of its first words, and one out of state 0 for every word of the unit.
    Arcs are sorted by ``state * words + word`` (``arcs``), with ``weight`` and ``target`` beside them.

    ``counts[k]`` belongs to ``grams.keys[k]``.
    """

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], total: int, distinct: int, priors):
        self.words, self.reach = len(grams.keys[1]), grams.order - 1
        seen = counts[1] > 0
        state = self._states(seen, 1, 1)
        chance = (counts[1] + 1.0) / (total + 1.0 * (distinct + 1))
        self.base = np.log10(chance)
        fail, held = [np.zeros(1 + int(state.max(initial=0)), np.int64)], [np.zeros(1, np.int64), counts[1][seen & (state > 0)]]
        fail_weight = [np.zeros(1)]
        arcs, weight, target = [np.arange(self.words)], [self.base], [state]
        made = len(fail[0])
        for k in range(2, grams.order + 1):
            mu, end = priors[k], grams.ends[k]
            source, suffix = state[grams.at[k - 1][end - 1]], grams.at[k - 1][end]
            seen = (counts[k] > 0) & (source > 0) & seen[suffix]
            size = np.concatenate(held)
            chance = (counts[k] + mu * chance[suffix]) / (size[source] + mu)
            fail_weight.append(np.log10(mu / (held[-1] + mu)))
            own = self._states(seen, made, k)
            arcs.append((source * self.words + grams.at[1][end])[seen])
            weight.append(np.log10(chance[seen]))
            target.append((own if k <= self.reach else state[suffix])[seen])
            if k <= self.reach:
                fail.append(state[suffix][seen])
                held.append(counts[k][seen])
                made += int(seen.sum())
            state = own
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        arcs = np.concatenate(arcs)
        rising = np.argsort(arcs)
        self.arcs, self.weight, self.target = arcs[rising], np.concatenate(weight)[rising], np.concatenate(target)[rising]

    def _states(self, seen: np.ndarray, made: int, k: int) -> np.ndarray:
        """Numbers from ``made`` on for the seen n-grams that are states, 0 for the others."""
        return np.where(seen, made - 1 + np.cumsum(seen), 0) if k <= self.reach else np.zeros(len(seen), np.int64)

    def _arc(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc out of a state for a word, -1 without one."""
        wanted = state * self.words + word
        arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
        return np.where(self.arcs[arc] == wanted, arc, -1)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read a word in each state: failure arcs until the state has an arc for it, then that arc."""
        state, gain = state.copy(), np.zeros(len(state))
        arc = self._arc(state, word)
        stuck = np.flatnonzero(arc < 0)
        while len(stuck):
            gain[stuck] += self.fail_weight[state[stuck]]
            state[stuck] = self.fail[state[stuck]]
            arc[stuck] = self._arc(state[stuck], word[stuck])
            stuck = stuck[arc[stuck] < 0]
        return self.target[arc], gain + self.weight[arc]

    def walk(self, words: np.ndarray, bounds: np.ndarray, run: int = RUN) -> np.ndarray:
        """log10 of the probability of every text, read once from left to right.

        All texts of the unit advance together, a word a step.  A longer text is cut into runs; a run
        starts ``order - 1`` words early in state 0, which is the state that the run before hands on,
        as no state holds more words.
        """
        length = np.diff(bounds)
        pieces = -(-length // run)
        text = np.repeat(np.arange(len(length)), pieces)
        start = bounds[text] + run * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(start + run, bounds[text + 1])
        begin = np.maximum(start - self.reach, bounds[text])
        longest = np.argsort(begin - stop, kind="stable")
        text, start, stop, begin = text[longest], start[longest], stop[longest], begin[longest]
        todo = stop - begin
        state, score = np.zeros(len(text), np.int64), np.zeros(len(text))
        for step in range(int(todo[0]) if len(todo) else 0):
            live = int(np.searchsorted(-todo, -step))
            at = begin[:live] + step
            state[:live], gain = self.step(state[:live], words[at])
            score[:live] += np.where(at >= start[:live], gain, 0.0)
        return np.bincount(text, score, len(length))


def _score(order: int, priors) -> Callable:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows, _, texts = _unpack(docs)
        grams = Grams(texts, order)
        told = sorted(zip(*(answers.column(c).to_pylist() for c in ("k", "part", "counts"))), key=lambda r: r[:2])
        counts = {k: np.concatenate([hashing.unpack_numbers(c) for o, _, c in told if o == k] or [np.zeros(0, "<u8")]).astype(np.int64)
                  for k in range(1, order + 1)}
        of_words = answers.filter(pc.equal(answers.column("k"), 1))
        total, distinct = (pc.sum(of_words.column(c)).as_py() for c in ("total", "distinct"))
        automaton = Automaton(grams, counts, total, distinct, priors)
        words = grams.at[1]
        sums = lambda x: np.add.reduceat(x, grams.bounds[:-1])  # noqa: E731  every text has its end token
        return pa.table({
            ROW: rows, "n_tokens": np.diff(grams.bounds), "n_known": sums((counts[1] > 0).astype(np.int64)[words]),
            "train_tokens": np.full(len(rows), total), "base_score": sums(automaton.base[words]), "score": automaton.walk(words, grams.bounds)})

    return run


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, priors=PRIORS,
                staging: Staging | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    spark = df.sparkSession
    staging = staging or Staging(spark)
    own = F.col(f"`{doc_id}`")
    held_out = id_crc(own) % MODULUS == HELD_OUT
    docs = with_row(df).select(
        ROW, own.alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    units = max(1, ceil(size / UNIT_BYTES))
    bits = key_counts.range_bits(size)
    packed = docs.select(ROW, (~F.col("held_out")).alias("train"), "text").mapInArrow(
        _pack, "first bigint, rows binary, train binary, lengths binary, texts binary")
    dealt = packed.select(F.pmod(F.xxhash64("first"), F.lit(units)).alias("unit"), "rows", "train", "lengths", "texts")
    requests = dealt.groupBy("unit").applyInArrow(
        _request(order, bits), "unit bigint, part int, k int, keys binary, counts binary")
    answers = requests.groupBy("part", "k").applyInArrow(
        _answer, "unit bigint, part int, k int, counts binary, total bigint, distinct bigint")
    scored = dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(
        _score(order, priors),
        f"{ROW} bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    scored = staging.keep(scored.withColumnRenamed(ROW, "r"), "scores")
    return docs.drop("text").join(scored, F.col(ROW) == F.col("r")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
