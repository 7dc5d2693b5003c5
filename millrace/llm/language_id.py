"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Every whole text is a vector of hashed n-grams of its lower-cased characters (``log(1 + count)``
times IDF, scaled to length one).  Document frequencies are counted over all training documents.
The regression is fitted on a sample of labelled training documents of bounded, documented size
(``SAMPLE``), by the follow-the-regularised-leader update with L1 and L2 penalties; a part of the
sample that it does not see sets the temperature of the softmax.

Defined results: texts that are NULL or have no letter are ``und`` with score 0, as is every text
when nothing could be learnt; NULL ``lang`` values are not learnt, the empty one is a label like others;
repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ROW, id_crc, with_row

MODULUS, HELD_OUT = 3, 1
DIMENSIONS = 1 << 15
LONGEST = 3  # characters of the longest n-grams
SAMPLE = 4000  # labelled documents that are learnt from, in the mean
MAX_LANGUAGES = 500
EPOCHS = 4
STEP, STEP_SMOOTHING, L1, L2 = 2.0, 1.0, 1e-3, 1e-4
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text, by dimension."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    counts = np.zeros(DIMENSIONS, np.int64)
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        rolled = rolled[:len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:]
        spread = (rolled ^ np.uint32(n * 0x9E37)) * np.uint32(0x9E3779B1)
        counts += np.bincount(spread >> np.uint32(32 - 15), minlength=DIMENSIONS)
    return counts


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for value in batch.column("text"):
        raw = value.as_py()
        yield "" if raw is None else raw.decode("utf-8", "replace")


def _frequencies(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per dimension of a task; dimension -1 counts the documents."""
    seen, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in stream:
        for text in _texts(batch):
            seen += gram_counts(text) > 0
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({
        "at": np.append(at, -1).astype(np.int32), "n": np.append(seen[at], n)})


class Model:
    """Weights of the classes, IDF, and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.weights = np.zeros((DIMENSIONS + 1, len(languages)))

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        values = np.log1p(counts[at]) * self.idf[at]
        values /= max(np.sqrt((values ** 2).sum()), 1e-12)
        return np.append(at, DIMENSIONS), np.append(values, 1.0)

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at]

    def fit(self, vectors: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, seed: int = 7) -> None:
        """FTRL-proximal updates, example by example; every fourth example sets the temperature."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(vectors))
        aside, train = order[::4], np.setdiff1d(order, order[::4])
        if not len(train):
            train = order
        z, n = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for _ in range(EPOCHS):
            for i in rng.permutation(train):
                at, values = vectors[i]
                zs, ns = z[at], n[at]
                w = -(zs - np.sign(zs) * L1) / ((STEP_SMOOTHING + np.sqrt(ns)) / STEP + L2)
                w[np.abs(zs) <= L1] = 0
                p = _softmax(values @ w)
                p[classes[i]] -= 1
                g = values[:, None] * p
                sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / STEP
                z[at] += g - sigma * w
                n[at] += g * g
        self.weights = -(z - np.sign(z) * L1) / ((STEP_SMOOTHING + np.sqrt(n)) / STEP + L2)
        self.weights[np.abs(z) <= L1] = 0
        logits = np.array([self.logits(*vectors[i]) for i in aside]).reshape(-1, len(self.languages))
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        losses = [-np.mean([np.log(_softmax(v / t)[c] + 1e-12) for v, c in zip(logits, classes[aside])]) if len(aside) else 0 for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))]) if len(aside) else 1.0

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*self.vector(gram_counts(text))) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _chosen(shares: dict[str, float]):
    """The n-gram counts of the labelled documents whose draw falls below the share of their language."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = {"lang": [], "at": [], "n": [], "draw": []}
            draws, langs = batch.column("draw").to_pylist(), batch.column("lang").to_pylist()
            for i, (draw, lang) in enumerate(zip(draws, langs)):
                if draw < shares.get(lang, 0):
                    counts = gram_counts((batch.column("text")[i].as_py() or b"").decode("utf-8", "replace"))
                    at = np.flatnonzero(counts)
                    out["lang"].append(lang)
                    out["at"].append(at.astype("<u2").tobytes())
                    out["n"].append(np.minimum(counts[at], 65535).astype("<u2").tobytes())
                    out["draw"].append(draw)
            if out["lang"]:
                yield pa.RecordBatch.from_pydict(out, pa.schema([
                    ("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary()), ("draw", pa.float64())]))

    return run


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows ``(row, text, lang)``, all of them training rows."""
    labelled = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    frequencies = docs.where("text is not null").select("text").mapInArrow(_frequencies, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(DIMENSIONS), 0
    for r in frequencies:
        if r["at"] < 0:
            total = r["n"]
        else:
            df[r["at"]] = r["n"]
    languages = sorted(sizes)
    model = Model(languages, np.log((1 + total) / (1 + df)) + 1)
    if not languages:
        return model
    shares = {lang: sample / len(languages) / n for lang, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit(5), ROW), F.lit(1 << 30)) / (1 << 30)
    rows = labelled.select("text", "lang", draw.alias("draw")).mapInArrow(
        _chosen(shares), "lang string, at binary, n binary, draw double").collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"]))
    vectors, classes = [], []
    for r in rows:
        counts = np.zeros(DIMENSIONS, np.int64)
        counts[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u2")
        vectors.append(model.vector(counts))
        classes.append(languages.index(r["lang"]))
    if vectors:
        model.fit(vectors, np.array(classes))
    return model


def _predictions(shared):
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in stream:
            found = [model.predict(text) for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
            ], ["doc_id", "lang_pred", "score"])

    return run


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row."""
    spark = df.sparkSession
    docs = with_row(df).select(
        ROW, F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"),
        F.col(f"`{lang}`").alias("lang"))
    held_out = id_crc("doc_id") % MODULUS == HELD_OUT
    model = fit(docs.where(~held_out).select(ROW, "text", "lang"))
    kind = df.schema[doc_id].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    found = docs.select("doc_id", "text").mapInArrow(_predictions(shared), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
