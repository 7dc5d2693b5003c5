"""A regularised quadratic discriminant over document statistics.

One scan turns every whole text into a short vector of transformed statistics, which is written.
The classes' counts, sums and products are added up over *all* labelled training rows (map-side, then
a few hundred rows); covariances are shrunk towards the pooled diagonal, their Cholesky factors are
inverted once and shipped.  A document's margin is the difference of the two Mahalanobis
log-densities; the margins of the training rows, counted in bins, calibrate it to a probability.

Defined results: NULL and empty texts have the statistics of an empty text and get a score like any
other; labels that are NULL or not 0 or 1 are left out, labels without a document too; a document
labelled twice counts twice; without rows of one of the classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import hashing
from millrace.llm.common import ROW, id_crc, with_row
from millrace.staging import Staging

MODULUS, HELD_OUT = 4, 2
CUT = 0.7
SHRINKAGE = 0.15
RIDGE = 1e-3
BINS = 400
MARGIN = 40.0  # margins are counted and scored up to this
SLICE_BYTES = 4 << 20

_GROUPS = {  # byte classes whose shares are statistics
    "upper": range(65, 91), "digits": range(48, 58), "stops": b".,;:?", "marks": b"#*$%&|<>!@_=~^{}[]\\/+",
    "lines": b"\n", "high": range(128, 256),
}
FEATURES = ("log_words", "word_length", "word_spread", "distinct_words", "distinct_shingles", "top_word",
            "words_per_line", *_GROUPS)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values by text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """One row per text, one column per feature."""
    data, offsets = hashing.column_bytes(column)
    words, bounds = hashing.word_hashes(data, offsets)
    n = np.diff(bounds).astype(float)
    size = np.diff(offsets).astype(float)
    # word lengths from where words start and end
    space = hashing._IS_SPACE[data]
    solid = np.concatenate([~space, [False]])
    brk = np.zeros(len(data) + 1, bool)
    brk[offsets] = True
    starts = np.flatnonzero(solid[:-1] & (np.concatenate([[True], space[:-1]]) | brk[:-1])) if len(data) else np.zeros(0, int)
    ends = np.flatnonzero(solid[:-1] & (np.concatenate([space[1:], [True]]) | brk[1:])) + 1 if len(data) else starts
    length = (ends - starts).astype(float)
    some = np.maximum(n, 1)
    mean = _per_text(length, bounds) / some
    spread = np.sqrt(np.maximum(_per_text(length ** 2, bounds) / some - mean ** 2, 0))
    distinct, top, shingles = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            own = np.sort(words[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])))
            distinct[i], top[i] = len(runs), runs.max()
    for i, s in enumerate(hashing.shingle_sets(words, bounds)):
        shingles[i] = len(s)
    table = np.zeros((len(_GROUPS), 256))
    for i, group in enumerate(_GROUPS.values()):
        table[i, list(group)] = 1
    shares = [_per_text(row[data], offsets) / np.maximum(size, 1) for row in table]
    lines = shares[list(_GROUPS).index("lines")] * size + 1
    columns = [
        np.log1p(n), np.log1p(mean), np.log1p(spread), np.sqrt(distinct / some),
        np.sqrt(shingles / np.maximum(n - 4, 1)), np.sqrt(top / some), np.log1p(n / lines),
        *[np.sqrt(s) for s in shares],
    ]
    return np.stack(columns, axis=1)


def _vectors(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for piece in hashing.slices(batch, "text", SLICE_BYTES):
            rows = statistics(piece.column("text"))
            yield pa.RecordBatch.from_arrays(
                [piece.column(ROW), piece.column("doc_id"), pa.array(list(rows), pa.list_(pa.float64()))],
                [ROW, "doc_id", "x"])


def _moments(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, sums and products of a task, per class."""
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in stream:
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
        y = batch.column("y").to_numpy()
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    for c in (0, 1):
        yield pa.RecordBatch.from_pydict({
            "y": np.full(sums.shape[1], c, np.int32), "at": np.arange(sums.shape[1], dtype=np.int32), "v": sums[c]})


class Discriminant:
    """Two shrunken Gaussians with inverted Cholesky factors, and the calibration of their margin."""

    def __init__(self, sums: np.ndarray, shrinkage: float = SHRINKAGE, ridge: float = RIDGE):
        d = len(FEATURES)
        self.counts, self.slope, self.shift = sums[:, 0], 1.0, 0.0
        self.usable = bool(self.counts.min() >= 1)
        if not self.usable:
            return
        means = sums[:, 1:d + 1] / self.counts[:, None]
        scatter = [sums[c, d + 1:].reshape(d, d) / self.counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = sum(n * s for n, s in zip(self.counts, scatter)) / self.counts.sum()
        self.means, self.inverse, self.logdet = means, [], []
        for s in scatter:
            shrunk = (1 - shrinkage) * s + shrinkage * np.diag(np.diag(pooled)) + ridge * np.eye(d)
            factor = np.linalg.cholesky(shrunk)
            self.inverse.append(np.linalg.inv(factor))
            self.logdet.append(2 * np.log(np.diag(factor)).sum())
        self.prior = float(np.log(self.counts[1] / self.counts[0]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 minus that of class 0, with the prior."""
        logs = [-0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) - 0.5 * ld
                for m, inv, ld in zip(self.means, self.inverse, self.logdet)]
        return np.clip(logs[1] - logs[0] + self.prior, -MARGIN, MARGIN)

    def calibrate(self, centres: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> None:
        """Newton steps for the slope and shift of a logistic curve over binned margins."""
        x = np.stack([centres, np.ones_like(centres)], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n1 * (1 - p) - n0 * p) - 1e-2 * (w - [1.0, 0.0])
            hessian = (x * ((n0 + n1) * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            w = w + np.linalg.solve(hessian, gradient).clip(-1, 1)
        if w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50)))


def _margin_bins(model: Discriminant):
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            bins = np.minimum(((model.margin(x) + MARGIN) / (2 * MARGIN) * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "bin": bins})

    return run


def _scores(model: Discriminant):
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return run


def fit(vectors: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Discriminant:
    """Learn from the vectors whose id has a label and is not held out."""
    known = labels.select(F.col(f"`{doc_id}`").alias("label_id"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)")
    train = vectors.where(id_crc("doc_id") % MODULUS != HELD_OUT).join(known, F.col("doc_id") == F.col("label_id")).select("y", "x")
    rows = train.mapInArrow(_moments, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + len(FEATURES) + len(FEATURES) ** 2))
    for r in rows:
        sums[r["y"], r["at"]] = r["v"]
    model = Discriminant(sums)
    if model.usable:
        bins = train.mapInArrow(_margin_bins(model), "y int, bin int").groupBy("y", "bin").count().collect()
        n = np.zeros((2, BINS))
        for r in bins:
            n[r["y"], r["bin"]] = r["count"]
        model.calibrate((np.arange(BINS) + 0.5) / BINS * 2 * MARGIN - MARGIN, n[0], n[1])
    return model


def quality_scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   staging: Staging | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    staging = staging or Staging(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    docs = with_row(df).select(ROW, F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    vectors = staging.keep(docs.mapInArrow(_vectors, f"{ROW} bigint, doc_id {kind}, x array<double>"), "vectors")
    model = fit(vectors, labels, doc_id)
    scored = vectors.select("doc_id", "x").mapInArrow(_scores(model), f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (id_crc("doc_id") % MODULUS == HELD_OUT).alias("held_out"), "score", "predicted")
