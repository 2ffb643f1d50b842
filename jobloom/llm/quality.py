"""Quality classifier: naive Bayes support vectors on n-grams.

Indicators of the byte n-grams of a text, of words that repeat at once and of the share of distinct words are scaled by the log ratio of the smoothed class frequencies; a linear hinge
loss on the scaled, length-normalised indicators is minimised by dual coordinate descent; the margin becomes a
probability by a logistic curve that is fitted on rows that the hinge model did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, stored, text_bytes
from .shingles import word_names

#: At most so many labelled rows, the first by hash of doc_id, are used to fit.
TRAIN_ROWS = 6000
#: And at most so many bytes of their features, which come to the driver.
TRAIN_BYTES = 1 << 28
THRESHOLD = 0.7
FEATURE_BITS = 18
_SPREAD = np.uint32(2654435761)


def features(data: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of a text's bytes: hashed runs of one to three bytes, and those of its words."""
    seen = np.zeros(1 << FEATURE_BITS, dtype=bool) if seen is None else seen
    for k in range(0, max(1, len(data)), 1 << 20):
        x = data[k : k + (1 << 20) + 2].astype(np.uint32)
        for n, code in ((1, x), (2, x[:-1] << 8 | x[1:]), (3, x[:-2] << 16 | x[1:-1] << 8 | x[2:] if len(x) > 2 else x[:0])):
            seen[((code + np.uint32(n << 24)) * _SPREAD) >> np.uint32(32 - FEATURE_BITS)] = True
    seen[word_features(data)] = True
    found = np.flatnonzero(seen).astype(np.int32)
    seen[found] = False
    return found


def word_features(data: np.ndarray, part: int = 1 << 20) -> list[int]:
    """How often a word follows itself, up to four times, and the share of distinct words by sixteenths and by the
    text's length in powers of two; a very long text is taken in parts, which add up."""
    words, again, distinct = 0, 0, 0
    for k in range(0, len(data), part):
        names = word_names(LOWER[data[k : k + part]])[1]
        words += len(names)
        again += int((names[1:] == names[:-1]).sum())
        distinct += len(np.unique(names))
    if not words:
        return []
    found = [(9 << 24) + min(4, again)] if again else []
    found.append((10 << 24) + (words.bit_length() << 8) + 16 * distinct // words)
    return [(x * int(_SPREAD) % 2**32) >> (32 - FEATURE_BITS) for x in found]


@dataclass
class Model:
    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratios[found]
        norm = float(np.sqrt((r * r).sum())) or 1.0
        return float((self.weights[found] * r).sum()) / norm + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -50, 50))))


def hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss; the bias is a feature of value 1."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    squares = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                moved = max(moved, abs(step))
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, ab = np.column_stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * ab)
        ab = ab - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def fitted(rows: list[np.ndarray], labels: list[int], smoothing: float = 1.0, cost: float = 10.0) -> Model:
    """With one class only, or none, every text scores that class's smoothed share."""
    size, y = 1 << FEATURE_BITS, np.where(np.array(labels, dtype=int) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = {1: np.full(size, smoothing), -1: np.full(size, smoothing)}
    for r, k in zip(rows, y.tolist(), strict=True):
        counts[k][r] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    ratios = np.where(counts[1] + counts[-1] > 2 * smoothing, ratios, 0.0)
    values = [(ratios[r] / (float(np.sqrt((ratios[r] ** 2).sum())) or 1.0)).astype(np.float32) for r in rows]
    share = {c: len(y) / (2 * max(1, (y == c).sum())) for c in (1, -1)}
    weigh = np.array([cost * share[c] for c in y.tolist()])
    held = np.arange(len(rows)) % 5 == 4
    own = held if len(set(y[held].tolist())) == 2 and len(set(y[~held].tolist())) == 2 else np.zeros(len(rows), bool)
    take = np.flatnonzero(~own)
    w, bias = hinge([rows[i] for i in take], [values[i] for i in take], y[take], weigh[take], size)
    seen = np.flatnonzero(own) if own.any() else take
    margin = np.array([float(w[rows[i]] @ values[i]) + bias for i in seen])
    slope, shift = logistic(margin, y[seen])
    return Model(w, ratios, bias, slope, shift)


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << FEATURE_BITS, dtype=bool)
    for batch in batches:
        data, at = text_bytes(batch.column(1))
        found = [features(data[at[k] : at[k + 1]], seen) for k in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in found], pa.binary()), batch.column(2)], ["doc_id", "features", "label"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """The model, from at most so many labelled rows that are not held out, the first by hash of their id, and of those as
    many as have TRAIN_BYTES of features together. Rows with a null id or label are left out."""
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    chosen = usable.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    # At most TRAIN_ROWS pairs of numbers, so this side is safe to send to every executor.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")
    featured = stored(texts.mapInArrow(_featured, "doc_id long, features binary, label int"), "featured")
    sizes = featured.groupBy("doc_id").agg(F.sum(F.length("features").cast("long")).alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total = np.cumsum([r.bytes for r in sizes])
    own = [r.doc_id for r, t in zip(sizes, total.tolist(), strict=True) if t <= TRAIN_BYTES]
    got = (featured if len(own) == len(sizes) else featured.filter(F.col("doc_id").isin(own))).toArrow()
    ids, labels_, packed = got.column("doc_id").to_numpy(), got.column("label").to_numpy(), got.column("features").combine_chunks()
    # One row for each id, in an order that neither partitions nor ids decide.
    _, one = np.unique(ids, return_index=True)
    order = one[np.random.default_rng(11).permutation(len(one))]
    return fitted([np.frombuffer(packed[int(k)].as_buffer(), np.int32) for k in order], labels_[order].tolist())


def _scored(model, text: int, name: str = "score"):
    """A score before the columns that come in; text is the place of the text among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, m = np.zeros(1 << FEATURE_BITS, dtype=bool), model.value
        for batch in batches:
            data, at = text_bytes(batch.column(text).cast(pa.large_string()))
            score = [m.score(features(data[at[k] : at[k + 1]], seen)) for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(score, pa.float64()), *batch.columns], [name, *batch.schema.names])

    return run


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted (1 from THRESHOLD up).

    Only the text's bytes are an input of the score; a null text scores as an empty one. Repeated rows score alike, a
    null doc_id is kept and never held out, other columns are not read, and an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows=rows))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = out.mapInArrow(_scored(model, 1), "score double, doc_id long, text string")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows whose predicted label is 0; all columns stay, whatever their names.

    A null text is judged as an empty one; rows that repeat, or whose doc_id is null or repeats, are each judged by their own
    text; an empty table gives no rows, and without labels every row scores 0.5 and goes.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows=rows))
    name = "score"
    while name in docs.columns:
        name += "_"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(_scored(model, docs.columns.index("text"), name), f"`{name}` double, {kinds}")
    return out.filter(F.col(name) >= THRESHOLD).select(*docs.columns)
