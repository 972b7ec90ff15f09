"""Quality classifier: a support vector machine on naive Bayes features.

A text is the set of its n-grams, of one to three bytes, and of patterns of
repetition over three and five words. Each n-gram's indicator is scaled by the log of the
ratio of its smoothed shares in the two classes; a linear model with hinge
loss is fitted on that by dual coordinate descent, and its weights are mixed
with their mean as in the method's paper. The fit takes a bounded sample of
labelled rows, the scores every whole text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.language_id import hash_part

#: Longer n-grams are hashed into this many slots.
SLOTS = 1 << 18
MULTIPLIER = 0x9E3779B1
#: Labelled rows of each class that the fit takes at most.
PER_CLASS = 1500


def ngrams(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The sorted distinct slots of a text's n-grams. ``seen``: SLOTS False flags, left as they were."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if not len(raw):
        return np.zeros(0, np.int32)
    two = raw[:-1] << 8 | raw[1:]
    three = two[:-1] << 8 | raw[2:]
    slots = [raw, (two + np.uint32(1 << 24)) * np.uint32(MULTIPLIER) >> 14, (three + np.uint32(1 << 25)) * np.uint32(MULTIPLIER) >> 14]
    names: dict[str, int] = {}
    words = np.array([names.setdefault(w, len(names)) for w in (text or "").split()], np.int64)
    same = words[1:] == words[:-1]
    apart = words[2:] == words[:-2]
    slots.append((same[1:] * 2 + same[:-1] + apart * 4 + 256).astype(np.uint32))
    slots.append((same[3:] * 8 + same[2:-1] * 4 + same[1:-2] * 2 + same[:-3] + 264).astype(np.uint32))
    for s in slots:
        seen[s] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.int32)


def margin_of(weight: np.ndarray, bias: float, slots: np.ndarray) -> float:
    """Texts count by the mean over their n-grams, so long and short ones compare."""
    return float(weight[slots].mean() if len(slots) else 0.0) + bias


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        return margin_of(self.weight, self.bias, slots)

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, SLOTS), smoothing)
    for row, label in zip(rows, y, strict=True):
        counts[int(label > 0), row] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 30, tolerance: float = 1e-3, seed: int = 3) -> tuple[np.ndarray, float, np.ndarray]:
    """(w, bias, alpha) of the L2-regularised hinge loss on x = scale / n at each row's n slots, with a constant 1 for the bias."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    values = [scale[r] / max(1, len(r)) for r in rows]
    square = np.array([float(v @ v) + 1 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
        if worst < tolerance:
            break
    return w, bias, alpha


def _fit(rows: list[np.ndarray], y: np.ndarray, cost: float, mixing: float) -> tuple[np.ndarray, float]:
    scale = log_count_ratio(rows, y)
    norm = np.sqrt(np.mean([np.square(scale[r] / max(1, len(r))).sum() for r in rows])) or 1.0  # rows of unit length on average, so one cost suits any length
    scale /= norm
    each = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    w, bias, _ = dual_coordinate_descent(rows, y, scale, each)
    used = np.zeros(SLOTS, bool)
    for r in rows:
        used[r] = True
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    return ((1 - mixing) * mean * used + mixing * w) * scale, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, mixing: float = 0.9) -> Model:
    """labels 0 and 1. The sigmoid from margins to scores is fitted on margins of rows left out of the fit."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        return Model(np.zeros(SLOTS), 0.0, 1.0, 0.0 if not len(y) else 5.0 * y[0])
    outside, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        train = np.flatnonzero(fold != k)
        w, bias = _fit([rows[i] for i in train], y[train], cost, mixing)
        for i in np.flatnonzero(fold == k):
            outside[i] = margin_of(w, bias, rows[i])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a small ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * outside + b, -30, 30)))
        d, h = p - (y > 0), np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(d * outside).sum() + 1e-2 * a, d.sum()])
        hess = np.array([[(h * outside * outside).sum() + 1e-2, (h * outside).sum()], [(h * outside).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    w, bias = _fit(rows, y, cost, mixing)
    return Model(w, bias, float(a), float(b))


def packed(slots: np.ndarray) -> bytes:
    """Slots as bytes: their numbers, or, if these take more room, a bit for each slot."""
    if len(slots) * 32 < SLOTS:
        return slots.astype("<i4").tobytes()
    flags = np.zeros(SLOTS, np.uint8)
    flags[slots] = 1
    return np.packbits(flags).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) * 8 < SLOTS:
        return np.frombuffer(data, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.int32)


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SLOTS, bool)
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([packed(ngrams(t.as_py(), seen)) for t in batch.column(2)], pa.binary()), batch.column(3)], names=["id", "label", "slots", "place"])


def one_label_each(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the rows whose labels agree; null ids and labels are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other").drop("other")


def train(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``per_class`` labelled ids of each class, in the order of a hash of the id. ``learn`` is a condition on ``id``.

    Of an id with several texts one teaches, that with the smallest hash. The
    driver gets at most SLOTS bits of each.
    """
    pool = one_label_each(labels, label_col, id_col).where(learn)
    share = F.xxhash64(F.lit("quality"), F.col("id"))
    picked = [pool.where(F.col("label") == k).orderBy(share, "id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select(F.col("id").cast("long"), F.col("label").cast("int"), "text", F.xxhash64("text").alias("place"))
    found = texts.mapInArrow(_featurer, "id long, label int, slots binary, place long")
    rows = found.groupBy("id").agg(F.min_by(F.struct("label", "slots"), "place").alias("one")).select("id", "one.*").collect()
    rows.sort(key=lambda r: r[0])
    return fit([unpacked(bytes(r[2])) for r in rows], np.array([r[1] for r in rows]))


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, bool)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([model.score(ngrams(t.as_py(), seen)) for t in batch.column(1)], pa.float64())], names=["id", "score"])

    return score


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, held_out, score and predicted.

    Rows whose hash part is the held-out one teach nothing. A null text scores
    as an empty one, by the bias alone; very long ones by all their n-grams.
    A score of exactly 0.5 predicts 1. Conflicting labels of one id are left
    out. Without labels of both classes all texts score alike. Null ids and
    repeated rows each get their row; an empty table gives an empty result;
    other columns are ignored.
    """
    parts, kept_back = held_out
    model = train(docs, labels, label_col, hash_part(F.col("id"), parts) != kept_back, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scorer(model), "id long, score double")
    return scored.select(F.col("id").alias(id_col), (hash_part(F.col("id"), parts) == kept_back).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
