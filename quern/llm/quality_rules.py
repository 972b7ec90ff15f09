"""Quality rules by an isolation forest on rule statistics.

Every whole text gives a row of statistics. Trees of random splits, each grown
on its own subsample of all rows, isolate rows; a row that few splits isolate
is anomalous. One forest sees what texts are made of, another how they repeat
themselves, as rare but harmless repeats would drown the former's anomalies.
The threshold on each anomaly score is calibrated from labelled rows: the
lowest that keeps a stated share of the good ones.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.quality_classifier import one_label_each
from quern.plans.staging import settle

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: What is no ASCII punctuation.
OTHERS = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_marks"]
#: For each forest the shares that it sees, each of two counts.
FORESTS = {
    "anomaly": [("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_upper", "word_chars"), ("n_marks", "n_words")],
    "repetition": [("n_dup_lines", "n_words"), ("n_repeat_words", "n_words")],
}
LEAST_WORDS, MOST_REPEATED = 50, 50
TREES, SUBSAMPLE = 200, 256
#: Share of the good labelled rows that each threshold keeps at least, and the steps in which scores are counted.
KEEP, STEPS = 0.995, 2000


def repeated_words(ids: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def statistics(text: str | None) -> list[int]:
    """COUNTS and MORE of a text. Words are what lies between ASCII white space; a null text has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    solid = raw.translate(None, BLANKS)
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    upper = len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    tails = len(solid.translate(None, bytes(range(0x80, 0xC0))))
    marks = len(solid.translate(None, OTHERS))
    return [len(words), tails, symbols, len(lines) - len(set(lines)), repeated_words(ids), upper, marks]


def features(counts: np.ndarray, name: str = "anomaly") -> np.ndarray:
    """Rows of COUNTS + MORE as a forest sees them."""
    at = {c: i for i, c in enumerate([*COUNTS, *MORE])}
    c = counts.astype(np.float64)
    return np.column_stack([c[:, at[a]] / np.maximum(1, c[:, at[b]]) for a, b in FORESTS[name]])


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: a node's feature (-1: a leaf), cut, children, and path length if a row ends there."""

    trees: list[tuple[np.ndarray, ...]]
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): about 0.5 for an average row, towards 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, path in self.trees:
            node = np.zeros(len(x), np.int32)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] < cut[node], left[node], right[node])
                node = np.where(inner, down, node)
            total += path[node]
        return 2.0 ** -(total / max(1, len(self.trees)) / self.norm) if self.trees else np.full(len(x), 0.5)


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + expected_path(len(rows))])
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(open_features):
            f = int(rng.choice(open_features))
            cut = rng.uniform(low[f], high[f])
            below = x[rows, f] < cut
            if below.any() and not below.all():
                nodes[me][:2] = [f, cut]
                nodes[me][2] = split(rows[below], depth + 1)
                nodes[me][3] = split(rows[~below], depth + 1)
        return me

    split(np.arange(len(x)), 0)
    feature, cut, left, right, path = zip(*nodes, strict=True)
    return np.array(feature, np.int32), np.array(cut), np.array(left, np.int32), np.array(right, np.int32), np.array(path)


def isolation_forest(x: np.ndarray, times: np.ndarray | None = None, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 5) -> Forest:
    """Trees on draws from ``x``, whose rows count ``times`` each (once)."""
    rng, times = np.random.default_rng(seed), np.ones(len(x), np.int64) if times is None else times
    n = int(min(subsample, times.sum()))
    limit = max(1, int(np.ceil(np.log2(max(2, n)))))
    upto = np.cumsum(times)
    pick = lambda: np.searchsorted(upto, rng.choice(upto[-1], n, replace=False), side="right")
    grown = [grow(x[pick()], rng, limit) for _ in range(trees)] if n else []
    return Forest(grown, expected_path(n) or 1.0)


def drawn(passed: DataFrame, wanted: int = TREES * SUBSAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, how often) of about ``wanted`` rows, by a hash of the row over the whole table.

    Equal rows have equal hashes and travel as one.
    """
    n, every = passed.count(), ["id", *COUNTS, *MORE]
    share = F.pmod(F.xxhash64(F.lit("forest"), *every), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = passed.where(share < F.lit(wanted / max(1, n))).groupBy(*every).agg(F.count(F.lit(1)).alias("times")).collect()
    rows.sort(key=lambda r: tuple(-1 if v is None else v for v in r))
    table = np.array([r[1:] for r in rows], np.int64).reshape(-1, len(every))
    return table[:, :-1], table[:, -1]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([statistics(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS) + len(MORE))
        yield pa.record_batch([batch.column(0), *(pa.array(found[:, i]) for i in range(found.shape[1]))], names=["id", *COUNTS, *MORE])


def _scorer(forests: dict[str, Forest]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)])
            found = [pa.array(forest.scores(features(counts, name))) for name, forest in forests.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *forests])

    return score


def thresholds(scored: DataFrame, labels: DataFrame, keep: float = KEEP) -> dict[str, float]:
    """For each forest the lowest step of its score that at least ``keep`` of the rows labelled good stay at or below; without such rows 1."""
    steps = F.explode(F.array(*(F.struct(F.lit(name).alias("forest"), F.ceil(F.col(name) * STEPS).cast("int").alias("step")) for name in FORESTS))).alias("s")
    good = one_label_each(labels, "quality").where("label = 1").select("id")
    counts = scored.join(good, "id", "left_semi").select(steps).groupBy("s.forest", "s.step").count().collect()  # STEPS rows a forest at most
    out = dict.fromkeys(FORESTS, 1.0)
    for name in FORESTS:
        own = sorted((r["step"], r["count"]) for r in counts if r["forest"] == name)
        upto = 0
        for step, n in own:
            upto += n
            if upto >= keep * sum(n for _, n in own):
                out[name] = step / STEPS
                break
    return out


def rules(docs: DataFrame, labels: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, COUNTS, base_failed, kept, anomaly and repetition.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED per
    cent of them in repeated windows. The forests grow on texts that pass the
    base rules; others are not kept anyway. A null text counts as empty and
    fails; very long texts are counted whole. Rows with equal statistics get
    equal verdicts, a score on the threshold is kept, and of conflicting
    labels of one id none counts. Without labels the method rejects nothing.
    Null ids and repeated rows each get their row; an empty table gives an
    empty result; other columns are ignored.
    """
    every = ", ".join(f"{c} long" for c in [*COUNTS, *MORE])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = settle(texts.mapInArrow(_counter, f"id long, {every}"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    passed = counts.where(~failed)
    pool, times = drawn(passed)
    forests = {name: isolation_forest(features(pool, name), times) for name in FORESTS}
    scored = settle(counts.mapInArrow(_scorer(forests), f"id long, {every}, " + ", ".join(f"{name} double" for name in FORESTS)))
    most = thresholds(scored.where(~failed), labels.withColumnRenamed(id_col, "doc_id"), keep)
    kept = ~failed
    for name, line in most.items():
        kept &= F.col(name) <= line
    return scored.select(F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), kept.alias("kept"), *FORESTS)
