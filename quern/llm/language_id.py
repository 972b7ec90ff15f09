"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of
a bounded sample of labelled documents. Applied, it labels every byte of every
whole text; a document's probabilities are the means over its positions.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import settle

UNDETERMINED = "und"
#: Byte 256 fills up a text's last window.
FILL = 256
LETTER = regex.compile(r"\p{L}")


class Gru:
    """One direction: gates z, r and the candidate n, in this order, ``hidden`` units each. Arrays are (units, windows)."""

    def __init__(self, hidden: int, rng: np.random.Generator) -> None:
        self.hidden = hidden
        self.byte = rng.normal(0, 0.3, (3 * hidden, FILL + 1)).astype(np.float32)
        self.state = rng.normal(0, 0.4, (3 * hidden, hidden)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False):
        """States (T, hidden, B) for the windows x (T, B); with ``keep`` also what the gradient needs.

        A sigmoid is (1 + tanh of half its argument) / 2; the halves are in the weights.
        """
        k = self.hidden
        h = np.zeros((k, x.shape[1]), np.float32)
        states, kept = np.empty((len(x), k, x.shape[1]), np.float32), []
        byte = self.byte * np.repeat(np.array([0.5, 0.5, 1], np.float32), k)[:, None]
        state = self.state * np.float32(0.5)
        for t in range(len(x)):
            a, u = byte.take(x[t], axis=1, mode="clip"), state @ h  # bytes are in range; the other modes are slower
            gates, half = a[: 2 * k], u[2 * k :]
            gates += u[: 2 * k]
            np.tanh(gates, out=gates)
            z, r = gates[:k], gates[k:]
            n = r * half
            n += half
            n += a[2 * k :]
            np.tanh(n, out=n)
            before = h
            h = before - n
            h *= z
            h += before
            h += n
            h *= 0.5
            states[t] = h
            if keep:
                kept.append((before, (z + 1) / 2, (r + 1) / 2, n, 2 * half))
        return (states, kept) if keep else states

    def gradient(self, x: np.ndarray, kept: list, dstates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dbyte, dstate, dh = np.zeros_like(self.byte.T), np.zeros_like(self.state), np.zeros_like(kept[0][0])
        for t in range(len(x) - 1, -1, -1):
            before, z, r, n, un = kept[t]
            dh = dh + dstates[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r])
            np.add.at(dbyte, x[t], np.concatenate([dz, dr, dn]).T)
            dstate += du @ before.T
            dh = dh * z + self.state.T @ du
        return dbyte.T, dstate


class Network:
    """Two directions and a softmax for each position."""

    def __init__(self, labels: list[str], hidden: int = 8, window: int = 64, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.window = labels, window
        self.ahead, self.back = Gru(hidden, rng), Gru(hidden, rng)
        self.out = rng.normal(0, 0.3, (len(labels), 2 * hidden)).astype(np.float32)
        self.bias = np.zeros((len(labels), 1), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 160, rate: float = 0.02, seed: int = 2) -> None:
        """x: windows (N, window) of bytes; y: the label's number of each. Adam with a falling rate.

        Half of the windows are cut short at a random byte, as short texts are.
        """
        rng = np.random.default_rng(seed)
        params = [self.ahead.byte, self.ahead.state, self.back.byte, self.back.state, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        k = self.ahead.hidden
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            xt = x[pick].T.astype(np.intp)
            short = rng.integers(4, self.window, batch // 2)
            xt[:, : batch // 2][np.arange(self.window)[:, None] >= short] = FILL
            f, kept_f = self.ahead.run(xt, keep=True)
            g, kept_g = self.back.run(xt[::-1], keep=True)
            both = np.concatenate([f, g[::-1]], axis=1)
            p = self._softmax(np.matmul(self.out, both) + self.bias)
            p[:, y[pick], np.arange(batch)] -= 1
            real = xt != FILL
            p *= (real / real.sum(axis=0) / batch).astype(np.float32)[:, None, :]
            dboth = np.matmul(self.out.T, p)
            grads = [*self.ahead.gradient(xt, kept_f, dboth[:, :k]), *self.back.gradient(xt[::-1], kept_g, dboth[::-1, k:]), np.matmul(p, both.transpose(0, 2, 1)).sum(axis=0), p.sum(axis=(0, 2))[:, None]]
            now = rate * (1 - 0.9 * step / steps)
            for w, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (T, labels, B) of each position of the windows x (B, T)."""
        xt = np.ascontiguousarray(x.T, dtype=np.intp)
        k = self.ahead.hidden
        s = np.matmul(self.out[:, :k], self.ahead.run(xt))
        s += np.matmul(self.out[:, k:], self.back.run(xt[::-1])[::-1])
        s += self.bias
        return self._softmax(s)

    def pooled(self, texts: list[bytes], at_once: int = 2048) -> np.ndarray:
        """Mean label probabilities over all positions of each text; zeros for an empty one."""
        w = self.window
        counts = np.array([-(-len(t) // w) for t in texts])
        total = np.zeros((len(texts), len(self.labels)))
        owner, pending = np.repeat(np.arange(len(texts)), counts), []
        for start in range(0, len(owner), at_once):
            own = owner[start : start + at_once]
            lo, hi = own[0], own[-1]
            skip = start - int(counts[:lo].sum())
            for i in range(lo, hi + 1):
                a = skip * w if i == lo else 0
                part = texts[i][a : a + at_once * w]
                pending.append(np.frombuffer(part, np.uint8))
                if rest := -len(part) % w:
                    pending.append(np.full(rest, FILL, np.uint16))
            x = np.concatenate(pending, dtype=np.uint16)[: len(own) * w].reshape(-1, w)
            pending = []
            p = self.positions(x)
            p *= (x.T != FILL)[:, None, :]
            np.add.at(total, own, p.sum(axis=0).T)
        return total / np.maximum(1, np.array([[len(t)] for t in texts]).reshape(-1, 1))


def hash_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def _windows(window: int, per_doc: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                step = max(window, len(raw) // per_doc)
                found += [(label, raw[a : a + window]) for a in range(0, max(1, len(raw) - window + 1), step)][:per_doc] if raw else []
            yield pa.record_batch([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], names=["label", "bytes"])

    return cut


def train(docs: DataFrame, learn: Column, per_label: int = 250, per_doc: int = 8, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **shape) -> Network | None:
    """A network fitted on about ``per_label`` different documents of each label, spread over the table by a hash of id and text.

    Of each such document ``per_doc`` windows, evenly spread over the whole
    text, are learned. None if there is nothing to learn from.
    """
    usable = docs.where(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.lit("language"), F.col(id_col), F.col(text_col)).alias("place"))
    counts = settle(usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    share = F.pmod(F.col("place"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = usable.join(counts, "label").where(share < F.lit(float(per_label)) / F.col("n"))
    once = picked.groupBy("label", "place").agg(F.first("text").alias("text")).select("label", "text")  # rows that repeat travel as one
    network = Network(sorted(r["label"] for r in counts.collect()), **shape)
    rows = once.mapInArrow(_windows(network.window, per_doc), "label string, bytes binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.full((len(rows), network.window), FILL, np.uint16)
    for at, r in enumerate(rows):
        x[at, : len(r[1])] = np.frombuffer(bytes(r[1]), np.uint8)
    y = np.array([network.labels.index(r[0]) for r in rows])
    balance = np.concatenate([np.resize(np.flatnonzero(y == k), max(np.bincount(y))) for k in np.unique(y)])
    network.fit(x[balance], y[balance])
    return network


def _labeller(network: Network | None):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lettered = [bool(t and LETTER.search(t)) for t in texts]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            at = [i for i, yes in enumerate(lettered) if yes]
            if network and at:
                p = network.pooled([texts[i].encode("utf-8", "surrogatepass") for i in at])
                best = p.argmax(axis=1)
                for i, k in zip(at, best.tolist(), strict=True):
                    names[i] = network.labels[k]
                scores[at] = np.minimum(1, p[np.arange(len(at)), best])
            yield pa.record_batch([batch.column(0), pa.array(names), pa.array(scores)], names=["id", "lang_pred", "score"])

    return label


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, lang_pred and score.

    lang_pred is a learned label, or ``und``, with score 0, for a text that is
    null or has no letter, and for all texts if nothing was learned. Very long
    texts are labelled whole, window by window. Of labels with equal
    probabilities the first in order wins. Null ids and repeated rows each get
    their row; an empty table gives an empty result; other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_labeller(network), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, held_out_parts: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Learn from the rows whose hash part is not 0, label all: the id, held_out, lang_pred and score."""
    part = hash_part(F.col(id_col), held_out_parts)
    network = train(docs, part != 0, id_col=id_col, text_col=text_col, label_col=label_col)
    return identify(docs, network, id_col, text_col).select(id_col, (part == 0).alias("held_out"), "lang_pred", "score")


def _accepter(network: Network | None, least_score: float, text_at: int):
    label = _labeller(network)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_at)
            for told in label([pa.record_batch([pa.nulls(len(text)), text], names=["id", "text"])]):
                yield batch.filter(pa.array([name != UNDETERMINED and score >= least_score for name, score in zip(told.column(1).to_pylist(), told.column(2).to_pylist(), strict=True)], pa.bool_()))

    return accept


def accepted(docs: DataFrame, least_score: float = 0.35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least_score``, with all columns; each row by its own text, whatever its id.

    A score on the threshold is accepted; texts that are null or have no
    letter go; an empty table gives an empty result.
    """
    network = train(docs, hash_part(F.col(id_col), 5) != 0, id_col=id_col, text_col=text_col)
    return docs.mapInArrow(_accepter(network, least_score, docs.columns.index(text_col)), docs.schema)
