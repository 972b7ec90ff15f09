"""Importance resampling towards a target distribution.

Features are runs of words. Each task keeps a word trie of what it reads: a
node stands for a run, holds how often the run occurred and the CRC-32 of its
bytes, from which that of a longer run goes on without reading the shorter one
again. Nodes' counts are summed by bucket, so a task hands on a row a bucket at
most, and Spark merges the totals of the corpus and of the target. A bucket's
gain is the logarithm of the ratio of its shares. Documents are then scored by
walking the trie again, with a gain at each node, and the highest of the scores
plus a seeded Gumbel noise are drawn, which is sampling without replacement in
proportion to the importance weights.
"""

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ranks import with_places
from quern.plans.staging import settle

#: Longest run of words, buckets, words that a drawn document has at least, per cent of those that are drawn.
RUN, BUCKETS, SHORTEST, SHARE, SEED = 1, 10_000, 20, 10, 2024
#: Nodes after which a task empties its trie; what was counted is kept by bucket.
NODES = 500_000
#: What is no letter, digit or character beyond ASCII parts words.
_SPACES = bytes(b if b >= 0x80 or bytes([b]).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()  # bytes: only A-Z


class Trie:
    """Runs of words by their paths: step[node, word] is a node, 0 the root; crc and count of each."""

    def __init__(self) -> None:
        self.step: dict[tuple[int, bytes], int] = {}
        self.crc, self.count = [0], [0]

    def node(self, run: tuple[bytes, ...]) -> int:
        at = 0
        for word in run:
            ahead = self.step.get((at, word))
            if ahead is None:
                ahead = self.step[at, word] = len(self.crc)
                self.crc.append(zlib.crc32(b" " + word, self.crc[at]) if at else zlib.crc32(word))
                self.count.append(0)
            at = ahead
        return at


def runs_of(words: list[bytes], longest: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """Each different run of 1 to ``longest`` words of a document, and how often it occurs."""
    for n in range(1, longest + 1):
        yield from Counter(zip(*(words[k:] for k in range(n)), strict=False)).items()


def _counter(longest: int, buckets: int, nodes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = np.zeros(buckets, np.int64), Trie()

        def merge() -> None:
            np.add.at(totals, np.array(trie.crc, np.int64) % buckets, np.array(trie.count, np.int64))

        for batch in batches:
            for text in batch.column("text"):
                for run, n in runs_of(words_of(text.as_py()), longest):
                    trie.count[trie.node(run)] += n
                if len(trie.crc) > nodes:
                    merge()
                    trie = Trie()
        merge()
        some = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(totals[some], pa.int64())], names=["bucket", "n"])

    return count


def bucket_totals(texts: DataFrame, longest: int = RUN, buckets: int = BUCKETS, nodes: int = NODES) -> list[int]:
    """How many features of ``texts(text)`` each bucket holds; no more than ``buckets`` rows come to the driver."""
    counted = texts.select("text").mapInArrow(_counter(longest, buckets, nodes), "bucket int, n long")
    out = [0] * buckets
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Of each bucket, a thousand times the logarithm of its smoothed share in the target over that in the corpus."""
    s_all, t_all, k = float(sum(corpus)), float(sum(target)), float(len(corpus))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(corpus, target, strict=True)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A thousand times a Gumbel variate that the seed and the id decide."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "id long, words long, n_features long, weight long, score long"


def _scorer(gain: list[int], longest: int, nodes: int, seed: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        attached = [0]  # gains of the trie's nodes
        for batch in batches:
            out: list[tuple[int, ...]] = []
            ids = batch.column("id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                words, features, weight = words_of(text.as_py()), 0, 0
                for run, n in runs_of(words, longest):
                    node = trie.node(run)
                    if node >= len(attached):
                        attached += [gain[c % len(gain)] for c in trie.crc[len(attached) :]]
                    features += n
                    weight += n * attached[node]
                out.append((len(words), features, weight, weight + noise(doc_id, seed)))
                if len(trie.crc) > nodes:
                    trie, attached = Trie(), [0]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.record_batch([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "words", "n_features", "weight", "score"])

    return score


def resampled(docs: DataFrame, target: DataFrame, longest: int = RUN, buckets: int = BUCKETS, shortest: int = SHORTEST, share: int = SHARE, seed: int = SEED, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_features, weight, score and, if drawn, rank.

    ``target`` has a column ``text``. Whole texts count, null ones as empty.
    Documents of fewer than ``shortest`` words are scored but not drawn; of
    equal scores the smaller id goes first and null ids last, and rows that
    share both are drawn in any order. A null id has the noise of an empty
    one. Repeated rows are documents of their own. An empty target leaves all
    its shares equal; an empty table gives an empty result; other columns are
    ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gain = gains(bucket_totals(texts, longest, buckets, nodes), bucket_totals(target, longest, buckets, nodes))
    scored = settle(texts.mapInArrow(_scorer(gain, longest, nodes, seed), SCORED).withColumn("row", F.monotonically_increasing_id()))
    long_enough = scored.where(F.col("words") >= shortest).select("row", (-F.col("score")).alias("down"), F.col("id").isNull().alias("last"), "id")
    placed = with_places(long_enough, [], ["down", "last", "id"], "rank", "all")
    drawn = placed.where(F.col("rank") <= F.expr(f"{share} * all div 100")).select("row", F.col("rank").cast("long").alias("rank"))
    return scored.join(drawn, "row", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
