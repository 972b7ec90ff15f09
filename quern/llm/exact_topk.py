"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists.

Vectors are dealt by hash into blocks of a bounded size. Of each block and
dimension a list of its rows, sorted by that component, is made once and
written. A query goes down all lists together, from the end at which its own
component gains most; each row met for the first time is scored exactly by
random access. What the components at the present depth would sum to bounds
all rows not met yet, and as soon as that cannot reach the kth best score any
more, the query is done with the block. Each pair of a block of queries and a
block of lists is one task's group, and the best of the blocks are merged.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.staging import settle

SCALE, EVERY, K = 256, 50, 5
#: Rows whose lists are one block at most, and queries that meet it at once. Small tables make smaller blocks, SPREAD of them.
ROWS, QUERIES, SPREAD = 16_384, 4096, 16
#: Depth of the first round; each round goes as far again as all before.
DEPTH = 16
#: Queries of which a worker keeps the kth best score that it has seen in earlier blocks.
REMEMBERED = 1_000_000
#: Sums up to this are exact in doubles.
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as longs; NULL where the vector or a component is null or not finite."""
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(vec.isNotNull() & finite, whole)


def _matrix(raw: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(rows, dims)


class Lists:
    """The rows of a block in the order of each dimension's components, ascending."""

    def __init__(self, keys: np.ndarray, ids: list[int | None], vectors: np.ndarray, order: np.ndarray) -> None:
        self.keys, self.ids, self.order = keys, ids, order
        self.vectors = vectors
        self.reach = int(max(abs(int(vectors.max())), abs(int(vectors.min())))) if vectors.size else 0
        self.doubles = vectors.astype(float)

    def search(self, key: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int | None, int]]:
        """(score, id, key) of the ``k`` best rows but the query's own, of equal scores the smaller ids; fewer if ``floor`` rules the rest out.

        ``floor`` is a score that ``k`` rows elsewhere reach.
        """
        n, dims = len(self.keys), np.flatnonzero(query)
        exact = self.reach * max((abs(int(q)) for q in query), default=0) * max(1, len(query)) < EXACT
        vectors = self.doubles if exact else self.vectors.astype(object)
        q = query.astype(float if exact else object)
        met = self.keys == key
        best: list[tuple[int, bool, int, int]] = []
        depth, step = 0, DEPTH
        while depth < n:
            to = min(n, depth + step) if len(dims) else n  # a query of zeros scores all alike
            down = query[dims] > 0
            heads = np.concatenate([self.order[dims[down], n - to : n - depth].ravel(), self.order[dims[~down], depth:to].ravel()]) if len(dims) else np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[heads] = True
            new = np.flatnonzero(fresh & ~met)
            met |= fresh
            if len(new):
                scores = vectors[new] @ q if len(q) else np.zeros(len(new))
                least = best[k - 1][0] * -1 if len(best) == k else floor
                if len(new) > k:
                    kth = np.sort(scores)[-k]
                    least = kth if least is None else max(least, kth)
                if least is not None:
                    new, scores = new[scores >= least], scores[scores >= least]
                best += [(-int(s), self.ids[i] is None, self.ids[i] or 0, int(self.keys[i])) for s, i in zip(scores, new.tolist(), strict=True)]
                best = sorted(best)[:k]
            if met.all():
                break
            at = np.concatenate([self.order[dims[down], n - to], self.order[dims[~down], to - 1]])
            along = np.concatenate([dims[down], dims[~down]])
            bound = (vectors[at, along] * q[along]).sum()
            if len(best) == k and bound < -best[-1][0] or floor is not None and bound < floor:
                break
            depth, step = to, to
        return [(-s, None if missing else i, row) for s, missing, i, row in best]


LISTED = "dims int, block int, n int, rows array<long>, ids array<long>, vectors binary, lists binary"


def _listed(group: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(group.vec.tolist(), "<i8").reshape(len(group), int(group.dims.iloc[0]))
    lists = np.argsort(vectors, axis=0, kind="stable").T.astype("<i4")
    ids = [None if pd.isna(i) else int(i) for i in group.id]
    return pd.DataFrame([(group.dims.iloc[0], group.block.iloc[0], len(group), group.row.tolist(), ids, vectors.tobytes(), np.ascontiguousarray(lists).tobytes())], columns=[f.split()[0] for f in LISTED.split(", ")])


FOUND = "row long, id long, other long, score long"


def _searcher(k: int):
    floors: dict[int, int] = {}

    def search(queries: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int | None, int, int]] = []
        for asked, block in _both(queries, lists):
            for key, query in zip(asked.rows, _matrix(asked.vectors, asked.n, asked.dims), strict=True):
                found = block.search(key, query, k, floors.get(key))
                if len(found) == k and (key in floors or len(floors) < REMEMBERED):
                    floors[key] = max(floors.get(key, LEAST), found[-1][0])
                out += [(key, i, other, min(MOST, max(LEAST, s))) for s, i, other in found]
        frame = pd.DataFrame(out, columns=["row", "id", "other", "score"])
        return frame.astype({"row": "int64", "id": "Int64", "other": "int64", "score": "int64"})

    return search


def _both(queries: pd.DataFrame, lists: pd.DataFrame) -> Iterator[tuple]:
    """A pair's one row of queries and one of lists, where both exist."""
    for b in lists.itertuples():
        vectors = _matrix(b.vectors, b.n, b.dims)
        block = Lists(np.array(b.rows, np.int64), [None if pd.isna(i) else int(i) for i in b.ids], vectors, np.frombuffer(b.lists, "<i4").reshape(b.dims, b.n))
        for a in queries.itertuples():
            yield a, block


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, rows: int = ROWS, queries: int = QUERIES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` best rows, or all if there are fewer: query_id, rank, the id and score.

    Queries are the rows whose id is divisible by ``every``; a row is never
    its own result, but rows that repeat its id or vector are. Of equal scores
    the smaller id goes first, null ids last; rows that share both come in any
    order. Null vectors and those with a null or non-finite component take no
    part. Vectors of another length than the query's have no inner product
    with it and are no candidates; those of length 0 score 0 with each other.
    Components beyond a long's range are cut to it, sums are exact, and scores
    beyond its range are cut to it too. An empty table gives an empty result;
    other columns are ignored. No limit on length: long vectors make blocks of
    fewer rows.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("vec")).where("vec is not null")
    kept = settle(usable.select(F.monotonically_increasing_id().alias("row"), "id", F.size("vec").alias("dims"), "vec"))
    n, longest = kept.agg(F.count(F.lit(1)), F.max("dims")).first()
    most = max(1, min(rows, rows * 64 // max(64, longest or 0)))
    deal = lambda count, size: max(1, -(-count // size))
    blocks = deal(n, min(most, max(1024, n // SPREAD)))
    asked = kept.where(F.pmod("id", F.lit(every)) == 0)
    sets = deal(asked.count(), min(most, queries))
    into = lambda df, count: df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    lists = settle(into(kept, blocks).groupBy("dims", "block").applyInPandas(_listed, LISTED))
    sought = settle(into(asked, sets).groupBy("dims", "block").applyInPandas(_listed, LISTED)).drop("lists")
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = sought.withColumnRenamed("block", "part").withColumn("block", numbers(blocks))
    right = lists.withColumn("part", numbers(sets))
    pair = ["dims", "part", "block"]
    found = settle(left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(_searcher(k), FOUND))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select("row", F.col("id").alias("query_id"))
    return top.join(names, "row").select("query_id", "rank", F.col("id").alias(id_col), "score")
