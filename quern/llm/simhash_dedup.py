"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.
The Manhattan distance of two such vectors never exceeds the Hamming distance
of the fingerprints, so pairs within RADIUS bits lie within RADIUS there too.
The range join runs over grids: the segments are dealt into GROUPS groups, and
of a distance of at most RADIUS at least GROUPS - RADIUS groups get nothing,
so a pair shares the cell of some grid that is made of so many groups' counts.
Within a cell the Manhattan distance over all segments filters, and the
Hamming distance decides. Every link within RADIUS is found.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.components import components
from quern.plans.rows import ROW, chosen, numbered
from quern.plans.salting import per_salt, salt_bits, salt_of
from quern.plans.staging import settle

SEED, RADIUS, SHINGLE = 42, 4, 4
SEGMENTS, GROUPS = 32, 7
#: Fingerprints of one cell that one task compares with one another; larger cells are cut into pairs of blocks.
BLOCK = 4096
LOW = 0x5555555555555555


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of ``size`` words; of the whole word sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)] if words else []
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """A bit is set if it is set in more than half of the hashes. 0 for none."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(shingle_hashes(t.as_py())) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])


def embedded(fp: str) -> str:
    """SQL: each segment's bit count in unary, so that XOR and a bit count give the Manhattan distance of two vectors."""
    odd = f"(shiftrightunsigned({fp}, 1) & {LOW}L)"
    return f"((({fp} & {LOW}L) | {odd}) | shiftleft(({fp} & {LOW}L) & {odd}, 1))"


def grids(n_groups: int = GROUPS, radius: int = RADIUS) -> list[int]:
    """For each grid the mask, as a signed long, of the segments that make its cells."""
    groups = [sum(3 << (2 * s) for s in range(g, SEGMENTS, n_groups)) for g in range(n_groups)]
    masks = [sum(c) for c in combinations(groups, n_groups - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _unite(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that each reaches over the links u-v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _close(t: np.ndarray, f: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the index pairs those within RADIUS: first by the lower bound, then exactly."""
    near = np.bitwise_count(t[i] ^ t[j]) <= RADIUS
    near[near] = np.bitwise_count(f[i[near]] ^ f[j[near]]) <= RADIUS
    return near


def _pairs(key: np.ndarray, t: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of links between rows with equal keys; rows are sorted by key. Work arrays stay small."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    end = np.repeat(starts + sizes, sizes)
    rows = np.flatnonzero((np.repeat(sizes, sizes) <= 64) & (np.arange(len(key)) + 1 < end))
    step = 1
    while len(rows):
        near = _close(t, f, rows, rows + step)
        yield rows[near], rows[near] + step
        step += 1
        rows = rows[rows + step < end[rows]]
    for a, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        for i in range(a, a + n - 1):
            j = np.arange(i + 1, a + n)
            near = _close(t, f, np.full(len(j), i), j)
            yield np.full(near.sum(), i), j[near]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within cells, as a forest over fingerprints: never more links than there are fingerprints."""

    def linked(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(c).to_numpy() for c in ("grid", "part", "cell", "fp", "unary")]
        new = np.zeros(table.num_rows, bool)
        for c in cols[:3]:
            new[1:] |= c[1:] != c[:-1]
        f, t = cols[3].view(np.uint64), cols[4].view(np.uint64)
        found = [(np.zeros(0, np.int64),) * 2, *_pairs(np.cumsum(new), t, f)]
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        names, at = np.unique(f[np.r_[u, v]], return_inverse=True)
        label = _unite(at[: len(u)], at[len(u) :], len(names))
        child = label != np.arange(len(names))
        return pa.record_batch([pa.array(names[child].view(np.int64)), pa.array(names[label[child]].view(np.int64))], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 1 << 18:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(c).to_numpy() for c in ("grid", "part", "cell")]
        last = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = rows - int(last[::-1].argmin()) if not last.all() else 0  # the last cell may go on in the next batch
        if cut:
            yield linked(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        rows -= cut
    if rows:
        yield linked(pa.Table.from_batches(held).combine_chunks())


def near_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect whatever distinct fingerprints ``prints(fp)`` lie within RADIUS bits of one another.

    A cell with more than ``block`` fingerprints is dealt into blocks by hash;
    each pair of blocks is a group of its own, so no task gets a whole large cell.
    """
    cells = ", ".join(f"struct({g} as grid, unary & {m}L as cell)" for g, m in enumerate(grids()))
    rows = prints.selectExpr("fp", f"{embedded('fp')} as unary").selectExpr("fp", "unary", f"inline(array({cells}))").select("grid", "cell", "fp", "unary")
    large = settle(rows.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("grid", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        own = "cast(pmod(xxhash64(fp), blocks) as int)"
        parts = f"if(blocks is null, array(0), transform(sequence(0, blocks - 1), b -> least(b, {own}) * blocks + greatest(b, {own})))"
        rows = rows.join(large, ["grid", "cell"], "left").withColumn("part", F.explode(F.expr(parts)))
    rows = rows.select("grid", "part", "cell", "fp", "unary")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "grid", "part", "cell").sortWithinPartitions("grid", "part", "cell").mapInArrow(_forest, "u long, v long").distinct()


def _prints(docs: DataFrame, key: Column, text_col: str) -> DataFrame:
    return settle(docs.select(key.alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "id long, fp long").withColumn("salt", salt_of("id")))


def _rooted(points: DataFrame) -> DataFrame:
    """``points(fp, ...)`` with the ``root`` of each fingerprint's component."""
    roots = components(near_links(points.select("fp")))
    return points.join(roots, points["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id that is reachable over links of at most
    RADIUS differing bits, the row's own included. A null text counts as
    empty; texts without words have fingerprint 0, which links like any other;
    of very long texts every shingle counts. A bit that exactly half of the
    shingles set is 0. A null id gets a component like any row but never names
    one, unless the whole component lacks ids, which leaves component_id null.
    Repeated rows each get their row. An empty table gives an empty result;
    other columns are ignored.
    """
    prints = _prints(docs, F.col(id_col).cast("long"), text_col)
    points = settle(prints.groupBy("fp", "salt").agg(F.min("id").alias("least")).groupBy("fp").agg(F.min("least").alias("least"), salt_bits("salt").alias("salts")))
    rooted = settle(_rooted(points))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = per_salt(rooted.join(ids, "root").select("fp", "salts", "component_id"), "salts")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(known, ["fp", "salt"]).select(F.col("id").alias(id_col), hexed, "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group stays, with all its columns: of the rows with the smallest id any one; null ids go last.

    Rows are told apart by a key of their own on a settled copy, as ids may be null or repeat.
    """
    rows = numbered(docs)
    prints = _prints(rows, F.col(ROW), text_col).join(rows.select(F.col(ROW).alias("id"), F.col(id_col).cast("long").alias("own")), "id")
    first = F.min(F.struct(F.col("own").isNull().alias("nameless"), "own", F.col("id").alias("row"))).alias("first")
    points = settle(prints.groupBy("fp", "salt").agg(first).groupBy("fp").agg(F.min("first").alias("first")))
    return chosen(rows, _rooted(points).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(ROW)))
