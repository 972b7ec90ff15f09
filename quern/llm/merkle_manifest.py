"""A Merkle manifest of a dataset, built by mountain ranges.

Each source is a tree of fan-out BASE over its documents in the order of their
ids; the sources' roots are the leaves of one more tree. Spark deals the
indexed leaves by ranges, and a stack runs over each partition: a node is
pushed on its level, and as soon as its run of BASE neighbours, or the short
one at the tree's end, is whole, it carries: the run is hashed and its parent
pushed one level up. Whole nodes become node records. What a partition cannot
finish, because a run reaches over its edges, are its peaks: a few for each
level of two trees at most. Peaks of MERGED neighbouring partitions are merged
by the same stack, then those of as many neighbouring merges, until none are
left. Nothing is padded, as a tree's size tells where its short runs end.

A proof needs the siblings of each level. Node records are grouped by blocks of
TIER levels, from the top down, and each block hands the path above it on to
the blocks below, so no document meets more than one block.
"""

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranks import with_places
from quern.plans.staging import settle

BASE = 3
#: Neighbouring partitions, or merges, whose peaks one task merges.
MERGED = 64
#: Levels of a block: it has BASE ** TIER nodes on its lowest level at most.
TIER = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "tree string, n long, level int, idx long, hash string, kind string, run int"


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves, from the leaves to the root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // BASE))
    return sizes


class MountainRange:
    """The open runs of a part of one tree, one a level."""

    def __init__(self, n: int) -> None:
        self.sizes = level_sizes(n)
        self.open: list[list[tuple[int, str]]] = [[] for _ in self.sizes]
        self.done: list[tuple[int, int, str, str]] = []  # level, index, hash, kind

    def push(self, level: int, idx: int, digest: str) -> None:
        while level < len(self.sizes) - 1:
            run, parent = self.open[level], idx // BASE
            if run and run[0][0] // BASE != parent:
                self._give_up(level)
            run.append((idx, digest))
            if len(run) < min(BASE, self.sizes[level] - parent * BASE):
                return
            level, idx, digest = level + 1, parent, digest_of(h for _, h in run)
            run.clear()
            if level < len(self.sizes) - 1:
                self.done.append((level, idx, digest, "node"))
        self.done.append((level, idx, digest, "root"))

    def _give_up(self, level: int) -> None:
        self.done += [(level, i, h, "peak") for i, h in self.open[level]]
        self.open[level].clear()

    def taken(self, closing: bool = False) -> list[tuple[int, int, str, str]]:
        """What is whole by now; with ``closing`` the open runs' nodes too, as peaks."""
        if closing:
            for level in range(len(self.open)):
                self._give_up(level)
        done, self.done = self.done, []
        return done


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, n, level, idx, hash, run) in order; a tree's rows that are apart only leave more peaks."""
    tree, stack, run = None, None, 0
    empty: dict[str, list] = {f.split()[0]: [] for f in NODES.split(", ")}
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("kind", pa.string()), ("run", pa.int32())])

    def emit(out: dict[str, list], closing: bool) -> None:
        for level, idx, digest, kind in stack.taken(closing):
            for name, value in zip(out, (*tree, level, idx, digest, kind, run), strict=True):
                out[name].append(value)

    for batch in batches:
        out = {name: [] for name in empty}
        columns = [batch.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "hash", "run")]
        for name, n, level, idx, digest, run in zip(*columns, strict=True):
            if tree != (name, n):
                if stack:
                    emit(out, True)
                tree, stack = (name, n), MountainRange(n)
            stack.push(level, idx, digest)
        if stack:
            emit(out, False)
        yield pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)
    if stack:
        out = {name: [] for name in empty}
        emit(out, True)
        yield pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def _merged(peaks: DataFrame) -> DataFrame:
    """One more stack over the peaks of MERGED neighbours, a task each."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group["first"] = group.idx * BASE ** group.level.astype("int64")
        group = group.sort_values(["tree", "first"])
        out = []
        for (tree, n), rows in group.groupby(["tree", "n"], sort=False):
            stack = MountainRange(n)
            for level, idx, digest in zip(rows.level.tolist(), rows.idx.tolist(), rows.hash, strict=True):
                stack.push(level, idx, digest)
            out += [(tree, n, *node, int(group.run.iloc[0])) for node in stack.taken(closing=True)]
        return pd.DataFrame(out, columns=[f.split()[0] for f in NODES.split(", ")])

    lifted = peaks.withColumn("run", F.expr(f"run div {MERGED}").cast("int"))
    return lifted.groupBy("run").applyInPandas(lambda g: merge(g.copy()), NODES)


def tree_nodes(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes between leaves and roots, roots), both (tree, n, level, idx, hash), of ``leaves(tree, n, idx, hash)``."""
    ranged = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "hash").repartitionByRange("tree", "idx").sortWithinPartitions("tree", "idx")
    found = settle(ranged.withColumn("run", F.spark_partition_id()).mapInArrow(_stacked, NODES))
    every = [found]
    runs = (found.where("kind = 'peak'").agg(F.max("run")).first()[0] or 0) + 1
    while not (peaks := found.where("kind = 'peak'")).isEmpty():
        if runs == 1 and len(every) > 1:
            raise ValueError("a tree's leaves are not numbered from 0 without gaps")
        found = settle(_merged(peaks))
        every.append(found)
        runs = -(-runs // MERGED)
    whole = every[0]
    for more in every[1:]:
        whole = whole.union(more)
    columns = ["tree", "n", "level", "idx", "hash"]
    return whole.where("kind = 'node'").select(columns), whole.where("kind = 'root'").select(columns)


class Block:
    """The steps from a block's lowest nodes up to its top; a step has the run's siblings left and right of the path."""

    def __init__(self, group: pd.DataFrame, bottom: int, top: int) -> None:
        """Of ``group``'s rows, one has the path above the top; those without are nodes."""
        above = group[group.path.notna()].iloc[0]
        self.path, self.subroot, self.root = above.path, above.subroot, above.root
        nodes = group[group.path.isna()].astype({"level": "int64", "idx": "int64"})
        self.sizes, self.bottom = level_sizes(int(nodes.n.iloc[0])), bottom
        self.top = min(top, len(self.sizes) - 1)
        self.nodes = dict(zip(zip(nodes.level.tolist(), nodes.idx.tolist(), strict=True), nodes.hash, strict=True))
        self.known: dict[tuple[int, int], str] = {}
        self.base = nodes[nodes.level == bottom]

    def path_of(self, level: int, idx: int) -> str:
        if level == self.top:
            return self.path
        if (found := self.known.get((level, idx))) is None:
            first = idx // BASE * BASE
            run = [self.nodes[level, k] for k in range(first, min(first + BASE, self.sizes[level]))]
            step = f"{''.join(run[: idx - first])}|{''.join(run[idx - first + 1 :])}"
            above = self.path_of(level + 1, idx // BASE)
            found = self.known[level, idx] = f"{step},{above}" if above else step
        return found


def folded(digest: str, path: str) -> str:
    """The root that a leaf's hash and its siblings give."""
    for step in path.split(",") if path else ():
        left, right = step.split("|")
        digest = digest_of((left, digest, right))
    return digest


PATHS = "tree string, idx long, path string, subroot string, root string"


def _tier_paths(members: DataFrame, above: DataFrame, tier: int) -> DataFrame:
    bottom, top = tier * TIER, (tier + 1) * TIER

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        block = Block(group, bottom, top)
        paths = [block.path_of(block.bottom, i) for i in block.base.idx.tolist()]
        return pd.DataFrame({"tree": block.base.tree, "idx": block.base.idx, "path": paths, "subroot": block.subroot, "root": block.root})

    return _blocks(members, above, tier).groupBy("tree", "block").applyInPandas(walk, PATHS)


def _blocks(members: DataFrame, above: DataFrame, tier: int) -> DataFrame:
    """The nodes of a tier by block, and with them the path above each block's top."""
    width = "element_at(array({}), {} - level % {})".format(", ".join(f"{BASE**k}L" for k in range(1, TIER + 1)), TIER, TIER)
    own = members.where(F.expr(f"level div {TIER}") == tier).withColumn("block", F.expr(f"idx div {width}"))
    return own.unionByName(above.select("tree", "block", "path", "subroot", "root"), allowMissingColumns=True)


def _tops(roots: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, tier, block, path, subroot, root) of ``roots`` with the paths of ``above(tree, path, root)``: where a tree's own steps end."""
    return roots.join(above, "tree").select("tree", F.expr(f"greatest(level - 1, 0) div {TIER}").alias("tier"), F.lit(0).cast("long").alias("block"), "path", F.col("hash").alias("subroot"), "root")


def leaf_paths(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, down_to: int) -> tuple[DataFrame, DataFrame]:
    """(members, above) of the tier ``down_to``: all tiers over it are walked."""
    members = leaves.unionByName(nodes, allowMissingColumns=True)
    above = tops.where(F.lit(False))
    for tier in range(tops.agg(F.max("tier")).first()[0] or 0, down_to - 1, -1):
        above = above.select("tree", "block", "path", "subroot", "root").union(tops.where(F.col("tier") == tier).select("tree", "block", "path", "subroot", "root"))
        if tier > down_to:
            above = settle(_tier_paths(members, above, tier).withColumnRenamed("idx", "block"))
    return members, above


def leaf_of(fields: list[Column]) -> Column:
    """The hash of a row: each field as its UTF-8 byte count, a colon and its value, or as a dash."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]), 256)


PROVEN = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _proven(members: DataFrame, above: DataFrame) -> DataFrame:
    """What the leaves of each lowest block prove."""
    top = TIER

    def prove(group: pd.DataFrame) -> pd.DataFrame:
        block = Block(group, 0, top)
        base = block.base
        paths = [block.path_of(0, i) for i in base.idx.tolist()]
        proofs = [digest_of(p.replace("|", "").replace(",", "")) for p in paths]
        roots = [folded(h, p) for h, p in zip(base.tampered, paths, strict=True)]
        return pd.DataFrame({"id": base.id, "leaf": base.hash, "subroot": block.subroot, "root": block.root, "proof_sha256": proofs, "folded_root": roots})

    return _blocks(members, above, 0).groupBy("tree", "block").applyInPandas(prove, PROVEN)


def manifest(docs: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Ids are whole numbers. A row whose decimal id has an even CRC-32 is
    checked as if its text had lost its line breaks, the others as they are.
    Null fields hash as a dash, so a null and an empty text differ; a null
    source is a tree of its own and comes first; null ids come first in their
    source and are not tampered with. Rows that share an id are leaves of
    their own, in the order of their hashes; rows equal in all fields are
    leaves that may swap places. Very long texts are hashed whole. An empty
    table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col)
    changed = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(2)) == 0
    value = lambda c, t: t if c == text_col else F.col(c).cast("string")
    leaf = lambda t: leaf_of([value(c, t) for c in fields])
    tampered = F.when(changed, leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    tree = F.coalesce(F.concat(F.lit("+"), F.col(source_col)), F.lit(""))
    rows = settle(docs.select(F.col(id_col).cast("long").alias("id"), tree.alias("tree"), leaf(text).alias("hash"), tampered.alias("tampered")))
    placed = with_places(rows.withColumn("tampered", F.coalesce("tampered", "hash")), ["tree"], ["id", "hash"], "place", "n")
    leaves = settle(placed.select("tree", "n", (F.col("place") - 1).cast("long").alias("idx"), "hash", F.lit(0).alias("level"), F.col("id").cast("string").alias("id"), "tampered"))
    nodes, roots = tree_nodes(leaves)

    sources = with_places(roots.select("tree", "hash"), [], ["tree"], "place", "n")
    sources = settle(sources.select(F.lit("").alias("tree"), "n", (F.col("place") - 1).cast("long").alias("idx"), "hash", F.lit(0).alias("level"), F.col("tree").alias("source")))
    upper, top = tree_nodes(sources)
    members, above = leaf_paths(sources.drop("source"), upper, _tops(top, top.select("tree", F.lit("").alias("path"), F.col("hash").alias("root"))), 0)
    over = settle(_tier_paths(members, above, 0).join(sources.select("idx", "source"), "idx").select(F.col("source").alias("tree"), "path", "root"))

    members, above = leaf_paths(leaves, nodes, _tops(roots, over), 0)
    proven = _proven(members, above)
    return proven.select(F.col("id").cast("long").alias(id_col), *proven.columns[1:], (F.col("folded_root") == F.col("root")).alias("verified"))
