"""Two versions of a table: where they differ, found by digests of key ranges before rows are compared."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import settle

#: Key ranges that a tree has as leaves, and nodes that one node above them holds.
LEAVES, FANOUT = 4096, 16
#: Runs of neighbouring ranges that a scan is asked for; where more differ, near ones are joined.
RUNS = 64
NUMBERS = ("byte", "short", "int", "bigint", "smallint", "tinyint", "float", "double", "decimal")


def _leaf(key: str, low: int, width: int) -> str:
    return f"coalesce(floor((`{key}` - {low}) / {width}), -1)"


def digest_tree(df: DataFrame, key: str, low: int, width: int, leaves: int = LEAVES) -> DataFrame:
    """(level, node, rows, digest) over ranges of ``width`` whole-number keys from ``low`` on, level 0 being the ranges; node -1 holds what lies below or has no key.

    A range's digest is the sum of its rows' hashes over all columns in the
    order of their names, so neither row order nor partitions change it. The
    table is read once and travels as one row a range; the levels above are
    rolled up from that. A saved tree stands for its table in ``differing``.
    """
    names = sorted(df.columns)
    row = F.xxhash64(*[c for n in names for c in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())])
    at = F.expr(f"greatest(-1L, least({leaves - 1}L, {_leaf(key, low, width)}))").alias("node")
    level = df.select(at, row.alias("_h")).groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("digest"))
    level = settle(level.select(F.lit(0).alias("level"), "node", "rows", "digest"))
    out, depth = level, 0
    while FANOUT**depth < leaves:
        depth += 1
        over = level.groupBy(F.floor(F.col("node") / FANOUT**depth).alias("node")).agg(F.sum("rows").alias("rows"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
        out = out.union(over.select(F.lit(depth), "node", "rows", "digest"))
    return out


def differing(old: DataFrame, new: DataFrame) -> list[int]:
    """Leaves in which two trees of the same ranges differ: from the top down, only below nodes that differ; LEAVES at most."""
    depth = old.agg(F.max("level")).first()[0] or 0
    old, new = settle(old), settle(new)
    side = lambda t, k: t.select("level", "node", F.col("rows").alias(f"r{k}"), F.col("digest").alias(f"d{k}"))
    both = settle(side(old, 1).join(side(new, 2), ["level", "node"], "full").where("NOT (r1 <=> r2 AND d1 <=> d2)").select("level", "node"))
    below = both.where(F.col("level") == depth)
    for level in range(depth - 1, -1, -1):
        here = both.where(F.col("level") == level).withColumn("_up", F.floor(F.col("node") / FANOUT))
        below = here.join(below.select(F.col("node").alias("_up")).distinct(), "_up", "left_semi").select("level", "node")
    return sorted(r["node"] for r in below.collect())


def _runs(leaves: list[int], most: int) -> list[tuple[int, int]]:
    """First and last of runs of neighbours; the smallest gaps are closed until no more than ``most`` are left."""
    gaps = sorted(range(1, len(leaves)), key=lambda k: leaves[k] - leaves[k - 1], reverse=True)
    cuts = sorted(k for k in gaps[: most - 1] if leaves[k] - leaves[k - 1] > 1)
    bounds = [0, *cuts, len(leaves)]
    return [(leaves[a], leaves[b - 1]) for a, b in zip(bounds, bounds[1:], strict=False)] if leaves else []


def table_diff(old: DataFrame, new: DataFrame, key: str, tolerance: float = 0.0, relative: float = 0.0, leaves: int = LEAVES, report: dict | None = None) -> DataFrame:
    """(key, status, columns) of rows that are missing from ``new``, extra in it, or changed, with the names of the columns that changed.

    ``key`` is a whole number and unique in each version, or the diff fails; one
    row may have none. Numbers are equal within ``tolerance`` plus
    ``relative`` times the old one's size; nulls equal nulls, NaN equals NaN.
    Both versions have the same columns. Digests narrow the differences down
    to key ranges, and only rows of these are read again, by filters on the
    key that reach the scan, and compared. ``report`` gets how many rows both
    versions have and how many were compared.
    """
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"the columns differ: {sorted({*old.columns} ^ {*new.columns})}")
    ends = old.select(key).union(new.select(key)).agg(F.min(key), F.max(key)).first()
    low, high = (int(v) if v is not None else 0 for v in ends)
    width = max(1, -(-(high - low + 1) // leaves))
    trees = [settle(digest_tree(df, key, low, width, leaves)) for df in (old, new)]
    found = differing(*trees)
    spans = [(low + a * width, low + (b + 1) * width - 1) for a, b in _runs([n for n in found if n >= 0], RUNS)]
    within = " OR ".join([f"`{key}` BETWEEN {a} AND {b}" for a, b in spans] + ([f"`{key}` IS NULL"] if -1 in found else [])) or "false"
    one, two = (settle(df.where(within)) for df in (old, new))
    for df in (one, two):
        if (twice := df.groupBy(key).count().where("count > 1").first()) is not None:
            raise ValueError(f"key {twice[0]} is not unique")
    if report is not None:
        report |= {"rows": [t.where("level = 0").agg(F.sum("rows")).first()[0] or 0 for t in trees], "compared": [one.count(), two.count()], "ranges": len(found)}
    others = [c for c in old.columns if c != key]
    kinds = dict(old.dtypes)
    a = one.select(F.col(key).alias("_k1"), *[F.col(f"`{c}`").alias(f"_a{i}") for i, c in enumerate(others)], F.lit(True).alias("_in1"))
    b = two.select(F.col(key).alias("_k2"), *[F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(others)], F.lit(True).alias("_in2"))

    def same(i: int, c: str) -> str:
        if not kinds[c].startswith(NUMBERS):
            return f"_a{i} <=> _b{i}"
        return f"(_a{i} <=> _b{i} OR coalesce(abs(_a{i} - _b{i}) <= {tolerance!r}D + {relative!r}D * abs(_a{i}), false) AND NOT (isnan(_a{i}) OR isnan(_b{i})))"

    changed = F.expr(f"array_sort(filter(array({', '.join(f'CASE WHEN NOT ({same(i, c)}) THEN {c!r} END' for i, c in enumerate(others)) or 'CAST(NULL AS string)'}), c -> c IS NOT NULL))")
    both = a.join(b, F.col("_k1").eqNullSafe(F.col("_k2")), "full")
    status = F.expr("CASE WHEN _in2 IS NULL THEN 'missing' WHEN _in1 IS NULL THEN 'extra' ELSE 'changed' END")
    listed = both.select(F.coalesce("_k1", "_k2").alias(key), status.alias("status"), F.when(F.col("_in1") & F.col("_in2"), changed).otherwise(F.array().cast("array<string>")).alias("columns"))
    return listed.where("status <> 'changed' OR size(columns) > 0").withColumn("columns", F.concat_ws(",", "columns"))
