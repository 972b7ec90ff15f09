"""Removal of repeated passages by distributed prefix doubling.

A byte goes if some string of LENGTH bytes that covers it also starts
elsewhere. Positions are ranked by their first STEP bytes; Spark sorts the
pairs of a position's rank and the rank STEP, 2 * STEP, ... bytes further on
and numbers the different ones anew, so that a rank stands for twice as many
bytes after each round. A position whose pair is unique is out. Ranks that
stand for SPAN bytes end the doubling, as the next pair would pass LENGTH.

Which positions are ranked: of each window of WINDOW bytes the one whose next
GRAM bytes hash smallest is an anchor. A string of LENGTH bytes has its anchor
at the same place in each occurrence, so an anchor stands for all starts in a
range lo..hi. Two filters keep most anchors out of the doubling: one whose
NEAR bytes, which all its strings share, occur nowhere else repeats nothing;
and of ranges whose strings are equal byte for byte one is ranked, with their
number. Of a range that is left, positions are those a multiple of STEP from
its anchor, which again is the same in each occurrence. SPAN + STEP is LENGTH:
each string holds a ranked run, with less than STEP bytes around it.

After the doubling the starts around each ranked position are repeated if rank
and surroundings are. Where one rank has several surroundings and one of them
is unique, at the rims of repeated passages, its starts are split into parts
of SPLIT and then single starts, and compared again. Decisions compare 64-bit
hashes together with ranks, which stand for two such hashes a block.
"""

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.staging import settle

LENGTH, WINDOW, GRAM, NEAR, STEP, ROUNDS, SPLIT = 400, 256, 24, 144, 80, 2, 16
#: Bytes that a rank stands for after the last round.
SPAN = STEP << ROUNDS
#: Into so many slots keys are hashed to tell texts without them apart; 64 slots are one broadcast integer.
SLOTS = 1 << 24
#: Odd, so that powers have inverses modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of text whose positions are hashed at once.
CHUNK = 1 << 22


@lru_cache(maxsize=8)
def _powers(bits: int, base: int) -> np.ndarray:
    """``base`` to the powers from 0 to 2 ** bits - 1."""
    out, step = np.ones(1, np.uint64), np.uint64(base)
    with np.errstate(over="ignore"):
        for _ in range(bits):
            out = np.concatenate([out, out * step])
            step = step * step
    return out


@lru_cache(maxsize=2)
def _letters(base: int) -> np.ndarray:
    return np.random.default_rng(base).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray, length: int = GRAM) -> np.ndarray:
    """A polynomial hash of each string of ``length`` bytes in ``raw``."""
    n, bits = len(raw), max(10, len(raw).bit_length())
    prefix = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_letters(BASES[0])[raw] * _powers(bits, BASES[0])[:n], out=prefix[1:])
        h = (prefix[length:] - prefix[:-length]) * _powers(bits, pow(BASES[0], -1, 1 << 64))[: n + 1 - length]
        return (h ^ (h >> np.uint64(29))) * np.uint64(BASES[1])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, lo, hi) in order: the strings of LENGTH bytes that start at lo..hi have this anchor."""
    starts = len(raw) - LENGTH + 1
    if starts < 1:
        return (np.zeros(0, np.int64),) * 3
    found, low = [], np.uint64((1 << 24) - 1)
    for at in range(0, starts, CHUNK):
        n = min(CHUNK, starts - at)
        h = gram_hashes(raw[at : at + n + WINDOW + GRAM - 2])
        h = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
        span = 1
        while span < WINDOW:
            step = min(span, WINDOW - span)
            h = np.minimum(h[: len(h) - step], h[step:])
            span += step
        found.append((h & low).astype(np.int64) + at)
    of = np.concatenate(found)
    lo = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return of[lo], lo, np.r_[lo[1:] - 1, starts - 1]


def _hashed(raw: bytes, bounds: Iterator[tuple[int, int]]) -> list[bytes]:
    digest = xxhash.xxh3_64_digest
    return [digest(raw[a:b]) for a, b in bounds]


def _longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _mapped(schema: str, emit: Callable[[dict, list[list]], None]) -> Callable:
    """A function for mapInArrow: ``emit`` adds the output of one input row to the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = schema.count(",") + 1
        for batch in batches:
            columns: list[list] = [[] for _ in range(width)]
            for i in range(batch.num_rows):
                emit({n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}, columns)
                if len(columns[0]) > 1 << 16:
                    yield _batch(schema, columns)
                    columns = [[] for _ in range(width)]
            yield _batch(schema, columns)

    return run


ANCHORS = "id long, sum long, base int, lo int, hi int, near long, whole long"
SLICES = "rid long, n long, base int, lo int, hi int, raw binary"
BLOCKS = "rid long, j int, n long, first long, second long"
STARTS = "rid long, j int, n long, lo int, hi int, core long, whole long"
PARTS = "rid long, rank long, n long, lo int, hi int, core long, whole long"


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(row: dict, out: list[list]) -> None:
    raw = _encoded(row["text"])
    base, lo, hi = (x.tolist() for x in anchors(np.frombuffer(raw, np.uint8)))
    near = _longs(_hashed(raw, ((p, p + NEAR) for p in base)))
    whole = _longs(_hashed(raw, ((x, y + LENGTH) for x, y in zip(lo, hi, strict=True))))
    for column, values in zip(out, ([row["id"]] * len(base), [row["sum"]] * len(base), base, lo, hi, near.tolist(), whole.tolist()), strict=True):
        column += values


def _slice_rows(row: dict, out: list[list]) -> None:
    raw = _encoded(row["text"])
    for r in row["ranges"]:
        for column, value in zip(out, (r["rid"], r["n"], r["base"], r["lo"], r["hi"], raw[r["lo"] : r["hi"] + LENGTH]), strict=True):
            column.append(value)


def _grid(base: int, lo: int, hi: int, stride: int) -> range:
    """The last start of each part: a multiple of ``stride`` from the anchor; the first takes in lo, the last hi."""
    return range(base - (base - lo) // stride * stride, hi + stride, stride)


def _block_rows(row: dict, out: list[list]) -> None:
    """Two hashes of each block of STEP bytes that the grid's runs of SPAN bytes are made of."""
    grid, raw, digest = _grid(row["base"], row["lo"], row["hi"], STEP), row["raw"], xxhash.xxh3_128_digest
    blocks = len(grid) + SPAN // STEP - 1
    at = grid[0] - row["lo"]
    pairs = _longs([digest(raw[a : a + STEP]) for a in range(at, at + blocks * STEP, STEP)]).reshape(-1, 2)
    for column, values in zip(out, ([row["rid"]] * blocks, range(blocks), [row["n"]] * blocks, pairs[:, 0].tolist(), pairs[:, 1].tolist()), strict=True):
        column += values


def _start_rows(row: dict, out: list[list]) -> None:
    """The starts that a ranked position stands for, and the hash of their strings' bytes."""
    lo, hi, raw = row["lo"], row["hi"], row["raw"]
    parts = [(max(lo, g - STEP + 1), min(hi, g)) for g in _grid(row["base"], lo, hi, STEP)]
    whole = _longs(_hashed(raw, ((a - lo, b - lo + LENGTH) for a, b in parts)))
    k = len(parts)
    for column, values in zip(out, ([row["rid"]] * k, range(k), [row["n"]] * k, (a for a, _ in parts), (b for _, b in parts), [0] * k, whole.tolist()), strict=True):
        column += values


def _part_rows(stride: int) -> Callable:
    """Parts of ``stride`` starts, with the hash of the bytes that a part's strings share and that of all of them."""

    def emit(row: dict, out: list[list]) -> None:
        at, raw = row["at"], row["raw"]
        for p in row["parts"]:
            grid = _grid(row["base"], p["lo"], p["hi"], stride)
            bounds = [(max(p["lo"], g - stride + 1), min(p["hi"], g)) for g in grid]
            core = _longs(_hashed(raw, ((g - at, g - stride + 1 - at + LENGTH) for g in grid)))
            whole = _longs(_hashed(raw, ((a - at, b - at + LENGTH) for a, b in bounds)))
            k = len(grid)
            for column, values in zip(out, ([row["rid"]] * k, [p["rank"]] * k, [p["n"]] * k, (a for a, _ in bounds), (b for _, b in bounds), core.tolist(), whole.tolist()), strict=True):
                column += values

    return emit


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by id and text hash: rows that agree in both have equal texts, so share their spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("sum"), text.alias("text"), F.col(id_col).alias("own_id"))


def _touched(keyed: DataFrame, keys: DataFrame, touched: bool) -> DataFrame:
    """Texts that may have one of ``keys``, or those that surely do not: spares most of these a shuffle.

    At most SLOTS / 64 pairs of integers are broadcast, however many keys there are.
    """
    slot = F.pmod(F.xxhash64("id", "sum"), F.lit(SLOTS))
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id, sum), 64) as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    known = keyed.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(words), "word", "left")
    hit = F.expr("bits is not null and shiftrightunsigned(bits, cast(pmod(xxhash64(id, sum), 64) as int)) & 1 = 1")
    return known.where(hit if touched else ~hit).drop("word", "bits")


def reranked(rows: DataFrame, first: str, second: str) -> DataFrame:
    """``rows(rid, j, n)`` with the sorted number of their pair as ``rank``; those with a unique pair are out.

    The different pairs are sorted, not the rows, so that a pair that a third
    of the rows have is one row of the sort.
    """
    rows = settle(rows)
    pairs = rows.groupBy(first, second).agg(F.sum("n").alias("m")).where("m > 1").select(first, second)
    ranks = settle(pairs.orderBy(first, second).withColumn("name", F.monotonically_increasing_id()))
    return rows.join(ranks, [first, second]).select("rid", "j", "n", F.col("name").alias("rank"))


def doubled(blocks: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(rid, j, n, rank): ranks of 2 ** rounds blocks from block j on of each rid, of those that recur."""
    rows = reranked(blocks, "first", "second")
    for k in range(rounds):
        ahead = Window.partitionBy("rid").orderBy("j").rangeBetween(1 << k, 1 << k)
        rows = reranked(rows.withColumn("next", F.max("rank").over(ahead)).where("next is not null"), "rank", "next")
    return rows


def _decided(rows: DataFrame, by: list[str], span: list[str]) -> tuple[DataFrame, DataFrame]:
    """(spans that recur as a whole, one of each whole of the groups that still have to be split)."""
    wholes = settle(rows.groupBy(*by, "whole").agg(F.sum("n").alias("n"), F.min(F.struct(*span)).alias("one")))
    good = rows.join(wholes.where("n > 1").select(*by, "whole"), [*by, "whole"], "left_semi").select(*span)
    mixed = settle(wholes.groupBy(*by).agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select(*by))
    return good, wholes.join(mixed, by, "left_semi").select(*by, "n", "one.*")


def _split(slices: DataFrame, parts: DataFrame, stride: int) -> DataFrame:
    """Parts of ``stride`` starts of ``parts(rid, lo, hi, n, rank)``; of a rid there are LENGTH / SPLIT at most."""
    lists = parts.groupBy("rid").agg(F.collect_list(F.struct("rank", "n", "lo", "hi")).alias("parts"))
    both = slices.select("rid", "base", F.col("lo").alias("at"), "raw").join(lists, "rid")
    return settle(both.mapInArrow(_mapped(PARTS, _part_rows(stride)), PARTS))



def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sum, lo, hi): the strings of LENGTH bytes that start at lo..hi of the text occur elsewhere too."""
    keyed = _keyed(docs, id_col, text_col).select("id", "sum", "text").where(F.octet_length("text") >= LENGTH)
    found = settle(keyed.mapInArrow(_mapped(ANCHORS, _anchor_rows), ANCHORS))
    again = settle(found.groupBy("near").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("near"))
    shared = settle(found.withColumn("n", F.lit(1)).join(again, "near", "left_semi"))  # alone in its stage, Spark may split what one hash fills
    good, left = _decided(shared, ["near"], ["id", "sum", "base", "lo", "hi"])
    spans = good.select("id", "sum", "lo", "hi")

    ranges = settle(left.select("id", "sum", "base", "lo", "hi", "n", F.monotonically_increasing_id().alias("rid")))
    lists = settle(ranges.groupBy("id", "sum").agg(F.collect_list(F.struct("rid", "n", "base", "lo", "hi")).alias("ranges")))
    once = _touched(keyed, lists, True).groupBy("id", "sum").agg(F.first("text").alias("text"))
    slices = settle(once.join(lists, ["id", "sum"]).mapInArrow(_mapped(SLICES, _slice_rows), SLICES))
    ranks = doubled(slices.mapInArrow(_mapped(BLOCKS, _block_rows), BLOCKS))
    rows = settle(slices.mapInArrow(_mapped(STARTS, _start_rows), STARTS).join(ranks.select("rid", "j", "rank"), ["rid", "j"]).drop("j"))
    of_rid = ["rid", "lo", "hi"]
    good, left = _decided(rows, ["rank", "core"], of_rid)
    every = good
    for stride in (SPLIT, 1):
        good, left = _decided(_split(slices, left, stride), ["rank", "core"], of_rid)
        every = every.union(good)
    return spans.union(every.join(ranges.select("rid", "id", "sum"), "rid").select("id", "sum", "lo", "hi"))


def covered(n: int, spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs [a, b) of a text of n bytes that the spans' strings cover."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans or [], key=lambda s: s["lo"]):
        a, b = s["lo"], min(n, s["hi"] + LENGTH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remover(with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = _encoded(batch.column("text")[i].as_py())
                runs = covered(len(raw), batch.column("spans")[i].as_py())
                kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(raw)], strict=True))
                text = kept.decode("utf-8", "ignore") if with_text else None
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), text))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.record_batch([batch.column("own_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["own_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return remove


def without_repeats(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    Texts are UTF-8 bytes, a null one is empty; strings never cross rows and
    overlaps count. kept_text leaves out characters that a removal cuts
    through. Very long texts are taken whole, CHUNK bytes at a time. Repeated
    rows repeat each other's texts; null ids each get their row; of equal
    hashes in a window the first position is the anchor, and of equal ranges
    any one is ranked, which changes no result; an empty table gives an empty
    result; other columns are ignored.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = settle(repeated_spans(docs, id_col, text_col).distinct().groupBy("id", "sum").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    some = _touched(keyed, spans, True).join(spans, ["id", "sum"], "left").select("own_id", "text", "spans")
    schema = f"own_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    cut = some.mapInArrow(_remover(with_text), schema)
    rest = _touched(keyed, spans, False).select("own_id", F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2("text", 256), F.col("text") if with_text else F.lit(None).cast("string"))
    both = cut.union(rest).withColumnRenamed("own_id", id_col)
    return both if with_text else both.drop("kept_text")
