import hashlib
import random
import zlib

import pytest

from quern.llm import merkle_manifest as M
from tests.llm.helpers import DOCS, awkward_texts, rows, with_clashes


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))


def climb(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 3 * 3
        out.append((level[a:i], level[i + 1 : a + 3]))
        i //= 3
    return out


def brute(docs):
    order = sorted(docs, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    trees = {}
    for r in order:
        trees.setdefault(r[3], []).append(r)
    levels = {s: climb([leaf(r) for r in rs]) for s, rs in trees.items()}
    top = climb([levels[s][-1][0] for s in trees])
    out = []
    for k, (s, rs) in enumerate(trees.items()):
        for i, r in enumerate(rs):
            path = steps(levels[s], i) + steps(top, k)
            bad = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((r[0], r[1].replace("\n", ""), *r[2:]) if bad else r)
            for left, right in path:
                h = digest("".join([*left, h, *right]))
            proof = digest("".join("".join([*left, *right]) for left, right in path))
            out.append({"doc_id": r[0], "leaf": leaf(r), "subroot": levels[s][-1][0], "root": top[-1][0], "proof_sha256": proof, "folded_root": h, "verified": h == top[-1][0]})
    return sorted(out, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["leaf"], x["proof_sha256"]))


def expected(spark, docs, **params):
    frame = with_clashes(spark.createDataFrame(docs, DOCS))
    for name in ("tree", "n", "level", "idx", "hash", "path", "root", "block", "_range"):
        frame = frame.withColumn(name, frame.text)
    assert rows(M.manifest(frame, **params), "doc_id", "leaf", "proof_sha256") == brute(docs)


def test_manifest_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [*awkward_texts(), *(f"line {i}\nnext\n" for i in range(300))]
    docs = [(i, t, rng.choice(["en", None, "é"]), rng.choice(["src0"] * 6 + ["src1", "Z", "é", "", None, f"lone{i % 4}"]), rng.choice([None, 7, i])) for i, t in enumerate(texts)]
    expected(spark, docs)


@pytest.mark.parametrize("sizes", [[1], [28], [1, 2, 3, 4, 9, 10, 27, 82]])
def test_sizes_around_powers_of_the_fan_out(spark, sizes):
    expected(spark, [(i * 7 % 101, f"t\n{i}", None, f"source of {n}", i) for n in sizes for i in range(n)])


def test_many_partitions_blocks_and_merges(spark, monkeypatch):
    monkeypatch.setattr(M, "TIER", 2)
    monkeypatch.setattr(M, "MERGED", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        expected(spark, [(i, f"{i}\n", "en", "hot" if i % 3 else f"s{i % 33:02}", i) for i in range(400)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_and_repeated_ids_and_empty_tables(spark):
    docs = [(None, "a\n", None, None, None), (None, None, None, None, None), (5, "b\n", "en", None, 2), (5, "c\n", "en", None, 2), (5, "c\n", "en", None, 2), (6, "", None, "s", 0)]
    expected(spark, docs)
    assert M.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_a_stack_only_leaves_what_reaches_over_its_edges():
    leaves = [f"{i:064}" for i in range(40)]
    levels = climb(leaves)
    stack = M.MountainRange(40)
    for i in range(5, 31):
        stack.push(0, i, leaves[i])
    found = stack.taken(closing=True)
    assert all(h == levels[level][i] for level, i, h, _ in found)
    peaks = sorted((i * 3**level, level) for level, i, _, kind in found if kind == "peak")
    assert peaks == [(5, 0), (6, 1), (9, 2), (18, 2), (27, 1), (30, 0)]
    whole = M.MountainRange(40)
    for i in range(40):
        whole.push(0, i, leaves[i])
    assert [n for n in whole.taken() if n[3] == "root"] == [(4, 0, levels[4][0], "root")]
