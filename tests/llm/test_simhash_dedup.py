import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quern.llm import simhash_dedup as S
from tests.llm.helpers import DOCS, awkward_texts, documents, rows, with_clashes


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius=4):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_groups_match_brute_force(spark):
    texts = awkward_texts()
    base = " ".join(f"word{i}" for i in range(600)).split()
    rng = random.Random(3)
    for _ in range(12):
        copy = list(base)
        copy[rng.randrange(600)] = "edit"
        texts.append(" ".join(copy))
    prints = [brute_print(t) for t in texts]
    got = rows(S.simhash_groups(with_clashes(documents(spark, texts))), "doc_id")
    assert [r["fingerprint"] for r in got] == [f"{p:016x}" for p in prints]
    assert [r["component_id"] for r in got] == brute_components(prints)


def planted(n, seed=1):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 2)]
    while len(out) < n:
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


def test_links_connect_the_same_prints_as_all_pairs(spark):
    prints = planted(500)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = brute_components(prints)
    for block in (4096, 8):
        links = S.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), block=block).collect()
        at = {s: i for i, s in enumerate(signed)}
        for r in links:
            assert want[at[r.u]] == want[at[r.v]]
        label = S._unite(np.array([at[r.u] for r in links]), np.array([at[r.v] for r in links]), len(prints))
        assert label.tolist() == want


def test_large_cells_go_through_the_row_by_row_path():
    prints = np.array(planted(300, seed=5), np.uint64)
    key = np.zeros(len(prints), np.int64)
    unary = np.array([sum((3 if b == 3 else 1 if b else 0) << (2 * s) for s in range(32) for b in [int(p) >> (2 * s) & 3]) for p in prints], np.uint64)
    found = {(int(a), int(b)) for u, v in S._pairs(key, unary, prints) for a, b in zip(u, v)}
    assert found == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 4}


def test_embedding_bounds_hamming_distance_from_below(spark):
    prints = planted(200, seed=9)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r.fp: r.t & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in signed], "fp long").select("fp", F.expr(S.embedded("fp")).alias("t")).collect()}
    for a, sa in zip(prints, signed):
        for b, sb in zip(prints[:20], signed[:20]):
            manhattan = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
            assert (got[sa] ^ got[sb]).bit_count() == manhattan <= (a ^ b).bit_count()


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e", None, None, None), (5, "a b c d e", None, None, None), (5, "a b c d e", None, None, None), (9, None, None, None, None)], DOCS)
    got = {(r["doc_id"], r["component_id"]) for r in rows(S.simhash_groups(docs), "doc_id")}
    assert got == {(None, 5), (5, 5), (9, 9)}
    assert S.simhash_groups(docs.limit(0)).count() == 0
    assert S.simhash_dedup(with_clashes(docs)).count() == 2
