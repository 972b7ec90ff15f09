import hashlib
import random
from collections import Counter

from quern.llm import suffix_dedup as S
from tests.llm.helpers import DOCS, awkward_texts, documents, rows, with_clashes


def brute(texts, n=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(r[i : i + n]).digest() for r in raws for i in range(len(r) - n + 1))
    out = []
    for k, r in enumerate(raws):
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[hashlib.md5(r[i : i + n]).digest()] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append({"doc_id": k, "n_bytes": len(r), "n_removed": sum(gone), "n_spans": sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


def texts(seed):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choices("abcdefgh é\n", k=n))

    passages = [prose(n) for n in (380, 398, 400, 401, 450, 700, 1500)]
    out = [t for t in awkward_texts() if len(t or "") < 5000]
    for _ in range(60):
        parts = [prose(rng.randint(0, 300))]
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:  # an edit, or only a part of it
                i = rng.randrange(len(p))
                p = p[:i] + "#" + p[i + 1 :] if rng.random() < 0.5 else p[i // 3 :]
            parts += [p, prose(rng.randint(0, 300))]
        out.append("".join(parts))
    out += [out[-1], out[-2], "ab" * 600, "ab" * 450 + "!", "x" * 1000, "x" * 399, "y" * 400, "y" * 400, "q" * 401, passages[4] * 3]
    return out


def test_removals_match_brute_force(spark):
    for seed in (1, 2):
        every = texts(seed)
        assert rows(S.without_repeats(with_clashes(documents(spark, every))), "doc_id") == brute(every)


def test_anchors_cover_each_start_once_and_depend_on_content_only():
    rng = random.Random(3)
    import numpy as np

    shared = bytes(rng.choices(range(97, 105), k=900))
    seen = []
    for pad in (b"", b"zz" * 77, b"q" * 500):
        raw = pad + shared + pad
        base, lo, hi = S.anchors(np.frombuffer(raw, np.uint8))
        assert lo[0] == 0 and hi[-1] == len(raw) - S.LENGTH and (lo[1:] == hi[:-1] + 1).all()
        of = np.repeat(base, hi - lo + 1)
        starts = np.arange(len(pad), len(pad) + len(shared) - S.LENGTH + 1)
        seen.append((of[starts] - len(pad)).tolist())
    assert seen[0] == seen[1] == seen[2]


def test_a_chunk_boundary_changes_no_anchor(monkeypatch):
    import numpy as np

    raw = np.frombuffer(bytes(random.Random(4).choices(range(97, 101), k=9000)), np.uint8)
    whole = S.anchors(raw)
    monkeypatch.setattr(S, "CHUNK", 1000)
    parts = S.anchors(raw)
    assert [np.repeat(b, h - a + 1).tolist() for b, a, h in [whole]] == [np.repeat(b, h - a + 1).tolist() for b, a, h in [parts]]


def test_passages_in_a_text_longer_than_a_chunk(spark):
    rng = random.Random(5)
    long = rng.randbytes(S.CHUNK // 2 + 3000).hex()
    passage = long[S.CHUNK - 700 : S.CHUNK + 800]
    got = {r.doc_id: r for r in S.without_repeats(documents(spark, [long, "ä" + passage + "z", "q" * 100])).collect()}
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans) for k in range(3)] == [(len(long), 1500, 1), (1503, 1500, 1), (100, 0, 0)]
    assert got[0].kept_sha256 == hashlib.sha256((long[: S.CHUNK - 700] + long[S.CHUNK + 800 :]).encode()).hexdigest()


def test_ranks_double_until_unique_and_keep_the_order_of_pairs(spark):
    """Blocks of one letter each: ranks of four must group and order like the strings of four letters."""
    words = {0: "abcabcabca", 1: "bcabx", 2: "zzzz", 3: "q"}
    cells = [(rid, j, 1, ord(c), 0) for rid, w in words.items() for j, c in enumerate(w)]
    got = S.doubled(spark.createDataFrame(cells, S.BLOCKS)).collect()
    of = {(r.rid, r.j): (words[r.rid][r.j : r.j + 4], r.rank) for r in got}
    every = [(rid, j, w[j : j + 4]) for rid, w in words.items() for j in range(len(w) - 3)]
    counts = Counter(x for _, _, x in every)
    assert {(rid, j) for rid, j, x in every if counts[x] > 1} == set(of)
    assert [x for x, _ in sorted(of.values(), key=lambda p: p[1])] == sorted(x for x, _ in of.values())


def test_nulls_repeats_and_empty_tables(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=600))
    docs = spark.createDataFrame([(None, t, None, None, None), (None, None, None, None, None), (5, t + "q" * 50, None, None, None), (5, t + "q" * 50, None, None, None)], DOCS)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in S.without_repeats(docs).collect()}
    assert got == {(None, 600, 600, 1), (None, 0, 0, 0), (5, 650, 650, 1)}
    assert {r.kept_text for r in S.without_repeats(docs, with_text=True).collect()} == {""}
    assert S.without_repeats(docs.limit(0)).count() == 0
