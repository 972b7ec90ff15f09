import random
import zlib

import corpus_pipeline as P
from quern.llm import exact_dedup, language_id, simhash_dedup
from quern.llm.queries import tokenizer_path
from tests.llm.helpers import DOCS, with_clashes
from tests.llm.test_source_mixing import expected as mixed_rows


def documents():
    """Two languages, copies, near copies, rows that repeat ids or lack them, and what has no language."""
    rng = random.Random(6)
    words = {"xa": ["tro", "lum", "kera", "sti", "mopo", "vel", "quad"], "xb": ["ñandú", "güe", "çela", "éro", "ißt", "öde", "ámò"]}
    out = []
    for i in range(160):
        lang = rng.choice(sorted(words))
        out.append((i, " ".join(rng.choices(words[lang], k=rng.randint(30, 90))), lang, f"src{i % 4}", None))
    base = out[3][1]
    out += [(200, out[5][1], "xa", "src0", None), (201, out[5][1].upper().replace("É", "É"), "xa", "src1", None), (None, out[6][1], None, None, None)]
    out += [(None, base + " zum", "xb", "src2", None), (3, base, "xa", "src3", None), (7, "zzz " + out[9][1], "xa", "src1", None), (202, None, "xa", "src1", None), (203, "", None, "src1", None), (204, "123 45", "xb", None, None)]
    return out


def brute_exact(rows):
    best = {}
    for k, r in enumerate(rows):
        key = (r[1] or "").translate({c: c + 32 for c in range(65, 91)})
        rank = (r[0] is not None, -1 if r[0] is None else r[0])
        if key not in best or rank > best[key][0]:
            best[key] = (rank, k)
    return {(rank, text_of(rows[k])) for rank, k in best.values()}


def text_of(row):
    return (row[1] or "").translate({c: c + 32 for c in range(65, 91)})


def ids(rows):
    return sorted(((r[0] is not None, -1 if r[0] is None else r[0]), text_of(r)) for r in rows)


def plain(df):
    return [tuple(r)[:5] for r in df.collect()]


def test_stages_match_brute_force_one_after_the_other(spark, tmp_path):
    every = documents()
    docs = with_clashes(spark.createDataFrame(every, DOCS))
    columns = docs.columns

    kept = plain(P.STAGES[0][1](spark, docs, ""))
    network = language_id.train(docs, language_id.hash_part(docs["doc_id"], 5) != 0)
    letters = [bool(r[1]) and any(c.isalpha() for c in r[1]) for r in every]
    told = network.pooled([(r[1] or "").encode() for r in every]).max(axis=1)
    assert ids(kept) == ids([r for r, yes, p in zip(every, letters, told) if yes and p >= 0.35])
    assert ids(kept) == ids([r for r in every if r[0] not in (202, 203, 204)])

    docs = spark.createDataFrame(kept, DOCS)
    got = P.STAGES[1][1](spark, with_clashes(docs), "")
    assert got.columns == columns
    found = plain(got)
    assert set(ids(found)) == brute_exact(kept) and len(found) == len({text_of(r) for r in kept})

    docs, before = spark.createDataFrame(found, DOCS), found
    found = plain(P.STAGES[2][1](spark, with_clashes(docs), ""))
    prints = [simhash_dedup.fingerprint(simhash_dedup.shingle_hashes(r[1])) for r in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    best = {}
    for g, r in zip(group, before):
        rank = (r[0] is None, -1 if r[0] is None else r[0])
        best[g] = min(best.get(g, rank), rank)
    assert len(found) == len(best) < len(before)
    assert sorted((r[0] is None, -1 if r[0] is None else r[0]) for r in found) == sorted(best.values())

    docs, before = spark.createDataFrame(found, DOCS), found
    found = plain(P.STAGES[3][1](spark, with_clashes(docs), ""))
    want = {(r[0], r[2], r[3]) for r in ((x[0], *x[1:]) for x in mixed_rows(before, 0.9, 1))}
    assert {r[0] for r in found} == {w[0] for w in want} and 0 < len(found) < len(before)

    docs = spark.createDataFrame(found, DOCS)
    pieces = P.STAGES[4][1](spark, with_clashes(docs), "").collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    tokens = [library.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in found]
    assert sorted(p["ids_crc32"] for p in pieces) == sorted(zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids[a : a + 4096])) for ids in tokens for a in range(0, len(ids), 4096))
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_run_applies_the_stages_in_order_and_takes_empty_tables(spark, tmp_path):
    assert [name for name, _ in P.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing sources", "best-fit packing"]
    docs = spark.createDataFrame(documents(), DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(plain(stage(spark, docs, str(tmp_path))), DOCS)
    want = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and got
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def test_a_null_or_repeated_id_does_not_carry_other_rows_along(spark):
    rows = [(None, "a", None, None, None), (None, "b", None, None, None), (3, "b", None, None, None), (7, "x", None, None, None), (7, "x", None, None, None), (9, "p", None, None, None), (9, "q", None, None, None), (10, "q", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.exact_dedup(docs).collect()) == [("10", "q"), ("3", "b"), ("7", "x"), ("9", "p"), ("None", "a")]
    words = "one two three four five six seven eight nine ten eleven twelve"
    near = spark.createDataFrame([(1, words, None, None, None), (4, words, None, None, None), (4, "alpha beta gamma delta epsilon zeta", None, None, None), (None, words, None, None, None), (None, None, None, None, None), (None, "", None, None, None)], DOCS)
    assert sorted((str(r.doc_id), len(r.text or "")) for r in simhash_dedup.simhash_dedup(near).collect()) == [("1", len(words)), ("4", 35), ("None", 0)]
