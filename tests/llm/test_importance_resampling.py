import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import importance_resampling as R
from tests.llm.helpers import DOCS, awkward_texts, documents, rows, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, share=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus, wanted = (Counter(bucket(f) for t in texts for f in features(t, longest)[1]) for texts in ([t for _, t in docs], target))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in docs:
        words, found = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append({"doc_id": i, "n_features": len(found), "weight": weight, "score": weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), "rank": None, "words": len(words)})
    able = sorted((r for r in out if r["words"] >= 20), key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    for k, r in enumerate(able[: share * len(able) // 100], 1):
        r["rank"] = k
    return sorted([{k: v for k, v in r.items() if k != "words"} for r in out], key=lambda r: tuple((r[k] is None, r[k]) for k in ("doc_id", "rank", "score")))


def corpus():
    rng = random.Random(2)
    words = ["Ärger", "alpha", "BETA", "x1", "don't", "a-b", "日本語", "é", "q\x85z", "İx", "the", "of"]
    return [*awkward_texts(), *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(300)), *(["tie " * 25] * 3)]


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_scores_and_draws_match_brute_force(spark):
    texts, wanted = corpus(), ["alpha alpha the of Ärger", None, "", "日本語 don't q\x85z"]
    frame = with_clashes(documents(spark, texts))
    for name in ("row", "rank", "words", "n", "bucket"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = R.resampled(frame, target(spark, wanted), share=30)
    assert rows(got, "doc_id", "rank", "score") == brute(list(enumerate(texts)), wanted, share=30)


def test_longer_runs_and_tries_that_are_emptied_change_nothing(spark):
    texts, wanted = corpus()[40:], ["alpha the of", "BETA x1 x1"]
    got = R.resampled(documents(spark, texts), target(spark, wanted), longest=3, buckets=97, nodes=50)
    assert rows(got, "doc_id", "rank", "score") == brute(list(enumerate(texts)), wanted, longest=3, buckets=97)


def test_null_and_repeated_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(25))
    docs = [(None, text), (None, None), (5, text), (5, text), (6, "")]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    assert rows(R.resampled(frame, target(spark, []), share=70), "doc_id", "rank", "score") == brute(docs, [], share=70)
    assert R.resampled(frame.limit(0), target(spark, ["a"])).count() == 0


def test_a_node_s_crc_is_that_of_its_joined_words():
    trie = R.Trie()
    for run in ((b"a",), (b"a", "é".encode(), b"c"), ("é".encode(), b"c")):
        assert trie.crc[trie.node(run)] == zlib.crc32(b" ".join(run))
