import random
import zlib
from collections import Counter

import numpy as np

from quern.llm import quality_classifier as Q
from quern.llm import quality_rules as R
from tests.llm.helpers import DOCS, awkward_texts, documents, rows, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=1, every=6):
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "Velit", "esse", "cillum", "fugiat", "nulla", "sint"]
    docs, labels = [], []
    for i in range(n):
        bad = i % every == 0
        picked = rng.choices(words, k=rng.randint(55, 90))
        docs.append((i, " ".join(w.upper() + "!!" if bad and i % 8 else w + "###" if bad else w for w in picked), None, None, None))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_scores_hold_out_their_part(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = rows(Q.quality(with_clashes(d), with_clashes(lab)), "doc_id")
    assert [r["held_out"] for r in got] == [zlib.crc32(str(i[0]).encode()) % 3 == 1 for i in docs]
    held = [(r["predicted"], y[1]) for r, y in zip(got, labels) if r["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    poisoned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, t) for i, y, t in labels]
    assert rows(Q.quality(d, spark.createDataFrame(poisoned, LABELS)), "doc_id") == got


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    data = [np.unique(rng.integers(0, 30, 8)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    scale, cost = np.ones(Q.SLOTS), np.full(40, 0.7)
    w, bias, alpha = Q.dual_coordinate_descent(data, y, scale, cost, epochs=3000, tolerance=1e-9)
    x = np.zeros((40, 31))
    for i, r in enumerate(data):
        x[i, r] = 1 / len(r)
        x[i, 30] = 1
    full = np.r_[w[:30], bias]
    assert np.allclose(full, (alpha * y) @ x)
    primal = full @ full / 2 + (cost * np.maximum(0, 1 - y * (x @ full))).sum()
    dual = alpha.sum() - full @ full / 2
    assert abs(primal - dual) < 1e-4


def test_log_count_ratio():
    r = Q.log_count_ratio([np.array([1, 2]), np.array([2, 3])], np.array([1.0, -1.0]))
    assert r[1] > 0 > r[3] and abs(r[2]) < 1e-9


def brute_statistics(text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_statistics_match_brute_force():
    rng = random.Random(3)
    for t in [*awkward_texts(), "a b c a b c a b c", "x\nx\n \nx y\n\nx", *("".join(rng.choices("ab #|é\n\t ", k=60)) for _ in range(200))]:
        if len(t or "") < 10_000:
            assert R.statistics(t)[:5] == brute_statistics(t)


def test_forest_isolates_outliers_and_keeps_the_good(spark):
    docs, labels = corpus(every=20)
    got = rows(R.rules(with_clashes(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(labels, LABELS)), "doc_id")
    assert [[r[c] for c in R.COUNTS] for r in got] == [brute_statistics(d[1]) for d in docs]
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    passed = [(r["kept"], y[1]) for r, y in zip(got, labels) if not r["base_failed"]]
    assert np.mean([k for k, y in passed if y]) >= 0.985
    assert np.mean([k for k, y in passed if not y]) < 0.1


def test_path_lengths_average_as_expected():
    x = np.random.default_rng(1).random((256, 4))
    forest = R.isolation_forest(x, trees=100)
    assert abs(np.median(forest.scores(x)) - 0.45) < 0.08
    assert forest.scores(np.full((1, 4), 30.0))[0] > np.quantile(forest.scores(x), 0.99)


def test_awkward_rows(spark):
    docs = documents(spark, awkward_texts())
    none = spark.createDataFrame([(None, 1, 0), (3, None, 1), (4, 0, 0), (4, 1, 0)], LABELS)
    assert R.rules(docs, none).count() == Q.quality(docs, none).count() == docs.count()
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, DOCS)
    assert [(r.n_words, r.base_failed, r.kept) for r in R.rules(nulls, none).collect()] == [(0, True, False)] * 2
    assert len({r.score for r in Q.quality(nulls, none).collect()}) == 1
    assert R.rules(docs.limit(0), none).count() == Q.quality(docs.limit(0), none).count() == 0


def brute_slots(text):
    """The distinct slots of a text, one n-gram at a time."""
    raw, words, out = (text or "").encode(), (text or "").split(), set()
    for n, offset in ((1, None), (2, 1 << 24), (3, 1 << 25)):
        for i in range(len(raw) - n + 1):
            value = int.from_bytes(raw[i : i + n], "big")
            out.add(value if n == 1 else ((value + offset) * Q.MULTIPLIER & 0xFFFFFFFF) >> 14)
    for i in range(len(words) - 2 if raw else 0):
        a, b, c = words[i : i + 3]
        out.add((c == b) * 2 + (b == a) + (c == a) * 4 + 256)
    for i in range(len(words) - 4 if raw else 0):
        w = words[i : i + 5]
        out.add((w[4] == w[3]) * 8 + (w[3] == w[2]) * 4 + (w[2] == w[1]) * 2 + (w[1] == w[0]) + 264)
    return sorted(out)


def test_scores_match_brute_force(spark):
    """The model fitted from plain Python n-gram sets of the labelled rows scores every row as the query does."""
    docs, labels = corpus(n=240)
    docs += [(1000 + i, t, None, None, None) for i, t in enumerate(awkward_texts()) if len(t or "") < 5000]
    got = {r["doc_id"]: r["score"] for r in rows(Q.quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)), "doc_id")}
    learn = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = {d[0]: d[1] for d in docs}
    model = Q.fit([np.array(brute_slots(texts[i]), np.int32) for i, _ in learn], np.array([y for _, y in learn]))
    for i, text in texts.items():
        slots = brute_slots(text)
        margin = sum(model.weight[s] for s in slots) / len(slots) + model.bias if slots else model.bias
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))) < 1e-9


def test_packed_slots_come_back():
    for n in (0, 5, 8191, 8192, 8193, 200_000):
        slots = np.sort(np.random.default_rng(n).choice(Q.SLOTS, n, replace=False)).astype(np.int32)
        assert len(Q.packed(slots)) <= Q.SLOTS // 8 and (Q.unpacked(Q.packed(slots)) == slots).all()


def test_an_id_with_many_texts_teaches_once(spark):
    docs, labels = corpus(n=200)
    again = docs + [(docs[0][0], f"{docs[0][1]} {k}", None, None, None) for k in range(50)]
    got = rows(Q.quality(spark.createDataFrame(again, DOCS), spark.createDataFrame(labels, LABELS)), "doc_id")
    assert len(got) == 250


def test_verdicts_match_brute_force(spark):
    """Path lengths walked node by node, and the threshold by sorting the labelled scores."""
    docs, labels = corpus(n=300, every=20)
    frame = spark.createDataFrame(docs, DOCS)
    got = rows(R.rules(frame, spark.createDataFrame(labels, LABELS)), "doc_id")
    counts = np.array([R.statistics(d[1]) for d in docs])
    failed = np.array([c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts.tolist()])
    passed = spark.createDataFrame([(d[0], *map(int, c)) for d, c, f in zip(docs, counts, failed) if not f], "id long, " + ", ".join(f"{c} long" for c in [*R.COUNTS, *R.MORE]))
    pool, times = R.drawn(passed)
    assert len(pool) == (~failed).sum() and set(times) == {1}

    def path(tree, x):
        feature, cut, left, right, length = tree
        node = 0
        while feature[node] >= 0:
            node = left[node] if x[feature[node]] < cut[node] else right[node]
        return length[node]

    want = ~failed
    for name in R.FORESTS:
        forest = R.isolation_forest(R.features(pool, name), times)
        scores = [2 ** -(np.mean([path(t, x) for t in forest.trees]) / forest.norm) for x in R.features(counts, name)]
        good = sorted(int(np.ceil(s * R.STEPS)) for s, f, y in zip(scores, failed, labels) if not f and y[1] == 1)
        most = good[int(np.ceil(R.KEEP * len(good))) - 1] / R.STEPS
        want &= np.array(scores) <= most
    assert [r["kept"] for r in got] == want.tolist()


def test_draws_of_equal_rows_travel_as_one(spark):
    same = spark.range(20_000).selectExpr("cast(null as long) as id", *(f"60L as {c}" for c in [*R.COUNTS, *R.MORE]))
    pool, times = R.drawn(same, 50_000)
    assert len(pool) == 1 and times.tolist() == [20_000]
    assert len(R.isolation_forest(R.features(pool), times, trees=3).trees) == 3
