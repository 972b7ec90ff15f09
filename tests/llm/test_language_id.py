import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import language_id as L
from tests.llm.helpers import DOCS, awkward_texts, rows, with_clashes


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (5, 3))
    cell, weight = L.Gru(3, rng), rng.normal(size=(5, 3, 3))
    cell.byte, cell.state = cell.byte.astype(np.float64), cell.state.astype(np.float64)

    def loss():
        return float((cell.run(x) * weight).sum())

    _, kept = cell.run(x, keep=True)
    dbyte, dstate = cell.gradient(x, kept, weight.astype(np.float32))
    for array, grad in ((cell.byte, dbyte), (cell.state, dstate)):
        for at in [tuple(i) for i in np.argwhere(np.abs(grad) > 1e-3)[:25]]:
            old = array[at]
            array[at] = old + 1e-2
            up = loss()
            array[at] = old - 1e-2
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_pooling_equals_one_text_at_a_time():
    net = L.Network(["a", "b", "c"], hidden=4, window=8)
    texts = [b"", b"x", b"12345678", b"123456789", bytes(range(256)) * 3]
    together = net.pooled(texts, at_once=3)
    for t, p in zip(texts, together):
        total = np.zeros(3)
        for a in range(0, len(t), 8):
            part = np.frombuffer(t[a : a + 8], np.uint8).astype(np.intp)
            padded = np.full((1, 8), L.FILL)
            padded[0, : len(part)] = part
            total += net.positions(padded)[: len(part), :, 0].sum(axis=0)
        assert np.allclose(p, total / max(1, len(t)), atol=1e-5)


def corpus(n=400):
    rng = random.Random(2)
    words = {"xa": ["tro", "lum", "kera", "sti", "mopo"], "xb": ["ñandú", "güe", "çela", "éro", "ißt"], "xc": ["zqk", "wvx", "yjz", "kqw", "xxz"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(words))
        out.append((i, " ".join(rng.choices(words[lang], k=rng.randint(1, 40))), lang, None, None))
    return out


def test_held_out_accuracy_and_no_leaks(spark):
    docs = corpus()
    got = rows(L.language_id(with_clashes(spark.createDataFrame(docs, DOCS))), "doc_id")
    assert [r["held_out"] for r in got] == [zlib.crc32(str(d[0]).encode()) % 5 == 0 for d in docs]
    held = [(r["lang_pred"], d[2]) for r, d in zip(got, docs) if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    poisoned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s, n) for i, t, lang, s, n in docs]
    assert rows(L.language_id(spark.createDataFrame(poisoned, DOCS)), "doc_id") == got


def test_awkward_rows(spark):
    texts = awkward_texts()
    docs = [(None if i % 9 == 0 else i, t, None if i % 7 == 0 else "en" if i % 2 else "fr", None, None) for i, t in enumerate(texts)]
    got = L.language_id(spark.createDataFrame([*docs, docs[3]], DOCS)).collect()
    assert len(got) == len(texts) + 1
    assert sum(r.lang_pred == "und" for r in got) == sum(not any(c.isalpha() for c in t or "") for t in texts)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    empty = spark.createDataFrame(docs, DOCS).where(F.lit(False))
    assert L.language_id(empty).count() == 0
    unlabelled = L.language_id(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_rows_are_accepted_by_their_own_text(spark):
    known = [(None if i % 3 == 0 else i, t, lang, s, n) for i, t, lang, s, n in corpus()]
    unclear = [(None, "123", None, None, None), (1, "...", None, None, None), (1, None, None, None, None)]
    docs = with_clashes(spark.createDataFrame([*known, *unclear], DOCS))
    got = L.accepted(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == sorted((i or -1, t) for i, t, *_ in known)


def test_probabilities_match_a_network_run_unit_by_unit():
    """The recurrences written out for one byte and one unit at a time."""
    import math

    net = L.Network(["a", "b"], hidden=3, window=8)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def run(cell, raw):
        k, h, out = cell.hidden, [0.0] * cell.hidden, []
        for byte in raw:
            dot = lambda row: sum(float(cell.state[row, j]) * h[j] for j in range(k))
            z = [sigmoid(cell.byte[i, byte] + dot(i)) for i in range(k)]
            r = [sigmoid(cell.byte[k + i, byte] + dot(k + i)) for i in range(k)]
            n = [math.tanh(cell.byte[2 * k + i, byte] + r[i] * dot(2 * k + i)) for i in range(k)]
            h = [(1 - z[i]) * n[i] + z[i] * h[i] for i in range(k)]
            out.append(h)
        return out

    for text in (b"x", b"hello wo", "déjà vu, 日本".encode()):
        total = [0.0, 0.0]
        for a in range(0, len(text), 8):
            part = [*text[a : a + 8]]
            padded = part + [L.FILL] * (8 - len(part))
            ahead, back = run(net.ahead, padded), run(net.back, padded[::-1])[::-1]
            for f, g in list(zip(ahead, back))[: len(part)]:
                s = [math.exp(sum(float(w) * v for w, v in zip(net.out[c], f + g)) + float(net.bias[c, 0])) for c in range(2)]
                total = [t + x / sum(s) for t, x in zip(total, s)]
        assert np.allclose(net.pooled([text])[0], [t / len(text) for t in total], atol=1e-5)


def test_no_sample_is_no_network(spark):
    same = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'a b c' as text", "'xa' as lang", "'s' as source", "5L as n_chars")
    network = L.train(same, F.lit(True), per_label=3)
    names = {r.lang_pred for r in L.identify(same, network).collect()}
    assert names == ({L.UNDETERMINED} if network is None else {"xa"})
    assert L.train(same.limit(0), F.lit(True)) is None
