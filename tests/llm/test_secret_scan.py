import hashlib
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import secret_scan as S
from tests.llm.helpers import DOCS, awkward_texts, documents, rows, with_clashes

RAW = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(RAW.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2]) >= 6 if kind == "assign" else m.end() - m.start() >= (20 if kind == "access" else 24):
                found.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def texts():
    rng = random.Random(5)
    out = [*awkward_texts(), "secret=token: abcdefgh", "ToKeN='x.y_z-1'", "password=abc", "apikey : k" * 3, "ſecret=abcdefgh Token=abcdefgh toKen=abcdefgh", "AKIA" + "A" * 15, "xAKIA" + "B" * 16 + "AKIA", "é 日本 api_key=日abcdefg"]
    for i in range(300):
        value = "".join(rng.choices("0123456789abcdef", k=40))
        out.append(f"Some ordinary words here and donaudampfschifffahrt now. token = \"{value}\" more {i}")
    alphabet = ["token", "=", " ", '"', "secret", ":", "abcdef0123", "AKIA", "ABCDEFGHIJ012345", "'", "z", "passwd", "0a1b2c3d4e5f" * 2]
    return out + ["".join(rng.choices(alphabet, k=25)) for _ in range(300)]


def test_base_spans_match_brute_force_and_stay(spark):
    every = texts()
    got = rows(S.secret_spans(with_clashes(documents(spark, every))), "doc_id")
    for r, t in zip(got, every):
        want = brute(t)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w.startswith(k) for w in want) for k in S.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith(S.ADDED)] == want


def test_added_spans_have_the_format_and_ordinary_tokens_stay(spark):
    rng = random.Random(8)
    short = ["".join(rng.choices("0123456789abcdef", k=22)) for _ in range(5)]
    syllables = ["schaft", "ver", "ung", "tion", "heit", "mente", "able", "The", "inter"]
    plain = ["".join(rng.choices(syllables, k=5)) for _ in range(300)] + ["donaudampfschifffahrtsgesellschaft", "internationalization", "mail7.example.com.org", "9807915762804490", "some_long-identifier_name"] * 2
    docs = texts()[-600:-300] + [f"see {t} there" for t in short + plain]
    got = rows(S.secret_spans(documents(spark, docs)), "doc_id")
    assert all(r["spans"] == f"format:4:{4 + 22}" for r in got[300:305])
    assert all(r["spans"] == "" for r in got[305:])
    assert all(S.ADDED not in r["spans"] for r in got[:300])


def test_automaton_generalises_a_loop():
    rng = random.Random(1)
    machine = S.Automaton(["U" + "dh" * int(1 + rng.expovariate(0.25)) for _ in range(400)])
    assert len(machine.states) <= 6
    assert machine.log_likelihood("U" + "dh" * 12) > machine.log_likelihood("U" + "hd" * 12) + 20
    assert sum(s.ended for s in machine.states) == 400
    assert all(s.passed == s.ended + sum(s.taken.values()) for s in machine.states)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "plain", None, None, None), (1, "plain", None, None, None)], DOCS)
    got = rows(S.secret_spans(docs), "doc_id")
    assert [(r["n_hex"], r["spans"], r["base_sha256"]) for r in got] == [(0, "", hashlib.sha256(b"").hexdigest())] * 3
    assert S.secret_spans(docs.limit(0)).count() == 0


def test_copies_of_every_document_change_no_span(spark):
    rng = random.Random(3)
    texts = [f"see {''.join(rng.choices(letters, k=18))} there" for letters in ("ghijklmnop", "GHIJ", "gG_", "G7.") for _ in range(10)]
    texts += [f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}"' for _ in range(30)]
    docs = documents(spark, texts)
    want = rows(S.secret_spans(docs), "doc_id")
    every = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2000)))).repartition(8)
    found = S.secret_spans(every).groupBy("doc_id").agg(F.collect_set("spans").alias("spans"), F.count("*").alias("n"))
    assert [(r["spans"], r["n"]) for r in rows(found, "doc_id")] == [([w["spans"]], 2000) for w in want]


def test_every_ordinary_token_and_each_credential_once_are_learned(spark):
    shared = [f"a shared{k}-passage_with-{k}-long_token" for k in range(9)] * 400
    secret = [f"token = {chr(103 + k) * 9}{'z' * k}" for k in range(9)] * 200
    grammar = S.infer(S.learned(documents(spark, [*shared, *secret, "see abcabcabc12345678 there"])))
    assert sum(s.ended for s in grammar.ordinary.states) == 9 * 400 + 1
    assert [sum(s.ended for s in k.states) for k in grammar.kinds] == [9]


def test_planted_credentials_that_base_patterns_miss_are_found(spark):
    """Formats that some texts assign to a name; elsewhere they stand bare."""
    rng = random.Random(12)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    formats = [lambda: "gk_" + "".join(rng.choices(alnum, k=36)), lambda: "".join(rng.choices(alnum + "+/", k=43)) + "=", lambda: "-".join("".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12))]
    syllables = ["schaft", "ver", "ung", "tion", "heit", "mente", "able", "The", "inter"]
    ordinary = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 6))) for _ in range(30))
    named = [f'{ordinary()} api_key = "{f()}" {ordinary()}' for f in formats for _ in range(120)]
    bare = [(f"{ordinary()} ", f(), f" {ordinary()}") for f in formats for _ in range(60)]
    plain = [f"{ordinary()} https://www.example.org/some/long-path_to/page.html 1234567890123456 2024-11-27" for _ in range(100)]
    got = rows(S.secret_spans(documents(spark, [*named, *("".join(b) for b in bare), *plain])), "doc_id")
    caught = sum(f"{S.ADDED}:{len(a)}:{len(a) + len(b)}" in r["spans"].split(",") for r, (a, b, _) in zip(got[len(named) :], bare))
    assert caught >= 0.9 * len(bare)
    assert sum(S.ADDED in r["spans"] for r in got[len(named) + len(bare) :]) == 0
    assert all(len(r["scores"]) == len(r["spans"].split(",")) if r["spans"] else not r["scores"] for r in got)
    assert sum(max(r["scores"]) > S.MARGIN for r in got[: len(named)]) >= 0.9 * len(named)  # base credentials are scored too


def test_many_long_tokens_neither_fill_the_driver_nor_the_fold(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-./+="
    words = ["".join(rng.choices(letters, k=256)).translate(S.LETTERS) for _ in range(2000)]
    shapes = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(4)
    counts, least = S.prefix_counts(shapes, most=3000)
    began = time.process_time()
    S.Automaton.of_prefixes(counts, least)
    assert time.process_time() - began < 2
    assert sum(n >= least for n, _ in counts.values()) <= 3001 and len(counts) <= 3001 * len(S.SYMBOLS)
    plain = Counter(w[:k] for w in words for k in range(9))
    assert all(plain[p] == n for p, (n, _) in counts.items() if len(p) < 9)
    assert {p for p, n in plain.items() if n >= least and len(p) < 9} <= set(counts)


def test_counted_prefixes_are_those_of_brute_force(spark):
    rng = random.Random(6)
    words = [("".join(rng.choices("dhl", k=rng.randint(0, 40))), rng.choice([2, 4, 6])) for _ in range(120)] + [("dh" * 30, 50), ("", 2)]
    n, ended = Counter(), Counter(dict(words))
    for w, k in words:
        n.update({w[:j]: k for j in range(len(w) + 1)})
    ended = Counter()
    for w, k in words:
        ended[w] += k
    for levels, resolution in ((4, 20_000), (16, 50), (7, 90)):
        counts, least = S.prefix_counts(spark.createDataFrame(words, "word string, n long"), resolution, levels=levels)
        assert least == sum(k for _, k in words) / resolution / 2
        assert counts == {p: [k // 2, ended[p] // 2] for p, k in n.items() if not p or n[p[:-1]] >= least * 2}


def test_long_credentials_and_tokens_are_learned_from(spark):
    """Of what is longer than LONGEST the beginning counts in the trees, and ends nowhere."""
    from quern.llm.secret_scan import LONGEST, Automaton, learned, prefix_counts

    docs = spark.createDataFrame([(1, "see " + "a1" * 200), (2, "Wq_" * 200)], "doc_id long, text string")
    found = learned(docs)
    assert {(r.kind, len(r.word), r.n) for r in found.collect()} == {(2, LONGEST + 1, 1), (-1, LONGEST + 1, 1)}
    counts, _ = prefix_counts(found.where("kind = -1").select("word", "n"))
    assert counts["Ul_"] == [1, 0] and max(map(len, counts)) == LONGEST + 1 and not any(ended for _, ended in counts.values())
    assert sum(s.ended for s in Automaton(["d" * 1000]).states) == 0
