import hashlib
import math
import re
from collections import defaultdict

from quern.llm import source_mixing as M
from tests.llm.helpers import DOCS, awkward_texts, rows, with_clashes


def pour(budget, nodes):
    """Water-filling by repeated rounds: [(name, weight, capacity)] -> {name: whole tokens}."""
    given, open_nodes, left = {}, dict((n, (w, c)) for n, w, c in nodes), budget
    while open_nodes:
        line = left / sum(w for w, _ in open_nodes.values())
        over = [n for n, (w, c) in open_nodes.items() if c / w < line]
        if not over:
            return given | {n: min(c, math.floor(line * w)) for n, (w, c) in open_nodes.items()}
        n = min(over, key=lambda n: (open_nodes[n][1] / open_nodes[n][0], n))
        given[n] = open_nodes[n][1]
        left -= open_nodes.pop(n)[1]
    return given


def expected(docs, share, max_epochs, seed=11):
    def domain(source):
        m = re.search("([0-9]{1,9})$", source or "")
        return "unknown" if not m else "web" if int(m[1]) < 10 else "books" if int(m[1]) < 15 else "code"

    leaves = defaultdict(list)
    for i, text, lang, source, _ in docs:
        leaves[domain(source), lang or "unknown", source or "unknown"].append((i, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}

    def down(path, budget):
        if len(path) == 3:
            return {path: budget}
        level = M.LEVELS[len(path)]
        names = sorted({k[len(path)] for k in supply if k[: len(path)] == path})
        nodes = [(n, M.WEIGHTS[level].get(n, M.OTHER), max_epochs * sum(s for k, s in supply.items() if k[: len(path) + 1] == (*path, n))) for n in names]
        return {k: v for n, b in pour(budget, nodes).items() for k, v in down((*path, n), b).items()}

    out = []
    for leaf, budget in down((), math.floor(sum(supply.values()) * share)).items():
        full = budget // supply[leaf] if supply[leaf] else 0
        rest = budget - full * supply[leaf]
        order = sorted((hashlib.md5(f"{seed}:{full}:{'' if i is None else i}".encode()).hexdigest(), i, n) for i, n in leaves[leaf])
        for h, i, n in order:
            copies = full + (sum(m for g, _, m in order if g <= h) <= rest)
            out += [(i, *leaf, n, e) for e in range(copies)]
    return sorted(out, key=str)


def table(n=150):
    texts = awkward_texts()
    langs, sources = ["en", "de", "fr", None, "xx"], ["src0", "src0", "src0", "src3", "src11", "src12", "src19", None, "blog"]
    return [(i, texts[i % 44], langs[i * 7 % 5], sources[i * 5 % 9], None) for i in range(n)]


def test_rows_match_brute_force(spark):
    docs = table()
    for share, epochs in ((0.5, 2), (0.9, 1), (3.0, 4), (5.0, 2), (0.001, 1)):
        got = M.mixed(with_clashes(spark.createDataFrame(docs, DOCS)), share, epochs).collect()
        assert sorted((tuple(r) for r in got), key=str) == expected(docs, share, epochs)


def test_a_shortage_goes_to_siblings_before_ancestors(spark):
    supply = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("code", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    given = {r["source"]: r["allowance"] for r in rows(M.allowances(supply, 0.1, 1, {}), "source")}
    # 301 tokens: 150 a domain, 75 a language of web; a is full at 10, which only b makes up for.
    assert given == {"a": 10, "b": 65, "c": 75, "d": 150}


def test_only_native_operators(spark):
    plan = M.mixed(spark.createDataFrame(table(), DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeats_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", "en", "src1", None), (7, None, None, None, None), (7, None, None, None, None), (8, "c d", "en", "src1", None), (8, "c d", "en", "src1", None)], DOCS)
    assert {r.doc_id for r in M.mixed(docs, 1.0, 1).collect()} == {None, 7, 8}
    assert M.mixed(docs.limit(0)).count() == 0
    assert M.mix(with_clashes(docs), 1.0).count() == 5
