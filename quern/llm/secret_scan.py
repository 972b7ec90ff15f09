"""Secret scans by grammar inference.

Credentials that the base patterns label are the strings of a language. For
each kind a prefix tree of a bounded sample of different credentials, over
classes of characters, is folded into a probabilistic automaton by merging
states whose outgoing and ending shares no Hoeffding bound tells apart. The one
of ordinary tokens is folded from the prefix tree of all of them, which Spark
counts some levels at a time, below states only; states are the most frequent
prefixes, STATES at most, and none rarer than one token in RESOLUTION.
Every candidate of every text, credentials of base matches and all other
tokens of SHORTEST characters or more, is then scored by how much likelier a
kind's automaton makes it than the automaton of ordinary tokens, and those of
other tokens that stand out are added as spans.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import settle

KINDS = ["assign", "access", "hex"]
#: The kind of spans that the automata add.
ADDED = "format"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters that a token beyond the base matches needs to be a candidate. With 8, clean words of few letters or in capitals stood out.
SHORTEST = 16
#: A prefix of ordinary tokens is a state of their tree if this share of the tokens, one in so many, begins with it.
RESOLUTION = 20_000
#: States of that tree at most: where more prefixes are left, those above the first frequency that fits. Levels that are counted at once.
STATES, LEVELS = 30_000, 16
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
#: Different credentials of a kind that the inference takes at most. Of tokens longer than LONGEST the trees hold the beginning, which ends nowhere; they are scored whole.
PER_KIND, LONGEST = 500, 256
#: Shapes whose score a worker remembers.
REMEMBERED = 200_000
#: Nats by which a kind has to be likelier than ordinary text.
MARGIN = 8.0
CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U"), **dict.fromkeys("+/", "+"), **dict.fromkeys("_-", "_")}
LETTERS = str.maketrans(CLASSES)
SYMBOLS = "dhlHU+_.="


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of each base match, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ASSIGN_WORD.search(text) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def credential(text: str, span: tuple[int, int, int]) -> str:
    """The secret itself of a base match."""
    start, kind, end = span
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it touches a base span) of tokens that lie in no base span."""
    at = 0
    reach: list[tuple[int, int]] = []  # spans in order, those that overlap as one
    for start, _, end in spans:
        if reach and start < reach[-1][1]:
            reach[-1] = (reach[-1][0], max(end, reach[-1][1]))
        else:
            reach.append((start, end))
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(reach) and reach[at][1] <= a:
            at += 1
        touched = at < len(reach) and reach[at][0] < b
        if not touched or a < reach[at][0] or reach[at][1] < b:
            yield a, b, touched


@dataclass(slots=True)
class State:
    passed: int = 0
    ended: int = 0
    after: dict[str, int] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton over SYMBOLS; state 0 is the start."""

    def __init__(self, words: Iterable[str], alpha: float = 0.05) -> None:
        counts: dict[str, list[int]] = {"": [0, 0]}
        for word in words:
            for k in range(min(len(word), LONGEST + 1) + 1):
                counts.setdefault(word[:k], [0, 0])[0] += 1
            if len(word) <= LONGEST:
                counts[word][1] += 1
        self._fold(counts, 1, alpha)

    @classmethod
    def of_prefixes(cls, counts: dict[str, list[int]], least: float, alpha: float = 0.05) -> "Automaton":
        """Of a tree given as how many words have each prefix, and are it; prefixes of fewer than ``least`` words are steps, but no states."""
        machine = cls.__new__(cls)
        machine._fold(counts or {"": [0, 0]}, least, alpha)
        return machine

    def _fold(self, counts: dict[str, list[int]], least: float, alpha: float) -> None:
        names = {p: k for k, p in enumerate(sorted(p for p, (n, _) in counts.items() if n >= least or not p))}
        self.states = [State(*counts[p]) for p in names]
        for prefix in sorted(counts, key=len)[1:]:
            parent = names.get(prefix[:-1])
            if parent is not None:
                self.states[parent].taken[prefix[-1]] = counts[prefix][0]
                if prefix in names:
                    self.states[parent].after[prefix[-1]] = names[prefix]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._fold_tree()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            s, t = (self.states[x] for x in todo.pop())
            if self._differ(s.ended, s.passed, t.ended, t.passed) or any(self._differ(s.taken.get(c, 0), s.passed, t.taken.get(c, 0), t.passed) for c in {*s.taken, *t.taken}):
                return False
            todo += [(s.after[c], t.after[c]) for c in s.after if c in t.after]
        return True

    def _merge(self, parent: int, symbol: str, into: int) -> None:
        """The subtree at ``parent``'s ``symbol`` is folded onto ``into``."""
        todo = [(into, self.states[parent].after[symbol])]
        self.states[parent].after[symbol] = into
        while todo:
            a, b = todo.pop()
            s, t = self.states[a], self.states[b]
            s.passed += t.passed
            s.ended += t.ended
            for c, n in t.taken.items():
                s.taken[c] = s.taken.get(c, 0) + n
                if c in s.after and c in t.after:
                    todo.append((s.after[c], t.after[c]))
                elif c in t.after:
                    s.after[c] = t.after[c]

    def _fold_tree(self) -> None:
        firm, settled = [0], {0}
        while True:
            open_ends = [(-self.states[self.states[p].after[c]].passed, k, c, p) for k, p in enumerate(firm) for c in self.states[p].after if self.states[p].after[c] not in settled]
            if not open_ends:
                break
            _, _, symbol, parent = min(open_ends)
            child = self.states[parent].after[symbol]
            into = next((f for f in firm if self._compatible(f, child)), None)
            if into is None:
                firm.append(child)
                settled.add(child)
            else:
                self._merge(parent, symbol, into)
        names = {f: k for k, f in enumerate(firm)}
        self.states = [self.states[f] for f in firm]
        for s in self.states:
            s.after = {c: names[t] for c, t in s.after.items()}

    def log_likelihood(self, word: str, smoothing: float = 0.05) -> float:
        """Of the whole word, its end included. Where no state follows a step, the word goes on as one that begins with its last two symbols."""
        here, total = 0, 0.0
        for k, c in enumerate(word):
            s = self.states[here]
            total += math.log((s.taken.get(c, 0) + smoothing) / (s.passed + smoothing * (len(SYMBOLS) + 1)))
            here = s.after[c] if c in s.after else self._reached(word[max(0, k - 1) : k + 1])
        s = self.states[here]
        return total + math.log((s.ended + smoothing) / (s.passed + smoothing * (len(SYMBOLS) + 1)))

    def _reached(self, word: str) -> int:
        here = 0
        for c in word:
            here = self.states[here].after.get(c, 0)
        return here


@dataclass
class Grammar:
    kinds: list[Automaton]
    ordinary: Automaton
    known: dict[str, float] = field(default_factory=dict)

    def score(self, token: str) -> float:
        """Nats by which the likeliest kind beats ordinary text."""
        word = token.translate(LETTERS)
        found = self.known.get(word)
        if found is None:
            found = max((k.log_likelihood(word) for k in self.kinds), default=-math.inf) - self.ordinary.log_likelihood(word)
            if len(self.known) < REMEMBERED and len(word) <= LONGEST:
                self.known[word] = found
        return found


#: A word of the kind, or (-1) a shape of ordinary tokens, and how often a batch of texts has it; of longer ones LONGEST + 1 characters.
FOUND = "kind int, word string, n long"


def _learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter[tuple[int, str]] = Counter()
        for t in batch.column(0):
            text = t.as_py() or ""
            own = base_spans(text)
            found.update((s[1], credential(text, s)[: LONGEST + 1]) for s in own)
            found.update((-1, text[a : min(b, a + LONGEST + 1)].translate(LETTERS)) for a, b, touched in candidates(text, own) if not touched)
        kinds, words = zip(*found, strict=True) if found else ((), ())
        yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], names=["kind", "word", "n"])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{[*KINDS, ADDED][k]}:{a}:{b}" for a, k, b in sorted(spans))


MARKED = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores array<double>"


def _marker(grammar: Grammar | None, margin: float):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                scored = {s: grammar.score(credential(text, s)) for s in base} if grammar else {}
                if grammar:
                    scored |= {(a, len(KINDS), b): n for a, b, _ in candidates(text, base) if (n := grammar.score(text[a:b])) > margin}
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(list(scored or base)), [scored[s] for s in sorted(scored)]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (*[pa.int64()] * 3, pa.string(), pa.string(), pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

    return mark


def learned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, word, n): what all whole texts have to learn from, each credential and each ordinary shape once."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_learner, FOUND)
    return settle(found.groupBy("kind", "word").agg(F.sum("n").alias("n")))


def _divisor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common = 0
    for batch in batches:
        common = math.gcd(common, *batch.column(0).to_pylist())
    yield pa.record_batch([pa.array([common], pa.int64())], names=["n"])


def _few(counted: DataFrame, least: float, most: int) -> tuple[list[tuple[str, int]], float]:
    """The prefixes of ``counted(prefix, n, ended)`` of ``least`` words or more; where that is more than ``most`` prefixes, those of a larger least."""
    rows = counted.where(F.col("n") >= least).orderBy(F.desc("n")).limit(most + 1).select("prefix", "n").collect()
    if len(rows) > most:
        least = rows[-1]["n"] + 1
    return [(r["prefix"], r["n"]) for r in rows if r["n"] >= least], least


def prefix_counts(shapes: DataFrame, resolution: int = RESOLUTION, most: int = STATES, levels: int = LEVELS) -> tuple[dict[str, list[int]], float]:
    """({prefix: [words that have it, words that are it]}, words that a state needs) of ``shapes(word, n)``.

    Only children of states come to the driver, and only words below states
    are counted on: ``levels`` lengths at once, until no state is left. A
    common divisor is taken out: copies of a whole corpus tell no more than
    the corpus.
    """
    total, empty = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))).first()
    if not total:
        return {}, 0.0
    common = math.gcd(*(r["n"] for r in shapes.select("n").mapInArrow(_divisor, "n long").collect())) or 1
    least = total / resolution
    found, states, at, last = {"": [total, empty]}, {"": total}, 0, [""]
    while last:
        below = shapes.sparkSession.createDataFrame([(p,) for p in last], "start string")
        alive = shapes.join(F.broadcast(below), F.expr(f"substring(word, 1, {at})") == F.col("start"), "left_semi")  # of STATES rows at most
        longer = alive.where(F.length("word") > at).select("word", "n", F.explode(F.expr(f"sequence({at + 1}, least(length(word), {at + levels}))")).alias("k"))
        counted = longer.groupBy(F.expr("substring(word, 1, k)").alias("prefix")).agg(F.sum("n").alias("n"), F.sum(F.when((F.col("k") == F.length("word")) & (F.col("k") <= LONGEST), F.col("n")).otherwise(0)).alias("ended"))
        counted = settle(counted)
        new, least = _few(counted, least, most)
        states |= dict(new)
        if len(states) > most:
            least = max(least, sorted(states.values(), reverse=True)[most] + 1)
        states = {p: n for p, n in states.items() if n >= least or not p}
        parents = shapes.sparkSession.createDataFrame([(p,) for p in states if at <= len(p) < at + levels], "parent string")
        kept = counted.join(F.broadcast(parents), F.expr("substring(prefix, 1, length(prefix) - 1)") == F.col("parent"), "left_semi")
        found |= {r["prefix"]: [r["n"], r["ended"]] for r in kept.collect()}
        at += levels
        last = [p for p in states if len(p) == at]
    found = {p: row for p, row in found.items() if not p or p[:-1] in states}
    return {p: [n // common for n in row] for p, row in found.items()}, least / common


def infer(found: DataFrame) -> Grammar | None:
    """Automata of the kinds that the corpus has, and of ordinary tokens; None without credentials."""
    take = lambda df: [r["word"] for r in df.orderBy(F.xxhash64("word"), "word").limit(PER_KIND).collect()]
    words = [take(found.where(F.col("kind") == k).select("word")) for k in range(len(KINDS))]
    if not any(words):
        return None
    ordinary = Automaton.of_prefixes(*prefix_counts(found.where("kind = -1").select("word", "n")))
    return Grammar([Automaton(w.translate(LETTERS) for w in ws) for ws in words if ws], ordinary)


def secret_spans(docs: DataFrame, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_assign, n_access, n_hex, base_sha256, spans and scores.

    Offsets count code points, ends are exclusive; base spans cover whole
    matches. Added spans lie in no base span. ``scores`` has the nats of each
    span, in order; base spans stay whatever theirs. Spans with equal starts
    come in the order of their kinds. Very long texts and tokens are scanned
    and scored whole. A null text counts as empty; a corpus without base
    matches gets no added spans and no scores. Null ids and repeated rows each
    get their row; an empty table gives an empty result; other columns are
    ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_marker(infer(learned(texts)), margin), MARKED).withColumnRenamed("id", id_col)
