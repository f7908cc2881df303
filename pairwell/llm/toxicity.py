"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows.

The lexicon is learned from labelled documents: words and word stems found far
more often in toxic ones.  Its trie is intersected with the Levenshtein
automaton of every word read, built state by state as words ask for it, so a
misspelled term costs one step a letter.  Evidence on misspellings belongs to
the word as read: those that the labels show to be harmless neighbours of a term
count little, and a spelling they do not show counts part of the term.

Every hit is judged in a window of words around it: inside quotation marks, or
after a word of saying, it counts as quotation rather than abuse.  A logistic
model over the hits of a document gives the score.

Only texts are inputs of a score.  The model is fitted on at most ``sample``
labelled documents outside the held-out fifth, chosen by hash; everything else
reads all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.batches import added, texts
from pairwell.llm.common import text_of

#: Labelled documents a model is fitted on, at most.
SAMPLE = 20_000
#: Lexicon entries kept, at most; by evidence.
TERMS = 2_000
STEMS = (5, 6, 7, 8, 9)
LEAST_DOCS, LEAST_ODDS = 4, 2.5
#: Words before and after a hit that make its context.
WINDOW = 8
_WORD = re.compile(r"[^\W\d_]+")
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"
#: Words of saying, by which a writer reports what others wrote (fixed values).
_SAYING = frozenset(
    "said says say wrote writes called calls quoted quote sagte sagt schrieb nannte zitat "
    "dit disait écrit appelé citation dijo dice escribió llamó cita".split())


_FOREIGN = ""


def _edits(term: str) -> int:
    return 1 if len(term) >= 5 else 0


class Automaton:
    """Trie and Levenshtein automata as one machine, its states made when reached.

    A state is a set of (trie node, edits); reading a letter keeps, substitutes
    or inserts it, and letters of the trie may be skipped, each for one edit.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word, self.stem, self.allowed = {}, {}, [0]
        for terms, table in ((words, self.word), (stems, self.stem)):
            for term in terms:
                edits, node = _edits(term) if table is self.word else 0, 0
                self.allowed[0] = max(self.allowed[0], edits)
                for letter in term:
                    if letter not in self.children[node]:
                        self.children[node][letter] = len(self.children)
                        self.children.append({})
                        self.allowed.append(0)
                    node = self.children[node][letter]
                    self.allowed[node] = max(self.allowed[node], edits)
                table[node] = term
        # Letters of no term act alike: one symbol for all of them keeps a state's steps within the alphabet of the terms.
        self.letters = frozenset(c for node in self.children for c in node)
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.accepts: list[list[tuple[str, int]]] = []
        self.prefixes: list[list[str]] = []
        self.start = self._state({(0, 0)})

    def _state(self, nodes: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        stack = list(nodes)
        while stack:
            node, edits = stack.pop()
            if edits > self.allowed[node] or least.get(node, edits + 1) <= edits:
                continue
            least[node] = edits
            stack += [(child, edits + 1) for child in self.children[node].values()]
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.accepts.append(sorted(
                (self.word[n], e) for n, e in least.items() if n in self.word and e <= _edits(self.word[n])))
            self.prefixes.append(sorted(self.stem[n] for n, e in least.items() if n in self.stem and e == 0))
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        after = set()
        for node, edits in self.sets[state]:
            after.add((node, edits + 1))
            for other, child in self.children[node].items():
                after.add((child, edits if other == letter else edits + 1))
        self.steps[state][letter] = reached = self._state(after)
        return reached

    def read(self, word: str) -> list[tuple[str, int]]:
        """(term, edits) of the terms that ``word`` spells; a stem ends in ``*``."""
        state, found = self.start, []
        for letter in word:
            if self.prefixes[state]:
                found += [(s + "*", 0) for s in self.prefixes[state]]
            if letter not in self.letters:
                letter = _FOREIGN
            following = self.steps[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if not self.sets[state]:
                return found
        return found + self.accepts[state]


#: (term, 0, quoted), or (term, edits, quoted, word as read) of a misspelling.
Hit = tuple


class Reader:
    """Hits of whole texts; words already read are remembered up to a bound."""

    def __init__(self, words: list[str], stems: list[str]):
        self.automaton, self.seen = Automaton(words, stems), {}

    def hits(self, text: str) -> Counter:
        """How often each hit is found."""
        low = text.lower()
        words = set(_WORD.findall(low))
        hot = {}
        for word in words:
            got = self.seen.get(word)
            if got is None:
                if len(self.seen) > 300_000:
                    self.seen.clear()
                got = self.seen[word] = tuple(self.automaton.read(word))
            if got:
                hot[word] = got
        found: Counter = Counter()
        if hot:
            spans = [m.span() for m in _WORD.finditer(low)]
            for i, (start, end) in enumerate(spans):
                word = low[start:end]
                if terms := hot.get(word):
                    quoted = self._quoted(low, spans, i)
                    for term, edits in terms:
                        found[(term, edits, quoted, word) if edits else (term, 0, quoted)] += 1
        return found

    @staticmethod
    def _quoted(low: str, spans: list[tuple[int, int]], i: int) -> bool:
        """Whether the window around a hit shows it as somebody else's words."""
        first, last = max(0, i - WINDOW), min(len(spans) - 1, i + WINDOW)
        before, after = low[spans[first][0]:spans[i][0]], low[spans[i][1]:spans[last][1] + 1]
        marks = [c for c in before if c in _OPEN or c in _CLOSE]
        inside = bool(marks) and (len(marks) % 2 == 1 or marks[-1] in "„«“") and any(c in _CLOSE for c in after)
        return inside or any(low[a:b] in _SAYING for a, b in spans[max(0, i - 3):i])


FEATURES = ("bias", "most", "others", "repeats", "quoted")
#: Part of a term's log odds that a misspelling is worth without evidence.
UNSEEN = 0.7


@dataclass
class Model:
    """The lexicon's log odds by term, and by (term, word) for the misspellings of the labels; and the weights."""

    exact: dict[str, float]
    near: dict[tuple[str, str], float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-3.0, 1.0, 0.0, 0.0, 0.0])

    def terms(self) -> tuple[list[str], list[str]]:
        return [t for t in self.exact if t[-1] != "*"], [t[:-1] for t in self.exact if t[-1] == "*"]

    def features(self, hits: Counter) -> list[float]:
        plain, quoted, count = {}, 0.0, 0
        for (term, _, inside, *word), n in hits.items():
            worth = self.near.get((term, *word), UNSEEN * self.exact[term]) if word else self.exact[term]
            if inside:
                quoted = max(quoted, worth)
            elif worth > 0:
                plain[term] = max(plain.get(term, 0.0), worth)
                count += n
        most = max(plain.values(), default=0.0)
        others = sum(plain.values()) - most
        return [1.0, most, math.log1p(others), math.log1p(count), quoted]

    def score(self, hits: Counter) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(hits), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(key):
    """The fifth of documents that no model sees: crc32 of the key as text."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def training(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents outside the held-out fifth."""
    told = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(key)))
    told = told.groupBy(F.col(key).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = told.orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` rows of two numbers.
    return docs.select(F.col(key).alias("id"), text_of(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "toxic")


def _candidates(rows: DataFrame, terms: int) -> tuple[dict[str, float], int, int]:
    """Words and stems with their log odds, and the number of documents of each label."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    stems = [F.array_distinct(F.transform(F.filter("words", _longer(n)), _stem(n))) for n in STEMS]
    each = rows.select("toxic", words.alias("words")).select("toxic", F.explode(F.flatten(F.array("words", *stems))).alias("term"))
    sums = rows.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).first()
    bad, good = int(sums["bad"] or 0), int(sums["all"]) - int(sums["bad"] or 0)
    counted = each.groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).filter(F.col("bad") >= LEAST_DOCS)
    odds = F.log((F.col("bad") + 0.1) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1)))
    kept = counted.withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy(
        F.desc(F.col("odds") * F.col("bad")), "term").limit(terms).collect()
    whole = {r.term: r for r in kept if not r.term.endswith("*")}
    # A stem says something new where it covers clearly more than any one word under it.
    covered: dict[str, int] = defaultdict(int)
    for word, r in whole.items():
        for n in STEMS:
            if len(word) >= n:
                covered[word[:n]] = max(covered[word[:n]], r.bad)
    return {
        r.term: float(r.odds) for r in kept
        if not r.term.endswith("*") or 10 * r.bad >= 13 * covered[r.term[:-1]]
    }, bad, good


def _longer(n: int):
    return lambda w: F.length(w) > n


def _stem(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def _hits_of(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model.terms())
    kept: list[Reader] = []
    fields = [("hits", T.ArrayType(T.StructType([
        T.StructField("term", T.StringType()), T.StructField("edits", T.IntegerType()), T.StructField("quoted", T.BooleanType()),
        T.StructField("word", T.StringType()), T.StructField("n", T.IntegerType())])))]

    def work(cells: pa.Array) -> list[tuple]:
        if not kept:
            kept.append(Reader(*shared.value))
        return [([{"term": t, "edits": e, "quoted": q, "word": w[0] if w else None, "n": n}
                  for (t, e, q, *w), n in kept[0].hits(body).items()],) for body in texts(cells)]

    return added(rows, "text", fields, work, keep)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE,
        terms: int = TERMS) -> Model:
    """A model from labelled documents; without toxic ones, one that scores all alike.

    Rows without a key or a label do not count, nor do empty tables.  A null text
    is an empty one.  Of several labels for a key the toxic one holds; rows that
    share a key all take its label.
    """
    rows = training(docs, labels, key, text, sample)
    exact, bad, good = _candidates(rows, terms)
    model = Model(exact)
    if not exact:
        return model
    # At most ``sample`` short lists of hits.
    seen = [(r.toxic, Counter({(h.term, h.edits, h.quoted, h.word) if h.edits else (h.term, 0, h.quoted): h.n for h in r.hits}))
            for r in _hits_of(rows, model, ["toxic"]).collect()]
    near: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    for toxic, hits in seen:
        for term, word in {(h[0], h[3]) for h in hits if h[1]}:
            near[term, word][toxic] += 1
    for (term, word), (clean, toxic) in near.items():
        # Evidence moves a spelling away from what it is worth without any.
        prior = math.exp(UNSEEN * exact[term]) * bad / max(1, good)
        model.near[term, word] = max(0.0, math.log(((toxic + prior) / (clean + 1)) * max(1, good) / max(1, bad)))
    x = np.array([model.features(h) for _, h in seen])
    y = np.array([t for t, _ in seen], float)
    model.weights = _logistic(x, y).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's steps; the bias is free."""
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, score, predicted, n_terms).

    Null and empty texts have no hits and get the score of a text without any.
    Repeated rows are scored each; an empty table gives an empty one.  A very long
    text costs in proportion, for words read before are remembered.  Other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: list[Reader] = []

    def work(cells: pa.Array) -> list[tuple]:
        if not kept:
            kept.append(Reader(*shared.value.terms()))
        rows = []
        for body in texts(cells):
            hits = kept[0].hits(body)
            score = shared.value.score(hits)
            rows.append((score, int(score >= 0.5), len({h[0] for h in hits})))
        return rows

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    fields = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_terms", T.LongType())]
    return added(rows, "text", fields, work, ["key"]).withColumnRenamed("key", key)
