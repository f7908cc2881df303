"""Spelling variants: pairs one edit apart by composing automata.

Words within one edit are the paths of ``A o E o A``: the minimised acceptor
``A`` of the vocabulary, the transducer ``E`` that copies letters but for one
insertion, deletion or replacement, and ``A`` again.

The composition is enumerated per initial state.  Of two words one edit apart,
with ``m`` letters in the shorter, either the first ``m // 2`` letters agree or
the rest does.  A word therefore belongs to a partition for each half that may
agree, named by that half, by ``m`` and by which half it is; what the automata
of a partition read is the other half only.  A partition with many or very long
words is divided again by halving what is left, as often as it takes: in the end
all but one letter agrees, and the alphabet bounds the partition.  Nothing is left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.common import written

#: Fixed values of the word rule: letters, ASCII or of the Latin-1 block.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
#: Words a partition may hold before it is divided again.
PARTITION = 20_000
#: Letters the automata of a partition read at most; longer halves are divided too.
REGION = 64
#: Characters of a text looked at at once; longer ones are cut between runs.
_SLICE = 1 << 20
#: Different words a task counts before it passes the counts on.
_HELD = 200_000
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _slices(text: str, letter: re.Pattern) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and letter.match(text, end - 1) and letter.match(text, end):
            end += 1
        yield text[at:end]
        at = end


def _crc_seed(key: object) -> int:
    return zlib.crc32(f"{'' if key is None else key}:".encode())


def damaged(run: str, seed: int, damage: int) -> str:
    """The run, or that without one letter if its hash says so."""
    h = zlib.crc32(run.encode(), seed)
    if h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: str = LETTERS,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` letters and ``min_count`` occurrences.

    Counts are summed in the tasks before anything is shuffled.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, letter = re.compile(f"[{letters}]{{{min_length},}}"), re.compile(f"[{letters}]")
        held: dict[str, int] = {}

        def passed() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= min_length]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                seed = _crc_seed(name.as_py())
                for part in _slices(body.as_py() or "", letter):
                    # One damage per document and run: all its occurrences go the same way.
                    mine: dict[str, int] = {}
                    for run in runs.findall(part.translate(_ASCII_LOWER)):
                        mine[run] = mine.get(run, 0) + 1
                    for run, n in mine.items():
                        word = damaged(run, seed, damage)
                        held[word] = held.get(word, 0) + n
                    if len(held) > _HELD:
                        yield passed()
                        held.clear()
        yield passed()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Acceptor:
    """Minimal acyclic acceptor of sorted words: per state its arcs by letter, and whether a word ends there."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self._known: dict[tuple, int] = {}
        path = [0]
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._close(path, last, same)
            for letter in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        self._close(path, last, 0)

    def _close(self, path: list[int], word: str, depth: int) -> None:
        """States of ``word`` below ``depth`` get no more arcs: equal ones become one."""
        while len(path) > depth + 1:
            state = path.pop()
            form = (self.final[state], tuple(self.arcs[state].items()))
            self.arcs[path[-1]][word[len(path) - 1]] = self._known.setdefault(form, state)


def one_edit_pairs(acceptor: Acceptor) -> Iterator[tuple[str, str]]:
    """Accepted pairs of ``A o E o A`` from the initial state, each once with the shorter or smaller word first.

    A state of the composition is (state, state, edit spent).  Before the edit
    both sides read the same letters from one state of the acceptor; after it
    both read the same letters from two.
    """
    arcs, final = acceptor.arcs, acceptor.final
    meets: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        """All that can be read from both states to an end."""
        todo = [(p, q, False)]
        while todo:
            a, b, ready = todo.pop()
            if (a, b) in meets:
                continue
            shared = [c for c in arcs[a] if c in arcs[b]]
            if ready or not shared:
                meets[a, b] = ([""] if final[a] and final[b] else []) + [
                    c + rest for c in shared for rest in meets[arcs[a][c], arcs[b][c]]]
            else:
                todo.append((a, b, True))
                todo += [(arcs[a][c], arcs[b][c], False) for c in shared]
        return meets[p, q]

    seen: set[tuple[str, str]] = set()
    before = [(0, "")]
    while before:
        state, read = before.pop()
        below = list(arcs[state].items())
        for i, (c, p) in enumerate(below):
            before.append((p, read + c))
            for d, q in below[i + 1:]:  # c replaced by d
                for rest in common(p, q):
                    yield read + c + rest, read + d + rest
            for rest in common(state, p):  # c inserted; in a run of c each place gives the same pair
                pair = (read + rest, read + c + rest)
                if pair not in seen:
                    seen.add(pair)
                    yield pair


def _pieces(word: Column, low: Column, high: Column, m: Column) -> tuple[Column, Column, Column]:
    """What precedes, stands in, and follows the region from ``low`` to ``high`` of the shorter word's ``m`` letters."""
    after = m - high
    inner = F.length(word) - low - after
    return F.substr(word, F.lit(1), low), F.substr(word, low + 1, inner), F.substr(word, low + inner + 1, after)


def _keyed(regions: DataFrame) -> DataFrame:
    """Regions (word, m, low, high) with the name of their partition and the part that the automata read."""
    head, inner, tail = _pieces(F.col("word"), F.col("low"), F.col("high"), F.col("m"))
    # Two digests of different pieces: a partition never mixes words that disagree outside the region.
    name = F.sha2(F.concat_ws(" ", "m", "low", "high", head, tail).cast("binary"), 256)
    return regions.withColumns({"part": name, "inner": inner})


def _halves(regions: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    sides = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return regions.select("word", "m", F.explode(sides).alias("side")).select("word", "m", "side.low", "side.high")


def partitions(words: DataFrame, size: int) -> DataFrame:
    """(part, low, high, m, inner, word): each word in every partition where a partner of it may be.

    A word of length L stands as the shorter of a pair (m = L) and as the longer
    (m = L - 1).  Partitions of one word, or of one length as the longer only,
    hold no pair.
    """
    length = F.length("word")
    start = words.select("word", F.explode(F.array(length, length - 1)).alias("m")).filter("m >= 1").select(
        "word", "m", F.lit(0).alias("low"), F.col("m").alias("high"))
    regions = _halves(start.filter("high > 1")).unionByName(start.filter("high = 1"))
    done = None
    while True:
        keyed = written(_keyed(regions), "regions")
        sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("words"), F.min(F.length("word") - F.col("m")).alias("short"))
        useful = keyed.join(sizes.filter("words > 1 and short = 0"), "part").drop("short")
        span = F.col("high") - F.col("low")
        divide = (span > REGION) | ((F.col("words") > size) & (span > 1))
        small = useful.filter(~divide).drop("words")
        done = small if done is None else done.unionByName(small)
        large = useful.filter(divide).select("word", "m", "low", "high")
        if large.isEmpty():
            return done
        regions = _halves(large)


def near_pairs(words: DataFrame, size: int = PARTITION) -> DataFrame:
    """(a, b) of the words one edit apart, each pair once."""
    parted = partitions(words, size).select(
        "part", "inner", F.substr("word", F.lit(1), F.col("low")).alias("head"),
        F.substr("word", F.col("low") + F.length("inner") + 1, F.length("word")).alias("tail"))
    ordered = parted.repartition("part").sortWithinPartitions("part", "inner")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, tail, inner = None, "", "", []
        out: list[tuple[str, str]] = []

        def closed() -> None:
            # Code-point order, as the acceptor wants it; repeats come from nowhere but the same word.
            for x, y in one_edit_pairs(Acceptor(sorted(set(inner)))):
                out.append(tuple(sorted((head + x + tail, head + y + tail))))

        def passed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in out], pa.string()) for i in (0, 1)], ["a", "b"])
            out.clear()
            return made

        for batch in batches:
            for p, i, h, t in zip(*(batch.column(c).to_pylist() for c in ("part", "inner", "head", "tail")), strict=True):
                if p != part:
                    if inner:
                        closed()
                    part, head, tail, inner = p, h, t, []
                inner.append(i)
            if len(out) > 10_000:
                yield passed()
        if inner:
            closed()
        yield passed()

    return ordered.mapInArrow(compose, "a string, b string").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow one another; each step doubles what it skips."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = now.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        step = written(step, "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO, size: int = PARTITION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words`` (word, n), each named once.

    A word's form is its near word of the largest count, of equal ones the
    smallest in code-point order, if that is at least ``ratio`` times as
    frequent.  ``root`` follows forms to the last.  Words near to no other have
    ``n_near`` 0, no form, and are their own root.  An empty table gives an empty one.
    """
    words = written(words, "words")
    pairs = written(near_pairs(words.select("word"), size), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    found = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    holds = -F.col("best.less") >= ratio * F.col("n")
    made = written(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(holds, F.col("best.form")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(made.filter("form is not null"))
    return made.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The variants of all words of ``docs``: ``word_counts``, then ``variants``.

    Null and empty texts have no words.  A null key hashes as an empty one, and
    repeated rows count as often as they stand.  Texts are read whole, in slices
    between words.  Other columns are not read.
    """
    return variants(word_counts(docs, key, text, **options))
