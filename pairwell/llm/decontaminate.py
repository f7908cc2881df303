"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``size`` words (an item with fewer is
one window).  A document is hit where all words of a window stand in order.

Containment of a whole window needs each of its shingles, so the rarest one is
a sufficient prefix.  Shingles (word pairs; the word itself in a window of one)
are counted over all documents.  Documents are probed with the prefix shingles;
a probe fixes where the window would begin, windows that would not fit in the
document are dropped, and the rest are compared word by word.

Windows go to the tasks by broadcast in blocks of at most ``block_windows``:
usually one; a larger benchmark takes more passes over the documents, not more
memory.  Documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.batches import added, byte_texts
from pairwell.llm.common import fresh, text_of

SIZE = 10
BLOCK_WINDOWS = 500_000

#: Letters A-Z in lower case; separators (all other ASCII but digits and a-z) as a blank.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))
HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered."""
    return text.translate(_WORDS).split()


def windows(benchmark: DataFrame, size: int = SIZE, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (an array of words) with the items that have them."""
    # ASCII letters only: translate, not lower().
    upper = "".join(map(chr, range(65, 91)))
    body = F.translate(text_of(text), upper, upper.lower())
    split = benchmark.select(F.col(item).cast("string").alias("item"), F.filter(
        F.split(body, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "").alias("w"))
    n = F.size("w")
    each = split.filter(n > 0).select("item", F.explode(F.when(n <= size, F.array("w")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.slice("w", i, size))
    )).alias("window")).filter(F.col("item").isNotNull())
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Vocabulary:
    """Numbers for the words of a block; pairs of words as one number."""

    def __init__(self, block: list[tuple[list[bytes], list[str]]]):
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for ws, _ in block for w in ws))}
        self.base = len(self.number) + 1

    def coded(self, words: list[bytes]) -> np.ndarray:
        find = self.number.get
        return np.fromiter((find(w, -1) for w in words), np.int64, len(words))

    def shingles(self, coded: np.ndarray, singles: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place, code) of every shingle made of known words."""
        known = coded >= 0
        at = np.flatnonzero(known[:-1] & known[1:])
        code = coded[at] * self.base + coded[at + 1] + self.base
        if singles:
            one = np.flatnonzero(known)
            at, code = np.concatenate([at, one]), np.concatenate([code, coded[one]])
        return at, code


class _Index(_Vocabulary):
    """Windows of a block under their rarest shingle."""

    def __init__(self, block: list[tuple[list[bytes], list[str]]], counts: dict[int, int]):
        super().__init__(block)
        self.items = [items for _, items in block]
        self.rows = [self.coded(ws) for ws, _ in block]
        self.singles = any(len(ws) == 1 for ws, _ in block)
        by_code = defaultdict(list)
        for i, row in enumerate(self.rows):
            at, code = self.shingles(row, len(row) == 1)
            rarest = min(range(len(at)), key=lambda j: (counts.get(int(code[j]), 0), int(code[j]), int(at[j])))
            by_code[int(code[rarest])].append((i, int(at[rarest])))
        self.codes = np.array(sorted(by_code), np.int64)
        self.under = [by_code[int(c)] for c in self.codes]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, window) of every occurrence."""
        coded = self.coded(words)
        at, code = self.shingles(coded, self.singles)
        place = np.searchsorted(self.codes, code)
        place[place == len(self.codes)] = 0
        for j in np.flatnonzero(self.codes[place] == code) if len(self.codes) else ():
            for window, offset in self.under[place[j]]:
                row, start = self.rows[window], int(at[j]) - offset
                # Positional and length bounds, then the words themselves.
                if start >= 0 and start + len(row) <= len(coded) and np.array_equal(coded[start:start + len(row)], row):
                    yield start, window


def _counts(docs: DataFrame, vocabulary, wanted, column: str) -> dict[int, int]:
    """How often each shingle of the block stands in all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes = vocabulary.value, wanted.value
        total = np.zeros(len(codes), np.int64)
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                _, code = words.shingles(words.coded(words_of(text)), True)
                place = np.searchsorted(codes, code)
                place[place == len(codes)] = 0
                place = place[codes[place] == code] if len(codes) else place[:0]
                total += np.bincount(place, minlength=len(codes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes[some]), pa.array(total[some])], ["code", "n"])

    found = docs.select(F.col(f"`{column}`")).mapInArrow(run, "code long, n long")
    return {r.code: r.n for r in found.groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator()}


def _apply(docs: DataFrame, index, column: str, out: str, before: str | None, keep: list[str]) -> DataFrame:
    def work(cells: pa.Array) -> list[tuple]:
        found = index.value
        rows = []
        for cell in cells.to_pylist():
            words = words_of((cell["text"] or "").encode())
            spans, items = [], set()
            if cell["before"]:
                spans = list(zip(cell["before"]["starts"], cell["before"]["ends"], strict=True))
                items = set(cell["before"]["items"])
            for start, window in found.search(words):
                spans.append((start, start + len(found.rows[window])))
                items.update(found.items[window])
            merged: list[list[int]] = []
            for start, end in sorted(spans):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            rows.append(({
                "n_words": len(words), "n_hit": sum(e - s for s, e in merged),
                "starts": [s for s, _ in merged], "ends": [e for _, e in merged], "items": sorted(items)},))
        return rows

    cell = F.struct(F.col(f"`{column}`").alias("text"), (F.col(f"`{before}`") if before else F.lit(None).cast(HITS)).alias("before"))
    probe = fresh(docs.columns, "probe")
    return added(docs.withColumn(probe, cell), probe, [(out, HITS)], work, keep)


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE,
         block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (columns ``keep``, all by default) with a struct of hits, and its name.

    The struct has n_words, n_hit (words inside any occurrence), the merged
    spans as ``starts`` and ``ends`` (word numbers, end exclusive) and the
    sorted ``items`` with occurring windows.

    Null and empty texts have no words; an item without words or id has no
    window; an empty benchmark hits nothing.  Repeated rows are judged each.
    The new column's name avoids those of ``docs``.
    """
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    keep = docs.columns if keep is None else keep
    out = fresh(docs.columns, "hits")
    cut = windows(benchmark, size)
    blocks = max(1, -(-cut.count() // block_windows))
    named = cut.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    marked, before = docs, None
    for number in range(blocks):
        rows = named.filter(F.col("block") == number).select("window", "items").toLocalIterator()
        block = sorted(([w.encode() for w in r.window], r.items) for r in rows)
        words = _Vocabulary(block)
        wanted = np.unique(np.concatenate(
            [words.shingles(words.coded(ws), len(ws) == 1)[1] for ws, _ in block] or [np.zeros(0, np.int64)]))
        counts = _counts(docs, context.broadcast(words), context.broadcast(wanted), text)
        index = context.broadcast(_Index(block, counts))
        last = number == blocks - 1
        columns = list(keep) if last else list(docs.columns)
        name = out if last else fresh([*docs.columns, out], f"hits{number}")
        marked, before = _apply(marked, index, text, name, before, columns), name
    return marked, out


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document: key, counts, items and spans of hits."""
    marked, out = hits(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark, "text", size, keep=["key"])
    return marked.select(F.col("key").alias(key), f"{out}.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """The documents without any hit, with their own columns."""
    marked, out = hits(docs, benchmark, text, size)
    return marked.filter(F.col(f"{out}.n_hit") == 0).select(*[f"`{c}`" for c in docs.columns])
