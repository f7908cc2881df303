"""Exact-substring dedup by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier: in a
smaller document, or earlier in the same one.  The first copy stays.

Suffixes that can share ``LENGTH`` bytes are brought together first.  Every
window of that length belongs to its least k-gram (by hash, leftmost), and runs
of windows with one k-gram are one string of at most 2 * LENGTH bytes; equal
windows have equal k-grams, so strings meet by k-gram.

* k-grams that occur once cannot repeat a window: dropped after a count.
* Of equal strings all but the first are covered whole, without looking inside.
* Distinct strings under one k-gram are sorted by suffix.  The longest previous
  factor of a suffix is the longer of its common prefixes with the nearest
  smaller position before and after it in suffix order; where that reaches
  ``LENGTH`` the window is covered.

A k-gram with more than ``GROUP`` distinct strings (the edge of a passage that
stands in very many texts) is not gathered: its windows are spread by their own
hash and compared with the first of each, which settles them exactly.

Text moves by document, strings by k-gram; counts and minima combine before the
shuffle.  No step depends on how often a line, passage or document is copied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairwell.llm.batches import ROWS, added, byte_texts
from pairwell.llm.common import release, text_of, written
from pairwell.llm.shingles import mixed

LENGTH = 100
GRAM = 32
GROUP = 10_000
#: Strings whose suffixes are sorted in one go, if their k-grams allow.
ENOUGH = 2_000

_PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_BYTE = np.random.Generator(np.random.Philox(3)).integers(1, 2**64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def _table(step: np.uint64) -> np.ndarray:
    out = np.full(_PIECE + 2 * LENGTH, step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWER:
        _POWER.extend([_table(_STEP), _table(_BACK)])
    return _POWER


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row."""
    n, span = len(values) - width + 1, 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span:width - span + n])


def strings(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(start, windows, gram hash, content hash) of the strings of a text.

    A string starts at ``start`` and spans ``windows + length - 1`` bytes.
    """
    power, back = _powers()
    whole = np.frombuffer(text, np.uint8)
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(whole) - length + 1, _PIECE):
        data = whole[at:at + _PIECE + length - 1]
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:len(data)])])
        grams = mixed((upto[gram:] - upto[:-gram]) * back[:len(data) - gram + 1])
        placed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (_least(placed, length - gram + 1) & _PLACE).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        windows = np.diff(np.concatenate([starts, [len(place)]]))
        anchor = place[starts]
        body = (upto[starts + windows + length - 1] - upto[starts]) * back[starts]
        shape = ((anchor - starts) * 1024 + windows).astype(np.uint64)
        parts.append((starts + at, windows, grams[anchor].view(np.int64), mixed(mixed(body) + shape).view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def factors(suffixes: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, up to the length given.

    ``suffixes`` holds equally long byte strings, ``position`` their places.
    Previous and next smaller positions come from one stack pass over the
    suffix order; the common prefix with either is the least of those between.
    """
    order = np.lexsort((position, suffixes))
    rows = suffixes[order].view(np.uint8).reshape(len(order), -1)
    width = rows.shape[1]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    place = position[order].tolist()
    found = [0] * len(place)
    stack: list[int] = []
    held: list[int] = []  # common prefix of each stacked suffix with the one below it
    for i, (here, shared) in enumerate(zip(place, [0, *common.tolist()], strict=True)):
        while stack and place[stack[-1]] > here:
            # The next smaller position of the top is here; ``held`` has its previous one.
            top, below = stack.pop(), held.pop()
            found[top] = max(below, shared)
            shared = min(below, shared)
        stack.append(i)
        held.append(shared if len(stack) > 1 else 0)
    for i, below in zip(stack, held, strict=True):
        found[i] = below
    out = np.empty(len(place), np.int64)
    out[order] = found
    return out


def _occurrences(docs: DataFrame) -> DataFrame:
    """(gram, body, id, at) of every string; ``at`` packs start and windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "body", "id", "at"]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                made = []
                for key, text in zip(part.column(0).to_pylist(), byte_texts(part.column(1)), strict=True):
                    start, windows, gram, body = strings(text)
                    made.append((gram, body, np.full(len(gram), key, np.int64), start << 7 | windows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names)

    return docs.mapInArrow(run, "gram long, body long, id long, at long")


def _factored(rows: DataFrame) -> DataFrame:
    """(id, start, end) of covered runs from strings sorted by gram within partitions."""
    def covered(grams: np.ndarray, ids: np.ndarray, ats: np.ndarray, bodies: list[bytes]) -> pa.RecordBatch:
        starts, windows = ats >> 7, ats & 127
        # Positions compare by document, then start.
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((starts, ids))] = np.arange(len(ids))
        total = int(windows.sum())
        row = np.repeat(np.arange(len(ids)), windows)
        shift = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        first = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
        view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        # The gram leads each suffix, so suffixes of different grams share nothing.
        block = np.empty((total, LENGTH + 8), np.uint8)
        block[:, :8] = grams[row].astype(">i8").view(np.uint8).reshape(total, 8)
        block[:, 8:] = view[first[row] + shift]
        suffixes = block.view(f"S{LENGTH + 8}").ravel()
        hit = factors(suffixes, rank[row] * 128 + shift) >= LENGTH + 8
        at = starts[row[hit]] + shift[hit]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[row[hit]]), pa.array(at), pa.array(at + LENGTH)], ["id", "start", "end"])

    def grouped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        grams, ids, ats = (rows.column(c).to_numpy() for c in ("gram", "id", "at"))
        begin = 0
        for end in [*(np.flatnonzero(np.diff(grams)) + 1).tolist(), len(grams)]:
            if end - begin >= ENOUGH or (end == len(grams) and end > begin):
                yield covered(grams[begin:end], ids[begin:end], ats[begin:end],
                              rows.column("string").slice(begin, end - begin).to_pylist())
                begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            rows = more if rows is None else pa.concat_tables([rows, more])
            if rows.num_rows >= ENOUGH:
                grams = rows.column("gram").to_numpy()
                cut = int(np.searchsorted(grams, grams[-1]))  # the last group may go on
                yield from grouped(rows.slice(0, cut))
                rows = rows.slice(cut)
        if rows is not None:
            yield from grouped(rows)

    return rows.mapInArrow(run, "id long, start long, end long")


def _cut_out(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The strings that ``wanted`` (id, picks) names, read from their documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "crowded", "id", "at", "string"]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                rows = []
                for key, text, picks in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    body = zstandard.decompress(text)
                    for pick in picks:
                        start, windows = pick["at"] >> 7, pick["at"] & 127
                        rows.append((pick["gram"], pick["crowded"], key, pick["at"], body[start:start + windows + LENGTH - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    return packed.join(wanted.hint("shuffle_hash"), "id").select("id", "text", "picks").mapInArrow(
        run, "gram long, crowded boolean, id long, at long, string binary")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed one by one, for the joins that must move them."""
    def work(cells: pa.Array) -> list[tuple]:
        squeeze = zstandard.ZstdCompressor(level=3)
        return [(squeeze.compress(body),) for body in byte_texts(cells)]

    return added(docs.select("id", F.col("text").alias("body")), "body", [("text", T.BinaryType())], work, ["id"])


def covered(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(id, start, end) of covered bytes, runs overlapping, from (id, text) with unique ids."""
    spark = docs.sparkSession
    often = _occurrences(docs).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    often = written(often, "grams")
    release(spark)
    met = written(_occurrences(docs).join(often, "gram"), "strings")
    release(spark)
    position = F.struct("id", "at")
    kinds = written(met.groupBy("gram", "body").agg(F.min(position).alias("first")), "kinds")
    whole = met.join(kinds, ["gram", "body"]).filter(position != F.col("first")).select(
        "id", F.shiftright("at", 7).alias("start"),
        (F.shiftright("at", 7) + F.col("at").bitwiseAND(F.lit(127).cast("long")) + (LENGTH - 1)).alias("end"))
    whole = written(whole, "covered")

    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    picks = kinds.join(several, "gram").select(
        F.col("first.id").alias("id"),
        F.struct("gram", (F.col("n") > group).alias("crowded"), F.col("first.at").alias("at")).alias("pick"))
    picks = picks.groupBy("id").agg(F.collect_list("pick").alias("picks"))
    cut = written(_cut_out(_packed(docs), picks), "bodies")
    release(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = _factored(cut.filter("not crowded").select("gram", "id", "at", "string")
                       .repartition(parts, "gram").sortWithinPartitions("gram"))
    return whole.union(inside).union(_crowded(cut.filter("crowded")))


def _crowded(cut: DataFrame) -> DataFrame:
    """Covered windows of k-grams with too many strings to gather: window by window."""
    windows = cut.select("gram", "id", F.shiftright("at", 7).alias("from"), "string", F.explode(F.sequence(
        F.lit(0), F.col("at").bitwiseAND(F.lit(127).cast("long")).cast("int") - 1)).alias("shift"))
    body = F.substring("string", F.col("shift") + 1, F.lit(LENGTH))
    windows = windows.select(
        F.sha2(body, 256).alias("window"), "id", (F.col("from") + F.col("shift")).alias("start"))
    first = windows.groupBy("window").agg(F.min(F.struct("id", "start")).alias("first"))
    return windows.join(first, "window").filter(F.struct("id", "start") != F.col("first")).select(
        "id", "start", (F.col("start") + LENGTH).alias("end"))


def _runs(spans: list[dict]) -> list[list[int]]:
    """Overlapping and touching spans merged."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


RESULT = [
    ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()),
    ("kept_sha256", T.StringType()), ("kept", T.BinaryType()),
    ("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(key, id, text) with one integer ``id`` per row, in the order of the key; and if it is the key.

    The key itself serves where it is a whole number and no row lacks or shares
    it.  Otherwise rows are put in order (null first, then key, then text) and
    numbered.
    """
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or key is null")
    if whole and not keys.limit(1).count():
        return rows.withColumn("id", F.col("key").cast("long")), True
    ordered = rows.orderBy("key", "text").withColumn("id", F.monotonically_increasing_id())
    return written(ordered, "numbered"), False


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP,
          outputs: tuple[str, ...] = tuple(n for n, _ in RESULT)) -> DataFrame:
    """One row per row of ``docs``: the key and ``outputs``.

    Outputs: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    kept (the remaining bytes; cuts may fall inside a character) and spans.
    Null and empty texts, and those under ``LENGTH`` bytes, lose nothing.
    Repeated rows are documents of their own: the first in order (key, then
    text; null keys first) stays.  An empty table gives an empty one.  Very long
    texts are cut into strings of windows, so no row of a shuffle outgrows its
    text.  Other columns are not read.
    """
    rows, same = identified(docs, key, text)
    spans = covered(rows.select("id", "text"), group).groupBy("id").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = _packed(rows.select("id", "text")).join(spans.hint("shuffle_hash"), "id", "left")
    fields = [(n, t) for n, t in RESULT if n in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                made: dict[str, list] = {n: [] for n, _ in RESULT}
                for packed, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    body, runs = zstandard.decompress(packed), _runs(spans or [])
                    kept, at = [], 0
                    for start, end in runs:
                        kept.append(body[at:start])
                        at = end
                    rest = b"".join([*kept, body[at:]])
                    for name, value in zip(made, (
                            len(body), len(body) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest,
                            [{"start": s, "end": e} for s, e in runs]), strict=True):
                        made[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array(made[n], to_arrow_type(t)) for n, t in fields], ["id", *(n for n, _ in fields)])

    schema = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(n, t) for n, t in fields])
    done = joined.select("id", "text", "spans").mapInArrow(run, schema)
    if same:
        return done.select(F.col("id").cast(dict(docs.dtypes)[key]).alias(key), *outputs)
    return done.join(rows.select("id", F.col("key").alias(key)), "id").select(key, *outputs)
