"""SentencePiece encoding by forward filtering and backward sampling; decoding.

The lattice of a text has an edge for every piece of the vocabulary at every
place; a character without a piece is one edge of byte pieces.  Forward
filtering sums the weight of all segmentations up to each place, backward
sampling then draws pieces from the end, each with its exact posterior.  The
draw at a place depends on the seed, the row's key and the place alone, so a
row gets the same pieces in any batch, partition or run.

No piece has a blank after another character, so every segmentation cuts before
each run of blanks.  The lattice therefore factors into segments: equal segments
of a batch are filtered once, and all of them advance together in arrays.  A long
segment, as of a script without blanks, factors further where no piece found in
it goes across.

Weights: a piece of rank r (the negated score of a merge vocabulary, at most its size) has
weight ``(1 + r) ** -sharpness``.  Greater sharpness brings samples nearer to the best
segmentation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.batches import ROWS
from pairwell.llm.common import fresh
from pairwell.llm.shingles import mixed

SHARPNESS = 2.0
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_BLANK, _NONE = 0x2581, 0xFFFFFFFF
#: Characters worked on at once; longer texts are cut between segments.
_CHUNK = 1 << 19
#: Longer segments are cut where no piece goes across; what is longer still is filtered one by one, rescaled on the way.
_SHORT = 48
#: Filtered segments a worker keeps for later batches; beyond that it starts anew.
_KEPT = 120_000
_STEP = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def _power(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Running polynomial hash, one entry more than ``codes``."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        mixed(codes.astype(np.uint64) + np.uint64(1)) * _power(_STEP, len(codes)))])


class Pieces:
    """A vocabulary with its weights, and lookups of many pieces at once."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS):
        vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_ids = np.zeros(256, np.int32)
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = []
        for i in range(vocabulary.get_piece_size()):
            piece = vocabulary.id_to_piece(i)
            if vocabulary.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif vocabulary.is_control(i) or vocabulary.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                self.bytes.append(piece.replace(chr(_BLANK), " ").encode())
        self.weight = np.array(
            [(1.0 + min(max(0.0, -vocabulary.get_score(i)), len(self.bytes))) ** -sharpness
             for i in range(len(self.bytes))])
        self.longest = max(map(len, self.ids))
        self.kept: tuple[np.ndarray, ...] | None = None
        self.pool: tuple[np.ndarray, ...] | None = None
        # A factor per character cancels in every posterior; this one keeps the
        # sums of a short segment within what a double holds.
        digits = np.log10(1.0 / self.weight[list(self.ids.values())].min()) / 2
        lengths = np.zeros(len(self.bytes))
        lengths[list(self.ids.values())] = list(map(len, self.ids))
        self.scaled = self.weight * 10.0 ** np.minimum(digits * lengths, 250.0)
        self.short = int(min(_SHORT, 280 / max(digits, 1.0)))
        names = list(self.ids)
        keys = np.array([_hashes(np.array([ord(c) for c in p], np.uint32))[-1] for p in names], np.uint64)
        # Two slots for a key; the few keys that find both taken are kept in order.
        self.slots = [np.full(1 << 18, -1, np.int32) for _ in range(2)]
        self.keys = np.zeros(len(self.bytes), np.uint64)
        rest = []
        for key, name in zip(keys.tolist(), names, strict=True):
            i = self.ids[name]
            self.keys[i] = key
            for slots, shift in zip(self.slots, (46, 20), strict=True):
                at = (key >> shift) & ((1 << 18) - 1)
                if slots[at] < 0:
                    slots[at] = i
                    break
            else:
                rest.append((key, i))
        self.rest = sorted(rest)
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in names if len(p) == 1]] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(keys), -1, np.int32)
        for slots, shift in zip(self.slots, (46, 20), strict=True):
            got = slots[((keys >> np.uint64(shift)) & np.uint64((1 << 18) - 1)).astype(np.int64)]
            same = (got >= 0) & (self.keys[got] == keys)
            out[same] = got[same]
        for key, i in self.rest:
            out[keys == np.uint64(key)] = i
        return out

    # Segments side by side -------------------------------------------------

    def _edges(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first edge of each place, number of edges, length and piece of each edge).

        ``codes`` holds the segments end to end.  The edges of place ``i`` are
        the pieces that end with character ``i``, shortest first.
        """
        begin = np.cumsum(size) - size
        inside = np.arange(len(codes)) - np.repeat(begin, size)  # characters before this one
        upto, back = _hashes(codes), _power(_BACK, len(codes))
        odd = np.flatnonzero(codes == _NONE)
        found = [(odd, np.full(len(odd), -2, np.int32))]  # the only way over a character without a piece
        at = np.arange(len(codes))
        for k in range(min(self.longest, int(size.max()))):
            at = at[inside[at] >= k] if k else at
            piece = self.find((upto[at + 1] - upto[at - k]) * back[at - k])
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], piece[hit]))
        degree = np.zeros(len(codes), np.int64)
        for rows, _ in found:
            degree[rows] += 1
        first = np.cumsum(degree) - degree
        edges = int(degree.sum())
        length, pieces, filled = np.empty(edges, np.int64), np.empty(edges, np.int32), first.copy()
        for k, (rows, piece) in enumerate(found):
            slot = filled[rows]
            length[slot], pieces[slot] = max(k, 1), piece
            filled[rows] += 1
        return first, degree, length, pieces

    def _cut(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of long segments cut wherever no piece that stands there goes across."""
        taken = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        _, degree, length, _ = self._edges(codes[taken], size)
        end = np.repeat(np.arange(len(taken)), degree)
        across = np.zeros(len(taken) + 1, np.int64)
        np.add.at(across, end - length + 2, 1)  # the boundary behind a piece's first character
        np.add.at(across, end + 1, -1)
        open_at = np.cumsum(across)[:-1] == 0
        open_at[np.cumsum(size) - size] = True
        at = np.flatnonzero(open_at)
        return taken[at], np.diff(np.append(at, len(taken)))

    def _filtered(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first edge of each place, cumulated posterior, length and piece of each edge)."""
        begin = np.cumsum(size) - size
        first, degree, length, pieces = self._edges(codes, size)
        edges = len(length)
        weight = np.where(pieces >= 0, self.scaled[pieces], 1.0)
        # One sum of weights per place, and one before each segment.
        total = np.zeros(len(codes) + len(size))
        zero = begin + np.arange(len(size))
        total[zero] = 1.0
        upto_edge = np.empty(edges)
        on = np.arange(len(size))
        for j in range(int(size.max())):
            on = on[size[on] > j] if j else on
            row, here = begin[on] + j, zero[on] + j
            edge, left, summed = first[row], degree[row], np.zeros(len(on))
            live = np.arange(len(on))
            while len(live):
                e = edge[live]
                summed[live] += weight[e] * total[here[live] + 1 - length[e]]
                upto_edge[e] = summed[live]
                edge[live] += 1
                left[live] -= 1
                live = live[left[live] > 0]
            total[here + 1] = summed
        share = (upto_edge / np.repeat(upto_edge[first + degree - 1], degree)).astype(np.float32)
        return first, share, length, pieces

    def _sampled(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """For each character the piece that ends there, -2 for byte pieces, or -1."""
        out = np.full(len(codes), -1, np.int32)
        upto = _hashes(codes)
        name = mixed((upto[start + size] - upto[start]) * _power(_BACK, int(start[-1]) + 1)[start]) ^ size.astype(np.uint64)
        kinds, one, which = np.unique(name, return_index=True, return_inverse=True)
        known = self.kept if self.kept and len(self.kept[0]) + len(kinds) <= _KEPT else self._nothing()
        new = one[~np.isin(kinds, known[0], assume_unique=True)]
        if len(new):
            known = self._added(known, name[new], codes, start[new], size[new])
        self.kept = known
        names, begin, seen, first, share, length, piece = known
        base = begin[np.searchsorted(names, kinds)][which]
        reach = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        places = np.minimum(np.repeat(base, size) + reach, len(seen) - 1)
        if not np.array_equal(seen[places], codes[np.repeat(start, size) + reach]):
            # Two segments share a hash: filter each occurrence by itself.
            taken = np.repeat(start, size) + reach
            first, share, length, piece = self._filtered(codes[taken], size)
            base = np.cumsum(size) - size
        left = size.copy()
        on = np.arange(len(start))
        while len(on):
            end = start[on] + left[on] - 1
            edge, drawn = first[base[on] + left[on] - 1], draw[end]
            over = np.flatnonzero(share[edge] <= drawn)
            while len(over):
                edge[over] += 1
                over = over[share[edge[over]] <= drawn[over]]
            out[end] = piece[edge]
            left[on] -= length[edge]
            on = on[left[on] > 0]
        return out

    @staticmethod
    def _nothing() -> tuple[np.ndarray, ...]:
        kinds = (np.uint64, np.int64, np.uint32, np.int64, np.float32, np.int8, np.int32)
        return tuple(np.zeros(0, k) for k in kinds)

    def _added(self, known: tuple, name: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple:
        """The filtered segments kept so far, and new ones behind them."""
        names, begin, seen, first, share, length, piece = known
        own = np.cumsum(size) - size
        taken = np.repeat(start - own, size) + np.arange(int(size.sum()))
        more = self._filtered(codes[taken], size)
        names, begin = np.concatenate([names, name]), np.concatenate([begin, own + len(seen)])
        order = np.argsort(names)
        return (
            names[order], begin[order], np.concatenate([seen, codes[taken]]), np.concatenate([first, more[0] + len(share)]),
            *(np.concatenate([a, b.astype(a.dtype)]) for a, b in zip((share, length, piece), more[1:], strict=True)))

    def _sampled_alone(self, codes: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """One long segment that pieces hold together everywhere; sums are rescaled on the way."""
        n = len(codes)
        first, degree, length, pieces = self._edges(codes, np.array([n]))
        weight = np.where(pieces >= 0, self.weight[pieces], 1.0).tolist()
        begin, count, length = first.tolist(), degree.tolist(), length.tolist()
        total, upto = [1.0], [0.0] * len(weight)
        for j in range(n):
            summed = 0.0
            for e in range(begin[j], begin[j] + count[j]):
                summed += weight[e] * total[j + 1 - length[e]]
                upto[e] = summed
            total.append(summed)
            if not 1e-150 < summed < 1e150:  # only ratios within the reach of a piece matter
                for i in range(max(0, j + 2 - self.longest), j + 2):
                    total[i] /= summed
        out, end = np.full(n, -1, np.int32), n
        while end > 0:
            e, last = begin[end - 1], begin[end - 1] + count[end - 1] - 1
            bound = float(draw[end - 1]) * upto[last]
            while e < last and upto[e] <= bound:
                e += 1
            out[end - 1] = pieces[e]
            end -= length[e]
        return out

    def encode(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        """Sampled pieces of each text, drawn by its seed."""
        done: list[list[np.ndarray]] = [[] for _ in texts]
        queue: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0
        for i, (text, seed) in enumerate(zip(texts, seeds, strict=True)):
            raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.concatenate([np.array([_BLANK], np.uint32), np.where(raw == 0x20, np.uint32(_BLANK), raw)])
            codes[1:][~self.known[raw] & (raw != 0x20) | (raw == _BLANK)] = _NONE
            full = np.concatenate([np.zeros(1, np.uint32), raw])
            key = mixed(np.array([seed], np.uint64))[0]
            at = 0
            while at < len(codes):
                end = self._edge(codes, at + _CHUNK)
                place = np.arange(at, end, dtype=np.uint64)
                draw = (mixed(place * _STEP ^ key) >> np.uint64(11)).astype(np.float64) / 2.0**53
                queue.append((i, codes[at:end], full[at:end], draw))
                held += end - at
                if held >= _CHUNK:
                    self._flush(queue, done)
                    queue, held = [], 0
                at = end
        self._flush(queue, done)
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in done]

    @staticmethod
    def _edge(codes: np.ndarray, at: int) -> int:
        """The first segment start at or after ``at``."""
        while at < len(codes):
            part = codes[at - 1:at + _CHUNK] == _BLANK
            starts = np.flatnonzero(part[1:] & ~part[:-1])
            if len(starts):
                return at + int(starts[0])
            at += _CHUNK
        return len(codes)

    def _flush(self, queue: list[tuple], done: list[list[np.ndarray]]) -> None:
        if not queue:
            return
        codes, full, draw = (np.concatenate([q[k] for q in queue]) for k in (1, 2, 3))
        sizes = np.array([len(q[1]) for q in queue])
        first = np.zeros(len(codes), bool)
        first[np.cumsum(sizes) - sizes] = True
        blank = codes == _BLANK
        first[1:] |= blank[1:] & ~blank[:-1]
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(codes)))
        short = size <= self.short
        if not short.all():
            more, sizes_of_more = self._cut(codes, start[~short], size[~short])
            start, size = np.append(start[short], more), np.append(size[short], sizes_of_more)
            order = np.argsort(start)
            start, size = start[order], size[order]
            short = size <= self.short
        out = np.full(len(codes), -1, np.int32)
        if short.any():
            out = self._sampled(codes, start[short], size[short], draw)
        for s, n in zip(start[~short].tolist(), size[~short].tolist(), strict=True):
            out[s:s + n] = self._sampled_alone(codes[s:s + n], draw[s:s + n])
        at = np.flatnonzero(out != -1)
        piece, count = out[at], np.ones(len(at), np.int64)
        odd = np.flatnonzero(piece == -2)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in full[at[odd]].tolist()]
        count[odd] = [len(b) for b in spelled]
        ids = np.repeat(piece, count)
        where = np.cumsum(count) - count
        if len(odd):
            cells = np.concatenate([np.arange(w, w + len(b)) for w, b in zip(where[odd].tolist(), spelled, strict=True)])
            ids[cells] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        owner = np.searchsorted(np.cumsum(sizes), at, side="right")
        ends = np.cumsum(np.bincount(owner, count, len(queue)).astype(np.int64))
        for (i, *_), part in zip(queue, np.split(ids, ends[:-1]), strict=True):
            done[i].append(part)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of many rows: exact for what :meth:`encode` gives.

        The pieces of row ``i`` are ``ids[offsets[i]:offsets[i + 1]]``.
        """
        if self.pool is None:
            sizes = np.array([len(b) for b in self.bytes])
            self.pool = (np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(sizes) - sizes, sizes)
        pool, begin, sizes = self.pool
        at, size = begin[ids], sizes[ids]
        heads = offsets[:-1][np.diff(offsets) > 0]  # the leading blank is not text
        at[heads] += 1
        size[heads] -= 1
        ends = np.concatenate([[0], np.cumsum(size)])
        data = pool[np.repeat(at - ends[:-1], size) + np.arange(int(ends[-1]))]
        return data, ends[offsets]


_LOADED: dict[tuple, Pieces] = {}


def _pieces(model: bytes, sharpness: float) -> Pieces:
    name = (hashlib.blake2b(model).digest(), sharpness)
    if name not in _LOADED:
        _LOADED[name] = Pieces(model, sharpness)
    return _LOADED[name]


def _model(df: DataFrame, path: str):
    """The vocabulary file, read once on the driver and sent to the tasks."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _seed(seed: int, key: object) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0, model: str = MODEL,
            sharpness: float = SHARPNESS) -> tuple[DataFrame, str]:
    """``docs`` with the sampled pieces of each text, and the new column's name.

    A null text has null pieces; the empty text has the leading blank alone.
    Rows with one key and text get the same pieces; a null key is a key like
    others; an empty table gives an empty one.  Very long texts are worked on in
    chunks between segments.  The new column's name avoids those of ``docs``.
    """
    out, shared = fresh(docs.columns, "pieces"), _model(docs, model)
    names = [*docs.columns, out]
    at, by = docs.columns.index(text), docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value, sharpness)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                bodies, keys = part.column(at).to_pylist(), part.column(by).to_pylist()
                made = iter(pieces.encode([b for b in bodies if b is not None], [
                    _seed(seed, i) for i, b in zip(keys, bodies, strict=True) if b is not None]))
                rows = [next(made) if b is not None else None for b in bodies]
                ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
                flat = np.concatenate([np.zeros(0, np.int32), *(r for r in rows if r is not None)])
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([r is None for r in rows]))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema), out


def decoded(docs: DataFrame, pieces: str, model: str = MODEL) -> tuple[DataFrame, str]:
    """``docs`` with the text of an array of pieces, and the new column's name.

    Null pieces give a null text.
    """
    out, shared = fresh(docs.columns, "decoded"), _model(docs, model)
    names, at = [*docs.columns, out], docs.columns.index(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _pieces(shared.value, SHARPNESS)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                lists = part.column(at)
                ids, offsets = lists.flatten().to_numpy(), np.concatenate(
                    [[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
                data, ends = vocabulary.decode(ids, offsets)
                made = pa.LargeStringArray.from_buffers(
                    len(lists), pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data)).cast(pa.string())
                made = pc.if_else(lists.is_valid(), made, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])
    return docs.mapInArrow(run, schema), out


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0, model: str = MODEL,
               sharpness: float = SHARPNESS) -> DataFrame:
    """(key, n_pieces, pieces, lossless): the samples, and whether they decode to the text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made, pieces = encoded(rows, "key", "text", seed, model, sharpness)
    back, decoded_text = decoded(made, pieces, model)
    return back.select(
        F.col("key").alias(key), F.size(pieces).cast("long").alias("n_pieces"), F.col(pieces).alias("pieces"),
        F.col(decoded_text).eqNullSafe(F.col("text")).alias("lossless"))
