"""Blocks of vectors: sizes, distances and nearest centers in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements of the largest distance matrix held at once (2 MB, so that it stays in the cache).
_CHUNK = 250_000


def matrix(vectors: pd.Series) -> np.ndarray:
    values = np.concatenate(vectors.to_numpy()).astype(np.float64, copy=False)
    return values.reshape(len(vectors), -1)


def rows_of(vectors: DataFrame, values: int, least: int) -> int:
    """Rows of ``vectors`` (vec) that hold about ``values`` numbers, ``least`` at least; any row tells the length."""
    one = vectors.select(F.size("vec")).first()
    return max(least, values // max(1, (one[0] if one else None) or 1))


def items(column: pa.ChunkedArray) -> pa.Array:
    """All entries of a column of lists, one after another."""
    return column.combine_chunks().flatten()


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """:func:`matrix` of an Arrow column, without an object per vector."""
    if column.null_count:
        raise ValueError("a vector is null")
    flat = items(column) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared L2 between all rows of two blocks."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        diff = a[:, d, None] - b[None, :, d]
        out += diff * diff
    return out


def chunks(rows: int, width: int) -> Iterator[slice]:
    step = max(1, _CHUNK // max(1, width))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def nearest_center(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Nearest center of each point, up to float error."""
    half = (centers * centers).sum(axis=1) / 2
    out = np.empty(len(points), dtype=np.int64)
    for part in chunks(len(points), len(centers)):
        out[part] = (half[None, :] - points[part] @ centers.T).argmin(axis=1)
    return out


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared L2 between all points and all boxes; 0 within a box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(low[None, :, d] - points[:, d, None], points[:, d, None] - high[None, :, d])
        np.maximum(gap, 0, out=gap)
        out += gap * gap
    return out


def halved(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of ``points`` in parts of at most ``rows``: halved along the axis they vary most in, again and again."""
    parts, rest = [], [np.arange(len(points))]
    while rest:
        part = rest.pop()
        if len(part) <= rows:
            parts.append(part)
            continue
        here = points[part]
        middle = len(part) // 2
        by = np.argpartition(here[:, here.var(axis=0).argmax()], middle)
        rest += [part[by[:middle]], part[by[middle:]]]
    return parts


def first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Ascending row numbers without those that have ``k`` rows of the same vector before them."""
    bits = np.ascontiguousarray(vectors).view(np.uint64)
    bits = bits ^ bits >> np.uint64(32)  # round numbers differ in their high bits only
    odd = np.random.default_rng(0).integers(1 << 63, size=bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = (bits * odd).sum(axis=1)
    by = sums.argsort(kind="stable")
    start = np.maximum.accumulate(np.where(np.diff(sums[by], prepend=sums[by[:1]]) != 0, np.arange(len(by)), 0))
    # Different vectors of one sum are not copies; of a run, those of its first row are counted.
    same = (vectors[by] == vectors[by[start]]).all(axis=1)
    before = same.cumsum()
    return np.sort(by[~same | (before - before[start] < k)])


def blocks(size: str, rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(size) / rows)).cast("int")


def block_of(col: str, count: str) -> Column:
    return F.pmod(F.xxhash64(col), F.col(count)).cast("int")
