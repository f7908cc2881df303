"""Hard negatives by a vertical scan of the vectors, dimension by dimension.

Rows meet the anchors in blocks.  A block is held by columns.  Each anchor reads
the columns in the descending order of its own components' magnitude, adds up
partial scores, and knows from every column's least and largest value what the
columns still unread can add at least and at most.  Rows that can no longer be
among the best, or no longer fall into a window of scores, leave the candidate
bitmap; the scan ends when none are left or all scores are exact.

The anchors are a stated set of queries held against all rows.  A group is one
block of rows and one block of anchors, however many rows share a label; from
each group no more than the wanted number per anchor and window leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwell.llm.common import written

#: Rows and anchors of a block; one group of the scan holds one block of each.
ROWS, ANCHORS = 4096, 2048
#: Columns read between two looks at the bounds.
STEP = 8
#: Larger scaled components would leave the range of a long in their products.
LARGEST = 2**26

#: Rows that stay, given the least and the most each may still score.
Pruning = Callable[[np.ndarray, np.ndarray], np.ndarray]


def vertical_scan(anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray,
                  alive: np.ndarray, keep: Pruning) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the rows of a block that ``keep`` leaves until their scores are exact.

    ``columns`` is dimension by row, ``low`` and ``high`` the range of each
    dimension, ``alive`` the bitmap of the rows that may take part.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.sort(np.stack([anchor * low, anchor * high]), axis=0)[:, order]
    # What the columns not yet read add at least and at most.
    rest = np.concatenate([ends[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((2, 1), np.int64)], axis=1)
    rows = np.flatnonzero(alive)
    score = np.zeros(len(rows), np.int64)
    for at in range(0, len(order), STEP):
        read = order[at:at + STEP]
        part = columns[read] if len(rows) == columns.shape[1] else columns[np.ix_(read, rows)]
        score += anchor[read] @ part
        done = min(at + STEP, len(order))
        stay = keep(score + rest[0, done], score + rest[1, done])
        if not stay.all():
            rows, score = rows[stay], score[stay]
        if not len(rows):
            break
    return rows, score


def among_best(k: int) -> Pruning:
    """Rows that may be among the ``k`` of the highest score."""
    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(least) <= k:
            return np.ones(len(least), bool)
        return most >= np.partition(least, len(least) - k)[len(least) - k]

    return keep


def in_windows(windows: np.ndarray, n: int) -> Pruning:
    """Rows that may be among the ``n`` of the highest score within a window (from, to)."""
    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(len(least), bool)
        for start, end in windows:
            may = (most >= start) & (least <= end)
            sure = least[(least >= start) & (most <= end)]
            if len(sure) >= n:
                may &= most >= np.partition(sure, len(sure) - n)[len(sure) - n]
            out |= may
        return out

    return keep


def _best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the ``n`` first by descending score, then key."""
    return np.lexsort((ids[rows], -score))[:n]


def _window(score: Column | np.ndarray, low: int, high: int) -> tuple:
    """The least and the largest score between ``low`` and ``high`` per cent of ``score``."""
    return -((-low * score) // 100), (high * score) // 100


def _columns(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((width, len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        out[:len(v), i] = v
    return out


def _scans(rows: pd.DataFrame, anchors: pd.DataFrame) -> Iterator[tuple[int, Callable[[np.ndarray, Pruning], tuple]]]:
    """For every anchor of a group its place and a scan of the group's block."""
    width = max(max(map(len, rows["vec"])), max(map(len, anchors["vec"])))
    columns, wanted = _columns(rows["vec"], width), _columns(anchors["vec"], width)
    low, high = columns.min(axis=1), columns.max(axis=1)
    for i in range(len(anchors)):
        yield i, lambda alive, keep, a=wanted[:, i]: vertical_scan(a, columns, low, high, alive, keep)


def vectors(points: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, vec): rows that take part, components as whole numbers."""
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(F.floor(scale * x)) > LARGEST))
    given = points.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    usable = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~odd)
    whole = usable.select("id", F.struct("label", F.transform("vec", lambda x: F.floor(scale * x)).alias("vec")).alias("row"))
    return whole.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vec")


def _block(column: str, rows: str | Column, size: int) -> Column:
    return F.pmod(F.xxhash64(column), F.greatest(F.lit(1), F.ceil((F.col(rows) if isinstance(rows, str) else rows) / size))).cast("int")


def _every(rows: str | Column, size: int) -> Column:
    """All blocks of so many rows, one row each."""
    count = F.greatest(F.lit(1), F.ceil((F.col(rows) if isinstance(rows, str) else rows) / size)).cast("int")
    return F.explode(F.sequence(F.lit(0), count - 1))


def positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the ``k`` best other rows of each anchor's label."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).join(
        anchors.groupBy("label").agg(F.count(F.lit(1)).alias("anchors")), "label")
    left = rows.join(sizes, "label").withColumn("block", _block("id", "rows", ROWS)).withColumn(
        "group", _every("anchors", ANCHORS)).drop("rows", "anchors")
    right = anchors.join(sizes, "label").withColumn("group", _block("id", "anchors", ANCHORS)).withColumn(
        "block", _every("rows", ROWS)).drop("rows", "anchors")
    kind = rows.schema["id"].dataType.simpleString()

    def scan(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(block) and len(group):
            ids = block["id"].to_numpy()
            for i, run in _scans(block, group):
                name = group["id"].iloc[i]
                at, score = run(ids != name, among_best(k))
                first = _best(at, score, ids, k)
                found.append(pd.DataFrame({"anchor_id": name, "positive_id": ids[at[first]], "positive_score": score[first]}))
        return pd.concat(found) if found else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []})

    keys = ["label", "block", "group"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        scan, f"anchor_id {kind}, positive_id {kind}, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def negatives(rows: DataFrame, anchors: DataFrame, chosen: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``chosen`` are the anchors' positives; a negative is a row of another label
    that scores between ``low`` and ``high`` per cent of the positive.
    """
    lists = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("chosen"))
    asked = written(anchors.join(lists.withColumnRenamed("anchor_id", "id"), "id"), "asked")
    n_rows, n_asked = F.lit(rows.count()), F.lit(asked.count())
    left = rows.withColumn("block", _block("id", n_rows, ROWS)).withColumn("group", _every(n_asked, ANCHORS))
    right = asked.withColumn("group", _block("id", n_asked, ANCHORS)).withColumn("block", _every(n_rows, ROWS))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

    def scan(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(block) and len(group):
            ids, labels = block["id"].to_numpy(), block["label"].to_numpy()
            for i, run in _scans(block, group):
                anchor = group.iloc[i]
                spans = [_window(p["positive_score"], low, high) for p in anchor["chosen"]]
                at, score = run(labels != anchor["label"], in_windows(np.array(sorted(set(spans))), n))
                for p, (start, end) in zip(anchor["chosen"], spans, strict=True):
                    inside = np.flatnonzero((score >= start) & (score <= end))
                    first = inside[_best(at[inside], score[inside], ids, n)]
                    found.append(pd.DataFrame({
                        "anchor_id": anchor["id"], "positive_id": p["positive_id"], "negative_id": ids[at[first]],
                        "positive_score": p["positive_score"], "negative_score": score[first]}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in names})

    keys = ["block", "group"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        scan, f"anchor_id {kind}, positive_id {kind}, negative_id {kind}, positive_score long, negative_score long")
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(points: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
         scale: int = 256, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as ``floor(scale * x)``, scores are inner products of
    those, higher ones first, ties by key.  ``anchor`` tells, from the column
    ``id``, which rows are anchors.  The first ``n_positives`` other rows of an
    anchor's label are its positives; for each, the first ``n_negatives`` rows of
    other labels come back that score ``low`` to ``high`` per cent of it (with a
    negative positive score there are none).

    Rows with a null key, label or vector, or a component that is null, not
    finite or beyond ``LARGEST`` once scaled, take no part.  Rows that share a
    key count as one: the least by label, then vector.  A shorter vector counts
    as if zeros followed.  An anchor alone in its label has no rows, nor has an
    empty table.  Other columns are not read.
    """
    rows = written(vectors(points, key, label, vector, scale), "vectors")
    anchors = rows.filter(anchor).toDF(*rows.columns)
    chosen = written(positives(rows, anchors, n_positives), "positives")
    return negatives(rows, anchors, chosen, n_negatives, low, high)
