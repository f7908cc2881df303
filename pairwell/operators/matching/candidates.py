"""Nearest controls of exposed rows, within strata.

Controls of a stratum lie in a tree of cells (``cells``).  An exposed row
searches its nearest cells; that is the approximate search.  The exact search
then visits every other cell that could still hold a nearer control: a node
whose members lie within ``radius`` of its center cannot contain a point
nearer than ``distance to center - radius``, and nor can what is below it.

Work is spread by (stratum, cell, block of controls, block of exposed rows): a
group is two blocks however large a stratum or cell is, and the groups of a
large stratum spread over all tasks.
Distances are computed block against block in numpy and only the k best per
exposed row leave a task.  Identical vectors need no more than k controls in
the running, and identical exposed rows are searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairwell.operators.matching.blocks import block_of, blocks, box_gaps, chunks, first_copies, halved, rows_of, vectors_of
from pairwell.operators.matching.cells import CELL_ROWS, PLACED, CellIndex, build, given_cells, place, route, search_nodes
from pairwell.session import materialize, spread

#: Groups of controls whose minima bound the k-th nearest.
_GROUPS = 64
#: Fewer controls are not divided into boxes; controls in a box, exposed rows in a group, boxes visited first and at once after that.
_FEW, _BOX, _ROWS, _FIRST, _STEP = 2048, 256, 64, 2, 8
#: Pairs of a group that may wait for their exact distances.
_PENDING = 250_000
#: Levels up to which members are read as the index gives them.
_DEEP = 3
#: Numbers in the vectors of a block, if its rows are not given.
_VALUES = 1 << 19


def _nearest_of_all(
    exposed: np.ndarray, controls: np.ndarray, k: int, limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`nearest_in_block` by all distances.

    A matrix product gives distances up to float error; whatever is within that
    error of the k-th is then computed exactly.  With many controls the k-th
    least of ``_GROUPS`` minima, which is no less than the k-th, stands for it.
    """
    center = controls.mean(axis=0)
    a, b = exposed - center, controls - center
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 2e-9 + 1e-12 * (a2.max() + b2.max())
    nth = min(k, len(b)) - 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    grouped = k <= _GROUPS and len(b) >= 4 * _GROUPS
    padding = -len(b) % _GROUPS if grouped else 0  # at no distance that counts
    a1 = np.column_stack([a, np.ones(len(a))])
    b1 = np.column_stack([
        np.vstack([-2 * b, np.zeros((padding, b.shape[1]))]), np.append(b2, np.full(padding, np.inf))]).T
    for part in chunks(len(a), len(b)):
        near = a1[part] @ b1  # less the row's own a2
        bound = limit[part] - a2[part] + error
        if grouped:
            least = near.reshape(len(near), -1, _GROUPS).min(axis=1)
            bound = np.minimum(bound, np.partition(least, nth, axis=1)[:, nth] + error)
        rows, cols = np.nonzero(near[:, :len(b)] <= bound[:, None])
        # Where no more than k are within the limit, the k-th need not be known.
        many = np.bincount(rows, minlength=len(near)) > nth + 1
        if not grouped and many.any():
            bound[many] = np.minimum(bound[many], np.partition(near[many], nth, axis=1)[:, nth] + error)
            rows, cols = np.nonzero(near <= bound[:, None])
        found.append(_first_k(exposed, controls, rows + part.start, cols, k, limit))
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _first_k(
    exposed: np.ndarray, controls: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int, limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows, the k nearest per exposed row within its limit, by exact distances."""
    diff = exposed[rows] - controls[cols]
    dist = np.round((diff * diff).sum(axis=1), 9)
    keep = dist <= limit[rows]
    rows, cols, dist = rows[keep], cols[keep], dist[keep]
    by = np.lexsort((cols, dist, rows))
    rows, cols, dist = rows[by], cols[by], dist[by]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = place < k
    return rows[keep], cols[keep], dist[keep]


def nearest_in_block(
    exposed: np.ndarray, controls: np.ndarray, k: int, limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exposed row, control row, d²) of the k nearest controls per exposed row.

    ``controls`` is in preference order: of equally near ones the first wins.
    Farther ones than a row's ``limit`` (of the squared distance) are left out.
    Many controls are divided into boxes.  A group of like exposed rows visits
    them from the nearest on, until no box is within the k-th nearest of one of
    its rows.  Only what is within the k-th known so far is kept.
    """
    if len(controls) < _FEW or not len(exposed):
        return _nearest_of_all(exposed, controls, k, limit)
    center = controls.mean(axis=0)
    a, b = exposed - center, controls - center
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 2e-9 + 1e-12 * (a2.max() + b2.max())
    kept = first_copies(b, k)
    parts = [kept[part] for part in halved(b[kept], _BOX)]
    low, high = (np.array([f(b[part], axis=0) for part in parts]) for f in (np.min, np.max))
    # Boxes are filled up with what is at no distance that counts.
    width = -(-max(map(len, parts)) // _GROUPS) * _GROUPS
    ids = np.full((len(parts), width), -1)
    boxes = np.zeros((len(parts), width, b.shape[1] + 1))
    boxes[:, :, -1] = np.inf
    for i, part in enumerate(parts):
        ids[i, :len(part)] = part
        boxes[i, :len(part), :-1], boxes[i, :len(part), -1] = -2 * b[part], b2[part]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for group in halved(a, _ROWS):
        here = a[group]
        gap = np.maximum(np.maximum(low - here.max(axis=0), here.min(axis=0) - high), 0)
        gap = (gap * gap).sum(axis=1)
        by = gap.argsort(kind="stable")
        own, bound = a2[group], limit[group] + error
        least = np.full((len(group), k), np.inf)
        rows, cols = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        gaps = None
        at, step = 0, _FIRST
        while at < len(by):
            visited, who = by[at:at + step], np.arange(len(group))
            if gaps is None and at:
                # With a bound for each row, its own distance to the boxes tells which it needs.
                by = by[at:][gap[by[at:]] <= bound.max()]
                gaps, at = box_gaps(here, low[by], high[by]), 0
                continue
            if gaps is not None:
                needed = gaps[:, at:at + step] <= bound[:, None]
                visited, who = visited[needed.any(axis=0)], needed.any(axis=1).nonzero()[0]
            at, step = at + step, _STEP
            if not len(who) or not len(visited):
                continue
            near = np.column_stack([here[who], np.ones(len(who))]) @ boxes[visited].reshape(-1, here.shape[1] + 1).T
            # Less the row's own a2.  The k-th least of minima of groups is no less than the k-th.
            minima = near.reshape(len(near), -1, _GROUPS).min(axis=1) if k <= _GROUPS else near
            least[who] = np.partition(np.hstack([least[who], minima]), k - 1, axis=1)[:, :k]
            bound[who] = np.minimum(bound[who], least[who].max(axis=1) + own[who] + error)
            pairs = np.flatnonzero(near <= (bound[who] - own[who])[:, None])
            c = ids[visited].ravel()[pairs % near.shape[1]]
            r = group[who[pairs // near.shape[1]]]
            rows, cols = np.append(rows, r[c >= 0]), np.append(cols, c[c >= 0])
            if len(rows) > _PENDING:
                rows, cols, _ = _first_k(exposed, controls, rows, cols, k, limit)
        found.append(_first_k(exposed, controls, rows, cols, k, limit))
    rows, cols, dist = (np.concatenate(x) for x in zip(*found))
    by = rows.argsort(kind="stable")
    return rows[by], cols[by], dist[by]


def _search(
    routed: DataFrame, controls: DataFrame, k: int, block_rows: int
) -> DataFrame:
    """(stratum, e_key, control_key, d2): the k best per exposed row and block,
    none beyond the row's bound.  ``routed`` is a written table."""
    place = ["stratum", "cell"]
    n_controls = controls.groupBy(*place).agg(F.count("*").alias("nc"))
    n_exposed = routed.groupBy(*place).agg(F.count("*").alias("ne"))
    # Written, its size is known: vectors are not shuffled to learn the blocks of their cell.
    grid = materialize(n_controls.join(n_exposed, place).select(
        *place, blocks("nc", block_rows).alias("cb"), blocks("ne", block_rows).alias("eb")
    ), "grid")
    left = routed.join(grid, place).withColumns({
        "e_block": block_of("e_key", "eb"),
        "c_block": F.explode(F.sequence(F.lit(0), F.col("cb") - 1)),
    }).drop("cb", "eb")
    right = controls.select(*place, "key", "vec").join(grid, place).withColumns({
        "c_block": block_of("key", "cb"),
        "e_block": F.explode(F.sequence(F.lit(0), F.col("eb") - 1)),
    }).drop("cb", "eb")

    def search(exp: pa.Table, ctl: pa.Table) -> pa.Table:
        if not len(exp) or not len(ctl):
            return none
        ctl = ctl.select(["key", "vec"]).sort_by("key")
        rows, cols, d2 = nearest_in_block(
            vectors_of(exp["vec"]), vectors_of(ctl["vec"]), k, exp["bound"].to_numpy())
        return pa.table({
            "stratum": exp["stratum"].take(rows),
            "e_key": exp["e_key"].take(rows).cast(pa.int64()),
            "control_key": ctl["key"].take(cols).cast(pa.int64()),
            "d2": d2,
        }).cast(none.schema)

    schema = T.StructType([
        routed.schema["stratum"], T.StructField("e_key", T.LongType()),
        T.StructField("control_key", T.LongType()), T.StructField("d2", T.DoubleType()),
    ])
    none = to_arrow_schema(schema).empty_table()
    keys = [*place, "c_block", "e_block"]
    return spread(left, *keys).groupBy(*keys).cogroup(spread(right, *keys).groupBy(*keys)).applyInArrow(search, schema)


def top_k(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest controls per key, ranked; ties by control key.

    Spark keeps k rows per key before the shuffle already.
    """
    order = W.partitionBy(*keys).orderBy("d2", "control_key")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    index: CellIndex,
    exposed: DataFrame,
    *,
    k: int = 10,
    n_probe: int = 10,
    exact: bool = True,
    max_distance_sq: float | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Edges (stratum, exposed_key, control_key, d2, rank) from ``exposed``
    (stratum, key, vec) to the k nearest controls of an index.

    With ``max_distance_sq`` farther controls are left out, which changes no
    match.  ``exact=False`` searches ``n_probe`` cells only.  Blocks hold
    ``block_rows`` rows, or as many as make a few MB.
    """
    limit = F.lit(float("inf") if max_distance_sq is None else float(max_distance_sq))
    searched = exposed.groupBy("stratum", "vec").agg(F.min("key").alias("e_key")).withColumns(
        {"bound": limit, "probed": F.array().cast("array<long>")}
    )
    searched = materialize(searched, "searched")
    # Each level is a join more to read; those of a deep tree are read once.
    members = index.members if index.levels <= _DEEP else materialize(index.members, "cells")
    nodes = materialize(search_nodes(index.cells, members), "nodes")
    placed = members.drop("nodes", "dists")
    block_rows = block_rows or rows_of(placed, _VALUES, CELL_ROWS)
    # What is exact visits all cells that count in any case; the nearest one bounds how far they may be.
    routed = route(searched, nodes, index.levels, 1 if exact else n_probe, block_rows, rest=False)
    best = top_k(_search(routed, placed, k, block_rows), ["stratum", "e_key"], k)
    if exact:
        best = materialize(best, "probed")
        farthest = best.groupBy("stratum", "e_key").agg(
            F.count("*").alias("found"), F.max("d2").alias("kth")
        )
        probed = routed.groupBy("stratum", "e_key").agg(F.collect_list("cell").alias("probed"))
        bounded = searched.drop("bound", "probed").join(farthest, ["stratum", "e_key"], "left").join(
            probed, ["stratum", "e_key"]
        ).withColumn("bound", F.when(F.col("found") >= k, F.col("kth")).otherwise(limit))
        rest = route(bounded, nodes, index.levels, n_probe, block_rows, rest=True)
        more = _search(rest, placed, k, block_rows)
        best = top_k(best.drop("rank").unionByName(more), ["stratum", "e_key"], k)

    copies_of = exposed.select("stratum", "vec", F.col("key").alias("exposed_key")).join(
        searched, ["stratum", "vec"]
    ).select("stratum", "e_key", "exposed_key")
    return copies_of.join(best, ["stratum", "e_key"]).select(
        "stratum", "exposed_key", "control_key", "d2", "rank"
    )


def recall(index: CellIndex, exposed: DataFrame, *, k: int = 10, n_probe: int = 10, block_rows: int | None = None) -> float:
    """Share of the exact k nearest that a search of ``n_probe`` cells finds; 1.0 if there are none."""
    exact = search(index, exposed, k=k, block_rows=block_rows).select("stratum", "exposed_key", "control_key")
    some = search(index, exposed, k=k, n_probe=n_probe, exact=False, block_rows=block_rows)
    both = exact.join(
        some.select("stratum", "exposed_key", "control_key", F.lit(True).alias("hit")),
        ["stratum", "exposed_key", "control_key"], "left")
    wanted, hit = both.agg(F.count("*"), F.count("hit")).first()
    return hit / wanted if wanted else 1.0


def probes_for(
    index: CellIndex, exposed: DataFrame, *, k: int = 10, target: float = 0.9, block_rows: int | None = None
) -> int:
    """Cells to search for a recall of ``target``, measured on ``exposed``: 8, and half as many again until it is reached.

    ``exposed`` may be a sample of the rows to search later.  With all cells of
    the largest stratum the search is exact, so this ends.
    """
    n_probe = 8
    while recall(index, exposed, k=k, n_probe=n_probe, block_rows=block_rows) < target:
        n_probe += n_probe // 2
    return n_probe


def nearest_controls(
    points: DataFrame,
    *,
    k: int = 10,
    n_list: int | None = None,
    n_probe: int = 10,
    exact: bool = True,
    max_distance_sq: float | None = None,
    block_rows: int | None = None,
    rounds: int | None = None,
    centroids: DataFrame | None = None,
    written: bool = False,
    **tree: int,
) -> DataFrame:
    """Edges (stratum, exposed_key, control_key, d2, rank) to the k nearest
    controls of the same stratum.

    ``points`` has ``stratum``, ``key`` (long, ascending in order of
    preference), ``is_control`` and ``vec`` (array of double).  ``centroids``
    (stratum, centroids) gives the cells, of one level; else they are fitted,
    ``tree`` naming ``fanout`` and ``cell_rows``.  ``written`` points come from
    a stored table and are read from it again rather than copied.
    """
    controls = points.filter("is_control").select("stratum", "key", "vec")
    exposed = points.filter(~F.col("is_control")).select("stratum", "key", "vec")
    if centroids is not None:
        cells = materialize(given_cells(centroids), "centers")
        index = CellIndex(cells, place(controls, cells, 1, block_rows or PLACED), 1)
    else:
        # Exact results do not depend on how well the cells fit, only their cost does.
        rounds = (2 if exact else 4) if rounds is None else rounds
        if exact and not n_list and "cell_rows" not in tree:
            tree["cell_rows"] = rows_of(controls, _VALUES, CELL_ROWS)
        index = build(controls, n_list=n_list, rounds=rounds, block_rows=block_rows or PLACED, written=written, **tree)
    return search(
        index, exposed, k=k, n_probe=n_probe, exact=exact, max_distance_sq=max_distance_sq, block_rows=block_rows)


def self_neighbours(points: DataFrame, **options) -> DataFrame:
    """Search every control among the controls: the nearest is at distance 0."""
    controls = points.filter("is_control")
    both = controls.unionByName(controls.withColumn("is_control", F.lit(False)))
    return nearest_controls(both, k=1, **options)
