"""A tree of cells over the controls of each stratum.

The root of a stratum has at most ``FANOUT`` cells; a cell that holds many more
controls than wanted is divided again, and so on.  Points go down the tree one
level at a time, joined with the children of the node they stand in: no row or
task ever holds more than ``FANOUT`` centers, and a point meets a number of
centers that grows with the logarithm of its stratum.

A node's children are fitted by k-means on a sample of its controls, chosen by
a hash of the key: ``SAMPLE`` per child, so at most ``FANOUT * SAMPLE`` vectors
in a task.  Every control is placed in the tree.  How well the cells fit decides
what an exact search costs, not what it finds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairwell.operators.matching.blocks import (
    block_of, blocks, box_gaps, chunks, items, matrix, nearest_center, squared_distances, vectors_of,
)
from pairwell.session import materialize, spread

FANOUT, CELL_ROWS, SAMPLE = 256, 2048, 64
#: Most rows routed at once: each may go on to all children of its node.
_ROUTED = 1024
#: Rows in a block while controls are placed.
PLACED = 8192
#: A node is divided once it holds so many times the controls a cell is meant to hold.
_FULL = 2
# Distances are told apart to nine decimals of their square, plus float error.
_ROUNDING, _FLOAT = 1e-9, 1e-9

NODE = ["stratum", "node"]


@dataclass(frozen=True)
class CellIndex:
    """Cells of all strata and the controls in them.

    ``cells``: stratum, level, parent, node, center.  ``members``: stratum, key,
    vec, cell, and the nodes from the first level to the cell (``nodes``) with
    the distance to each one's center (``dists``).  ``levels`` is the depth.
    """

    cells: DataFrame
    members: DataFrame
    levels: int

    def add(self, controls: DataFrame, *, block_rows: int = PLACED) -> CellIndex:
        """The index with further ``controls`` (stratum, key, vec), the cells as they are.

        Controls of a stratum without cells are left out: build an index for it.
        """
        placed = place(controls, self.cells, self.levels, block_rows)
        return CellIndex(self.cells, self.members.unionByName(placed), self.levels)

    def save(self, path: str) -> None:
        """Write the index to a folder; controls come as the first batch."""
        self.cells.withColumn("levels", F.lit(self.levels)).write.parquet(f"{path}/cells")
        self.members.write.parquet(f"{path}/members/batch=0")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        cells = spark.read.parquet(f"{path}/cells")
        levels = cells.agg(F.max("levels")).first()[0]
        return CellIndex(cells.drop("levels"), spark.read.parquet(f"{path}/members").drop("batch"), levels or 0)

    @staticmethod
    def extend(spark: SparkSession, path: str, controls: DataFrame, batch: int, *, block_rows: int = PLACED) -> CellIndex:
        """Place further controls in a stored index; a batch written again replaces itself."""
        stored = CellIndex.load(spark, path)
        placed = place(controls, stored.cells, stored.levels, block_rows)
        placed.write.mode("overwrite").parquet(f"{path}/members/batch={int(batch)}")
        return CellIndex.load(spark, path)


# Building

def _means(points: np.ndarray, children: int, rounds: int) -> np.ndarray:
    """k-means centers; the first distinct points start."""
    _, first = np.unique(points, axis=0, return_index=True)
    centers = points[np.sort(first)[:children]]
    for _ in range(rounds):
        cell = nearest_center(points, centers)
        total = np.zeros_like(centers)
        np.add.at(total, cell, points)
        n = np.bincount(cell, minlength=len(centers))
        used = n > 0
        centers[used] = total[used] / n[used, None]
    return np.unique(centers, axis=0)


def _fit(open_points: DataFrame, splits: DataFrame, fanout: int, rounds: int) -> DataFrame:
    """(stratum, parent, node, center): children of the nodes in ``splits`` (node, rows, children, first)."""
    rate = F.least(F.lit(1.0), F.lit(float(SAMPLE)) * F.col("children") / F.col("rows"))
    drawn = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) < rate * float(1 << 30)
    sample = open_points.join(splits, NODE).filter(drawn | (F.col("key") == F.col("first"))).select(
        *NODE, "key", "vec", "children")

    def fit(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("key", key=lambda k: pd.util.hash_array(k.to_numpy()))
        centers = _means(matrix(points["vec"]), int(points["children"].iloc[0]), rounds)
        return pd.DataFrame({
            "stratum": key[0], "parent": key[1], "node": key[1] * (fanout + 1) + 1 + np.arange(len(centers)),
            "center": list(centers),
        })

    schema = T.StructType([
        open_points.schema["stratum"], T.StructField("parent", T.LongType()),
        T.StructField("node", T.LongType()), T.StructField("center", T.ArrayType(T.DoubleType())),
    ])
    return sample.groupBy(*NODE).applyInPandas(fit, schema)


def _children(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row per parent with its children's ``columns`` as lists, in the order of the nodes."""
    listed = cells.groupBy("stratum", F.col("parent").alias("node")).agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("children"))
    return listed.select("stratum", "node", *[F.col(f"children.{c}").alias(f"c_{c}") for c in columns])


def _with_children(points: DataFrame, key: str, children: DataFrame, block_rows: int, work, schema: T.StructType) -> DataFrame:
    """``work(points, children row)`` for every block of points of every node."""
    # Written, its size is known: points are not shuffled to learn the blocks of their node.
    sizes = materialize(
        points.groupBy(*NODE).agg(F.count("*").alias("n")).select(*NODE, blocks("n", block_rows).alias("blocks")), "sizes")
    left = points.join(sizes, NODE).withColumn("block", block_of(key, "blocks")).drop("blocks")
    right = children.join(sizes, NODE).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    none = to_arrow_schema(schema).empty_table()

    def run(block: pa.Table, listed: pa.Table) -> pa.Table:
        # The same types, up to whether the entries of a list may be null.
        return work(block, listed).cast(none.schema) if len(block) and len(listed) else none

    keys = [*NODE, "block"]
    return spread(left, *keys).groupBy(*keys).cogroup(spread(right, *keys).groupBy(*keys)).applyInArrow(run, schema)


def _step_down(points: DataFrame, cells: DataFrame, block_rows: int) -> DataFrame:
    """Points at nodes with children, moved to their nearest child."""
    carried = points.columns

    def nearest(block: pa.Table, listed: pa.Table) -> pa.Table:
        vectors, centers = vectors_of(block["vec"]), vectors_of(items(listed["c_center"]))
        child = nearest_center(vectors, centers)
        dist = np.sqrt(((vectors - centers[child]) ** 2).sum(axis=1))
        ids = items(listed["c_node"]).to_numpy()
        return block.select(carried).append_column("child", pa.array(ids[child])).append_column("dist", pa.array(dist))

    schema = T.StructType([*points.schema.fields, T.StructField("child", T.LongType()), T.StructField("dist", T.DoubleType())])
    moved = _with_children(points, "key", _children(cells, ["node", "center"]), block_rows, nearest, schema)
    return moved.select(
        "stratum", "key", "vec", F.col("child").alias("node"),
        F.concat("nodes", F.array("child")).alias("nodes"), F.concat("dists", F.array("dist")).alias("dists"))


def _at_root(controls: DataFrame) -> DataFrame:
    return controls.select(
        "stratum", "key", "vec", F.lit(0).cast("long").alias("node"),
        F.array().cast("array<long>").alias("nodes"), F.array().cast("array<double>").alias("dists"))


def _as_members(points: DataFrame) -> DataFrame:
    return points.select("stratum", "key", "vec", F.col("node").alias("cell"), "nodes", "dists")


def place(controls: DataFrame, cells: DataFrame, levels: int, block_rows: int) -> DataFrame:
    """Members for ``controls``: each goes down to a cell without children."""
    points, done = _at_root(controls), None
    for level in range(1, levels + 1):
        here = cells.filter(F.col("level") == level)
        parents = here.select("stratum", F.col("parent").alias("node")).distinct()
        if level > 1:
            resting = points.join(parents, NODE, "left_anti")
            done = resting if done is None else done.unionByName(resting)
        points = materialize(_step_down(points.join(parents, NODE, "left_semi"), here, block_rows), "placed")
    return _as_members(points if done is None else done.unionByName(points))


def given_cells(centroids: DataFrame) -> DataFrame:
    """Cells of one level from (stratum, centroids), numbered from 1 as they are listed."""
    return centroids.select("stratum", F.posexplode("centroids").alias("at", "center")).select(
        "stratum", F.lit(1).alias("level"), F.lit(0).cast("long").alias("parent"),
        (F.col("at") + 1).cast("long").alias("node"), F.col("center").cast("array<double>").alias("center"))


def build(
    controls: DataFrame, *, n_list: int | None = None, rounds: int = 2, block_rows: int = PLACED,
    fanout: int = FANOUT, cell_rows: int = CELL_ROWS, written: bool = False,
) -> CellIndex:
    """An index of ``controls`` (stratum, key, vec).

    Without ``n_list`` cells are meant to hold ``cell_rows`` controls; with it
    each stratum gets about so many cells, at most one level for every power of
    ``fanout`` in it.  Equal vectors share a cell, however many they are.
    Controls that are read from a ``written`` table are not written again.
    """
    most = math.ceil(math.log(max(n_list, 2), fanout)) if n_list else int(62 / math.log2(fanout + 1))
    points = _at_root(controls) if written else materialize(_at_root(controls), "placed")
    total = points.groupBy("stratum").agg(F.count("*").alias("total"))
    wanted = F.ceil(F.col("total") / n_list) if n_list else F.lit(cell_rows)
    all_cells, members, level = [], [], 0
    while level < most:
        sizes = points.groupBy(*NODE).agg(F.count("*").alias("rows"), F.min("key").alias("first")).join(total, "stratum")
        children = F.least(F.lit(fanout), F.lit(n_list) if n_list and most == 1 else F.ceil(F.col("rows") / wanted)).cast("int")
        # Every stratum has a first level; further down only full nodes are divided.
        splits = sizes if level == 0 else sizes.filter(F.col("rows") > _FULL * wanted)
        splits = materialize(
            splits.withColumn("children", children).select(*NODE, "rows", "children", "first"), "splits")
        fitted = materialize(_fit(points, splits, fanout, rounds), "centers")
        if level:
            # A node of one vector, or one that all go to again, stays as it is.
            several = fitted.groupBy("stratum", "parent").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
            fitted = materialize(fitted.join(several, ["stratum", "parent"], "left_semi"), "centers")
        if fitted.isEmpty():
            break
        level += 1
        here = fitted.select("stratum", F.lit(level).alias("level"), "parent", "node", "center")
        all_cells.append(here)
        parents = fitted.select("stratum", F.col("parent").alias("node")).distinct()
        resting = points.join(parents, NODE, "left_anti")
        # As a rule nothing rests at the root; written, it is not looked for again.
        members.append(resting if level > 1 else materialize(resting, "resting"))
        points = materialize(_step_down(points.join(parents, NODE, "left_semi"), here, block_rows), "placed")
    members.append(points)
    united = _united(members)
    empty = points.select(
        "stratum", F.lit(0).alias("level"), F.col("node").alias("parent"), "node", F.col("vec").alias("center")).limit(0)
    return CellIndex(_united(all_cells) if all_cells else empty, _as_members(united), level)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# Searching

def search_nodes(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Cells and inner nodes that hold members: center, the farthest member's distance, the box around the
    members (``low``, ``high``), whether it has children."""
    radius = members.select("stratum", F.explode(F.arrays_zip("nodes", "dists")).alias("at")).groupBy(
        "stratum", F.col("at.nodes").alias("node")).agg(F.max("at.dists").alias("radius"))
    sides = members.select("stratum", F.explode("nodes").alias("node"), "vec").select(
        *NODE, F.posexplode("vec").alias("axis", "value")).groupBy(*NODE, "axis").agg(
        F.min("value").alias("low"), F.max("value").alias("high"))
    box = sides.groupBy(*NODE).agg(F.sort_array(F.collect_list(F.struct("axis", "low", "high"))).alias("sides")).select(
        *NODE, F.col("sides.low").alias("low"), F.col("sides.high").alias("high"))
    leaves = members.select("stratum", F.col("cell").alias("node")).distinct().withColumn("leaf", F.lit(True))
    return cells.join(radius, NODE).join(box, NODE).join(leaves, NODE, "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))


def route(
    points: DataFrame, nodes: DataFrame, levels: int, n_probe: int, block_rows: int, *, rest: bool
) -> DataFrame:
    """(stratum, cell, e_key, vec, bound): the cells each exposed row has to search.

    Without ``rest`` the ``n_probe`` nearest cells, of which each level keeps as
    many nodes.  With it every cell, but for those in the row's ``probed``, that
    can hold a control within the row's ``bound`` of the squared distance.
    """
    def near(block: pa.Table, listed: pa.Table) -> pa.Table:
        ids = items(listed["c_node"]).to_numpy()
        centers = vectors_of(items(listed["c_center"]))
        radius = items(listed["c_radius"]).to_numpy()
        low, high = (vectors_of(items(listed[f"c_{side}"])) for side in ("low", "high"))
        leaf = items(listed["c_leaf"]).to_numpy(zero_copy_only=False)
        vectors = vectors_of(block["vec"])
        # A control tied with the bound may be farther by the rounding.
        reach = np.sqrt(block["bound"].to_numpy() + _ROUNDING)
        found = []
        for part in chunks(len(block), len(ids)):
            d2 = squared_distances(vectors[part], centers)
            if rest:
                away = np.sqrt(d2)
                nearest = away - radius[None, :] - _FLOAT * (1 + away + radius[None, :])
                beyond = np.sqrt(box_gaps(vectors[part], low, high)) > reach[part, None] * (1 + _FLOAT) + _FLOAT
                rows, cols = np.nonzero((nearest <= reach[part, None]) & ~beyond)
            else:
                rank = np.round(d2, 9).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                rows, cols = np.nonzero(rank < n_probe)
            found.append((rows + part.start, cols, np.round(d2[rows, cols], 9)))
        rows, cols, away = (np.concatenate(x) for x in zip(*found))
        if rest:
            done = np.zeros((len(block), len(ids)), dtype=bool)
            probed = block["probed"].combine_chunks()
            cells, of = probed.flatten().to_numpy(), np.repeat(np.arange(len(block)), probed.value_lengths().to_numpy())
            by = ids.argsort()
            at = by[np.minimum(np.searchsorted(ids, cells, sorter=by), len(ids) - 1)]
            here = ids[at] == cells
            done[of[here], at[here]] = True
            keep = ~(leaf[cols] & done[rows, cols])
            rows, cols, away = rows[keep], cols[keep], away[keep]
        out = block.select(carried).combine_chunks().take(pa.array(rows))
        for name, values in (("node", ids[cols]), ("away", away), ("leaf", leaf[cols])):
            out = out.append_column(name, pa.array(values))
        return out

    carried = ["stratum", "e_key", "vec", "bound", "probed"]
    schema = T.StructType([
        *(points.schema[c] for c in carried), T.StructField("node", T.LongType()),
        T.StructField("away", T.DoubleType()), T.StructField("leaf", T.BooleanType()),
    ])
    at = points.select(*carried, F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("away"), F.lit(False).alias("leaf"))
    best = W.partitionBy("stratum", "e_key").orderBy("away", "node")
    for level in range(1, levels + 1):
        here = _children(nodes.filter(F.col("level") == level), ["node", "center", "radius", "low", "high", "leaf"])
        below = _with_children(at.filter(~F.col("leaf")), "e_key", here, min(block_rows, _ROUTED), near, schema)
        if level > 1:
            below = below.unionByName(at.filter("leaf"))
            if not rest:
                below = below.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n_probe).drop("place")
        at = materialize(below, "routed")
    return at.filter("leaf").select("stratum", F.col("node").alias("cell"), "e_key", "vec", "bound")
