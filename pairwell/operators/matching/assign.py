"""Greedy matching without replacement.

Exposed rows choose in ascending order of their key.  In each of ``n_final``
turns every exposed row still in the running takes its nearest control that
nobody holds; one that finds none leaves and releases what it held, at once.

A turn is settled for all cohorts and strata together, in two ways.

*Rounds.*  All rows ask for their best open wish at once.  A row is sure of a
control if nobody holds it and no earlier undecided row wishes for it: it takes
it if that is its best, and forgets what it wishes less.  A stratum in which
nobody asks for the same is settled.  What a row asks for is lost to later ones.
Rounds go on as long as they cut the open wishes by half or more, so their
number is at most the logarithm of that of the wishes.

*Components.*  What then still depends on one another, wish by wish, forms
connected components.  Each is settled in one task, which reads the rows of a
component in the order of their keys and keeps no more than the controls taken.

The result is that of going one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.operators.matching.components import components
from pairwell.session import materialize

STRATUM = ["cohort", "stratum"]
EXPOSED = [*STRATUM, "exposed_key"]
SLOT = [*STRATUM, "control_key"]

Wish = tuple[int, float]


def choose_in_order(
    rows: Iterable[tuple[int, list[Wish], list[int]]]
) -> Iterator[tuple[int, Wish | None]]:
    """(exposed, pick) of one turn for (exposed, wishes by rank, held), rows by key.

    A wish may be for a control that an earlier row holds: it can be had once
    that row has failed.
    """
    closed: set[int] = set()
    for exposed, wishes, held in rows:
        pick = next((w for w in wishes if w[0] not in closed), None)
        if pick is not None:
            closed.add(pick[0])
            closed.update(held)
        yield exposed, pick


def _open_wishes(wishes: DataFrame, held: DataFrame | None) -> DataFrame:
    """Wishes of the rows in the running for what is free or may become so in time.

    ``holder`` is the earlier row that holds the control, if one does.
    """
    if held is None:
        return wishes.withColumn("holder", F.lit(None).cast("long"))
    running = held.select(*EXPOSED).distinct()
    holders = held.select(*SLOT, F.col("exposed_key").alias("holder"))
    return wishes.join(running, EXPOSED, "left_semi").join(holders, SLOT, "left").filter(
        F.col("holder").isNull() | (F.col("holder") < F.col("exposed_key"))
    )


def _round(wishes: DataFrame, held: bool) -> tuple[DataFrame, DataFrame]:
    """(picks, wishes left) after all rows asked for their best open wish at once."""
    first = wishes.groupBy(*SLOT).agg(F.min("exposed_key").alias("first"))
    sure = F.col("holder").isNull() & (F.col("first") == F.col("exposed_key"))
    rows = materialize(
        wishes.join(first, SLOT).groupBy(*EXPOSED).agg(
            F.min("rank").alias("top"), F.min(F.when(sure, F.col("rank"))).alias("sure"),
            F.min_by(F.struct("control_key", "d2", "holder"), "rank").alias("pick"),
        ).select(*EXPOSED, "top", "sure", "pick.*"),
        "rows",
    )
    asked = rows.filter("holder is null").groupBy(*SLOT).agg(
        F.min("exposed_key").alias("asks"), F.count("*").alias("asking"))
    contested = rows.filter("holder is not null").select(*STRATUM).unionByName(
        asked.filter("asking > 1").select(*STRATUM)).distinct().withColumn("contested", F.lit(True))
    rows = rows.join(contested, STRATUM, "left").withColumn(
        "settled", F.col("contested").isNull() | F.coalesce(F.col("top") == F.col("sure"), F.lit(False)))
    picks = rows.filter("settled").select(*EXPOSED, "control_key", "d2")
    left = wishes.join(rows.filter("not settled").select(*EXPOSED, "sure"), EXPOSED).filter(
        "sure is null or rank <= sure").drop("sure")
    # Of what a row asks for, nothing is left to later ones: it, or an earlier row, takes it.
    left = left.join(asked.drop("asking"), SLOT, "left").filter(
        F.col("asks").isNull() | (F.col("exposed_key") <= F.col("asks"))).drop("asks")
    left = left.join(picks.select(*SLOT), SLOT, "left_anti")
    if held:
        # A holder that took another control keeps what it held; one without open wishes has failed.
        state = rows.select(*STRATUM, F.col("exposed_key").alias("holder"), F.col("settled").alias("kept"))
        left = left.join(state.withColumn("known", F.lit(True)), [*STRATUM, "holder"], "left").filter(
            ~F.coalesce("kept", F.lit(False))
        ).withColumn("holder", F.when(F.col("known"), F.col("holder"))).select(*wishes.columns)
    return picks, left


def _by_components(wishes: DataFrame, held: DataFrame | None) -> DataFrame:
    """The picks of one turn, a component in a task each."""
    first = wishes.groupBy(*SLOT).agg(F.min("exposed_key").alias("first"))
    told = wishes.join(first, SLOT)
    links = told.select(*STRATUM, F.col("first").alias("a"), F.col("exposed_key").alias("b")).unionByName(
        told.filter("holder is not null").select(
            *STRATUM, F.col("holder").alias("a"), F.col("exposed_key").alias("b")))
    named = components(links, STRATUM).withColumnRenamed("node", "exposed_key")
    rows = wishes.groupBy(*EXPOSED).agg(
        F.sort_array(F.collect_list(F.struct("rank", "control_key", "d2"))).alias("wishes")
    ).join(named, EXPOSED)
    if held is None:
        rows = rows.withColumn("held", F.array().cast("array<long>"))
    else:
        holds = held.groupBy(*EXPOSED).agg(F.collect_list("control_key").alias("held"))
        rows = rows.join(holds, EXPOSED, "left")
    together = [*STRATUM, "component"]
    ordered = rows.repartition(*together).sortWithinPartitions(*together, "exposed_key")
    schema = T.StructType([
        *(ordered.schema[c] for c in STRATUM), T.StructField("exposed_key", T.LongType()),
        T.StructField("control_key", T.LongType()), T.StructField("d2", T.DoubleType()),
    ])
    kinds = [pa.int64(), pa.int64(), pa.float64()]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
            columns = [batch.column(c).to_pylist() for c in (*together, "exposed_key", "wishes", "held")]
            yield from zip(*columns, strict=True)

        component, turn, row = None, None, None

        def feed() -> Iterator[tuple]:
            while True:
                yield row

        for batch in batches:
            out = []
            for *place, exposed, wishes, held in rows_of(batch):
                if turn is None or place != component:
                    component, turn = place, choose_in_order(feed())
                row = (exposed, [(w["control_key"], w["d2"]) for w in wishes], held or [])
                _, pick = next(turn)
                if pick is not None:
                    out.append((*place[:2], exposed, *pick))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.column(STRATUM[0]).type), pa.array(columns[1], batch.column(STRATUM[1]).type),
                 *(pa.array(v, k) for v, k in zip(columns[2:], kinds, strict=True))],
                schema.names)

    return ordered.mapInArrow(settle, schema)


def _turn(wishes: DataFrame, held: DataFrame | None, shrink: float) -> DataFrame:
    """(cohort, stratum, exposed_key, control_key, d2): what the rows in the running take."""
    left = materialize(_open_wishes(wishes, held), "open_wishes")
    number = left.count()
    picked = []
    while number and shrink > 0:
        picks, after = _round(left, held is not None)
        picked.append(materialize(picks, "picks"))
        left, before = materialize(after, "open_wishes"), number
        number = left.count()
        if number == before or number > shrink * before:
            break
    if number or not picked:
        picked.append(materialize(_by_components(left, held), "picks"))
    out = picked[0]
    for more in picked[1:]:
        out = out.unionByName(more)
    return out


def greedy_match(edges: DataFrame, *, n_final: int = 1, shrink: float = 0.5) -> DataFrame:
    """(cohort, stratum, exposed_key, control_key, n, d2) of the greedy matching.

    ``edges`` has cohort, stratum, exposed_key, control_key, d2 and rank, with
    distances beyond the limit already left out.  A control is used once per
    cohort.  Rounds go on while they leave no more than the share ``shrink`` of
    the open wishes: 0 goes to components at once, 1 as far as rounds lead.
    The result is the same.
    """
    kind = edges.schema
    wishes = materialize(edges.select(*EXPOSED, "control_key", "rank", "d2"), "wishes")
    held = None
    for n in range(1, n_final + 1):
        picks = _turn(wishes, held, shrink)
        taken = picks.withColumn("n", F.lit(n))
        if held is not None:
            taken = held.join(picks.select(*EXPOSED), EXPOSED, "left_semi").unionByName(taken)
        held = materialize(taken, "held") if n < n_final else taken
    return held.select(
        *EXPOSED, F.col("control_key").cast(kind["control_key"].dataType), F.col("n").cast("int"), "d2")
