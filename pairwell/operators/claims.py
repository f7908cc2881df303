"""Spend per member and month, and its layout around events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import dates, measures
from pairwell.sources.readers import nonzero_pay

SPEND = ("med_total", "med_total_net", "pharma_total", "pharma_total_net")


def spend_by_month(
    lines: DataFrame, date_col: str, prefix: str, *, positive_only: bool = True
) -> DataFrame:
    """Gross and net spend by member and month, ``<prefix>_total[_net]``.

    ``lines`` has ``member_id``, ``pay`` and ``netpay``.  Decimal amounts sum
    exactly, so the totals do not depend on the order of rows.
    """
    return (
        nonzero_pay(lines, "pay", positive_only=positive_only)
        .groupBy("member_id", dates.format_yyyymm(F.col(date_col)).alias("service_month"))
        .agg(
            F.sum("pay").cast("double").alias(f"{prefix}_total"),
            F.sum("netpay").cast("double").alias(f"{prefix}_total_net"),
        )
    )


def spend_of_days(days: DataFrame) -> DataFrame:
    """Medical spend by member and month from :func:`pairwell.operators.visits.member_days`."""
    return (
        days.filter("paid_lines > 0")
        .groupBy("member_id", dates.format_yyyymm(F.col("svc_start")).alias("service_month"))
        .agg(
            F.sum("med_total").cast("double").alias("med_total"),
            F.sum("med_total_net").cast("double").alias("med_total_net"),
        )
    )


def join_spend(medical: DataFrame, pharmacy: DataFrame) -> DataFrame:
    """Medical and pharmacy spend side by side, absent ones 0, with totals.

    Both inputs are aggregated on the join keys, so the join adds no shuffle.
    """
    joined = medical.join(pharmacy, ["member_id", "service_month"], "full_outer").na.fill(
        0, list(SPEND)
    )
    return sum_measures(joined)


def stack_spend(medical: DataFrame, pharmacy: DataFrame, buckets: int | None = None) -> DataFrame:
    """:func:`join_spend` of inputs with one row per member and month each.

    They are stacked and brought
    together by one aggregation, laid out in ``buckets`` of the member if given.
    Rows without a member or a month stay apart, as they would in a join.
    """
    keys = ["member_id", "service_month"]
    apart = F.col("member_id").isNull() | F.col("service_month").isNull()
    stacked = medical.withColumn("_side", F.when(apart, 0)).unionByName(
        pharmacy.withColumn("_side", F.when(apart, 1)), allowMissingColumns=True)
    joined = by_member(stacked, buckets).groupBy(*keys, "_side").agg(*[F.max(c).alias(c) for c in SPEND])
    return sum_measures(joined.drop("_side").na.fill(0, list(SPEND)))


def sum_measures(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "total_claims": F.col("med_total") + F.col("pharma_total"),
        "total_claims_net": F.col("med_total_net") + F.col("pharma_total_net"),
    })


def join_utilization(spend: DataFrame, utilization: DataFrame) -> DataFrame:
    """Add visit counts to spend; months without visits get 0."""
    return measures.fill_zero(spend.join(utilization, ["member_id", "service_month"], "left"))


def claims_range(claims: DataFrame) -> DataFrame:
    """First and last month with claims (one row)."""
    return claims.agg(
        F.min("service_month").alias("first_month"), F.max("service_month").alias("last_month")
    )


def merge_claims(events: DataFrame, claims: DataFrame, pre: int, post: int) -> DataFrame:
    """Claims of the member from ``pre`` months before to ``post`` after.

    The window is written out as one row per month, which makes this a plain
    equality join on (member, month): a member with very many rows spreads over
    its months, and nothing is compared that does not match.
    """
    months = F.sequence(
        F.add_months("utc_period", -pre), F.add_months("utc_period", post),
        F.expr("interval 1 month"),
    )
    return events.withColumn("service_month", F.explode(months)).join(
        claims, ["member_id", "service_month"]
    )


def _cells(
    leading: Sequence[str], trailing: Sequence[str], pre: int, post: int
) -> list[tuple[str, int]]:
    """(measure, offset) of the wide layout: leading measures have offsets up
    to 0, trailing ones from 0, those in both lists all of them."""
    out = []
    for m in dict.fromkeys([*leading, *trailing]):
        first = -pre if m in leading else 0
        last = post if m in trailing else 0
        out += [(m, n) for n in range(first, last + 1)]
    return out


def pivot_claims(
    merged: DataFrame, leading: Sequence[str], trailing: Sequence[str], pre: int, post: int
) -> DataFrame:
    """Claims rows around events to one wide row per (member, event month).

    One aggregation for all measures and offsets; absent months are 0.
    """
    offset = dates.month_offset(F.col("service_month"), F.col("utc_period"))
    keyed = merged.withColumn("mo_seq", offset)

    def cell(measure: str, n: int) -> Column:
        total = F.sum(F.when(F.col("mo_seq") == n, F.col(measure)))
        return measures.round2(F.coalesce(total, F.lit(0.0))).alias(
            measures.offset_name(measure, n)
        )

    return keyed.groupBy("member_id", "utc_period").agg(
        *[cell(m, n) for m, n in _cells(leading, trailing, pre, post)]
    )


def by_member(df: DataFrame, buckets: int | None) -> DataFrame:
    """Rows laid out like tables stored in ``buckets`` of the member, if there are any."""
    return df if buckets is None else df.repartition(buckets, "member_id")


def _months_of_members(claims: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per member with claims: its months in order and where each one stands.

    ``_spent`` lists the months with claims, amounts to two decimals; ``_place``
    gives, for every month from ``_first`` on, the number from 1 of its entry in
    ``_spent``, or 0.  Both are bounded by the calendar.
    """
    monthly = claims.filter("service_month is not null").groupBy(
        "member_id", dates.month_index(F.col("service_month")).alias("idx")
    ).agg(*[measures.round2(F.coalesce(F.sum(c).cast("double"), F.lit(0.0))).alias(c) for c in names])
    listed = monthly.groupBy("member_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", *names))).alias("_spent"),
        F.sort_array(F.collect_list("idx")).alias("_months"),
        F.min("idx").alias("_first"), F.max("idx").alias("_last"),
    )
    place = F.transform(
        F.sequence("_first", "_last"), lambda i: F.array_position("_months", i).cast("int"))
    return listed.select("member_id", "_spent", "_first", place.alias("_place"))


def add_panel(
    rows: DataFrame,
    claims: DataFrame,
    leading: Sequence[str],
    trailing: Sequence[str],
    pre: int,
    post: int,
) -> DataFrame:
    """``rows`` (member_id, utc_period, …) with the wide claims columns; rows without claims in the window go.

    Claims become one row per member, to which rows are joined on the member
    alone; each offset is then looked up by its place.  Rows are not multiplied,
    and wide rows are neither sorted nor shuffled.  Rows without a member or a
    period have no claims.
    """
    names = list(dict.fromkeys([*leading, *trailing]))
    spent = _months_of_members(claims, names)
    at = dates.month_index(F.col("utc_period")) - F.col("_first")

    def place(n: int) -> Column:
        return F.get("_place", at + n)

    has_claim = reduce(
        lambda a, b: a | b, [F.coalesce(place(n) > 0, F.lit(False)) for n in range(-pre, post + 1)])
    return rows.join(spent, "member_id").filter(has_claim).select(
        *rows.columns,
        *[
            F.coalesce(F.get("_spent", place(n) - 1).getField(m), F.lit(0.0)).alias(measures.offset_name(m, n))
            for m, n in _cells(leading, trailing, pre, post)
        ],
    )


def claims_panel(
    periods: DataFrame,
    claims: DataFrame,
    leading: Sequence[str],
    trailing: Sequence[str],
    pre: int,
    post: int,
    *,
    buckets: int | None = None,
) -> DataFrame:
    """The same wide rows as merging and pivoting, without multiplying rows.

    ``periods`` holds (member_id, utc_period), of which repeats count once.  Where
    the claims are stored in ``buckets`` of the member
    (:func:`pairwell.sources.sinks.write_by_member`) only the periods move.
    """
    wanted = by_member(periods.select("member_id", "utc_period"), buckets).distinct()
    return add_panel(wanted, claims, leading, trailing, pre, post)


def wide_columns(
    leading: Sequence[str], trailing: Sequence[str], pre: int, post: int
) -> list[str]:
    return [measures.offset_name(m, n) for m, n in _cells(leading, trailing, pre, post)]


def remove_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows in which any of the columns is negative.

    One predicate per column: a single one over all columns makes the optimizer
    derive a variant for every combination of their aliases.
    """
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) >= 0 for c in columns]))


MIN_AGE, MAX_AGE = 18, 70


def adults(df: DataFrame, min_age: int = MIN_AGE, max_age: int = MAX_AGE) -> DataFrame:
    return df.filter(F.col("age").between(min_age, max_age))


def outlier_filter(
    df: DataFrame,
    month_columns: Sequence[str],
    sum_columns: Sequence[str] = (),
    *,
    limit: float = 250_000,
    min_age: int = MIN_AGE,
    max_age: int = MAX_AGE,
) -> DataFrame:
    """Adults up to ``max_age`` with every month and sum below the limit."""
    columns = [*month_columns, *sum_columns]
    return adults(df, min_age, max_age).filter(
        reduce(lambda a, b: a & b, [F.col(c) < limit for c in columns], F.lit(True)))
