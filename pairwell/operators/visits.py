"""Claim lines to visits, and visits to monthly utilization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwell.functions import dates, labels
from pairwell.functions import fixed_values as fixed
from pairwell.operators.claims import by_member

LINE_CATEGORIES = ("p_category", "o_category", "er_category")
VISIT_KEYS = ("service_month", "member_id", "util_id", "visit_start", "visit_end", "visit_len")


def code_lookup_3way(lines: DataFrame, util_codes: DataFrame, avoidable: DataFrame) -> DataFrame:
    """Categories of a line by place of service, revenue code and first diagnosis.

    Blank codes carry no meaning and are dropped from the lists, or every line
    with a blank would match them.
    """
    def code_list(df: DataFrame, code: str, line_col: str, name: str) -> DataFrame:
        return df.filter(F.col(code) != "").select(
            F.col(code).alias(line_col), F.col("category").alias(name)
        ).distinct()

    return (
        lines.join(code_list(util_codes, "p_code", "code_pos", "p_category"), "code_pos", "left")
        .join(code_list(util_codes, "o_code", "code_rev", "o_category"), "code_rev", "left")
        .join(code_list(avoidable, "ms_joiner", "dx1", "er_category"), "dx1", "left")
    )


def stack_categories(lines: DataFrame) -> DataFrame:
    """The three category columns as rows, without nulls and repeats."""
    return (
        lines.unpivot(
            ["member_id", "svc_start", "svc_end"], list(LINE_CATEGORIES), "source", "util"
        )
        .drop("source")
        .filter(F.col("util").isNotNull())
        .distinct()
    )


def _in_category(category: str) -> Column:
    hit = F.lit(False)
    for c in LINE_CATEGORIES:
        hit = hit | F.coalesce(F.col(c) == category, F.lit(False))
    return hit.cast("int")


def _days(lines: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Categorised lines as one row per member and start day.

    All lines that start on one day belong to one visit, so only their latest
    end and their flags matter.  The aggregation combines before the shuffle
    and leaves at most one row per calendar day for any member.
    """
    flags = [labels.snake_name(c) for c in categories]
    marked = lines.filter(F.coalesce(*LINE_CATEGORIES).isNotNull()).select(
        "member_id", "svc_start",
        F.greatest("svc_start", "svc_end").alias("svc_end"),
        *[_in_category(c).alias(f) for c, f in zip(categories, flags)],
    )
    return marked.groupBy("member_id", "svc_start").agg(
        F.max("svc_end").alias("svc_end"), *[F.max(f).alias(f) for f in flags]
    )


def visit_islands(days: DataFrame) -> DataFrame:
    """Number the visits of each member.

    A row opens a visit if it starts after every earlier end; ranges that touch
    merge, ranges one day apart do not.  ``util_id`` counts visits per member,
    so it is the same whatever the partitioning.
    """
    member = W.partitionBy("member_id").orderBy("svc_start", "svc_end")
    earlier = member.rowsBetween(W.unboundedPreceding, -1)
    return (
        days.withColumn("max_end", F.max("svc_end").over(earlier))
        .withColumn(
            "opens", (F.col("max_end").isNull() | (F.col("svc_start") > F.col("max_end"))).cast("int")
        )
        .withColumn("util_id", F.sum("opens").over(member.rowsBetween(W.unboundedPreceding, 0)))
        .drop("opens")
    )


def carry_forward_id(df: DataFrame, id_col: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fill gaps in an id with the last one seen before."""
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(id_col, F.last(id_col, ignorenulls=True).over(upto))


def visits(
    lines: DataFrame, categories: Sequence[str] = fixed.VISIT_CATEGORIES
) -> DataFrame:
    """Visits with bounds, length, month and one 0/1 column per category.

    ``lines`` comes from :func:`code_lookup_3way`; lines without any category
    take no part.  After the reduction to days everything stays within one
    partitioning by member.
    """
    return visits_of_days(_days(lines, categories), categories)


def visits_of_days(days: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Visits from rows (member_id, svc_start, svc_end, one flag per category)."""
    flags = [labels.snake_name(c) for c in categories]
    return (
        visit_islands(days)
        .groupBy("member_id", "util_id")
        .agg(
            F.min("svc_start").alias("visit_start"), F.max("svc_end").alias("visit_end"),
            *[F.max(f).alias(f) for f in flags],
        )
        .select(
            dates.format_yyyymm(F.col("visit_start")).alias("service_month"),
            "member_id", "util_id", "visit_start", "visit_end",
            dates.visit_length(F.col("visit_start"), F.col("visit_end")).alias("visit_len"),
            *flags,
        )
    )


# Spend and visits from one pass over the lines

def member_days(
    lines: DataFrame,
    util_codes: DataFrame,
    avoidable: DataFrame,
    categories: Sequence[str] = fixed.VISIT_CATEGORIES,
    *,
    positive_only: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """One row per member and start day: what was paid, and what visits need.

    ``paid_lines``, ``med_total`` and ``med_total_net`` cover the lines with an
    amount; ``coded_lines``, ``svc_end`` and the flags those with a category.
    The code lists are reduced to one row per code first, so a code of several
    categories repeats no line and no amount.  With ``buckets`` lines are laid
    out by member before they are aggregated, which is then their only shuffle.
    """
    def by_code(df: DataFrame, code: str, line_col: str, name: str) -> DataFrame:
        return df.filter(F.col(code) != "").groupBy(F.col(code).alias(line_col)).agg(
            F.collect_set("category").alias(name))

    coded = (
        lines.join(by_code(util_codes, "p_code", "code_pos", "p_category"), "code_pos", "left")
        .join(by_code(util_codes, "o_code", "code_rev", "o_category"), "code_rev", "left")
        .join(by_code(avoidable, "ms_joiner", "dx1", "er_category"), "dx1", "left")
    )
    named = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in LINE_CATEGORIES]))
    paid = F.col("pay") > 0 if positive_only else F.col("pay") != 0
    found = F.size("named") > 0
    flags = [labels.snake_name(c) for c in categories]
    rows = coded.withColumn("named", named).select(
        "member_id", "svc_start",
        paid.alias("paid"), F.when(paid, F.col("pay")).alias("pay"), F.when(paid, F.col("netpay")).alias("netpay"),
        found.alias("found"), F.when(found, F.greatest("svc_start", "svc_end")).alias("svc_end"),
        *[F.array_contains("named", c).cast("int").alias(f) for c, f in zip(categories, flags)],
    )
    return by_member(rows, buckets).groupBy("member_id", "svc_start").agg(
        F.count_if("paid").alias("paid_lines"),
        F.sum("pay").alias("med_total"),
        F.sum("netpay").alias("med_total_net"),
        F.count_if("found").alias("coded_lines"),
        F.max("svc_end").alias("svc_end"),
        *[F.max(f).alias(f) for f in flags],
    )


def coded_days(days: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The days of :func:`member_days` that visits are made of."""
    return days.filter("coded_lines > 0").select(
        "member_id", "svc_start", "svc_end", *[labels.snake_name(c) for c in categories])


# Year by year

def no_carried(days: DataFrame) -> DataFrame:
    """The state before the first year."""
    return days.limit(0).select(
        "member_id", F.lit(0).cast("long").alias("visits_before"), F.col("svc_end").alias("last_inpatient_end"),
        *days.drop("member_id").columns)


def year_of_visits(
    days: DataFrame, carried: DataFrame, year: int | None, categories: Sequence[str] = fixed.VISIT_CATEGORIES
) -> tuple[DataFrame, DataFrame]:
    """(visits closed in ``year``, state for the next) from the days of one year and the state before.

    ``days`` has (member_id, svc_start, svc_end, flags), ``svc_start`` within the
    year.  A visit that lasts into the next year stays open and is carried: its
    start, its end so far and its flags, beside the number of visits closed
    and the end of the last inpatient one.  ``year`` None closes everything.
    All years one after another give the visits of all days at once, with
    ``avoidable_er`` and ``readmission`` as :func:`add_util` has them.
    """
    flags = [labels.snake_name(c) for c in categories]
    ongoing = carried.filter("svc_start is not null").select(*days.columns)
    state = carried.select("member_id", "visits_before", "last_inpatient_end")
    found = visits_of_days(days.unionByName(ongoing), categories).join(state, "member_id", "left")
    found = found.withColumn("util_id", F.col("util_id") + F.coalesce("visits_before", F.lit(0)))
    marked = mark_readmission(mark_avoidable_er(found), before=F.col("last_inpatient_end"))
    stays_open = F.lit(False) if year is None else F.col("visit_end") >= F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))
    closed = marked.filter(~stays_open).drop("visits_before", "last_inpatient_end")

    still = [F.max(F.when(stays_open, F.col(c))).alias(c) for c in flags]
    after = found.groupBy("member_id").agg(
        F.max(F.when(~stays_open, F.col("util_id"))).alias("closed"),
        F.max(F.when(~stays_open & (F.col("inpatient") == 1), F.col("visit_end"))).alias("inpatient_end"),
        F.max(F.when(stays_open, F.col("visit_start"))).alias("svc_start"),
        F.max(F.when(stays_open, F.col("visit_end"))).alias("svc_end"), *still,
    )
    following = state.join(after, "member_id", "full_outer").select(
        "member_id", F.coalesce("closed", "visits_before", F.lit(0)).cast("long").alias("visits_before"),
        F.coalesce("inpatient_end", "last_inpatient_end").alias("last_inpatient_end"), *days.drop("member_id").columns)
    return closed, following


def mark_avoidable_er(visit_rows: DataFrame) -> DataFrame:
    """An avoidable diagnosis counts only for an ER visit without admission."""
    counts = (F.col("avoidable_er") == 1) & (F.col("er") == 1) & (F.col("inpatient") == 0)
    return visit_rows.withColumn("avoidable_er", counts.cast("int"))


def mark_readmission(
    visit_rows: DataFrame, min_gap: int = 1, max_gap: int = 30, before: Column | None = None
) -> DataFrame:
    """Inpatient visits that start more than ``min_gap`` and fewer than
    ``max_gap`` days after the member's previous inpatient visit ended.

    ``before`` is the end of the last one before these rows, if there was one.
    """
    earlier = W.partitionBy("member_id").orderBy("visit_start").rowsBetween(
        W.unboundedPreceding, -1
    )
    last_end = F.last(F.when(F.col("inpatient") == 1, F.col("visit_end")), ignorenulls=True)
    previous = last_end.over(earlier)
    gap = F.datediff("visit_start", previous if before is None else F.coalesce(previous, before))
    back = (F.col("inpatient") == 1) & (gap > min_gap) & (gap < max_gap)
    return visit_rows.withColumn("readmission", F.coalesce(back, F.lit(False)).cast("int"))


def add_util(visit_rows: DataFrame) -> DataFrame:
    return mark_readmission(mark_avoidable_er(visit_rows))


def count_util(visit_rows: DataFrame) -> DataFrame:
    """Visits of each kind by member and month."""
    kinds = [c for c in visit_rows.columns if c not in VISIT_KEYS]
    return visit_rows.groupBy("member_id", "service_month").agg(
        *[F.sum(c).alias(c) for c in kinds]
    )
