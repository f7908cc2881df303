"""Choosing exposed and control member-months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import dates

MONTH = "interval 1 month"


def clean_exposed(
    events: DataFrame,
    exposed: Sequence[str],
    exclude: Sequence[str],
    pre: int,
    post: int,
) -> DataFrame:
    """Exposed events without another excluded event from ``pre`` months before
    to ``post`` months after (both ends counted).

    An event never disqualifies its own category.  Each excluded event is
    written to the months it disqualifies and those are reduced to the lowest
    and highest category (by place in the list) per (person, month): another
    category is present unless both are the event's own.  So the anti join is on
    equality, its right side has one row per key, and one join serves all
    categories.
    """
    def place(col: str) -> Column:
        return F.array_position(F.array(*[F.lit(c) for c in exclude]), F.col(col))

    blocked = (
        events.filter(F.col("category").isin(*exclude))
        .select(
            "person_id", place("category").alias("place"),
            F.explode(
                F.sequence(
                    F.add_months("utc_period", -post), F.add_months("utc_period", pre),
                    F.expr(MONTH),
                )
            ).alias("utc_period"),
        )
        .groupBy("person_id", "utc_period")
        .agg(F.min("place").alias("low"), F.max("place").alias("high"))
    )
    wanted = events.filter(F.col("category").isin(*exposed)).select(
        "person_id", "utc_period", "category", place("category").alias("place")
    )
    same_month = (
        (wanted.person_id == blocked.person_id)
        & (wanted.utc_period == blocked.utc_period)
        & ((blocked.low != wanted.place) | (blocked.high != wanted.place))
    )
    return wanted.join(blocked, same_month, "left_anti").drop("place")


def within_claims(
    df: DataFrame, claims: DataFrame, pre: int, post: int, *, last_month: str | None = None
) -> DataFrame:
    """Rows whose whole window lies inside the range of claims months.

    The range comes in as scalar subqueries; ``last_month`` overrides its end
    where the latest claims are known to be incomplete.
    """
    first = claims.agg(F.min("service_month")).scalar()
    last = (
        F.lit(last_month).cast("date") if last_month else claims.agg(F.max("service_month")).scalar()
    )
    return df.filter(
        (F.add_months("utc_period", -pre) >= first) & (F.add_months("utc_period", post) <= last)
    )


def eligible(df: DataFrame, members: DataFrame, pre: int, post: int) -> DataFrame:
    """Join member profiles whose enrolment covers the whole window."""
    covers = (
        (df.person_id == members.person_id)
        & (members.start_date <= F.add_months(df.utc_period, -pre))
        & (members.end_date >= F.add_months(df.utc_period, post))
    )
    return df.join(members, covers).drop(members.person_id).drop("start_date", "end_date")


def limit_exposed(
    df: DataFrame,
    members: DataFrame,
    claims: DataFrame,
    pre: int,
    post: int,
    *,
    last_month: str | None = None,
) -> DataFrame:
    return eligible(
        within_claims(df, claims, pre, post, last_month=last_month), members, pre, post
    )


def control_months(
    members: DataFrame,
    claims: DataFrame,
    pre: int,
    post: int,
    *,
    last_month: str | None = None,
) -> DataFrame:
    """One row per member profile and month that could serve as control.

    A month qualifies if its window lies in the claims range and, with one
    month to spare at the end, in the enrolment.  Months are generated per row,
    not by joining a calendar.
    """
    first = claims.agg(F.min("service_month")).scalar()
    last = (
        F.lit(last_month).cast("date") if last_month else claims.agg(F.max("service_month")).scalar()
    )
    low = F.greatest(F.add_months("start_date", pre), F.add_months(first, pre))
    high = F.least(F.add_months("end_date", -(post + 1)), F.add_months(last, -post))
    # Start on the first month start that is not before the lower bound.
    low_month = dates.trunc_month(F.date_add(F.add_months(low, 1), -1))
    return (
        members.withColumns({"low": low_month, "high": high})
        .filter(F.col("low") <= F.col("high"))
        .withColumn("utc_period", F.explode(F.sequence("low", "high", F.expr(MONTH))))
        .drop("low", "high", "start_date", "end_date")
        .withColumn("category", F.lit("control"))
    )


def drop_after_events(df: DataFrame, events: DataFrame, months: int) -> DataFrame:
    """Drop member-months from an event to ``months`` after it."""
    shadow = events.select(
        "person_id",
        F.explode(
            F.sequence("utc_period", F.add_months("utc_period", months), F.expr(MONTH))
        ).alias("utc_period"),
    ).distinct()
    return df.join(shadow, ["person_id", "utc_period"], "left_anti")


def drop_unlinkable(df: DataFrame, marker: str) -> DataFrame:
    """Drop person ids that start with the marker of unlinkable records."""
    return df.filter(~F.col("person_id").startswith(marker))


def event_categories(events: DataFrame) -> DataFrame:
    """The set of categories (one row); bounded by the distinct names."""
    return events.select("category").distinct().agg(
        F.sort_array(F.collect_list("category")).alias("categories")
    )


def max_flags(flags: DataFrame, year_columns: Sequence[str] = ("cal_yr", "cal_year")) -> DataFrame:
    """One row of chronic flags per member over all years."""
    names = [c for c in flags.columns if c != "member_id" and c not in year_columns]
    return flags.groupBy("member_id").agg(*[F.max(c).alias(c) for c in names])


def add_flags(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows with the chronic flags of the member; members without any get 0, as all empty numbers do."""
    return df.join(flags, "member_id", "left").na.fill(0)


def features_join(exposed: DataFrame, wide: DataFrame, flags: DataFrame) -> DataFrame:
    """Cohort rows with claims features (required) and chronic flags (optional)."""
    return add_flags(exposed.join(wide, ["member_id", "utc_period"]), flags)
