"""Rounding, shares of spend, and sums over month offsets."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round2(col: Column) -> Column:
    """Two decimals, half away from zero.

    Values within 5e-7 of a tie count as ties, so float noise (1.00499999…)
    rounds the same on every engine and partitioning.  Plain double arithmetic:
    the built-in rounding goes through a decimal object per value.
    """
    return F.signum(col) * F.floor(F.abs(col) * 100 + 0.50005) / 100


def mean2(col: Column | str) -> Column:
    """Mean to two decimals; exact over decimal input."""
    c = F.col(col) if isinstance(col, str) else col
    return round2(F.sum(c.cast("decimal(20,6)")).cast("double") / F.count(c))


def offset_name(measure: str, offset: int) -> str:
    """Column of a measure at a month offset: ``total_claims_m3`` … ``_p5``."""
    return f"{measure}_{'m' if offset < 0 else 'p'}{abs(offset)}"


def sum_name(measure: str, pre: int, post: int) -> str:
    """Column of a measure summed over ``[pre, post)``."""
    return f"{offset_name(measure, pre)}_to_{'m' if post < 0 else 'p'}{abs(post)}_sum"


def sum_periods(
    df: DataFrame, measures: Iterable[str], pre: int, post: int, *, rounded: bool = False
) -> DataFrame:
    """Add the running sum over offsets ``pre`` … ``post - 1`` (end excluded)
    per measure, rounded at each addition.

    Columns already ``rounded`` to two decimals give the same with one rounding
    at the end, a far shorter expression.
    """
    def running(measure: str) -> Column:
        columns = [F.col(offset_name(measure, n)) for n in range(pre, post)]
        if rounded and columns:
            return round2(reduce(lambda a, b: a + b, columns))
        return reduce(
            lambda acc, n: round2(acc + F.col(offset_name(measure, n))),
            range(pre, post),
            F.lit(0.0),
        )

    return df.select("*", *[running(m).alias(sum_name(m, pre, post)) for m in measures])


def share(part: Column, whole: Column) -> Column:
    """part / whole to two decimals where part is positive, else 0."""
    return F.when(part > 0, round2(F.try_divide(part, whole))).otherwise(F.lit(0.0))


def share_band(col: Column) -> Column:
    """Band of the medical share of spend."""
    return (
        F.when(col < 0.5, "0-50%_med").when(col < 0.9, "50-90%_med").otherwise("mostly_med")
    )


def age_years(birth: Column, period: Column) -> Column:
    """Difference of calendar years; ``birth`` is a date."""
    return (F.year(period) - F.year(birth)).cast("int")


def age_band(age: Column) -> Column:
    return (
        F.when(age < 18, "0-17").when(age < 40, "18-39").when(age < 60, "40-59")
        .when(age >= 60, "60+")
    )


def pmpm(df: DataFrame, measure: str, pre: int, post: int) -> DataFrame:
    """Per-member-per-month means before and from the event on."""
    def mean_of(offsets: range) -> Column:
        total = reduce(lambda a, b: a + b, [F.col(offset_name(measure, n)) for n in offsets])
        return round2(total / len(offsets))

    return df.select(
        "*",
        mean_of(range(-pre, 0)).alias("pmpm_pre"),
        mean_of(range(0, post + 1)).alias("pmpm_post"),
    )


def apply_weights(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(float(w)) for c, w in weights.items()})


def fill_zero(df: DataFrame) -> DataFrame:
    """Nulls in numeric columns become 0; text and dates keep their nulls."""
    return df.na.fill(0)
