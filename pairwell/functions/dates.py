"""Month keys, windows and offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_yyyymm(col: Column) -> Column:
    """``yyyyMM`` text to the first day of that month; bad text gives null."""
    return F.try_to_timestamp(col, F.lit("yyyyMM")).cast("date")


def format_yyyymm(col: Column) -> Column:
    return F.date_format(col, "yyyyMM")


def year_of_month_key(col: Column) -> Column:
    return F.substring(col, 1, 4).try_cast("int")


def trunc_month(col: Column) -> Column:
    return F.trunc(col, "month")


def trunc_year(col: Column) -> Column:
    return F.trunc(col, "year")


def month_index(col: Column) -> Column:
    """Months since year 0: consecutive months differ by one."""
    return F.year(col) * 12 + F.month(col)


def month_offset(service: Column, event: Column) -> Column:
    """Rounded months from the event to the service date."""
    return F.round(F.months_between(service, event), 0).cast("int")


def visit_length(start: Column, end: Column) -> Column:
    """Days of a visit, both ends counted."""
    return F.datediff(end, start) + 1


def date_int(col: Column) -> Column:
    """Epoch seconds (UTC session) as a double, so that dates can be scaled."""
    return F.unix_timestamp(col.cast("timestamp")).cast("double")


def in_year(col: Column, year: int) -> Column:
    """Range predicate for one calendar year; unlike comparing formatted text
    it reaches the parquet scan and prunes partitions and row groups."""
    return (col >= F.lit(f"{year}-01-01").cast("date")) & (
        col < F.lit(f"{year + 1}-01-01").cast("date")
    )


def overlaps_year(start: Column, end: Column, year: int) -> Column:
    """Interval touches a calendar year."""
    return (end >= F.lit(f"{year}-01-01").cast("date")) & (
        start < F.lit(f"{year + 1}-01-01").cast("date")
    )
