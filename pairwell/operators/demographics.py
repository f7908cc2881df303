"""Member profiles from enrolment spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import dates, labels


def demographics_rollup(
    spans: DataFrame,
    profile: Sequence[str],
    year: int,
    *,
    as_of: Column,
    region_col: str = "msa_4",
    rural_code: str = "0000",
    blank: str = "Blank",
) -> DataFrame:
    """One row per member profile with spans in the year.

    ``spans`` has ``start_date`` and ``end_date``; the end is capped at
    ``as_of``.  ``rural`` and ``msa_provided`` are read from the region code.
    """
    region = F.col(region_col)
    return (
        spans.filter(dates.overlaps_year(F.col("start_date"), F.col("end_date"), year))
        .groupBy(*profile)
        .agg(
            F.max(F.when(region == rural_code, 1).otherwise(0)).alias("rural"),
            F.max(F.when(region.isNull() | (region == blank), 0).otherwise(1)).alias("msa_provided"),
            F.min("start_date").alias("start_date"),
            labels.clamp_end_date(F.max("end_date"), as_of).alias("end_date"),
        )
    )


def coded_demographics_rollup(
    spans: DataFrame, industries: DataFrame, places: DataFrame, year: int
) -> DataFrame:
    """The same for a source with coded sex, industry and place.

    Region codes holding an ``R`` are rural and not an area; ``X`` means none.
    """
    area = F.col("msa_cd")
    industry_names = industries.select("indstry", F.col("description").alias("li"))
    place_names = places.select(F.col("geoloc").alias("state_cd"), F.col("description").alias("lg"))
    named = (
        spans.filter(dates.overlaps_year(F.col("start_date"), F.col("end_date"), year))
        .join(industry_names, "indstry", "left")
        .join(place_names, "state_cd", "left")
    )
    return (
        named.select(
            "member_id", "birth_year", "start_date", "end_date", "msa_cd",
            labels.decode_sex(F.col("sex")).alias("sex"),
            labels.strip_prefix(F.col("li"), 2).alias("industry"),
            labels.strip_prefix(F.col("lg"), 3).alias("state"),
            F.when((area != "X") & ~area.like("%R%"), area).alias("msa_5"),
        )
        .groupBy("member_id", "birth_year", "sex", "industry", "state", "msa_5")
        .agg(
            F.max(F.when(area.like("%R%"), 1).otherwise(0)).alias("rural"),
            F.max(F.when(area != "X", 1).otherwise(0)).alias("msa_provided"),
            F.min("start_date").alias("start_date"),
            F.max("end_date").alias("end_date"),
        )
    )


def add_state_code(members: DataFrame) -> DataFrame:
    """Replace the state name by its code."""
    return members.withColumn("state_abr", labels.map_state(F.col("state"))).drop("state")
