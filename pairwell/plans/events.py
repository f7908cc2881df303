"""Programme extracts to one events table, as the cohort selection reads it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import dates
from pairwell.operators.extracts import EVENT_COLUMNS
from pairwell.sources import sinks


def build_events(parts: Sequence[DataFrame]) -> DataFrame:
    """The extracts in one table, months as dates, each event once.

    Rows without a person or a readable month are no events.
    """
    rows = reduce(DataFrame.unionByName, [p.select(*EVENT_COLUMNS) for p in parts])
    month = dates.parse_yyyymm(F.col("utc_period"))
    return rows.withColumn("utc_period", month).filter(
        F.col("person_id").isNotNull() & F.col("utc_period").isNotNull()
    ).distinct()


def append_events(events: DataFrame, path: str) -> None:
    """Add events to a stored table; new columns are allowed."""
    sinks.append_rows(events, path)
