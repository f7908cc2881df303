"""All code lists, derived from the terminology and stored as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairwell.functions import fixed_values as fixed
from pairwell.operators import code_lists
from pairwell.session import materialize
from pairwell.sources import sinks

SETS = (
    *fixed.CHRONIC_CONDITIONS, *fixed.AVOIDABLE_ER_SETS, *fixed.DIABETES_DRUG_SETS, *fixed.DIABETES_DRUG_EXCLUSION_SETS,
)


def build_code_tables(terms: DataFrame, revenue: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """The code lists by name.

    The terminology is read once: what any list needs of it is written, and all
    lists come from that.
    """
    needed = materialize(code_lists.value_sets(terms, SETS), "terms")
    return {
        "condition_codes": code_lists.condition_codes(needed),
        "avoidable_er_codes": code_lists.avoidable_er_codes(needed),
        "diabetes_drug_codes": code_lists.diabetes_drug_codes(needed),
        "diabetes_drug_exclusions": code_lists.diabetes_drug_exclusions(needed),
        "utilization_codes": code_lists.utilization_codes(revenue, places),
    }


def store_code_tables(terms: DataFrame, revenue: DataFrame, places: DataFrame, path: str) -> dict[str, DataFrame]:
    """Write the code lists to folders of ``path``, replacing earlier ones, and read them back."""
    tables = build_code_tables(terms, revenue, places)
    for name, df in tables.items():
        sinks.write_overwrite(df, f"{path}/{name}")
    return {name: df.sparkSession.read.parquet(f"{path}/{name}") for name, df in tables.items()}
