"""Exact-match strata, and the points that are matched within them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.operators.features import feature_vector, stratum_label
from pairwell.session import materialize


def with_keys(df: DataFrame, order: Sequence[str], name: str = "key") -> DataFrame:
    """Number rows so that the numbers ascend in the given order.

    The rows are range-partitioned and sorted, so the number of a row within
    its partition, placed after the number of the partition, follows the order.
    Write the result before using it twice: only the order of the numbers is
    fixed, not their values.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.withColumn(name, F.monotonically_increasing_id())


def match_points(
    features: DataFrame,
    id_columns: Sequence[str],
    exact: Sequence[str],
    scaled: Sequence[str],
) -> DataFrame:
    """Rows to match: key, ids, stratum, cohort and feature vector.

    Keys ascend by member, period and category: the order in which exposed
    rows choose, and in which controls at equal distance are preferred.
    """
    order = sorted(id_columns, key=lambda c: c == "category")
    points = features.select(
        *id_columns,
        stratum_label(exact).alias("stratum"),
        feature_vector(scaled).alias("vec"),
        (F.col("category") == "control").alias("is_control"),
    )
    return with_keys(points, order)


def strata_counts(points: DataFrame, n_list: int) -> DataFrame:
    """Exposed and control rows per cohort and stratum.

    A stratum is matched if it has more controls than ``n_list``.  Strata
    without exposed rows do not occur; those without controls do.
    """
    # One pass over the points; a stratum then has no more rows than there are categories.
    counted = points.groupBy("stratum", "category").agg(
        F.count_if(~F.col("is_control")).alias("exposed_count"), F.count_if("is_control").alias("controls"))
    strata = counted.groupBy("stratum").agg(
        F.collect_list(F.struct(F.col("category").alias("cohort"), "exposed_count")).alias("cohorts"),
        F.sum("controls").alias("controls"))
    known = F.col("stratum").isNotNull() & (F.col("controls") > 0)
    return strata.withColumn("control_count", F.when(known, F.col("controls"))).select(
        F.inline("cohorts"), "stratum", "control_count"
    ).filter("exposed_count > 0").select(
        "cohort", "stratum", "exposed_count", "control_count",
        F.coalesce(F.col("control_count") > n_list, F.lit(False)).alias("kept"),
    )


def eligible_points(points: DataFrame, n_list: int) -> DataFrame:
    """Points of strata with exposed rows and enough controls."""
    kept = points.groupBy("stratum").agg(
        F.count_if("is_control").alias("controls"),
        F.count_if(~F.col("is_control")).alias("exposed"),
    ).filter((F.col("controls") > n_list) & (F.col("exposed") > 0))
    # Written, its size is known: points are not shuffled to be joined with it.
    return points.join(materialize(kept.select("stratum"), "strata"), "stratum", "left_semi")
