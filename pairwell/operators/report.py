"""Statistics and comparisons of cohorts before and after matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions import labels, measures
from pairwell.operators.features import distinct_by_key


def cohort_stats(df: DataFrame, spend: str = "total_claims_p0") -> DataFrame:
    """Rows, mean spend at the event, mean age and period range per category."""
    return df.groupBy("category").agg(
        F.count("*").alias("record_count"),
        measures.mean2(spend).alias("avg_spend"),
        measures.mean2("age").alias("avg_age"),
        F.min("utc_period").alias("min_period"),
        F.max("utc_period").alias("max_period"),
    )


def cohort_retention(matched: DataFrame, original: DataFrame) -> DataFrame:
    """Share of each original cohort that was matched, in percent."""
    kept = matched.groupBy("category").agg(F.count("*").alias("record_count"))
    had = original.groupBy("category").agg(F.count("*").alias("cohort_records"))
    return kept.join(had, "category").withColumn(
        "cohort_percent",
        measures.round2(F.col("record_count") / F.col("cohort_records") * 100),
    )


def mean_by_offset(
    df: DataFrame, columns: Sequence[str], group: Sequence[str] = ("category",)
) -> DataFrame:
    """Mean of each column per group."""
    return df.groupBy(*group).agg(*[measures.mean2(c).alias(c) for c in columns])


def chart_series(means: DataFrame, columns: Sequence[str], group: str = "category") -> DataFrame:
    """Means by offset in long form: one point per group and column."""
    return means.unpivot([group], list(columns), "series", "mean")


def yearly_profile(claims: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and means per service year."""
    year = F.substring("service_month", 1, 4).cast("int").alias("year")
    return claims.groupBy(year).agg(
        F.count("*").alias("record_count"), *[measures.mean2(c).alias(c) for c in columns]
    )


def duplicate_ids(df: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*id_columns).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def category_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def numeric_profile(df: DataFrame, multiplier: float) -> DataFrame:
    """Count, mean, deviation, extremes and outlier threshold per numeric column.

    The threshold is deviation × multiplier; the mean is not added.  Columns
    whose maximum is at most 1 (flags) are left out.  One aggregation; the
    result is one row per column.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    per_column = df.agg(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(c).alias("count"),
            F.avg(F.col(c).cast("double")).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("stddev"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        ).alias(f"_{i}")
        for i, c in enumerate(names)
    ])
    stacked = per_column.select(
        F.explode(F.array(*[F.col(f"_{i}") for i in range(len(names))])).alias("s")
    ).select("s.*")
    return stacked.filter(F.col("max") > 1).withColumn(
        "outlier_threshold", measures.round2(F.col("stddev") * multiplier)
    )


def attach_details(
    matched: DataFrame, details: DataFrame, id_columns: Sequence[str]
) -> DataFrame:
    """Details of matched rows; keeps the long label and the match key.

    Controls are looked up under ``control`` and labelled afterwards.  The key
    columns of details are made unique first, so the join adds no rows.
    """
    keyed = matched.select(
        *[c for c in id_columns if c != "category"],
        F.col("category").alias("category_long"),
        labels.collapse_control_label(F.col("category")).alias("category"),
        "match_key",
    )
    # Of repeated details the least row counts, whatever the partitioning.
    others = [c for c in details.columns if c not in id_columns]
    wanted = details.join(keyed.select(*id_columns).distinct(), list(id_columns), "left_semi")
    rows = wanted.groupBy(*id_columns).agg(F.min(F.struct(*others)).alias("row")).select(
        *id_columns, "row.*"
    ) if others else wanted.distinct()
    return keyed.join(rows, list(id_columns), "left").withColumn("category", F.col("category_long"))


def discarded(details: DataFrame, matched: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Cohort rows that were not matched; control labels are collapsed first."""
    used = matched.select(
        *[c for c in id_columns if c != "category"],
        labels.collapse_control_label(F.col("category")).alias("category"),
    ).distinct()
    return details.join(used, list(id_columns), "left_anti")


def full_vs_matched(
    details: DataFrame, matched_details: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Means of all cohort rows and of the matched ones, side by side."""
    keep = ["member_id", "utc_period", "category", *columns]
    def part(df: DataFrame, label: str) -> DataFrame:
        named = labels.label_concat(label, F.col("category"))
        return distinct_by_key(df.select(*keep), keep[:3]).withColumn("category", named)

    return mean_by_offset(part(details, "full").unionByName(part(matched_details, "matched")), columns)


def only_category(df: DataFrame, category: str) -> DataFrame:
    """A category and its control; compared as a whole, not as substring."""
    return df.filter(F.col("category").isin(category, f"{category} control"))


def sample_matches(
    matched: DataFrame, n: int, *, category: str | None = None, seed: int = 0
) -> DataFrame:
    """``n`` exposed rows, drawn by the MD5 of seed and key, with their controls.

    A seed fixes the draw whatever the partitioning.
    """
    is_control: Column = F.col("category").contains("control")
    rows = matched if category is None else only_category(matched, category)
    named = F.concat_ws("|", F.lit(seed), "match_key", F.col("member_id").cast("string"), "category")
    order = [F.md5(named.cast("binary")), F.col("match_key")]
    exposed = rows.filter(~is_control).orderBy(*order).limit(n)
    partner = exposed.select(
        "match_key", labels.label_concat(F.col("category"), "control").alias("category")
    )
    return exposed.unionByName(
        rows.filter(is_control).join(partner, ["match_key", "category"], "left_semi")
    )
