"""Feature vectors for matching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import labels
from pairwell.session import materialize


def assemble_vector(df: DataFrame, columns: Sequence[str], out: str = "vector") -> DataFrame:
    """Columns to one ML vector, for use with other ML stages."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def unpack_vector(
    df: DataFrame, vector_col: str, keep: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """ML vector back to columns."""
    values = df.withColumn("_v", vector_to_array(F.col(vector_col)))
    return values.select(*keep, *[F.col("_v")[i].alias(n) for i, n in enumerate(names)])


def scale_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide each column by its sample standard deviation over all rows.

    There is no centring, and a constant column becomes 0.  The deviations come
    from one aggregation that enters the plan as a scalar subquery.
    """
    def deviation(c: str) -> Column:
        # Merged partial deviations of a constant are not exactly 0.
        return F.when(F.min(c) < F.max(c), F.stddev_samp(F.col(c).cast("double")))

    spread = df.agg(F.struct(*[deviation(c).alias(c) for c in columns])).scalar()

    def scaled(c: str) -> Column:
        sd = spread.getField(c)
        return F.when(sd > 0, F.col(c).cast("double") / sd).otherwise(F.lit(0.0))

    return df.withColumns({c: scaled(c) for c in columns})


def one_hot(
    df: DataFrame, id_columns: Sequence[str], values: dict[str, Sequence[str]]
) -> DataFrame:
    """0/1 column ``<column>_<value>`` per listed value; others give all 0."""
    return df.select(*id_columns, *[
        F.coalesce(labels.sanitize_value(F.col(c)) == labels.sanitize_name(v), F.lit(False))
        .cast("int").alias(f"{c}_{labels.sanitize_name(v)}")
        for c, listed in values.items() for v in listed
    ])


def distinct_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df.distinct()`` for wide rows of which few share a key.

    The keys that stand more than once are found on the narrow columns and
    written; only their rows are then compared as a whole.  A written table has
    a known size, so as a rule the wide rows are not shuffled.
    """
    again = materialize(
        df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), "repeated")
    same = reduce(lambda a, b: a & b, [df[f"`{k}`"].eqNullSafe(again[f"`{k}`"]) for k in keys])
    return df.join(again, same, "left_anti").unionByName(df.join(again, same, "left_semi").distinct())


def full_transformation(
    df: DataFrame,
    id_columns: Sequence[str],
    scale: Sequence[str],
    exact: dict[str, Sequence[str]],
    weights: dict[str, float] | None = None,
    binary: Sequence[str] = (),
) -> DataFrame:
    """Ids, 0/1 columns for the exact variables, and scaled, weighted columns.

    One projection over the input.  Repeated rows count once; they are looked
    for by the ids.
    """
    names = list(scale)
    scaled = scale_columns(df.na.fill(0, names), names)
    flags = [
        F.coalesce(labels.sanitize_value(F.col(c)) == labels.sanitize_name(v), F.lit(False))
        .cast("int").alias(f"{c}_{labels.sanitize_name(v)}")
        for c, listed in exact.items() for v in listed
    ]
    weighted = [
        (F.col(c) * F.lit(float((weights or {}).get(c, 1)))).alias(c) for c in names
    ]
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in binary]
    return distinct_by_key(scaled.select(*id_columns, *filled, *flags, *weighted), id_columns)


def stratum_label(columns: Sequence[str]) -> Column:
    """Text of the exact-match values; nulls count as equal to each other."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])


def feature_vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])
