"""Reading tables, queries, lookups and older versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions import dates

LOOKUP_SCHEMA = T.StructType([
    T.StructField("edw_cust", T.StringType()),
    T.StructField("industry", T.StringType()),
])


def scan_table(spark: SparkSession, table: str) -> DataFrame:
    """A catalog table, or a parquet path if ``table`` contains a slash."""
    return spark.read.parquet(table) if "/" in table else spark.table(table)


def scan_query(
    spark: SparkSession,
    query: str,
    *,
    tables: dict[str, DataFrame] | None = None,
    jdbc: dict[str, str] | None = None,
) -> DataFrame:
    """Result of a SQL text.

    With ``jdbc`` options the text is sent to that database; add
    ``partitionColumn``, bounds and ``numPartitions`` to read large results in
    parallel.  Otherwise Spark runs it, with ``tables`` bound to the
    ``{name}`` placeholders in the text.
    """
    if jdbc is None:
        return spark.sql(query, **(tables or {}))
    options = dict(jdbc)
    if "partitionColumn" in options:
        options["dbtable"] = f"({query}) q"
    else:
        options["query"] = query
    return spark.read.format("jdbc").options(**options).load()


def read_lookup_csv(
    spark: SparkSession, path: str, schema: T.StructType = LOOKUP_SCHEMA
) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_as_of_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Rows of one stored version; the filter prunes to its directories."""
    return spark.read.parquet(path).filter(F.col("export_ver") == version).drop("export_ver")


def year_slice(df: DataFrame, date_col: str, year: int) -> DataFrame:
    return df.filter(dates.in_year(F.col(date_col), year))


def year_overlap(df: DataFrame, start_col: str, end_col: str, year: int) -> DataFrame:
    return df.filter(dates.overlaps_year(F.col(start_col), F.col(end_col), year))


def month_table(df: DataFrame, *month_cols: str) -> DataFrame:
    """Parse ``yyyyMM`` columns of a stored table to dates."""
    return df.withColumns({c: dates.parse_yyyymm(F.col(c).cast("string")) for c in month_cols})


def nonzero_pay(df: DataFrame, amount: str, *, positive_only: bool) -> DataFrame:
    """Lines with an amount: any non-zero one, or only positive ones."""
    pay: Column = F.col(amount)
    return df.filter(pay > 0 if positive_only else pay != 0)
