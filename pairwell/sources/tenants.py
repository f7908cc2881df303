"""One table spread over many tenant schemas."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwell.functions import fixed_values as fixed
from pairwell.functions import labels

# Tables a tenant schema must hold before it is read.
REQUIRED_TABLES = ("eligibility", "medical", "pharmacy", "utilization")


def union_sources(parts: dict[str, DataFrame], tag: str = "table_schema") -> DataFrame:
    """Concatenate a table that several tenants hold in different places, each row tagged.

    For tenants that are folders beside each other :func:`scan_tenants` reads all at once.
    """
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def scan_tenants(
    spark: SparkSession,
    root: str,
    table: str,
    *,
    schemas: Sequence[str] | None = None,
    columns: StructType | None = None,
    tag: str = "table_schema",
) -> DataFrame:
    """The same table of many tenants in one scan, each row tagged with its tenant.

    Tenants are the folders of ``root``, the table a folder or file within each;
    ``schemas`` names those to read, else all that hold the table.  The tenant
    comes from the path of the file a row was read from, so the plan has one
    scan however many there are.  Columns that some tenants lack are null.
    Without ``columns`` Spark merges the schemas of all files, in parallel.
    """
    base = root.rstrip("/")
    paths = [f"{base}/{s}/{table}" for s in (["*"] if schemas is None else schemas)]
    reader = spark.read.schema(columns) if columns is not None else spark.read.option("mergeSchema", "true")
    folder = F.regexp_extract(
        F.col("_metadata.file_path"), f"/([^/]+)/{re.escape(table)}(/.*)?$", 1)
    rows = reader.parquet(*paths)
    return rows.select("*", F.url_decode(folder).alias(tag))


def sources_with_all_tables(
    catalog: DataFrame,
    required: Sequence[str] = REQUIRED_TABLES,
    *,
    like: str | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Schemas holding every required table, with the third part of their name.

    ``catalog`` has ``table_schema`` and ``table_name``.
    """
    wanted = catalog.filter(F.col("table_name").isin(*required))
    if like:
        wanted = wanted.filter(F.col("table_schema").like(like))
    if exclude:
        wanted = wanted.filter(~F.col("table_schema").isin(*exclude))
    return (
        wanted.groupBy("table_schema")
        .agg(F.count_distinct("table_name").alias("n"))
        .filter(F.col("n") == len(set(required)))
        .select(
            "table_schema",
            F.split_part("table_schema", F.lit("_"), F.lit(3)).alias("acronym"),
        )
    )


def distinct_customers(eligibility: DataFrame, name_col: str = "cg_cust") -> DataFrame:
    return eligibility.select("table_schema", name_col).distinct()


def customer_filter_list(
    members: DataFrame, placeholders: Sequence[str] = fixed.PLACEHOLDER_CUSTOMERS
) -> DataFrame:
    """Distinct employers without placeholders, to restrict extracts by semi join."""
    return members.select("edw_cust").filter(~F.col("edw_cust").isin(*placeholders)).distinct()


def customer_schema_join(
    customers: DataFrame,
    schemas: DataFrame,
    placeholders: Sequence[str] = fixed.PLACEHOLDER_CUSTOMERS,
) -> DataFrame:
    """Employers per schema, with the number of employers sharing it.

    ``customers`` has ``acronym`` and ``cg_cust``; ``schemas`` comes from
    :func:`sources_with_all_tables`.
    """
    named = (
        customers.withColumn("edw_cust", labels.map_customer(F.col("cg_cust")))
        .join(schemas, "acronym")
        .filter(~F.col("edw_cust").isin(*placeholders))
    )
    shared = named.groupBy("table_schema").agg(F.count_distinct("edw_cust").alias("num_cust"))
    return named.join(shared, "table_schema").select(
        "table_schema", "acronym", "edw_cust", "cg_cust", "num_cust"
    )


def customer_member_fallback(
    members: DataFrame,
    customers: DataFrame,
    placeholders: Sequence[str] = fixed.PLACEHOLDER_CUSTOMERS,
) -> DataFrame:
    """Give unnamed members the employer of their schema if it has only one."""
    only = (
        customers.filter(F.col("num_cust") == 1)
        .groupBy("table_schema")
        .agg(F.min("edw_cust").alias("schema_cust"))
    )
    own: Column = labels.map_customer(F.col("dw_customer_nm"))
    return (
        members.join(only, "table_schema", "left")
        .withColumn(
            "edw_cust",
            labels.coalesce_placeholder(own, F.col("schema_cust"), placeholders),
        )
        .drop("table_schema", "dw_customer_nm", "schema_cust")
    )


def industry_left_join(members: DataFrame, industries: DataFrame) -> DataFrame:
    """Industry of the employer; ``unknown`` where the map has none."""
    return members.join(industries, "edw_cust", "left").withColumn(
        "industry", F.coalesce("industry", F.lit("unknown"))
    )
