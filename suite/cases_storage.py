"""Sources and sinks: each query writes what it derives and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.operators import claims
from pairwell.session import new_path
from pairwell.sources import readers, sinks
from suite.registry import case
from suite.tables import Tables

#: Service years of the claims.
YEARS = range(1995, 2002)


def _spend(t: Tables) -> DataFrame:
    return claims.spend_by_month(t.med_lines, "svc_start", "med")


def _year(df: DataFrame, year: int) -> DataFrame:
    return df.filter(F.col("service_month").startswith(str(year)))


@case("scan_table", "select c_custkey, c_name, c_acctbal from customer")
def _(t: Tables) -> DataFrame:
    return readers.scan_table(t.spark, f"{t.sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")


@case("scan_query", "select o_custkey as member_id, count(*) as n, max(o_totalprice) as top from orders where o_orderstatus = 'F' group by 1")
def _(t: Tables) -> DataFrame:
    return readers.scan_query(
        t.spark,
        "select o_custkey as member_id, count(*) as n, max(o_totalprice) as top from {orders} "
        "where o_orderstatus = 'F' group by 1",
        tables={"orders": t.raw("orders")})


@case("read_lookup_csv", "select c_mktsegment as edw_cust, 'industry ' || count(*) as industry from customer group by 1")
def _(t: Tables) -> DataFrame:
    path = new_path(t.spark, "industries")
    lookup = t.raw("customer").groupBy(F.col("c_mktsegment").alias("edw_cust")).agg(
        F.concat(F.lit("industry "), F.count("*").cast("string")).alias("industry"))
    lookup.write.csv(path, header=True)
    return readers.read_lookup_csv(t.spark, path)


@case("write_parquet_versioned", """
    select *, cast(left(service_month, 4) as int) as svc_year from x_med_spend""")
def _(t: Tables) -> DataFrame:
    path = new_path(t.spark, "claims_versions")
    for year in YEARS:
        sinks.write_parquet_versioned(_year(_spend(t), year), path, year=year, version=8)
    return t.spark.read.parquet(path).drop("export_ver")


@case("read_as_of_version", """
    select member_id, service_month, med_total, med_total_net, 1998 as svc_year from x_med_spend
    where left(service_month, 4) = '1998' and med_total > 50000""")
def _(t: Tables) -> DataFrame:
    path = new_path(t.spark, "claims_versions")
    rows = _year(_spend(t), 1998)
    sinks.write_parquet_versioned(rows.filter("med_total > 50000"), path, year=1998, version=7)
    sinks.write_parquet_versioned(rows, path, year=1998, version=8)
    return readers.read_as_of_version(t.spark, path, 7)


@case("write_overwrite", "select member_id, service_month, med_total as total from x_med_spend")
def _(t: Tables) -> DataFrame:
    path = new_path(t.spark, "claims")
    sinks.write_overwrite(_spend(t), path)
    sinks.write_overwrite(_spend(t).select("member_id", "service_month", F.col("med_total").alias("total")), path)
    return t.spark.read.parquet(path)


@case("append_merge_schema", """
    select member_id, service_month, med_total, if(left(service_month, 4) < '1998', null, med_total_net) as med_total_net
    from x_med_spend""")
def _(t: Tables) -> DataFrame:
    path = new_path(t.spark, "claims")
    for year in YEARS:
        rows = _year(_spend(t), year)
        rows = rows.drop("med_total_net") if year < 1998 else rows
        sinks.append_batch(rows, path, str(year))
        if year == 1997:  # once more, as after a failure
            sinks.append_batch(rows, path, str(year))
    return sinks.read_merged(t.spark, path)
