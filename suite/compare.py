"""Run queries beside their SQL: ``python -m suite.compare [sf] [name …]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

from suite import registry

if TYPE_CHECKING:
    import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("pairwell")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    import duckdb  # only the comparison needs it, not the sessions

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return f"datetime {value}"
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value


def bag(columns: list[str], rows: list) -> list[str]:
    by_name = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in by_name]) for r in rows)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), database(sf_dir)
    queries, sql = registry.queries(), registry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            rows = df.collect()
            took = time.time() - start
            if name not in sql:
                print(f"ROWS  {name}: {len(rows)} rows, {took:.1f}s", flush=True)
                continue
            start = time.time()
            result = con.execute(sql[name])
            names = [d[0] for d in result.description]
            want = bag(names, result.fetchall())
            duck = time.time() - start
            got = bag(df.columns, rows)
            if sorted(names) != sorted(df.columns):
                bad += 1
                print(f"BAD   {name}: columns {sorted(df.columns)} against {sorted(names)}", flush=True)
            elif got != want:
                bad += 1
                print(f"BAD   {name}: {len(got)} rows against {len(want)}", flush=True)
                print("   spark only", sorted(set(got) - set(want))[:3])
                print("   sql only  ", sorted(set(want) - set(got))[:3], flush=True)
            else:
                print(f"ok    {name}: {len(got)} rows, {took:.1f}s, sql {duck:.1f}s", flush=True)
        except Exception as e:  # a broken query must not hide the others
            bad += 1
            print(f"FAIL  {name}: {str(e)[:700]}", flush=True)
    print(f"{bad} not matching")


if __name__ == "__main__":
    main()
