"""Writing tables: versions, replacement, appending with new columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.session import new_path, setting

#: Folder name of a batch of :func:`append_batch`.
BATCH = "append_batch"


def write_parquet_versioned(df: DataFrame, path: str, *, year: int, version: int) -> None:
    """One directory per service year and export version.

    Only the directories being written are replaced, so earlier versions stay
    readable.
    """
    (
        df.withColumns({"svc_year": F.lit(year), "export_ver": F.lit(version)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("svc_year", "export_ver")
        .parquet(path)
    )


def write_by_member(df: DataFrame, table: str, buckets: int, *, path: str | None = None) -> DataFrame:
    """Write a table in buckets of the member, and return it.

    Tables stored with one number of buckets join on the member without being
    shuffled.  A bucket should fit a task's memory several times over; each is
    one file.
    """
    writer = df.repartition(buckets, "member_id").write.bucketBy(buckets, "member_id").sortBy("member_id").mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    # Laid out by member, rows join on the member and a month where they are.
    with setting(df.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        writer.saveAsTable(table)
    return df.sparkSession.table(table)


def materialize_by_member(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Like :func:`pairwell.session.materialize`, in buckets of the member."""
    path = new_path(df.sparkSession, name)
    return write_by_member(df, path.rsplit("/", 1)[1].replace("-", "_"), buckets, path=path)


def write_overwrite(df: DataFrame, path: str) -> None:
    """Replace a table, whatever its former schema."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Append a named batch; columns the table lacks so far are added when it is read.

    A batch has a folder of its own, so one that is written again, after a
    failure or with corrections, replaces itself and no row stands twice.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{BATCH}={batch}")


def append_rows(df: DataFrame, path: str) -> None:
    """Append rows for good: repeated, they stand twice.  :func:`append_batch` can be repeated."""
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Read a table whose files hold different sets of columns, or whose batches do."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop(BATCH)
