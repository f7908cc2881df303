"""Session settings, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Compressed input for one shuffle partition or bucket; rows take about ten times as much in memory.
_PARTITION_BYTES = 8 << 20

_SETTINGS = {
    # Month keys and epoch seconds must not depend on where the driver runs.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key may hold a third of all rows: split it even where that costs
    # one more shuffle further up the plan.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Wide feature projections exceed what the JVM compiles as one method and
    # would run interpreted; past this size operators compile separately.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def partitions_for(spark: SparkSession, paths: Sequence[str]) -> int:
    """Shuffle partitions for the files of ``paths``: the session's, or one for every ``_PARTITION_BYTES``.

    What a task holds then stays the same however large the tables are.  The
    files' lengths are listed, not their content.
    """
    sizes = spark.read.format("binaryFile").load(list(paths)).agg(F.sum("length")).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes // _PARTITION_BYTES))


def raise_partitions(spark: SparkSession, number: int) -> None:
    """Let shuffles start with ``number`` partitions at least; adaptive execution joins small ones."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if number > int(now):
        spark.conf.set(name, str(number))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by ``keys`` over as many partitions as shuffles start with.

    Adaptive execution joins partitions by their bytes; it leaves these alone.
    For work in Python that takes long for its size.
    """
    conf = df.sparkSession.conf
    number = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return df.repartition(int(number or conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for the queries that are run meanwhile."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A session on one machine may leave it unset: it then gets a folder in the
    session's warehouse, removed when the program ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", folder)
    atexit.register(shutil.rmtree, folder.removeprefix("file:"), ignore_errors=True)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several later steps or a loop.  A written table
    survives the loss of executors, is computed once, and has a known size, so
    Catalyst can choose join strategies from facts.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
