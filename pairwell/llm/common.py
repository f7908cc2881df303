"""Helpers the operators share: column names, folders, written steps."""

from __future__ import annotations

import gc
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.session import materialize

#: White space of the word rules: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], base: str) -> str:
    """``base``, lengthened until no column of that name exists (case ignored)."""
    names = {n.lower() for n in taken}
    while base.lower() in names:
        base += "_"
    return base


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: ``written(df, name)``: the table written to the folder in
#: ``spark.checkpoint.dir`` and read back.  It outlives lost executors, is
#: computed once and cuts the lineage of what follows.
written = materialize


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps already written.

    It deletes them once the driver has collected the plans that made them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
