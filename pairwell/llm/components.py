"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import written


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Each round takes the least component among the neighbours, then that
    component's own; a path halves at least every other round.  Rounds are
    written tables.  Minima combine before the shuffle, so a node with a third
    of all links is no more to any task than others.  ``files`` bounds the files of
    a round, for links known to be few.
    """
    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df if files is None else df.coalesce(files), name)

    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    both = kept(links.union(links.select("b", "a")).toDF("node", "other"), "links")
    now = kept(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "components")
    while True:
        near = both.join(now.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
            F.min("component").alias("near"))
        step = now.join(near, "node", "left").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        # A component is the name of a node, which may itself have moved on.
        far = now.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = step.join(far, "component", "left").select(
            "node", "was", F.least("component", "far").alias("component"))
        step = kept(step, "components")
        now = step.select("node", "component")
        if not step.filter("component <> was").limit(1).count():
            return now
