"""Connected components of links within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.session import materialize


def components(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, component) for every node of ``links`` (keys, a, b): the smallest node reachable.

    Every round each node takes the smallest component beside it, and then the
    component of that; what is known of a path reaches about twice as far after
    each round.  A round is one written table.
    """
    keys = list(keys)
    both = materialize(
        links.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    now = materialize(both.groupBy(*keys, "node").agg(
        F.least("node", F.min("other")).alias("component")), "components")
    while True:
        beside = both.join(now.withColumnRenamed("node", "other"), [*keys, "other"]).groupBy(*keys, "node").agg(
            F.min("component").alias("beside"))
        nearer = now.join(beside, [*keys, "node"]).select(
            *keys, "node", F.col("component").alias("was"), F.least("component", "beside").alias("component"))
        onward = now.select(*keys, F.col("node").alias("component"), F.col("component").alias("onward"))
        step = materialize(nearer.join(onward, [*keys, "component"], "left").select(
            *keys, "node", "was", F.least("component", "onward").alias("component")), "components")
        now = step.select(*keys, "node", "component")
        if step.filter("component <> was").isEmpty():
            return now
