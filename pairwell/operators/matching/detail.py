"""From matched keys to labelled rows, and the whole matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import labels
from pairwell.operators.matching.assign import greedy_match
from pairwell.operators.matching.candidates import nearest_controls
from pairwell.operators.matching.strata import eligible_points, match_points, strata_counts
from pairwell.session import materialize


def tag_matches(pairs: DataFrame, points: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Pairs with the ids of both sides (``exposed_…``, ``control_…``)."""
    ids = [c for c in id_columns if c != "category"]
    out = pairs
    for side in ("exposed", "control"):
        named = points.select(
            F.col("key").alias(f"{side}_key"), *[F.col(c).alias(f"{side}_{c}") for c in ids]
        )
        out = out.join(named, f"{side}_key")
    return out


def match_key(ids: Sequence[str]) -> Column:
    """``<cohort>_<stratum>_<exposed ids>``: unique over cohorts and strata."""
    return F.concat_ws("_", "cohort", "stratum", *[F.col(c).cast("string") for c in ids])


def detail_matches(
    pairs: DataFrame,
    points: DataFrame,
    features: DataFrame,
    id_columns: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """One row per matched record: match key, ids and matching columns.

    Controls get the category ``<cohort> control``.
    """
    ids = [c for c in id_columns if c != "category"]
    tagged = tag_matches(pairs, points, id_columns).withColumn(
        "match_key", match_key([f"exposed_{c}" for c in ids])
    )
    exposed = tagged.select(
        "match_key", F.col("cohort").alias("category"), F.col("cohort").alias("label"),
        *[F.col(f"exposed_{c}").alias(c) for c in ids],
    ).distinct()
    control = tagged.select(
        "match_key", F.lit("control").alias("category"),
        labels.label_concat(F.col("cohort"), "control").alias("label"),
        *[F.col(f"control_{c}").alias(c) for c in ids],
    )
    rows = exposed.unionByName(control).join(
        features.select(*id_columns, *columns), list(id_columns)
    )
    return rows.withColumn("category", F.col("label")).select("match_key", *id_columns, *columns)


def pair_points(
    points: DataFrame,
    *,
    k: int = 10,
    n_final: int = 1,
    n_list: int = 40,
    n_probe: int = 10,
    exact: bool = True,
    max_distance_sq: float | None = 50.0,
) -> DataFrame:
    """Pairs for all cohorts and strata of ``points``, a written table, in one go.

    Each cohort is matched by itself: it may use any control once.
    """
    usable = eligible_points(points, n_list)
    edges = nearest_controls(
        usable, k=k, n_list=n_list if not exact else None, n_probe=n_probe, exact=exact,
        max_distance_sq=max_distance_sq, written=True,
    )
    cohorts = usable.filter(~F.col("is_control")).select(
        F.col("key").alias("exposed_key"), F.col("category").alias("cohort")
    )
    return greedy_match(edges.join(cohorts, "exposed_key"), n_final=n_final)


def main_match(
    cohorts: DataFrame,
    features: DataFrame,
    id_columns: Sequence[str],
    exact_columns: Sequence[str],
    scaled: Sequence[str],
    final_columns: Sequence[str],
    *,
    only: Sequence[str] | None = None,
    n_list: int = 40,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Matched rows of all cohorts, and the counts per cohort and stratum.

    ``features`` carries scaled columns and the exact columns; ``cohorts`` the
    original values to report.  ``only`` restricts the exposed categories.
    """
    if only is not None:
        features = features.filter(F.col("category").isin(*only, "control"))
    points = materialize(match_points(features, id_columns, exact_columns, scaled), "points")
    pairs = materialize(pair_points(points, n_list=n_list, **options), "pairs")
    matched = detail_matches(pairs, points, cohorts, id_columns, final_columns)
    return matched, strata_counts(points, n_list)
