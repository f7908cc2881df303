"""Chronic conditions of members, from diagnoses and drugs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import fixed_values as fixed
from pairwell.functions import labels

DIAGNOSES = ("dx1", "dx2", "dx3", "dx4")


def _listed(codes: DataFrame) -> DataFrame:
    """Codes with their conditions; blanks carry no meaning."""
    return codes.filter(F.col("ms_diag") != "").select("ms_diag", "condition").distinct()


def condition_lookup(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """Lines with the condition of each diagnosis, keeping those with any.

    A code that belongs to two conditions yields two rows, as a join does.
    """
    listed = _listed(codes)
    present = [d for d in DIAGNOSES if d in lines.columns]
    out = lines
    for i, dx in enumerate(present, start=1):
        out = out.join(
            listed.select(F.col("ms_diag").alias(dx), F.col("condition").alias(f"d{i}_condition")),
            dx, "left",
        )
    hits = [f"d{i}_condition" for i in range(1, len(present) + 1)]
    return out.filter(F.coalesce(*hits).isNotNull())


def stack_conditions(cond_lines: DataFrame) -> DataFrame:
    """Condition columns as rows (member, date, condition)."""
    hits = [c for c in cond_lines.columns if c.endswith("_condition")]
    return (
        cond_lines.unpivot(["member_id", "svc_start"], hits, "position", "condition")
        .drop("position")
        .filter(F.col("condition").isNotNull())
    )


def _acute() -> Column:
    acute = fixed.ACUTE_CATEGORIES
    return F.coalesce(F.col("p_category").isin(*acute), F.lit(False)) | F.coalesce(
        F.col("o_category").isin(*acute), F.lit(False)
    )


def util_conditions(cond_lines: DataFrame) -> DataFrame:
    """Conditions that were first diagnosis of an ER or inpatient line."""
    return (
        cond_lines.filter(F.col("d1_condition").isNotNull() & _acute())
        .select("member_id", F.col("d1_condition").alias("condition"))
        .distinct()
    )


def dx_twice(cond_lines: DataFrame) -> DataFrame:
    """Conditions diagnosed on more than one date.

    First and last date differ exactly if there are two, and both combine
    before the shuffle, unlike a distinct count.
    """
    return (
        stack_conditions(cond_lines)
        .groupBy("member_id", "condition")
        .agg(F.min("svc_start").alias("first"), F.max("svc_start").alias("last"))
        .filter(F.col("first") < F.col("last"))
        .select("member_id", "condition")
    )


def drug_lookup_inner(rx_lines: DataFrame, drugs: DataFrame) -> DataFrame:
    """Conditions implied by a drug."""
    listed = drugs.select(F.col("ndc").alias("ndcnum"), "condition").distinct()
    return rx_lines.join(listed, "ndcnum").select("member_id", "condition").distinct()


def conditions_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def member_conditions(lines: DataFrame, codes: DataFrame, rx: DataFrame) -> DataFrame:
    """(member, condition) by any of the three rules, in one aggregation.

    Each diagnosis of a line becomes a row and is joined to the code list once;
    the acute and the two-date rule are then read off the same group.
    ``lines`` has ``p_category`` and ``o_category``; ``rx`` comes from
    :func:`drug_lookup_inner`.
    """
    present = [d for d in DIAGNOSES if d in lines.columns]
    listed = _listed(codes)
    diagnoses = (
        lines.select("member_id", "svc_start", _acute().alias("acute"), *present)
        .unpivot(["member_id", "svc_start", "acute"], present, "position", "ms_diag")
        .join(listed, "ms_diag")
    )
    by_rule = (
        diagnoses.groupBy("member_id", "condition")
        .agg(
            F.min("svc_start").alias("first"), F.max("svc_start").alias("last"),
            F.max(F.col("acute") & (F.col("position") == "dx1")).alias("seen_acute"),
        )
        .filter(F.col("seen_acute") | (F.col("first") < F.col("last")))
        .select("member_id", "condition")
    )
    return conditions_union(by_rule, rx)


def pivot_condition_flags(
    conditions: DataFrame, names: Sequence[str] = fixed.CHRONIC_CONDITIONS, *, year: int | None = None
) -> DataFrame:
    """One row per member with a 0/1 column per condition."""
    lowered = conditions.select("member_id", F.lower("condition").alias("condition"))
    flags = lowered.groupBy("member_id").agg(*[
        F.max((F.col("condition") == n.lower()).cast("int")).alias(labels.snake_name(n))
        for n in names
    ])
    return flags if year is None else flags.withColumn("cal_yr", F.lit(year))
