"""Code lists and line extracts from their source tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import dates, labels
from pairwell.functions import fixed_values as fixed

STATUS_COLUMNS = (
    "cd_sys_sts", "cd_sys_concept_sts", "value_set_sts", "value_set_compose_sts",
)


def not_retired(terms: DataFrame, columns: Sequence[str] = STATUS_COLUMNS) -> DataFrame:
    """Terminology rows none of whose states is ``retired``."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.col(c) != "retired")
    return terms.filter(keep)


def value_sets(terms: DataFrame, names: Sequence[str]) -> DataFrame:
    return not_retired(terms).filter(F.col("value_set_nm").isin(*names))


def _described(terms: DataFrame, *extra: Column) -> DataFrame:
    code = F.col("cd_sys_concept_cd")
    return terms.select(
        F.col("value_set_nm").alias("condition"),
        "cd_sys_concept_cd",
        labels.strip_quote(F.col("cd_sys_concept_display")).alias("description"),
        labels.ilike_joiner(code).alias("ilike_joiner"),
        *extra,
    ).distinct()


def condition_codes(
    terms: DataFrame, names: Sequence[str] = fixed.CHRONIC_CONDITIONS
) -> DataFrame:
    """Diagnosis codes of the chronic conditions, with and without dots."""
    return _described(
        value_sets(terms, names), labels.strip_dots(F.col("cd_sys_concept_cd")).alias("ms_diag")
    )


def avoidable_er_codes(
    terms: DataFrame, names: Sequence[str] = fixed.AVOIDABLE_ER_SETS
) -> DataFrame:
    return _described(
        value_sets(terms, names),
        labels.strip_dots(F.col("cd_sys_concept_cd")).alias("ms_joiner"),
        F.lit("Avoidable ER").alias("category"),
    )


def diabetes_drug_codes(
    terms: DataFrame, names: Sequence[str] = fixed.DIABETES_DRUG_SETS
) -> DataFrame:
    return value_sets(terms, names).select(
        F.lit("DIABETES_MELLITUS").alias("condition"), F.col("cd_sys_concept_cd").alias("ndc")
    )


def diabetes_drug_exclusions(
    terms: DataFrame, names: Sequence[str] = fixed.DIABETES_DRUG_EXCLUSION_SETS
) -> DataFrame:
    return value_sets(terms, names).select("cd_sys_concept_cd").distinct()


def utilization_codes(
    revenue: DataFrame,
    places: DataFrame,
    revenue_rules: Sequence[tuple[str, str]] = fixed.REVENUE_RULES,
    place_rules: Sequence[tuple[str, str]] = fixed.PLACE_RULES,
    not_selecting: Sequence[str] = fixed.REVENUE_RULES_NOT_SELECTING,
) -> DataFrame:
    """Revenue codes and places of service with their visit category.

    ``revenue`` has ``code`` and ``description``, ``places`` ``stdplac`` and
    ``description``.
    """
    about = F.col("description")
    selecting = [p for p, _ in revenue_rules if p not in not_selecting]
    by_revenue = revenue.filter(labels.like_any(about, selecting)).select(
        F.lit("").alias("p_code"),
        F.col("code").alias("o_code"),
        labels.revcode_to_r(F.col("code")).alias("r_code"),
        "description",
        labels.like_classify(about, revenue_rules).alias("category"),
    )
    by_place = places.filter(labels.like_any(about, [p for p, _ in place_rules])).select(
        F.col("stdplac").alias("p_code"),
        F.lit("").alias("o_code"),
        F.lit("").alias("r_code"),
        "description",
        labels.like_classify(about, place_rules).alias("category"),
    )
    return by_revenue.unionByName(by_place).distinct()


def med_code_lines(lines: DataFrame, columns: Sequence[str], year: int) -> DataFrame:
    return lines.filter(dates.in_year(F.col("svc_start"), year)).select(
        "member_id", "svc_start", "svc_end", *columns
    )


def rx_code_lines(
    lines: DataFrame, year: int, code_col: str = "ndcnum", *, distinct: bool = False
) -> DataFrame:
    out = lines.filter(dates.in_year(F.col("svcdate"), year)).select("member_id", code_col)
    return out.distinct() if distinct else out


def _between_any(col: Column, ranges: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | col.between(low, high)
    return out


def utilization_days(lines: DataFrame) -> DataFrame:
    """Distinct service days by kind, member and month, from code ranges.

    ``lines`` has ``member_id``, ``svc_start``, ``code_rev``, ``code_cpt``,
    ``code_hcpcs``, ``avoidable_flag`` and ``readmit_days``.  Lines are reduced
    to one row per member and day first, so the counts are plain sums.
    """
    rev, cpt, hcpcs = F.col("code_rev"), F.col("code_cpt"), F.col("code_hcpcs")
    er = (
        rev.isin(*fixed.ER_REVENUE)
        | _between_any(cpt, fixed.ER_CPT_RANGES)
        | _between_any(hcpcs, fixed.ER_HCPCS_RANGES)
    )
    inpatient = (
        _between_any(rev, fixed.INPATIENT_REVENUE_RANGES)
        | rev.isin(*fixed.INPATIENT_REVENUE)
        | _between_any(cpt, fixed.INPATIENT_CPT_RANGES)
    )
    kinds = {
        "er_days": er,
        "avoidable_er_days": er & (F.col("avoidable_flag") == 1),
        "ip_days": inpatient,
        "ip_readmit_days": inpatient & (F.col("readmit_days") > 0),
        "uc_days": rev.isin(*fixed.URGENT_CARE_REVENUE) | hcpcs.isin(*fixed.URGENT_CARE_HCPCS),
        "mamm_screening": rev.isin(*fixed.MAMMOGRAM_REVENUE),
        "ip_surgical_days": rev.isin(*fixed.SURGERY_REVENUE),
        "gen_outpatient_days": rev.isin(*fixed.OUTPATIENT_REVENUE),
    }
    by_day = lines.groupBy("member_id", "svc_start").agg(*[
        F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias(name) for name, hit in kinds.items()
    ])
    return by_day.groupBy(
        "member_id", dates.format_yyyymm(F.col("svc_start")).alias("service_month")
    ).agg(*[F.sum(name).alias(name) for name in kinds])


def conditional_distinct_counts(
    rows: DataFrame, keys: Sequence[str], counted: str, kinds: dict[str, Column]
) -> DataFrame:
    """Distinct values of a column per key and per kind.

    Rows are reduced to one per (keys, value) first, which combines before the
    shuffle; a count of distinct values per kind would expand every row instead.
    """
    by_value = rows.filter(F.col(counted).isNotNull()).groupBy(*keys, counted).agg(*[
        F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias(name)
        for name, hit in kinds.items()
    ])
    return by_value.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in kinds])


def signed_event_count(rows: DataFrame, keys: Sequence[str], counted: Sequence[str]) -> DataFrame:
    """Distinct events per key and event type; reversals count negative."""
    typed = [*keys, "event_type"]
    return (
        rows.select(*typed, *counted).distinct().groupBy(*typed)
        .agg(F.count("*").alias("n"))
        .select(
            *typed,
            F.when(F.col("event_type") == "Neither", F.col("n"))
            .when(F.col("event_type") == "Reversal", -F.col("n"))
            .otherwise(F.lit(0)).alias("count_units"),
        )
    )
