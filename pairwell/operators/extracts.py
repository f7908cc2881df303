"""Programme events from membership, communication and programme tables.

All extracts return ``person_id``, ``covrg_id``, ``utc_period`` (``yyyyMM``
text), ``category``, ``sub_category``.  ``customers`` is a DataFrame with
``edw_cust`` and restricts the organisation by semi join; ``start_year`` is an
integer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import dates, labels
from pairwell.functions import fixed_values as fixed

EVENT_COLUMNS = ("person_id", "covrg_id", "utc_period", "category", "sub_category")


def for_customers(df: DataFrame, customers: DataFrame, org_col: str = "org_nm") -> DataFrame:
    names = customers.select(F.col("edw_cust").alias(org_col)).distinct()
    return df.join(names, org_col, "left_semi")


def since(df: DataFrame, start_year: int, month_col: str = "utc_period") -> DataFrame:
    """Months from January of the year on; compares keys, so it can be pushed down."""
    return df.filter(F.col(month_col) >= f"{start_year}01")


def definitely_not_like(col: Column, *patterns: str) -> Column:
    """True only where the text is known and matches none of the patterns."""
    out = F.lit(True)
    for pattern in patterns:
        out = out & ~col.like(pattern)
    return out


def first_per_year(df: DataFrame, keys: Sequence[str], month_col: str, name: str) -> DataFrame:
    """First month per key and calendar year."""
    return df.groupBy(*keys, F.substring(month_col, 1, 4).alias("yr")).agg(
        F.min(month_col).alias(name)
    )


def join_case_insensitive(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, also: Sequence[str] = ()
) -> DataFrame:
    """Equality of the upper-cased keys and of further columns; keeps the
    right side's key."""
    a = left.withColumn("_key", F.upper(left_key)).drop(left_key)
    b = right.withColumn("_key", F.upper(right_key))
    return a.join(b, ["_key", *also]).drop("_key")


def in_service_year(
    df: DataFrame, service_years: DataFrame, month_col: str, org_col: str = "org_nm"
) -> DataFrame:
    """Rows whose month lies in a service year of their organisation.

    An existence test: overlapping service years do not repeat rows.  Periods
    are written out as months, so the join is on equality.
    """
    spans = service_years.select(
        F.upper("org_nm").alias("_org"),
        F.explode(
            F.sequence(
                dates.parse_yyyymm(F.col("svc_period_start")),
                dates.parse_yyyymm(F.col("svc_period_end")),
                F.expr("interval 1 month"),
            )
        ).alias("_month"),
    ).select("_org", dates.format_yyyymm(F.col("_month")).alias("_month")).distinct()
    hit = (F.upper(df[org_col]) == spans["_org"]) & (df[month_col] == spans["_month"])
    return df.join(spans, hit, "left_semi")


def events_spi(
    savings: DataFrame, coverage: DataFrame, customers: DataFrame, start_year: int
) -> DataFrame:
    """Savings events of covered members, minor categories collapsed."""
    wanted = since(savings, start_year).select("covrg_id", "utc_period", "savings_category")
    covered = for_customers(coverage, customers).select("person_id", "covrg_id", "utc_period")
    joined = join_case_insensitive(
        wanted.distinct(), covered.distinct(), "covrg_id", "covrg_id", ["utc_period"]
    )
    return joined.select(
        "person_id", "covrg_id", "utc_period",
        labels.keep_listed(
            F.col("savings_category"), fixed.SAVINGS_CATEGORIES, "other_SPI_event"
        ).alias("category"),
        F.lit("spi_definition").alias("sub_category"),
    ).distinct()


def care_issue_tasks(tasks: DataFrame) -> DataFrame:
    """Valid clinical care tasks; other care education does not count."""
    education = F.col("objective_type") == "Other Care Education"
    return tasks.filter(
        (F.col("task_cd") == "issue")
        & ~F.col("task_status").isin(*fixed.VOID_TASK_STATES)
        & (F.col("deleted_flag") != 1)
        & (F.col("objective_category") == "Care")
        & F.col("objective_type").isNotNull() & ~education
    )


def first_clinical_engagement(
    comms: DataFrame, tasks: DataFrame, customers: DataFrame, start_year: int
) -> DataFrame:
    """First month per coverage and year with a clinical contact on a care task."""
    clinical = for_customers(since(comms, start_year), customers).filter(
        (F.col("clinical_flag") == 1) & F.col("comm_id").isNotNull()
    )
    with_task = clinical.join(
        care_issue_tasks(tasks).select("enctr_id").distinct(), "enctr_id", "left_semi"
    )
    return first_per_year(with_task, ["covrg_id"], "utc_period", "eng_mo")


def events_hcc_clinical(
    coverage: DataFrame, claim_flags: DataFrame, comms: DataFrame, tasks: DataFrame,
    customers: DataFrame, start_year: int,
) -> DataFrame:
    """Clinical engagement before or after the first high-cost month of a year."""
    costly = claim_flags.filter("hcc_flag").select(
        "covrg_id", F.col("adjudication_period").alias("utc_period")
    ).distinct()
    covered = for_customers(since(coverage, start_year), customers).filter(
        F.col("member_flag") == 1
    )
    first_hcc = first_per_year(
        covered.join(costly, ["covrg_id", "utc_period"]), ["covrg_id", "person_id"],
        "utc_period", "hcc_mo",
    )
    engaged = first_clinical_engagement(comms, tasks, customers, start_year)
    return first_hcc.join(engaged, ["covrg_id", "yr"]).select(
        "person_id", "covrg_id", F.col("eng_mo").alias("utc_period"),
        F.lit("HCC Clinical Eng").alias("category"),
        F.when(F.col("hcc_mo") > F.col("eng_mo"), "pre-hcc").otherwise("post-hcc")
        .alias("sub_category"),
    )


def events_funnel(
    funnel: DataFrame, plan_ids: DataFrame, interventions: DataFrame, customers: DataFrame,
    start_year: int, *, case_system: str, closed_label: str = "case closed",
    open_label: str = "no closed case",
) -> DataFrame:
    """Closed programmes, labelled by whether their case was closed too.

    Whether a closed intervention exists is settled before the join, so the
    join adds no rows.
    """
    program = F.col("program")
    closed = for_customers(since(funnel, start_year), customers).filter(
        F.col("closed_on").isNotNull() & F.col("enrolled_on").isNotNull()
        & definitely_not_like(program, *fixed.FUNNEL_EXCLUDED_PATTERNS)
        & ~program.isin(*fixed.FUNNEL_EXCLUDED_PROGRAMS)
    )
    done = interventions.filter(F.col("status") == "Closed").select(
        F.col("enc_id").alias("alt_value")
    ).distinct().withColumn("case_closed", F.lit(True))
    # A plan with both a closed and an unknown case carries both labels.
    cases = (
        plan_ids.filter(F.col("alt_system") == case_system)
        .join(done, "alt_value", "left")
        .select("care_plan_id", F.coalesce("case_closed", F.lit(False)).alias("case_closed"))
        .distinct()
    )
    labelled = closed.join(cases, "care_plan_id", "left")
    return labelled.select(
        "person_id", "covrg_id", "utc_period",
        labels.program_group(program, fixed.NAVIGATION_PROGRAMS, "Care Navigation")
        .alias("category"),
        F.when(F.col("case_closed"), closed_label).otherwise(open_label).alias("sub_category"),
    ).distinct()


def events_engagement(
    comms: DataFrame, coverage: DataFrame, tasks: DataFrame, customers: DataFrame, start_year: int
) -> DataFrame:
    """First engagement per year, replaced by the first clinical one if any.

    Coverage ids are compared with coverage ids.
    """
    engaged = for_customers(since(comms, start_year), customers).filter("engaged_flag")
    per_cover = first_per_year(
        engaged.withColumn("covrg_id", F.upper("covrg_id")), ["covrg_id"], "utc_period", "eng_mo"
    )
    named = join_case_insensitive(
        per_cover, coverage.select("person_id", "covrg_id").distinct(), "covrg_id", "covrg_id"
    )
    clinical = first_clinical_engagement(comms, tasks, customers, start_year).select(
        F.upper("covrg_id").alias("clin_id"), "yr", F.col("eng_mo").alias("clin_mo")
    )
    joined = named.withColumn("clin_id", F.upper("covrg_id")).join(
        clinical, ["clin_id", "yr"], "left"
    )
    is_clinical = F.col("clin_mo").isNotNull()
    return joined.select(
        "person_id", "covrg_id",
        F.coalesce("clin_mo", "eng_mo").alias("utc_period"),
        F.when(is_clinical, "Clinically Engaged").otherwise("Engaged").alias("category"),
        F.lit("Engaged").alias("sub_category"),
    )


def crosswalk(coverage: DataFrame, customers: DataFrame, start_year: int) -> DataFrame:
    """Distinct employer, person and month."""
    return for_customers(since(coverage, start_year), customers).select(
        "org_nm", "person_id", "utc_period"
    ).distinct()


def events_partner_enrollment(
    encounters: DataFrame, service_years: DataFrame, coverage: DataFrame, customers: DataFrame,
    start_year: int,
) -> DataFrame:
    """Encounters with partners that started within a service year."""
    started = since(encounters, start_year).filter(
        F.col("start_date").isNotNull() & F.col("partner").isin(*fixed.PARTNERS)
    ).withColumn("start_month", dates.format_yyyymm(F.col("start_date")))
    valid = in_service_year(started, service_years, "start_month").select(
        "covrg_id", "utc_period", "partner"
    ).distinct()
    covered = for_customers(coverage, customers).filter(F.col("member_flag") == 1).select(
        "person_id", "covrg_id", "utc_period"
    ).distinct()
    partner = F.col("partner")
    return join_case_insensitive(
        valid, covered, "covrg_id", "covrg_id", ["utc_period"]
    ).select(
        "person_id", "covrg_id", "utc_period",
        F.coalesce(labels.lookup(fixed.RENAMED_PARTNERS, partner), partner).alias("category"),
        F.lit("TPE Enrollment").alias("sub_category"),
    ).distinct()


def events_outreach(
    comms: DataFrame, tasks: DataFrame, customers: DataFrame, start_year: int
) -> DataFrame:
    """Successful contacts and the outreach tasks of the same communication.

    Both sides are reduced to distinct keys before they meet, so a
    communication with very many records does not multiply.
    """
    contacted = for_customers(since(comms, start_year), customers).filter(
        F.col("result") == "CONTACT MADE"
    ).select("comm_id", "utc_period").distinct()
    outreach = tasks.filter(
        F.col("task_cd").like("%outreach%")
        & ~F.col("task_status").isin(*fixed.VOID_TASK_STATES)
        & (F.col("deleted_flag") != 1)
    ).select("enctr_id", "person_id", "covrg_id", "objective_type").distinct()
    by_comm = comms.select("comm_id", "enctr_id").distinct().join(outreach, "enctr_id").drop(
        "enctr_id"
    ).distinct()
    return contacted.join(by_comm, "comm_id").select(
        "person_id", "covrg_id", "utc_period",
        F.lit("Outreach").alias("category"), F.col("objective_type").alias("sub_category"),
    ).distinct()


def events_care_visits(
    visits: DataFrame, coverage: DataFrame, service_years: DataFrame, customers: DataFrame,
    start_year: int,
) -> DataFrame:
    """Months with care visits, first of the calendar year or subsequent."""
    by_month = visits.select(
        F.col("person_id").alias("visitor"),
        dates.format_yyyymm(F.col("service_date")).alias("utc_period"),
    ).distinct()
    first = first_per_year(by_month, ["visitor"], "utc_period", "first_mo").select(
        "visitor", F.col("first_mo").alias("utc_period"), F.lit(True).alias("is_first")
    )
    labelled = by_month.join(first, ["visitor", "utc_period"], "left")
    covered = for_customers(since(coverage, start_year), customers).filter(
        F.col("member_flag") == 1
    ).select("person_id", "covrg_id", "org_nm", "utc_period").distinct()
    joined = join_case_insensitive(labelled, covered, "visitor", "person_id", ["utc_period"])
    return in_service_year(joined, service_years, "utc_period").select(
        "person_id", "covrg_id", "utc_period",
        F.lit("Care").alias("category"),
        F.when(F.col("is_first"), "first visit").otherwise("subsequent visits")
        .alias("sub_category"),
    ).distinct()
