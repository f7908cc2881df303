"""Choosing cohorts, claims around events, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import measures
from pairwell.operators import claims, cohorts, features, report
from pairwell.plans import report_cohorts, select_cohorts
from suite.oracle import LEADING, POST, PRE, SCALED, TRAILING, mean2, r2, wide_columns, wide_sql
from suite.registry import case
from suite.tables import EXCLUDE, EXPOSED, Tables

WINDOWS = select_cohorts.Windows()
ID = ["member_id", "category", "utc_period"]
TOTALS = [measures.offset_name("total_claims", n) for n in range(-PRE, POST + 1)]

MATCHING = [*ID, "age_band", "sex", *SCALED]


def stored_claims(t: Tables) -> DataFrame:
    return t.stored_by_member("claims", lambda: t.claims)


def stored_flags(t: Tables) -> DataFrame:
    return t.stored_by_member("flags", lambda: t.flags)


def exposed(t: Tables) -> DataFrame:
    return select_cohorts.select_exposed(t.events, t.members, stored_claims(t), EXPOSED, EXCLUDE, WINDOWS)


def control(t: Tables) -> DataFrame:
    return cohorts.control_months(t.members, stored_claims(t), WINDOWS.eval_pre, WINDOWS.eval_post)


def wide_exposed(t: Tables) -> DataFrame:
    wide = claims.claims_panel(
        exposed(t).select("member_id", "utc_period"), stored_claims(t), LEADING, TRAILING, PRE, POST)
    return claims.remove_negatives(wide, wide_columns())


def build_cohorts(t: Tables) -> DataFrame:
    claim_rows, flags = stored_claims(t), stored_flags(t)
    return select_cohorts.build_cohorts(
        exposed(t), control(t), claim_rows, claim_rows, flags, flags, WINDOWS, LEADING, TRAILING, buckets=t.buckets)


def cohort_rows(t: Tables) -> DataFrame:
    return t.stored("cohorts", lambda: build_cohorts(t))


def cohort_columns(t: Tables) -> DataFrame:
    """All cohort rows with the columns that matching reads, for queries that need no others."""
    return t.stored_part("cohorts", "matching", lambda: build_cohorts(t), MATCHING)


def report_columns(t: Tables) -> DataFrame:
    """The same with the months that reports read."""
    return t.stored_part(
        "cohorts", "report", lambda: build_cohorts(t), [*MATCHING, *[c for c in TOTALS if c not in MATCHING]])


@case("clean_window_anti_join", "select * from x_clean")
def _(t: Tables) -> DataFrame:
    return cohorts.clean_exposed(t.events, EXPOSED, EXCLUDE, 3, 0)


@case("clean_window_shared_lists", """
    select e.* from x_events e where e.category in ('1-URGENT', '2-HIGH', '3-MEDIUM') and not exists (
        select 1 from x_events o where o.person_id = e.person_id and o.category in ('2-HIGH', '3-MEDIUM', '5-LOW')
        and o.category <> e.category
        and o.utc_period between e.utc_period - interval 2 month and e.utc_period + interval 1 month)""")
def _(t: Tables) -> DataFrame:
    return cohorts.clean_exposed(
        t.events, ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["2-HIGH", "3-MEDIUM", "5-LOW"], 2, 1)


@case("claims_window", """
    select e.* from x_events e, x_range where e.utc_period - interval 3 month >= first_month
    and e.utc_period + interval 5 month <= last_month""")
def _(t: Tables) -> DataFrame:
    return cohorts.within_claims(t.events, stored_claims(t), 3, 5)


@case("eligibility_interval_join", """
    select e.person_id, e.utc_period, e.category, m.member_id, m.edw_cust, m.state, m.sex, m.birth_year
    from x_events e join x_members m on e.person_id = m.person_id
    and e.utc_period - interval 3 month >= m.start_date and e.utc_period + interval 5 month <= m.end_date""")
def _(t: Tables) -> DataFrame:
    return cohorts.eligible(t.events, t.members, 3, 5)


@case("limit_exposed", "select * from x_exposed")
def _(t: Tables) -> DataFrame:
    return exposed(t)


@case("customer_semi_join", "select * from x_exposed where edw_cust in (select edw_cust from x_customers)")
def _(t: Tables) -> DataFrame:
    return select_cohorts.select_exposed(
        t.events, t.members, stored_claims(t), EXPOSED, EXCLUDE, WINDOWS, customers=t.customers)


@case("control_month_grid", "select * from x_control")
def _(t: Tables) -> DataFrame:
    return control(t)


@case("shifted_anti_join", """
    select c.* from x_control c where not exists (
        select 1 from x_events e where e.person_id = c.person_id and e.category in ('1-URGENT', '2-HIGH', '5-LOW')
        and c.utc_period between e.utc_period and e.utc_period + interval 8 month)""")
def _(t: Tables) -> DataFrame:
    listed = t.events.filter(F.col("category").isin(EXPOSED + EXCLUDE))
    return cohorts.drop_after_events(control(t), listed, PRE + POST)


@case("claims_range_join", """
    select p.member_id, p.utc_period, p.category, c.service_month, c.total_claims, c.er
    from x_exposed p join x_claims c on c.member_id = p.member_id
    and c.service_month between p.utc_period - interval 3 month and p.utc_period + interval 5 month""")
def _(t: Tables) -> DataFrame:
    return claims.merge_claims(
        exposed(t).select(*ID), stored_claims(t).select("member_id", "service_month", "total_claims", "er"), PRE, POST)


@case("pivot_claims", wide_sql("x_exposed"))
def _(t: Tables) -> DataFrame:
    rows = exposed(t).select("member_id", "utc_period").distinct()
    merged = claims.merge_claims(rows, stored_claims(t), PRE, POST)
    return claims.remove_negatives(
        claims.pivot_claims(merged, LEADING, TRAILING, PRE, POST), wide_columns())


@case("claims_panel", "select * from x_wide")
def _(t: Tables) -> DataFrame:
    return wide_exposed(t)


@case("claims_panel_control", wide_sql("x_control"))
def _(t: Tables) -> DataFrame:
    wide = claims.claims_panel(
        control(t).select("member_id", "utc_period"), stored_claims(t), LEADING, TRAILING, PRE, POST)
    return claims.remove_negatives(wide, wide_columns())


@case("remove_negatives", """
    select member_id, service_month, m, n from (select member_id, service_month, med_total - 50000 as m, pharma_total - 20000 as n from x_spend)
    where m >= 0 and n >= 0""")
def _(t: Tables) -> DataFrame:
    shifted = stored_claims(t).select(
        "member_id", F.date_format("service_month", "yyyyMM").alias("service_month"),
        (F.col("med_total") - 50000).alias("m"), (F.col("pharma_total") - 20000).alias("n"))
    return claims.remove_negatives(shifted, ["m", "n"])


@case("features_join", """
    select e.member_id, e.category, e.utc_period, w.total_claims_p0, coalesce(f.asthma, 0) as asthma, coalesce(f.copd, 0) as copd
    from x_exposed e join x_wide w using (member_id, utc_period) left join x_flags f on f.member_id = e.member_id""")
def _(t: Tables) -> DataFrame:
    joined = cohorts.features_join(exposed(t), wide_exposed(t), stored_flags(t))
    return joined.select(*ID, "total_claims_p0", "asthma", "copd")


@case("union_by_position", "select * from x_clean")
def _(t: Tables) -> DataFrame:
    parts = [cohorts.clean_exposed(t.events, [c], EXCLUDE, 3, 0) for c in EXPOSED]
    return parts[0].unionByName(parts[1])


@case("union_by_name", """
    select member_id, category, utc_period, edw_cust from x_exposed
    union all select member_id, category, utc_period, edw_cust from x_control""")
def _(t: Tables) -> DataFrame:
    columns = [*ID, "edw_cust"]
    return exposed(t).select(*columns).unionByName(control(t).select(*columns))


@case("union_missing_columns", """
    select member_id, category, utc_period, 1 as is_exposed from x_exposed
    union all select member_id, category, utc_period, null from x_control""")
def _(t: Tables) -> DataFrame:
    return exposed(t).select(*ID, F.lit(1).alias("is_exposed")).unionByName(
        control(t).select(*ID), allowMissingColumns=True)


@case("distinct_rows", "select distinct o_custkey, o_orderstatus from orders")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_custkey", "o_orderstatus").distinct()


@case("outlier_filter", "select member_id, category, utc_period, age, total_claims_p0 from x_cohorts")
def _(t: Tables) -> DataFrame:
    return cohort_rows(t).select(*ID, "age", "total_claims_p0")


@case("build_cohorts", "select * exclude (person_id) from x_cohorts")
def _(t: Tables) -> DataFrame:
    return build_cohorts(t).drop("person_id")


@case("event_categories", """
    select category, count(*) as n from (select unnest(list_sort(list_distinct(list(category)))) as category from x_events) group by 1""")
def _(t: Tables) -> DataFrame:
    listed = cohorts.event_categories(t.events).select(F.explode("categories").alias("category"))
    return report.category_counts(listed, "category")


@case("claims_min_max", "select * from x_range")
def _(t: Tables) -> DataFrame:
    return claims.claims_range(stored_claims(t))


@case("max_flags", """
    select c_nationkey as member_id, max(case when c_acctbal < 0 then 1 else 0 end) as asthma,
           max(case when c_mktsegment = 'BUILDING' then 1 else 0 end) as copd from customer group by 1""")
def _(t: Tables) -> DataFrame:
    yearly = t.raw("customer").select(
        F.col("c_nationkey").alias("member_id"), (F.col("c_acctbal") < 0).cast("int").alias("asthma"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("copd"), (F.col("c_custkey") % 3).alias("cal_yr"))
    return cohorts.max_flags(yearly)


@case("one_hot_by_id", """
    select member_id, category, utc_period,
           case when age_band = '18-39' then 1 else 0 end as age_band_1839,
           case when age_band = '40-59' then 1 else 0 end as age_band_4059,
           case when age_band = '60+' then 1 else 0 end as age_band_60,
           case when sex = 'M' then 1 else 0 end as sex_m, case when sex = 'F' then 1 else 0 end as sex_f
    from x_cohorts""")
def _(t: Tables) -> DataFrame:
    return features.one_hot(
        cohort_rows(t), ID, {"age_band": ["18-39", "40-59", "60+"], "sex": ["M", "F"]})


@case("scale_vector", """
    select member_id, category, utc_period, round(total_claims_m1 / s1, 6) as total_claims_m1,
           round(age / s2, 6) as age, cast(0 as double) as flat
    from x_cohorts, (select stddev_samp(total_claims_m1) as s1, stddev_samp(age) as s2 from x_cohorts)""")
def _(t: Tables) -> DataFrame:
    rows = cohort_rows(t).select(*ID, "total_claims_m1", "age", F.lit(7).alias("flat"))
    return features.scale_columns(rows, ["total_claims_m1", "age", "flat"]).select(
        *ID, F.round("total_claims_m1", 6).alias("total_claims_m1"), F.round("age", 6).alias("age"), "flat")


@case("full_transformation", """
    select distinct member_id, category, utc_period, copd, case when sex = 'M' then 1 else 0 end as sex_m,
           round(total_claims_p0 / s1 * 3.0, 6) as total_claims_p0, round(age / s2, 6) as age
    from x_cohorts, (select stddev_samp(total_claims_p0) as s1, stddev_samp(age) as s2 from x_cohorts)""")
def _(t: Tables) -> DataFrame:
    ready = features.full_transformation(
        cohort_rows(t), ID, ["total_claims_p0", "age"], {"sex": ["M"]}, {"total_claims_p0": 3}, ["copd"])
    return ready.withColumns({c: F.round(c, 6) for c in ("total_claims_p0", "age")})


_PMPM = ", ".join(f"{mean2(c)} as {c}" for c in TOTALS)
_PRE = r2("(" + " + ".join(f"total_claims_m{n}" for n in (3, 2, 1)) + ") / 3")
_POST = r2("(" + " + ".join(f"total_claims_p{n}" for n in range(6)) + ") / 6")
SPEND_SQL = f"""
    select *, {_PRE} as pmpm_pre, {_POST} as pmpm_post from (
        select category, {_PMPM} from x_exposed join x_wide using (member_id, utc_period) group by category)"""


@case("spend_around_events", SPEND_SQL)
def spend_around_events(t: Tables) -> DataFrame:
    return report_cohorts.spend_around_events(
        t.events, t.members, stored_claims(t), EXPOSED, EXCLUDE, WINDOWS, buckets=t.buckets)


@case("pmpm", f"""
    select *, {_PRE} as pmpm_pre, {_POST} as pmpm_post from (
        select sex, {_PMPM} from x_cohorts group by sex)""")
def _(t: Tables) -> DataFrame:
    means = report.mean_by_offset(cohort_rows(t), TOTALS, ["sex"])
    return measures.pmpm(means, "total_claims", PRE, POST)
