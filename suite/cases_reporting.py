"""Statistics, comparisons and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import labels
from pairwell.operators import report
from pairwell.plans import report_cohorts
from pairwell.session import materialize
from suite.cases_matching import MATCHED, _NEAR, matched_rows
from suite.cases_selection import ID, TOTALS, cohort_columns, cohort_rows, report_columns, stored_claims
from suite.oracle import greedy_sql, mean2, r2
from suite.registry import case
from suite.tables import UTIL, Tables


def neighbours(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """Rows shaped like a matching: each exposed row with the same month of the
    member whose number follows."""
    rows = (cohort_rows(t) if rows is None else rows).select(*ID, "total_claims_p0", "age")
    exposed = rows.filter("category <> 'control'").withColumn("match_key", labels.label_concat(
        F.col("category"), F.col("member_id"), F.date_format("utc_period", "yyyyMM"), sep="_"))
    partner = exposed.select(
        (F.col("member_id") + 1).alias("member_id"), "utc_period", F.col("category").alias("cohort"), "match_key")
    control = rows.filter("category = 'control'").join(partner, ["member_id", "utc_period"]).withColumn(
        "category", labels.label_concat(F.col("cohort"), "control")).drop("cohort")
    return exposed.unionByName(control.select(*exposed.columns))


_KEY = "category || '_' || member_id || '_' || strftime(utc_period, '%Y%m')"
_NEXT = f"""matched as (
    select member_id, category, utc_period, total_claims_p0, age, {_KEY} as match_key from x_cohorts where category <> 'control'
    union all
    select c.member_id, e.category || ' control', c.utc_period, c.total_claims_p0, c.age, e.match_key
    from x_cohorts c join (select *, {_KEY} as match_key from x_cohorts where category <> 'control') e
      on c.category = 'control' and c.member_id = e.member_id + 1 and c.utc_period = e.utc_period)"""
_STATS = f"""select category, count(*) as record_count, {mean2("total_claims_p0")} as avg_spend, {mean2("age")} as avg_age,
    min(utc_period) as min_period, max(utc_period) as max_period"""
_MEANS = ", ".join(f"{mean2(c)} as {c}" for c in TOTALS)


@case("cohort_stats", f"{_STATS} from x_cohorts group by category")
def _(t: Tables) -> DataFrame:
    return report.cohort_stats(cohort_rows(t))


@case("order_by", f"select * from ({_STATS} from x_cohorts group by category) order by category")
def _(t: Tables) -> DataFrame:
    return report.cohort_stats(cohort_rows(t)).orderBy("category")


@case("limit_preview", "select * from x_events order by person_id, utc_period, category limit 10")
def _(t: Tables) -> DataFrame:
    return t.events.orderBy("person_id", "utc_period", "category").limit(10)


@case("cohort_retention", f"""
    with {_NEXT} select m.category, record_count, cohort_records, {r2("record_count / cohort_records * 100")} as cohort_percent
    from (select category, count(*) as record_count from matched group by 1) m
    join (select category, count(*) as cohort_records from x_cohorts group by 1) using (category)""")
def _(t: Tables) -> DataFrame:
    return report.cohort_retention(neighbours(t), cohort_rows(t))


@case("mean_by_offset", f"select category, {_MEANS} from x_cohorts group by category")
def _(t: Tables) -> DataFrame:
    return report.mean_by_offset(cohort_rows(t), TOTALS)


@case("chart_series", f"""
    unpivot (select category, {_MEANS} from x_cohorts group by category) on {", ".join(TOTALS)} into name series value mean""")
def _(t: Tables) -> DataFrame:
    return report.chart_series(report.mean_by_offset(cohort_rows(t), TOTALS), TOTALS)


_PROFILE = ["med_total", "pharma_total", "total_claims", *UTIL]


@case("yearly_claims_profile", f"""
    select cast(left(service_month, 4) as int) as year, count(*) as record_count,
           {", ".join(f"{mean2(c)} as {c}" for c in _PROFILE)} from x_stored_claims group by 1""")
def _(t: Tables) -> DataFrame:
    stored = stored_claims(t).withColumn("service_month", F.date_format("service_month", "yyyyMM"))
    return report.yearly_profile(stored, _PROFILE)


@case("duplicate_ids", "select o_custkey, o_orderpriority, count(*) as n from orders group by all having count(*) > 1")
def _(t: Tables) -> DataFrame:
    return report.duplicate_ids(t.raw("orders"), ["o_custkey", "o_orderpriority"])


@case("category_counts", "select category, count(*) as n from x_cohorts group by 1")
def _(t: Tables) -> DataFrame:
    return report.category_counts(cohort_rows(t), "category")


def _profile(c: str) -> str:
    return f"""select '{c}' as column_name, count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as stddev,
               cast(min({c}) as double) as min, cast(max({c}) as double) as max,
               {r2(f"stddev_samp({c}) * 4")} as outlier_threshold from lineitem"""


@case("numeric_profile", " union all ".join(
    _profile(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")))
def _(t: Tables) -> DataFrame:
    return report.numeric_profile(t.raw("lineitem"), 4).withColumns({
        "mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


@case("attach_details", f"""
    with {_NEXT} select m.member_id, m.utc_period, m.category, m.category as category_long, match_key, c.sex, c.age_band, c.total_claims_m1
    from matched m left join x_cohorts c on c.member_id = m.member_id and c.utc_period = m.utc_period
    and c.category = case when m.category like '%control%' then 'control' else m.category end""")
def _(t: Tables) -> DataFrame:
    details = cohort_rows(t).select(*ID, "sex", "age_band", "total_claims_m1")
    return report.attach_details(neighbours(t), details, ID)


@case("discarded_anti_join", f"""
    with {_NEXT} select member_id, category, utc_period from x_cohorts c where not exists (
        select 1 from matched m where m.member_id = c.member_id and m.utc_period = c.utc_period
        and case when m.category like '%control%' then 'control' else m.category end = c.category)""")
def _(t: Tables) -> DataFrame:
    rows = cohort_columns(t)
    return report.discarded(rows, neighbours(t, rows), ID).select(*ID)


_DETAILS = f"""details as (
    select m.member_id, m.utc_period, m.category, c.* exclude (member_id, utc_period, category) from matched m
    left join x_cohorts c on c.member_id = m.member_id and c.utc_period = m.utc_period
    and c.category = case when m.category like '%control%' then 'control' else m.category end)"""
_BOTH = f"""both_sets as (
    select member_id, utc_period, 'full ' || category as category, {", ".join(TOTALS)} from x_cohorts
    union all select distinct member_id, utc_period, 'matched ' || category, {", ".join(TOTALS)} from details)"""
_PRE = r2("(total_claims_m3 + total_claims_m2 + total_claims_m1) / 3")
_POST = r2("(" + " + ".join(f"total_claims_p{n}" for n in range(6)) + ") / 6")


@case("full_vs_matched", f"with {_NEXT}, {_DETAILS}, {_BOTH} select category, {_MEANS} from both_sets group by category")
def _(t: Tables) -> DataFrame:
    rows = report_columns(t)
    details = rows.select(*ID, *TOTALS)
    return report.full_vs_matched(details, report.attach_details(neighbours(t, rows), details, ID), TOTALS)


@case("match_and_compare", greedy_sql(_NEAR.format(""), MATCHED + f""", {_DETAILS}, {_BOTH}
    select *, {_PRE} as pmpm_pre, {_POST} as pmpm_post from (select category, {_MEANS} from both_sets group by category)"""))
def match_and_compare(t: Tables) -> DataFrame:
    details = report_columns(t).select(*ID, *TOTALS)
    return report_cohorts.compare(matched_rows(t), details, ID)


# The same on the pairs that the matching found.

def _on_matches(sql: str) -> str:
    return greedy_sql(_NEAR.format(""), MATCHED + sql)


@case("matched_retention", _on_matches("""
    , kept as (select category, count(*) as n from matched where category not like '%control%' group by 1)
    select c.category, c.record_count, coalesce(k.n, 0)::bigint as matched_count
    from (select category, count(*) as record_count from x_cohorts where category <> 'control' group by 1) c
    left join kept k using (category)"""))
def _(t: Tables) -> DataFrame:
    full = cohort_columns(t).filter("category <> 'control'").groupBy("category").agg(F.count("*").alias("record_count"))
    kept = matched_rows(t).filter(~F.col("category").contains("control")).groupBy("category").agg(F.count("*").alias("n"))
    return full.join(kept, "category", "left").select(
        "category", "record_count", F.coalesce("n", F.lit(0).cast("long")).alias("matched_count"))


@case("matched_details", _on_matches("""
    select m.member_id, m.utc_period, m.category, m.category as category_long, match_key, c.sex, c.age_band, c.total_claims_m1
    from matched m left join x_cohorts c on c.member_id = m.member_id and c.utc_period = m.utc_period
    and c.category = case when m.category like '%control%' then 'control' else m.category end"""))
def _(t: Tables) -> DataFrame:
    details = cohort_columns(t).select(*ID, "sex", "age_band", "total_claims_m1")
    pairs = matched_rows(t).select("match_key", "member_id", "category", "utc_period")
    return report.attach_details(pairs, details, ID)


@case("matched_discarded", _on_matches("""
    select member_id, category, utc_period from x_cohorts c where not exists (
        select 1 from matched m where m.member_id = c.member_id and m.utc_period = c.utc_period
        and case when m.category like '%control%' then 'control' else m.category end = c.category)"""))
def _(t: Tables) -> DataFrame:
    return report.discarded(cohort_columns(t), matched_rows(t), ID).select(*ID)


@case("matched_sample", _on_matches("""
    , drawn as (
        select * from matched where category = '1-URGENT'
        order by md5(concat_ws('|', 7, match_key, member_id, category)), match_key limit 3)
    select * from drawn
    union all
    select m.* from matched m join drawn d on d.match_key = m.match_key and m.category = d.category || ' control'"""))
def _(t: Tables) -> DataFrame:
    return report.sample_matches(matched_rows(t), 3, category="1-URGENT", seed=7)


@case("report_overview", _on_matches(f"""
    , kept as (select category, count(*) as record_count from matched where category not like '%control%' group by 1),
    gone as (select category, count(*) as n from x_cohorts c where not exists (
        select 1 from matched m where m.member_id = c.member_id and m.utc_period = c.utc_period
        and case when m.category like '%control%' then 'control' else m.category end = c.category) group by 1)
    select s.*, {r2("cast(k.record_count as double) / s.record_count * 100")} as cohort_percent, coalesce(g.n, 0)::bigint as n_discarded
    from ({_STATS} from x_cohorts group by category) s left join kept k using (category) left join gone g using (category)"""))
def _(t: Tables) -> DataFrame:
    details = report_columns(t).select(*ID, "age", *TOTALS)
    tables = report_cohorts.report(matched_rows(t), details, ID)
    gone = tables["discarded"].groupBy("category").agg(F.count("*").alias("n_discarded"))
    return tables["statistics"].join(tables["retention"].select("category", "cohort_percent"), "category", "left").join(
        gone, "category", "left").withColumn("n_discarded", F.coalesce("n_discarded", F.lit(0).cast("long")))


@case("only_category", f"with {_NEXT} select * from matched where category in ('2-HIGH', '2-HIGH control')")
def _(t: Tables) -> DataFrame:
    return report.only_category(neighbours(t, cohort_columns(t)), "2-HIGH")


@case("match_sample_join", f"""
    with {_NEXT} select c.* from matched c join matched e on e.match_key = c.match_key and c.category = e.category || ' control'
    where e.category not like '%control%'""")
def _(t: Tables) -> DataFrame:
    rows = neighbours(t)
    partner = rows.filter(~F.col("category").contains("control")).select(
        "match_key", labels.label_concat(F.col("category"), "control").alias("category"))
    return rows.join(partner, ["match_key", "category"])


@case("sample_matches", f"""
    with {_NEXT}, drawn as (
        select * from matched where category = '1-URGENT'
        order by md5(concat_ws('|', 7, match_key, member_id, category)), match_key limit 3)
    select * from drawn
    union all
    select m.* from matched m join drawn d on d.match_key = m.match_key and m.category = d.category || ' control'""")
def _(t: Tables) -> DataFrame:
    return report.sample_matches(materialize(neighbours(t), "matched"), 3, category="1-URGENT", seed=7)
