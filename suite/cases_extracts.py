"""Programme events.

The SQL states each rule over the fixtures: who is meant by existence tests,
service years as sets of months, and firsts by windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import fixed_values as fixed
from pairwell.operators import extracts
from pairwell.plans import events
from pairwell.session import materialize, new_path
from pairwell.sources import sinks
from suite.registry import body, case
from suite.tables import Tables

YEAR = 1996


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def customer_of(row: str) -> str:
    return f"exists (from x_customers k where k.edw_cust = {row}.org_nm)"


SERVICE_MONTHS = """service_months as (
        select distinct upper(org_nm) as org, strftime(unnest(generate_series(
                   strptime(svc_period_start, '%Y%m'), strptime(svc_period_end, '%Y%m'), interval 1 month)), '%Y%m') as month
        from x_service_years)"""


@case("events_spi", f"""
    with events as (
        select distinct upper(covrg_id) as cover, utc_period as month,
               if(savings_category in {listed(fixed.SAVINGS_CATEGORIES)}, savings_category, 'other_SPI_event') as kind
        from x_savings where utc_period >= '{YEAR}01')
    select distinct person_id, covrg_id, utc_period, kind as category, 'spi_definition' as sub_category
    from x_coverage m, events
    where cover = upper(m.covrg_id) and month = m.utc_period and {customer_of("m")}""")
def _(t: Tables) -> DataFrame:
    return extracts.events_spi(t.savings, t.coverage, t.customers, YEAR)


@case("join_case_insensitive", """
    with savings as (select upper(covrg_id) as cover, utc_period as month, savings_category from x_savings)
    select savings_category, person_id, covrg_id, utc_period
    from x_coverage m join savings on cover = upper(m.covrg_id) and month = m.utc_period""")
def _(t: Tables) -> DataFrame:
    return extracts.join_case_insensitive(
        t.savings, t.coverage.select("person_id", "covrg_id", "utc_period"), "covrg_id", "covrg_id", ["utc_period"])


@case("first_event_per_year", """
    select person_id, substr(utc_period, 1, 4) as yr, min(utc_period) as first_mo from x_coverage group by all""")
def _(t: Tables) -> DataFrame:
    return extracts.first_per_year(t.coverage, ["person_id"], "utc_period", "first_mo")


@case("events_hcc_clinical", f"""
    with costly as (
        select person_id, covrg_id, substr(utc_period, 1, 4) as in_year, min(utc_period) as first_costly
        from x_coverage m
        where member_flag = 1 and utc_period >= '{YEAR}01' and {customer_of("m")} and exists (
            from x_claim_flags c where c.hcc_flag and c.covrg_id = m.covrg_id and c.adjudication_period = m.utc_period)
        group by all)
    select person_id, covrg_id, first_contact as utc_period, 'HCC Clinical Eng' as category,
           if(first_contact < first_costly, 'pre-hcc', 'post-hcc') as sub_category
    from costly join x_first_clinical using (covrg_id, in_year)""")
def _(t: Tables) -> DataFrame:
    return extracts.events_hcc_clinical(t.coverage, t.claim_flags, t.comms, t.tasks, t.customers, YEAR)


@case("events_funnel", f"""
    with outcomes as (
        select distinct care_plan_id, exists (
                   from x_interventions i where i.enc_id = p.alt_value and i.status = 'Closed') as was_closed
        from x_plan_ids p where alt_system = 'case-system'),
    finished as (
        select * from x_funnel f
        where closed_on is not null and enrolled_on is not null and utc_period >= '{YEAR}01' and {customer_of("f")}
          and program not in {listed(fixed.FUNNEL_EXCLUDED_PROGRAMS)}
          and not regexp_matches(program, '{"|".join(x.strip("%") for x in fixed.FUNNEL_EXCLUDED_PATTERNS)}'))
    select distinct person_id, covrg_id, utc_period,
           if(program in {listed(fixed.NAVIGATION_PROGRAMS)}, 'Care Navigation', program) as category,
           if(was_closed, 'case closed', 'no closed case') as sub_category
    from finished left join outcomes using (care_plan_id)""")
def _(t: Tables) -> DataFrame:
    return extracts.events_funnel(
        t.funnel, t.plan_ids, t.interventions, t.customers, YEAR, case_system="case-system")


@case("left_join_absence_label", """
    with plans as (select l_orderkey as care_plan_id, l_orderkey * 10 + l_linenumber as enc_id from lineitem)
    select distinct care_plan_id, if(exists (
               from x_interventions i where i.enc_id = plans.enc_id and i.status = 'Closed'), 'closed', 'open') as label
    from plans""")
def _(t: Tables) -> DataFrame:
    done = t.interventions.filter("status = 'Closed'").select("enc_id").distinct()
    plans = t.plan_ids.select("care_plan_id", F.col("alt_value").alias("enc_id"))
    return plans.join(done.withColumn("done", F.lit(True)), "enc_id", "left").select(
        "care_plan_id", F.when(F.col("done").isNull(), "open").otherwise("closed").alias("label")).distinct()


@case("events_engagement", f"""
    with contacts as (
        select upper(covrg_id) as cover, substr(utc_period, 1, 4) as in_year, min(utc_period) as first_any
        from x_comms c where engaged_flag and utc_period >= '{YEAR}01' and {customer_of("c")} group by all),
    clinical as (select upper(covrg_id) as cover, in_year, first_contact from x_first_clinical),
    members as (select distinct person_id, covrg_id, upper(covrg_id) as cover from x_coverage)
    select person_id, covrg_id, coalesce(first_contact, first_any) as utc_period,
           if(first_contact is null, 'Engaged', 'Clinically Engaged') as category, 'Engaged' as sub_category
    from members join contacts using (cover) left join clinical using (cover, in_year)""")
def _(t: Tables) -> DataFrame:
    return extracts.events_engagement(t.comms, t.coverage, t.tasks, t.customers, YEAR)


@case("crosswalk", f"""
    select org_nm, person_id, utc_period from x_coverage m
    where utc_period >= '{YEAR}01' and {customer_of("m")} group by all""")
def _(t: Tables) -> DataFrame:
    return extracts.crosswalk(t.coverage, t.customers, YEAR)


@case("events_partner_enrollment", f"""
    with {SERVICE_MONTHS},
    started as (
        select distinct upper(covrg_id) as cover, utc_period as month, partner from x_encounters e
        where partner in {listed(fixed.PARTNERS)} and utc_period >= '{YEAR}01' and exists (
            from service_months s where s.org = upper(e.org_nm) and s.month = strftime(e.start_date, '%Y%m')))
    select distinct person_id, covrg_id, utc_period,
           {" ".join(f"if(partner = '{a}', '{b}', partner)" for a, b in fixed.RENAMED_PARTNERS.items())} as category,
           'TPE Enrollment' as sub_category
    from x_coverage m join started on cover = upper(m.covrg_id) and month = m.utc_period
    where member_flag = 1 and {customer_of("m")}""")
def _(t: Tables) -> DataFrame:
    return extracts.events_partner_enrollment(t.encounters, t.service_years, t.coverage, t.customers, YEAR)


@case("service_year_range_join", f"""
    with {SERVICE_MONTHS}
    select person_id, org_nm, utc_period from x_coverage m
    where exists (from service_months s where s.org = upper(m.org_nm) and s.month = m.utc_period)""")
def _(t: Tables) -> DataFrame:
    rows = t.coverage.select("person_id", "org_nm", "utc_period")
    return extracts.in_service_year(rows, t.service_years, "utc_period")


@case("events_outreach", f"""
    with reached as (
        select distinct comm_id, utc_period from x_comms c
        where result = 'CONTACT MADE' and utc_period >= '{YEAR}01' and {customer_of("c")}),
    asked as (
        select distinct comm_id, person_id, x_tasks.covrg_id, objective_type from x_tasks join x_comms using (enctr_id)
        where contains(task_cd, 'outreach') and deleted_flag <> 1 and task_status not in {listed(fixed.VOID_TASK_STATES)})
    select distinct person_id, covrg_id, utc_period, 'Outreach' as category, objective_type as sub_category
    from reached join asked using (comm_id)""")
def _(t: Tables) -> DataFrame:
    return extracts.events_outreach(t.comms, t.tasks, t.customers, YEAR)


@case("events_care_visits", f"""
    with {SERVICE_MONTHS},
    visited as (select distinct person_id as visitor, strftime(service_date, '%Y%m') as month from x_care_visits),
    placed as (
        select visitor, month, month = min(month) over (partition by visitor, substr(month, 1, 4)) as opens_year from visited)
    select distinct person_id, covrg_id, utc_period, 'Care' as category,
           if(opens_year, 'first visit', 'subsequent visits') as sub_category
    from x_coverage m join placed on upper(visitor) = upper(m.person_id) and month = m.utc_period
    where member_flag = 1 and utc_period >= '{YEAR}01' and {customer_of("m")}
      and exists (from service_months s where s.org = upper(m.org_nm) and s.month = m.utc_period)""")
def _(t: Tables) -> DataFrame:
    return extracts.events_care_visits(t.care_visits, t.coverage, t.service_years, t.customers, YEAR)


# All extracts in one table

EXTRACTS = (
    "events_spi", "events_hcc_clinical", "events_funnel", "events_engagement", "events_partner_enrollment",
    "events_outreach", "events_care_visits",
)


def all_events(t: Tables) -> DataFrame:
    return events.build_events([
        extracts.events_spi(t.savings, t.coverage, t.customers, YEAR),
        extracts.events_hcc_clinical(t.coverage, t.claim_flags, t.comms, t.tasks, t.customers, YEAR),
        extracts.events_funnel(
            t.funnel, t.plan_ids, t.interventions, t.customers, YEAR, case_system="case-system"),
        extracts.events_engagement(t.comms, t.coverage, t.tasks, t.customers, YEAR),
        extracts.events_partner_enrollment(t.encounters, t.service_years, t.coverage, t.customers, YEAR),
        extracts.events_outreach(t.comms, t.tasks, t.customers, YEAR),
        extracts.events_care_visits(t.care_visits, t.coverage, t.service_years, t.customers, YEAR),
    ])


ALL_EVENTS = "select distinct person_id, covrg_id, strptime(utc_period, '%Y%m')::date as utc_period, category, sub_category from (" + (
    " union all ".join(f"select person_id, covrg_id, utc_period, category, sub_category from {body(n)}" for n in EXTRACTS)
) + ") where person_id is not null and utc_period is not null"


@case("build_events", ALL_EVENTS)
def _(t: Tables) -> DataFrame:
    return all_events(t)


@case("append_events", ALL_EVENTS)
def _(t: Tables) -> DataFrame:
    """Year by year to a stored table, read back."""
    path, rows = new_path(t.spark, "events"), materialize(all_events(t), "events")
    for year in range(1995, 2003):
        events.append_events(rows.filter(F.year("utc_period") == year), path)
    return sinks.read_merged(t.spark, path)
