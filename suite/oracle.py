"""The same derived tables as DuckDB SQL.

``oracle(body)`` prefixes a query with the common table expressions it names,
directly or through each other.
"""

from __future__ import annotations

import re

from pairwell.functions import fixed_values as fixed

#: Names that the fixtures draw from: every rule, set and partner, and one of none.
REVENUE_NAMES = [p.strip("%") for p, _ in fixed.REVENUE_RULES] + ["Laboratory", "Emergency Room Urgent Care"]
PLACE_NAMES = [p.strip("%") for p, _ in fixed.PLACE_RULES] + ["Pharmacy"]
TERM_SETS = [
    *fixed.CHRONIC_CONDITIONS, *fixed.DIABETES_DRUG_SETS, *fixed.DIABETES_DRUG_EXCLUSION_SETS, *fixed.AVOIDABLE_ER_SETS, None,
]
PARTNER_NAMES = [*fixed.PARTNERS, "Other Partner"]
VOID_STATES = "(" + ", ".join(f"'{s}'" for s in fixed.VOID_TASK_STATES) + ")"

def r2(expr: str) -> str:
    return f"cast(round(cast({expr} as decimal(18,6)), 2) as double)"


def mean2(col: str) -> str:
    return r2(f"cast(sum(cast({col} as decimal(20,6))) as double) / count({col})")


def pick(index: str, names: list[str | None]) -> str:
    whens = " ".join(
        f"when {i} then " + ("null" if n is None else f"'{n}'") for i, n in enumerate(names)
    )
    return f"case {index} {whens} end"


CTES: dict[str, str] = {
    "x_events": """
        select distinct o_custkey as person_id,
               cast(date_trunc('month', o_orderdate) as date) as utc_period,
               o_orderpriority as category
        from orders""",
    "x_members": """
        select c.c_custkey as member_id, c.c_custkey as person_id,
               make_date(1940 + c.c_custkey % 66, 1, 1) as birth_year,
               case when c.c_custkey % 2 = 0 then 'M' else 'F' end as sex,
               n.n_name as state, upper(c.c_mktsegment) as edw_cust,
               cast(date_trunc('month', min(o.o_orderdate)) as date) as start_date,
               cast(date_trunc('month', max(o.o_orderdate)) as date) as end_date
        from customer c join nation n on c.c_nationkey = n.n_nationkey
        join orders o on o.o_custkey = c.c_custkey
        group by all""",
    "x_lines": """
        select o.o_custkey as member_id, cast(l_shipdate as date) as ship,
               cast(l_extendedprice as decimal(12,2)) as pay,
               cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))
                    as decimal(18,4)) as netpay, l.*
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "x_med_lines": """
        select member_id, ship as svc_start,
               ship + cast(l_quantity as int) % 10 as svc_end,
               l_returnflag as code_pos, l_linestatus as code_rev,
               p_type as dx1, p_brand as dx2, pay, netpay
        from x_lines join part on l_partkey = p_partkey where l_linenumber <= 5""",
    "x_rx_lines": """
        select member_id, l_partkey as ndcnum, ship as svcdate, pay, netpay
        from x_lines where l_linenumber > 5""",
    "x_util_codes": """
        select * from (values ('R', '', 'ER'), ('A', '', 'Inpatient'), ('N', '', 'Office Visits'),
                              ('', 'F', 'Surgery')) t(p_code, o_code, category)""",
    "x_avoid_codes": """
        select * from (values ('ECONOMY', 'Avoidable ER')) t(ms_joiner, category)""",
    "x_cond_codes": """
        select * from (values ('SMALL', 'ASTHMA'), ('LARGE', 'COPD'),
                              ('PROMO', 'DIABETES_MELLITUS'), ('Brand#2', 'HYPERTENSION'))
                      t(ms_diag, condition)""",
    "x_drug_codes": """
        select p_partkey as ndc, 'DIABETES_MELLITUS' as condition from part where p_size <= 5""",
    "x_med_spend": """
        select member_id, strftime(svc_start, '%Y%m') as service_month,
               cast(sum(pay) as double) as med_total, cast(sum(netpay) as double) as med_total_net
        from x_med_lines where pay > 0 group by all""",
    "x_rx_spend": """
        select member_id, strftime(svcdate, '%Y%m') as service_month,
               cast(sum(pay) as double) as pharma_total,
               cast(sum(netpay) as double) as pharma_total_net
        from x_rx_lines where pay > 0 group by all""",
    "x_spend": """
        select member_id, service_month,
               coalesce(med_total, 0) as med_total, coalesce(med_total_net, 0) as med_total_net,
               coalesce(pharma_total, 0) as pharma_total,
               coalesce(pharma_total_net, 0) as pharma_total_net,
               coalesce(med_total, 0) + coalesce(pharma_total, 0) as total_claims,
               coalesce(med_total_net, 0) + coalesce(pharma_total_net, 0) as total_claims_net
        from x_med_spend full join x_rx_spend using (member_id, service_month)""",
    "x_coded": """
        select m.*, p.category as p_category, o.category as o_category, e.category as er_category
        from x_med_lines m
        left join x_util_codes p on p.p_code <> '' and m.code_pos = p.p_code
        left join x_util_codes o on o.o_code <> '' and m.code_rev = o.o_code
        left join x_avoid_codes e on m.dx1 = e.ms_joiner""",
    "x_stacked": """
        select distinct member_id, svc_start, svc_end, util from (
            select member_id, svc_start, svc_end, p_category as util from x_coded
            union all select member_id, svc_start, svc_end, o_category from x_coded
            union all select member_id, svc_start, svc_end, er_category from x_coded
        ) where util is not null""",
    "x_islands": """
        select *, sum(opens) over (partition by member_id order by svc_start, svc_end, util
                                   rows unbounded preceding) as util_id
        from (select *, case when svc_start <= max(svc_end) over (
                         partition by member_id order by svc_start, svc_end, util
                         rows between unbounded preceding and 1 preceding)
                      then 0 else 1 end as opens
              from x_stacked)""",
    "x_visits": """
        select strftime(min(svc_start), '%Y%m') as service_month, member_id,
               cast(util_id as bigint) as util_id,
               min(svc_start) as visit_start, max(svc_end) as visit_end,
               cast(max(svc_end) - min(svc_start) + 1 as int) as visit_len,
               max(case when util = 'ER' then 1 else 0 end) as er,
               max(case when util = 'Inpatient' then 1 else 0 end) as inpatient,
               max(case when util = 'Office Visits' then 1 else 0 end) as office_visits,
               max(case when util = 'Surgery' then 1 else 0 end) as surgery,
               max(case when util = 'Avoidable ER' then 1 else 0 end) as avoidable_er
        from x_islands group by member_id, util_id""",
    "x_inpatient_gaps": """
        select member_id, util_id,
               visit_start - lag(visit_end) over (partition by member_id order by visit_start) as gap
        from x_visits where inpatient = 1""",
    "x_full_visits": """
        select v.* replace (case when avoidable_er = 1 and er = 1 and inpatient = 0
                                 then 1 else 0 end as avoidable_er),
               case when gap > 1 and gap < 30 then 1 else 0 end as readmission
        from x_visits v left join x_inpatient_gaps g using (member_id, util_id)""",
    "x_util": """
        select member_id, service_month, cast(sum(er) as bigint) as er,
               cast(sum(inpatient) as bigint) as inpatient,
               cast(sum(office_visits) as bigint) as office_visits,
               cast(sum(surgery) as bigint) as surgery,
               cast(sum(avoidable_er) as bigint) as avoidable_er,
               cast(sum(readmission) as bigint) as readmission
        from x_full_visits group by all""",
    "x_stored_claims": """
        select s.*, coalesce(er, 0) as er, coalesce(inpatient, 0) as inpatient,
               coalesce(office_visits, 0) as office_visits, coalesce(surgery, 0) as surgery,
               coalesce(avoidable_er, 0) as avoidable_er, coalesce(readmission, 0) as readmission
        from x_spend s left join x_util u using (member_id, service_month)""",
    "x_claims": """
        select * replace (cast(strptime(service_month, '%Y%m') as date) as service_month)
        from x_stored_claims""",
    "x_range": """
        select min(service_month) as first_month, max(service_month) as last_month from x_claims""",
    "x_cond_lines": """
        select m.*, d1.condition as d1_condition, d2.condition as d2_condition
        from x_coded m left join x_cond_codes d1 on m.dx1 = d1.ms_diag
        left join x_cond_codes d2 on m.dx2 = d2.ms_diag
        where d1.condition is not null or d2.condition is not null""",
    "x_cond_stacked": """
        select member_id, svc_start, d1_condition as condition from x_cond_lines
        where d1_condition is not null
        union all select member_id, svc_start, d2_condition from x_cond_lines
        where d2_condition is not null""",
    "x_util_cond": """
        select distinct member_id, d1_condition as condition from x_cond_lines
        where d1_condition is not null
          and (p_category in ('ER', 'Inpatient') or o_category in ('ER', 'Inpatient'))""",
    "x_dx_cond": """
        select member_id, condition from x_cond_stacked group by all
        having count(distinct svc_start) > 1""",
    "x_rx_cond": """
        select distinct member_id, condition from x_rx_lines join x_drug_codes on ndcnum = ndc""",
    "x_conditions": """
        select * from x_util_cond union select * from x_dx_cond union select * from x_rx_cond""",
    "x_flags": """
        select member_id,
               max(case when condition = 'ASTHMA' then 1 else 0 end) as asthma,
               max(case when condition = 'COPD' then 1 else 0 end) as copd,
               max(case when condition = 'DIABETES_MELLITUS' then 1 else 0 end) as diabetes_mellitus,
               max(case when condition = 'HYPERTENSION' then 1 else 0 end) as hypertension
        from x_conditions group by member_id""",
    "x_clean": """
        select e.person_id, e.utc_period, e.category from x_events e
        where e.category in ('1-URGENT', '2-HIGH') and not exists (
            select 1 from x_events o where o.person_id = e.person_id
            and o.category in ('5-LOW') and o.category <> e.category
            and o.utc_period between e.utc_period - interval 3 month and e.utc_period)""",
    "x_exposed": """
        select m.* exclude (start_date, end_date), c.utc_period, c.category
        from x_clean c, x_range r, x_members m
        where c.utc_period - interval 3 month >= r.first_month
          and c.utc_period + interval 5 month <= r.last_month
          and m.person_id = c.person_id
          and c.utc_period - interval 3 month >= m.start_date
          and c.utc_period + interval 5 month <= m.end_date""",
    "x_control": """
        select m.* exclude (start_date, end_date), cast(g.p as date) as utc_period,
               'control' as category
        from x_members m, x_range r,
             lateral unnest(generate_series(
                 greatest(cast(m.start_date + interval 3 month as date),
                          cast(r.first_month + interval 3 month as date)),
                 least(cast(m.end_date - interval 6 month as date),
                       cast(r.last_month - interval 5 month as date)),
                 interval 1 month)) as g(p)""",
    "x_wide": "@wide@",
    "x_features": "@features@",
    "x_cohorts": "@cohorts@",
    "x_points": """
        select vec_id as key, cast(label as varchar) as stratum, vec_id % 5 <> 0 as is_control,
               cast(embedding as double[]) as vec from embeddings""",
    "x_strata": """
        select stratum from x_points group by stratum
        having count(*) filter (is_control) > 5 and count(*) filter (not is_control) > 0""",
    "x_pairs": """
        select e.stratum, e.key as exposed_key, c.key as control_key,
               round(list_sum(list_transform(range(1, 65), lambda i: (e.vec[i] - c.vec[i]) * (e.vec[i] - c.vec[i]))), 9) as d2
        from x_points e join x_points c on e.stratum = c.stratum and c.is_control
        where not e.is_control and e.stratum in (select stratum from x_strata)""",
    "x_edges": """
        select stratum, exposed_key, control_key, d2, cast(rank as int) as rank from (
            select *, row_number() over (partition by exposed_key order by d2, control_key) as rank
            from x_pairs) where rank <= 10""",
    # Programme tables
    "x_oc": """
        select o.*, c.*, 'P' || o_custkey as person_id, 'Cov-' || o_custkey as covrg_id,
               strftime(o_orderdate, '%Y%m') as utc_period, upper(c_mktsegment) as org_nm
        from orders o join customer c on o.o_custkey = c.c_custkey""",
    "x_customers": """
        select distinct upper(c_mktsegment) as edw_cust from customer
        where c_mktsegment <> 'FURNITURE'""",
    "x_coverage": """
        select distinct person_id, covrg_id, utc_period, org_nm,
               case when o_custkey % 5 = 0 then 0 else 1 end as member_flag from x_oc""",
    "x_savings": """
        select upper(covrg_id) as covrg_id, utc_period,
               case o_orderpriority when '1-URGENT' then 'Case Management'
                    when '2-HIGH' then 'Maternity Program' when '3-MEDIUM' then 'Disease Management'
                    when '4-NOT SPECIFIED' then 'Wellness Gap'
                    else 'High Cost Claimants (HCC)' end as savings_category
        from x_oc""",
    "x_claim_flags": """
        select covrg_id, utc_period as adjudication_period, o_totalprice > 300000 as hcc_flag
        from x_oc""",
    "x_contacts": """
        select l.*, x.*, l_orderkey * 10 + l_linenumber as enctr_id
        from lineitem l join x_oc x on l.l_orderkey = x.o_orderkey""",
    "x_comms": """
        select l_orderkey as comm_id, enctr_id, covrg_id, utc_period, org_nm,
               l_linestatus = 'F' as engaged_flag,
               case when l_returnflag = 'A' then 1 else 0 end as clinical_flag,
               case when l_returnflag = 'R' then 'CONTACT MADE' else 'NO ANSWER' end as result
        from x_contacts""",
    "x_tasks": f"""
        select enctr_id, person_id, covrg_id,
               {pick("l_linenumber % 3", ["issue", "member_outreach", "note"])} as task_cd,
               {pick("l_suppkey % 7", ["duplicate", "rejected", "draft", "done", "done", "open", "open"])} as task_status,
               case when l_quantity > 45 then 1 else 0 end as deleted_flag,
               case when l_linestatus = 'F' then 'Care' else 'Admin' end as objective_category,
               {pick("l_partkey % 4", ["Other Care Education", "Care Gap", None, "Benefit Support"])} as objective_type
        from x_contacts""",
    "x_funnel": f"""
        select person_id, covrg_id, utc_period, org_nm, o_orderkey as care_plan_id,
               {pick("o_orderkey % 10", ["Conditions Care", "Symptoms Care", "Wellness Care", "Preventive Care", "Care Navigation", "Case Management", "BH Support", "NICU Care", "Pharmacy", "Pediatric Plus"])} as program,
               case when o_orderstatus = 'F' then o_orderdate end as closed_on,
               case when o_orderstatus in ('F', 'P') then o_orderdate end as enrolled_on
        from x_oc""",
    "x_plan_ids": """
        select l_orderkey as care_plan_id,
               case when l_linenumber <= 3 then 'case-system' else 'other' end as alt_system,
               l_orderkey * 10 + l_linenumber as alt_value from lineitem""",
    "x_interventions": """
        select l_orderkey * 10 + l_linenumber as enc_id,
               case when l_returnflag = 'R' then 'Closed' else 'Open' end as status from lineitem""",
    "x_service_years": """
        select * from (
            select lower(org_nm) as org_nm, min(utc_period) as svc_period_start,
                   left(utc_period, 4) || '09' as svc_period_end
            from x_oc group by lower(org_nm), left(utc_period, 4))
        where svc_period_start <= svc_period_end""",
    "x_encounters": f"""
        select upper(covrg_id) as covrg_id, utc_period, org_nm,
               {pick(f"o_orderkey % {len(PARTNER_NAMES)}", PARTNER_NAMES)} as partner,
               case when o_orderstatus <> 'P' then o_orderdate end as start_date
        from x_oc""",
    "x_care_visits": """
        select lower(person_id) as person_id, cast(o_orderdate as date) as service_date from x_oc""",
    "x_first_clinical": f"""
        select covrg_id, substr(utc_period, 1, 4) as in_year, min(utc_period) as first_contact
        from x_comms c
        where clinical_flag = 1 and utc_period >= '199601'
          and exists (from x_customers k where k.edw_cust = c.org_nm)
          and exists (from x_tasks t where t.enctr_id = c.enctr_id and t.task_cd = 'issue' and t.deleted_flag <> 1
                      and t.objective_category = 'Care' and t.objective_type <> 'Other Care Education'
                      and t.task_status not in {VOID_STATES})
        group by all""",
    "x_terms": f"""
        select {pick(f"p_partkey % {len(TERM_SETS)}", TERM_SETS)} as value_set_nm,
               'E' || (p_partkey % 97) || '.' || p_size as cd_sys_concept_cd,
               p_name || '''s ' || p_brand as cd_sys_concept_display,
               case when p_size > 45 then 'retired' else 'active' end as cd_sys_sts,
               case when p_partkey % 11 = 0 then 'retired' else 'active' end as cd_sys_concept_sts
        from part""",
    "x_revenue": f"""
        select lpad(cast(p_partkey as varchar), 4, '0') as code,
               {pick(f"p_partkey % {len(REVENUE_NAMES)}", REVENUE_NAMES)} || ' ' || p_name as description
        from part""",
    "x_places": f"""
        select cast(p_partkey % 50 as varchar) as stdplac,
               {pick(f"p_partkey % {len(PLACE_NAMES)}", PLACE_NAMES)} || ' ' || p_name as description
        from part""",
}


# The wide layout around events, spelled out as joins to the claims table.

LEADING = ["med_total", "total_claims", "total_claims_net", "avoidable_er", "readmission", "er", "inpatient"]
TRAILING = ["total_claims", "avoidable_er", "readmission"]
PRE, POST = 3, 5


def offset_name(measure: str, n: int) -> str:
    return f"{measure}_{'m' if n < 0 else 'p'}{abs(n)}"


def cells() -> list[tuple[str, int]]:
    out = []
    for m in LEADING:
        out += [(m, n) for n in range(-PRE, (POST if m in TRAILING else 0) + 1)]
    return out


def _months(offset: str, period: str = "p.utc_period") -> str:
    return (
        f"(year({offset}) * 12 + month({offset}) - year({period}) * 12 - month({period}))"
    )


def wide_columns() -> list[str]:
    return [offset_name(m, n) for m, n in cells()]


def wide_sql(rows: str) -> str:
    """Wide claims of the given rows, without rows holding a negative value."""
    seq = _months("c.service_month")
    parts = ",\n".join(
        f"{r2(f'coalesce(sum(case when {seq} = {n} then {m} end), 0)')} as {offset_name(m, n)}"
        for m, n in cells()
    )
    keep = " and ".join(f"{c} >= 0" for c in wide_columns())
    return f"""
        select * from (
            select p.member_id, p.utc_period, {parts}
            from (select distinct member_id, utc_period from {rows}) p
            join x_claims c on c.member_id = p.member_id
             and c.service_month between p.utc_period - interval {PRE} month
                                     and p.utc_period + interval {POST} month
            group by p.member_id, p.utc_period) where {keep}"""


def _running(measure: str, offsets: range) -> str:
    out = "0.0"
    for n in offsets:
        out = r2(f"{out} + {offset_name(measure, n)}")
    return out


def features_sql(rows: str) -> str:
    """Rows with claims features, flags and derived columns."""
    flags = ["asthma", "copd", "diabetes_mellitus", "hypertension"]
    flagged = ", ".join(f"coalesce(f.{c}, 0) as {c}" for c in flags)
    pre = ", ".join(
        f"{_running(m, range(-PRE, 0))} as {m}_m3_to_p0_sum" for m in LEADING
    )
    post = ", ".join(f"{_running(m, range(0, POST))} as {m}_p0_to_p5_sum" for m in TRAILING)
    share = "case when {a} > 0 then " + r2("{a} / {b}") + " else 0.0 end"
    return f"""
        select *, case when med_percent < 0.5 then '0-50%_med'
                       when med_percent < 0.9 then '50-90%_med' else 'mostly_med' end as med_percent_cat
        from (select *,
                {share.format(a="med_total_m3_to_p0_sum", b="total_claims_m3_to_p0_sum")} as med_percent,
                {share.format(a="total_claims_net_m3_to_p0_sum", b="total_claims_m3_to_p0_sum")} as oop_percent,
                case when age < 18 then '0-17' when age < 40 then '18-39'
                     when age < 60 then '40-59' when age >= 60 then '60+' end as age_band
              from (select r.*, w.* exclude (member_id, utc_period), {flagged},
                           cast(year(r.utc_period) - year(r.birth_year) as int) as age,
                           cast(epoch(cast(r.utc_period as timestamp)) as double) as date_int,
                           {pre}, {post}
                    from {rows} r join ({wide_sql(rows)}) w using (member_id, utc_period)
                    left join x_flags f on f.member_id = r.member_id))"""


def cohorts_sql() -> str:
    low = " and ".join(
        f"{offset_name('total_claims', n)} < 250000" for n in range(-PRE, POST + 1)
    )
    return f"""
        select distinct * from (
            select * from x_features
            union all by name {features_sql("x_control")})
        where age between 18 and 70 and {low} and total_claims_p0_to_p5_sum < 250000"""


CTES["x_wide"] = wide_sql("x_exposed")
CTES["x_features"] = features_sql("x_exposed")
CTES["x_cohorts"] = cohorts_sql()

# Matching of the cohort rows: scaled and weighted columns, pairs, candidates.

SCALED = [
    "total_claims_m1", "total_claims_m2", "total_claims_m3", "total_claims_p0", "age", "asthma",
    "copd", "diabetes_mellitus", "hypertension", "date_int", "med_percent", "oop_percent",
    "er_m3_to_p0_sum", "inpatient_m3_to_p0_sum",
]
WEIGHTS = {"total_claims_m1": 3, "total_claims_m2": 3, "total_claims_m3": 3, "total_claims_p0": 3}
ID = "member_id, category, utc_period"

CTES["x_spread"] = "select " + ", ".join(
    f"stddev_samp(cast({c} as double)) as {c}" for c in SCALED) + " from x_cohorts"
CTES["x_ready"] = f"""
    select {ID.replace("member_id", "c.member_id")},
           concat_ws('|', cast(age_band = '18-39' as int), cast(age_band = '40-59' as int),
                     cast(age_band = '60+' as int), cast(sex = 'M' as int), cast(sex = 'F' as int)) as stratum,
           {", ".join(f"case when s.{c} > 0 then c.{c} / s.{c} else 0 end * {WEIGHTS.get(c, 1)}.0 as {c}" for c in SCALED)}
    from x_cohorts c, x_spread s"""
CTES["x_numbered"] = """
    select *, row_number() over (order by member_id, utc_period, category) as key from x_ready"""
CTES["x_usable"] = """
    select stratum from x_ready group by stratum
    having count(*) filter (category = 'control') > 40 and count(*) filter (category <> 'control') > 0"""
CTES["x_near"] = f"""
    select cohort, stratum, exposed_key, unnest(best) as b from (
        select e.category as cohort, e.stratum, e.key as exposed_key,
               min({{'d2': round({" + ".join(f"(e.{c} - c.{c}) * (e.{c} - c.{c})" for c in SCALED)}, 9), 'key': c.key}}, 10) as best
        from x_numbered e join x_numbered c on e.stratum = c.stratum and c.category = 'control'
        where e.category <> 'control' and e.stratum in (select stratum from x_usable)
        group by e.category, e.stratum, e.key)"""


def greedy_sql(edges: str, result: str) -> str:
    """Serial choice per (cohort, stratum): a recursion that carries the used
    controls.  ``edges`` names cohort, stratum, exposed_key, control_key, d2."""
    return f"""
        with recursive wishes as (
            select cohort, stratum, exposed_key, list(control_key order by d2, control_key) as wish,
                   row_number() over (partition by cohort, stratum order by exposed_key) as seq
            from ({edges}) group by cohort, stratum, exposed_key),
        walk as (
            select distinct cohort, stratum, cast(0 as bigint) as seq, cast([] as bigint[]) as used,
                   cast(null as bigint) as exposed_key, cast(null as bigint) as control_key from wishes
            union all
            select w.cohort, w.stratum, w.seq,
                   case when p.pick is null then k.used else list_append(k.used, p.pick) end, w.exposed_key, p.pick
            from walk k join wishes w on w.cohort = k.cohort and w.stratum = k.stratum and w.seq = k.seq + 1,
                 lateral (select list_filter(w.wish, lambda c: not list_contains(k.used, c))[1] as pick) p),
        pairs as (select cohort, stratum, exposed_key, control_key from walk where control_key is not null)
        {result}"""


_NAME = re.compile(r"\bx_[a-z_]+\b")


def oracle(body: str) -> str:
    """``body`` with the tables it needs, in order of dependence."""
    ordered: list[str] = []

    def need(sql: str) -> None:
        for name in dict.fromkeys(_NAME.findall(sql)):
            if name in CTES and name not in ordered:
                need(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{n} as materialized ({CTES[n].strip()})" for n in ordered)
    text = body.strip()
    for head in ("with recursive ", "with "):
        if text.startswith(head):
            return f"{head}{parts},\n{text[len(head):]}"
    return f"with {parts}\n{text}"
