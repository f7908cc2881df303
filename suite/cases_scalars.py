"""Scalar functions and simple predicates."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import dates, labels, measures
from pairwell.functions import fixed_values as fixed
from pairwell.operators import claims, cohorts, code_lists, extracts, features
from pairwell.sources import readers
from suite.oracle import mean2, r2
from suite.registry import case
from suite.tables import Tables

ORDER = "o_orderkey"


@case("parse_yyyymm", """
    select o_orderkey, cast(try_strptime(k, '%Y%m') as date) as month
    from (select o_orderkey, case when o_orderkey % 10 = 0 then 'bad' else strftime(o_orderdate, '%Y%m') end as k from orders)""")
def _(t: Tables) -> DataFrame:
    key = F.when(F.col(ORDER) % 10 == 0, "bad").otherwise(dates.format_yyyymm(F.col("o_orderdate")))
    return t.raw("orders").select(ORDER, dates.parse_yyyymm(key).alias("month"))


@case("trunc_month", "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month from orders")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select(ORDER, dates.trunc_month(F.col("o_orderdate")).alias("month"))


@case("trunc_year", "select o_orderkey, cast(date_trunc('year', o_orderdate) as date) as year_start from orders")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select(ORDER, dates.trunc_year(F.col("o_orderdate")).alias("year_start"))


@case("format_yyyymm", "select o_orderkey, strftime(o_orderdate, '%Y%m') as month_key from orders")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select(ORDER, dates.format_yyyymm(F.col("o_orderdate")).alias("month_key"))


@case("year_of_month_key", "select member_id, service_month, cast(left(service_month, 4) as int) as year from x_med_spend")
def _(t: Tables) -> DataFrame:
    spend = claims.spend_by_month(t.med_lines, "svc_start", "med")
    return spend.select("member_id", "service_month", dates.year_of_month_key(F.col("service_month")).alias("year"))


@case("add_months", """
    select o_orderkey, cast(o_orderdate - interval 3 month as date) as window_start,
           cast(o_orderdate + interval 5 month as date) as window_end from orders""")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select(
        ORDER, F.add_months("o_orderdate", -3).alias("window_start"),
        F.add_months("o_orderdate", 5).alias("window_end"),
    )


@case("month_offset", """
    select l_orderkey, l_linenumber, l_partkey,
           cast(case when day(s) = day(o) or (s = last_day(s) and o = last_day(o)) then m
                     else round(m + (day(s) - day(o)) / 31.0) end as int) as mo_seq
    from (select *, (year(s) * 12 + month(s)) - (year(o) * 12 + month(o)) as m
          from (select l.*, cast(l_shipdate as date) as s, cast(o_orderdate as date) as o
                from lineitem l join orders on l_orderkey = o_orderkey))""")
def _(t: Tables) -> DataFrame:
    return t.line_items.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        dates.month_offset(F.col("l_shipdate"), F.col("o_orderdate")).alias("mo_seq"),
    )


@case("visit_length", """
    select member_id, svc_start, svc_end, cast(svc_end - svc_start + 1 as int) as visit_len from x_med_lines""")
def _(t: Tables) -> DataFrame:
    return t.med_lines.select(
        "member_id", "svc_start", "svc_end",
        dates.visit_length(F.col("svc_start"), F.col("svc_end")).alias("visit_len"),
    )


@case("date_int", "select person_id, category, utc_period, cast(epoch(cast(utc_period as timestamp)) as double) as date_int from x_events")
def _(t: Tables) -> DataFrame:
    return t.events.withColumn("date_int", dates.date_int(F.col("utc_period")))


_AGES = """select e.person_id, e.utc_period, e.category, cast(year(e.utc_period) - year(m.birth_year) as int) as age
           from x_events e join x_members m on e.person_id = m.person_id"""


def _ages(t: Tables) -> DataFrame:
    births = t.members.select("person_id", "birth_year")
    return t.events.join(births, "person_id").select(
        "person_id", "utc_period", "category",
        measures.age_years(F.col("birth_year"), F.col("utc_period")).alias("age"),
    )


@case("calc_age", _AGES)
def _(t: Tables) -> DataFrame:
    return _ages(t)


@case("age_band", f"""
    select *, case when age < 18 then '0-17' when age < 40 then '18-39' when age < 60 then '40-59'
                   else '60+' end as age_band from ({_AGES})""")
def _(t: Tables) -> DataFrame:
    return _ages(t).withColumn("age_band", measures.age_band(F.col("age")))


_SHARE = "case when {a} > 0 then " + r2("{a} / {b}") + " else 0.0 end"


def _spend(t: Tables) -> DataFrame:
    return claims.join_spend(
        claims.spend_by_month(t.med_lines, "svc_start", "med"),
        claims.spend_by_month(t.rx_lines, "svcdate", "pharma"),
    )


@case("med_percent", f"""
    select member_id, service_month, {_SHARE.format(a="med_total", b="total_claims")} as med_percent from x_spend""")
def _(t: Tables) -> DataFrame:
    return _spend(t).select("member_id", "service_month", measures.share(
        F.col("med_total"), F.col("total_claims")).alias("med_percent"))


@case("med_percent_cat", f"""
    select member_id, service_month, case when p < 0.5 then '0-50%_med' when p < 0.9 then '50-90%_med'
           else 'mostly_med' end as med_percent_cat
    from (select *, {_SHARE.format(a="med_total", b="total_claims")} as p from x_spend)""")
def _(t: Tables) -> DataFrame:
    p = measures.share(F.col("med_total"), F.col("total_claims"))
    return _spend(t).select("member_id", "service_month", measures.share_band(p).alias("med_percent_cat"))


@case("oop_percent", f"""
    select member_id, service_month, {_SHARE.format(a="total_claims_net", b="total_claims")} as oop_percent from x_spend""")
def _(t: Tables) -> DataFrame:
    return _spend(t).select("member_id", "service_month", measures.share(
        F.col("total_claims_net"), F.col("total_claims")).alias("oop_percent"))


@case("decode_sex", "select c_custkey, case c_nationkey % 4 when 1 then 'M' when 2 then 'F' end as sex from customer")
def _(t: Tables) -> DataFrame:
    return t.raw("customer").select("c_custkey", labels.decode_sex(F.col("c_nationkey") % 4).alias("sex"))


@case("strip_prefix", "select c_custkey, right(c_name, len(c_name) - 9) as label from customer")
def _(t: Tables) -> DataFrame:
    return t.raw("customer").select("c_custkey", labels.strip_prefix(F.col("c_name"), 9).alias("label"))


@case("revcode_to_r", "select code, 'R' || right(code, len(code) - 1) as r_code from x_revenue")
def _(t: Tables) -> DataFrame:
    return t.revenue_codes.select("code", labels.revcode_to_r(F.col("code")).alias("r_code"))


@case("strip_dots", "select cd_sys_concept_cd, replace(cd_sys_concept_cd, '.', '') as code from x_terms")
def _(t: Tables) -> DataFrame:
    return t.terms.select("cd_sys_concept_cd", labels.strip_dots(F.col("cd_sys_concept_cd")).alias("code"))


@case("strip_quote", "select cd_sys_concept_display, replace(cd_sys_concept_display, chr(39), '') as description from x_terms")
def _(t: Tables) -> DataFrame:
    return t.terms.select(
        "cd_sys_concept_display", labels.strip_quote(F.col("cd_sys_concept_display")).alias("description"))


@case("ilike_joiner", "select cd_sys_concept_cd, '%' || replace(cd_sys_concept_cd, '.', '%') || '%' as pattern from x_terms")
def _(t: Tables) -> DataFrame:
    return t.terms.select("cd_sys_concept_cd", labels.ilike_joiner(F.col("cd_sys_concept_cd")).alias("pattern"))


@case("like_classify", """
    select code, description, case
        when description like '%Emergency Room%' then 'ER' when description like '%Urgent Care%' then 'UC'
        when description like '%Screening Mammography%' then 'Mammogram'
        when description like '%Room & Board%' or description like '%room and board%'
          or description like '%Labor Room%' or description like '%Inpatient Renal Dialysis%'
          or description like '%Hospital Visit%' or description like '%Intensive Care%'
          or description like '%Coronary Care%' then 'Inpatient'
        when description like '%Operating Room Services%' then 'Surgery' else 'x' end as category
    from x_revenue""")
def _(t: Tables) -> DataFrame:
    return t.revenue_codes.select(
        "code", "description",
        labels.like_classify(F.col("description"), fixed.REVENUE_RULES).alias("category"))


@case("map_state", """
    select c_custkey, case c_nationkey % 5 when 0 then 'TX' when 1 then 'DC' when 2 then 'MP' when 3 then null
           else 'WY' end as state_abr from customer""")
def _(t: Tables) -> DataFrame:
    names = ["Texas", "District of Columbia", "Northern Mariana Islands", "Atlantis", "Wyoming"]
    name = F.array(*[F.lit(n) for n in names])[F.col("c_nationkey") % 5]
    return t.raw("customer").select("c_custkey", labels.map_state(name).alias("state_abr"))


_EMPLOYERS = ["UGI", "Lowes", "Emd", "Blank", "BK", "api group, inc", "Acme"]
_EMPLOYER_SQL = "case c_custkey % 7 " + " ".join(
    f"when {i} then '{n}'" for i, n in enumerate(_EMPLOYERS)) + " end"
_MAPPED_SQL = """case upper(n) when 'UGI' then 'AMERIGAS' when 'LOWES' then 'LOWE''S' when 'EMD' then 'BENEFITS4ME'
                 when 'API GROUP, INC' then 'API GROUP' else upper(n) end"""


def _employer(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _EMPLOYERS])
    return t.raw("customer").withColumn("n", names[(F.col("c_custkey") % 7).cast("int")])


@case("map_customers", f"select c_custkey, {_MAPPED_SQL} as edw_cust from (select c_custkey, {_EMPLOYER_SQL} as n from customer)")
def _(t: Tables) -> DataFrame:
    return _employer(t).select("c_custkey", labels.map_customer(F.col("n")).alias("edw_cust"))


@case("coalesce_placeholder", f"""
    select c_custkey, case when upper(n) in ('BK', 'BLANK') then upper(c_mktsegment) else {_MAPPED_SQL} end as edw_cust
    from (select c_custkey, c_mktsegment, {_EMPLOYER_SQL} as n from customer)""")
def _(t: Tables) -> DataFrame:
    return _employer(t).select("c_custkey", labels.coalesce_placeholder(
        labels.map_customer(F.col("n")), F.upper("c_mktsegment")).alias("edw_cust"))


@case("program_group", """
    select care_plan_id, case when program in ('Conditions Care', 'Symptoms Care', 'Wellness Care', 'Preventive Care',
           'Care Navigation') then 'Care Navigation' else program end as category from x_funnel""")
def _(t: Tables) -> DataFrame:
    return t.funnel.select("care_plan_id", labels.program_group(
        F.col("program"), fixed.NAVIGATION_PROGRAMS, "Care Navigation").alias("category"))


@case("clamp_end_date", """
    select o_custkey as member_id, least(cast(max(o_orderdate) as date), date '1998-06-30') as end_date
    from orders group by o_custkey""")
def _(t: Tables) -> DataFrame:
    as_of = F.lit("1998-06-30").cast("date")
    return t.raw("orders").groupBy(F.col("o_custkey").alias("member_id")).agg(
        labels.clamp_end_date(F.max("o_orderdate").cast("date"), as_of).alias("end_date"))


@case("fill_zero", """
    select c_custkey, coalesce(o_orderkey, 0) as o_orderkey, coalesce(o_totalprice, 0) as o_totalprice, o_orderstatus
    from customer left join orders on c_custkey = o_custkey""")
def _(t: Tables) -> DataFrame:
    joined = t.raw("customer").join(t.raw("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return measures.fill_zero(joined.select("c_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"))


@case("sanitize_columns", "select c_custkey as customer_key, c_mktsegment as market_segment from customer")
def _(t: Tables) -> DataFrame:
    return labels.sanitize_columns(t.raw("customer").select(
        F.col("c_custkey").alias("Customer Key"), F.col("c_mktsegment").alias("Market Segment")))


@case("sanitize_values", "select o_orderkey, lower(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]', '', 'g')) as value from orders")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select(ORDER, labels.sanitize_value(F.col("o_orderpriority")).alias("value"))


@case("label_concat", "select person_id, utc_period, category || ' control' as label, category || '_' || person_id as match_key from x_events")
def _(t: Tables) -> DataFrame:
    return t.events.select(
        "person_id", "utc_period", labels.label_concat(F.col("category"), "control").alias("label"),
        labels.label_concat(F.col("category"), F.col("person_id"), sep="_").alias("match_key"))


@case("row_least", "select l_orderkey, l_linenumber, l_partkey, least(l_quantity, l_extendedprice, l_tax) as low from lineitem")
def _(t: Tables) -> DataFrame:
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                    F.least("l_quantity", "l_extendedprice", "l_tax").alias("low"))


@case("row_greatest", "select member_id, greatest(start_date, date '1996-01-01') as start_date from x_members")
def _(t: Tables) -> DataFrame:
    return t.members.select("member_id", F.greatest("start_date", F.lit("1996-01-01").cast("date")).alias("start_date"))


@case("sum_measures", "select * from x_spend")
def _(t: Tables) -> DataFrame:
    return _spend(t)


@case("apply_weights", "select member_id, utc_period, total_claims_m1 * 3.0 as total_claims_m1, total_claims_p0 * 2.0 as total_claims_p0 from x_wide")
def _(t: Tables) -> DataFrame:
    from suite.cases_selection import wide_exposed
    return measures.apply_weights(
        wide_exposed(t).select("member_id", "utc_period", "total_claims_m1", "total_claims_p0"),
        {"total_claims_m1": 3, "total_claims_p0": 2})


@case("sum_periods", "select member_id, utc_period, total_claims_m3_to_p0_sum, total_claims_p0_to_p5_sum, er_m3_to_p0_sum from x_features")
def _(t: Tables) -> DataFrame:
    from suite.cases_selection import exposed, wide_exposed
    wide = exposed(t).select("member_id", "utc_period", "category").join(
        wide_exposed(t), ["member_id", "utc_period"])
    summed = measures.sum_periods(wide, ["total_claims", "er"], -3, 0)
    return measures.sum_periods(summed, ["total_claims"], 0, 5).select(
        "member_id", "utc_period", "total_claims_m3_to_p0_sum", "total_claims_p0_to_p5_sum", "er_m3_to_p0_sum")


@case("collapse_control_label", """
    select person_id, utc_period, case when label like '%control%' then 'control' else label end as category, label as category_long
    from (select *, case when person_id % 3 = 0 then category || ' control' else category end as label from x_events)""")
def _(t: Tables) -> DataFrame:
    label = F.when(F.col("person_id") % 3 == 0, labels.label_concat(F.col("category"), "control")).otherwise(F.col("category"))
    return t.events.select("person_id", "utc_period", label.alias("category_long")).withColumn(
        "category", labels.collapse_control_label(F.col("category_long")))


@case("zip_to_int", """
    select o_orderkey, coalesce(try_cast(z as int), 0) as zip
    from (select o_orderkey, case when o_orderkey % 4 = 0 then 'n/a' when o_orderkey % 4 = 1 then null
                                  else lpad(cast(o_custkey as varchar), 5, '0') end as z from orders)""")
def _(t: Tables) -> DataFrame:
    k = F.col(ORDER) % 4
    z = F.when(k == 0, "n/a").when(k > 1, F.lpad(F.col("o_custkey").cast("string"), 5, "0"))
    return t.raw("orders").select(ORDER, labels.zip_to_int(z).alias("zip"))


# Predicates

@case("filter_in", "select * from x_events where category in ('1-URGENT', '2-HIGH')")
def _(t: Tables) -> DataFrame:
    return t.events.filter(F.col("category").isin("1-URGENT", "2-HIGH"))


@case("filter_not_in", "select * from x_events where category not in ('5-LOW', '3-MEDIUM')")
def _(t: Tables) -> DataFrame:
    return t.events.filter(~F.col("category").isin("5-LOW", "3-MEDIUM"))


@case("filter_not_like_nullsafe", "select enctr_id, objective_type from x_tasks where (objective_type like '%Care%') is false")
def _(t: Tables) -> DataFrame:
    return t.tasks.filter(extracts.definitely_not_like(F.col("objective_type"), "%Care%")).select(
        "enctr_id", "objective_type")


@case("filter_contains", "select enctr_id, objective_type from x_tasks where objective_type like '%Care%'")
def _(t: Tables) -> DataFrame:
    return t.tasks.filter(F.col("objective_type").contains("Care")).select("enctr_id", "objective_type")


@case("filter_prefix", "select * from x_events where category like '1-%'")
def _(t: Tables) -> DataFrame:
    return t.events.filter(F.col("category").startswith("1-"))


@case("filter_between", """
    select l_orderkey, l_linenumber, l_partkey from lineitem join orders on l_orderkey = o_orderkey
    where cast(l_shipdate as date) between cast(o_orderdate - interval 3 month as date) and cast(o_orderdate + interval 5 month as date)""")
def _(t: Tables) -> DataFrame:
    inside = F.col("ship").between(F.add_months("o_orderdate", -3), F.add_months("o_orderdate", 5))
    return t.line_items.filter(inside).select("l_orderkey", "l_linenumber", "l_partkey")


@case("filter_not_retired", """
    select * exclude (r) from (select *, cd_sys_sts = 'retired' or cd_sys_concept_sts = 'retired' as r from x_terms) where not r""")
def _(t: Tables) -> DataFrame:
    return code_lists.not_retired(t.terms).drop("value_set_sts", "value_set_compose_sts")


@case("filter_nonzero_pay", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_discount <> 0")
def _(t: Tables) -> DataFrame:
    return readers.nonzero_pay(t.raw("lineitem"), "l_discount", positive_only=False).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@case("filter_positive_pay", "select s_suppkey, s_acctbal from supplier where s_acctbal > 0")
def _(t: Tables) -> DataFrame:
    return readers.nonzero_pay(t.raw("supplier"), "s_acctbal", positive_only=True).select("s_suppkey", "s_acctbal")


@case("drop_unlinkable", "select person_id, covrg_id, utc_period from x_coverage where person_id not like 'P1%'")
def _(t: Tables) -> DataFrame:
    return cohorts.drop_unlinkable(t.coverage, "P1").select("person_id", "covrg_id", "utc_period")


@case("year_slice", "select member_id, svc_start, dx1 from x_med_lines where year(svc_start) = 1997")
def _(t: Tables) -> DataFrame:
    return readers.year_slice(t.med_lines, "svc_start", 1997).select("member_id", "svc_start", "dx1")


@case("year_overlap", "select member_id, start_date, end_date from x_members where year(end_date) >= 1997 and year(start_date) <= 1997")
def _(t: Tables) -> DataFrame:
    return readers.year_overlap(t.members, "start_date", "end_date", 1997).select(
        "member_id", "start_date", "end_date")


@case("assemble_vector", "select c_custkey, cast(c_nationkey as double) as first, c_acctbal as last from customer")
def _(t: Tables) -> DataFrame:
    vector = vector_to_array("vector")
    return features.assemble_vector(t.raw("customer"), ["c_nationkey", "c_acctbal"]).select(
        "c_custkey", F.element_at(vector, 1).alias("first"), F.element_at(vector, -1).alias("last"))


@case("unpack_vector", "select c_custkey, cast(c_nationkey as double) as nation, c_acctbal as balance from customer")
def _(t: Tables) -> DataFrame:
    packed = features.assemble_vector(t.raw("customer"), ["c_nationkey", "c_acctbal"])
    return features.unpack_vector(packed, "vector", ["c_custkey"], ["nation", "balance"])


@case("mean_rounding", f"select l_returnflag, {mean2('l_quantity')} as avg_quantity from lineitem group by 1")
def _(t: Tables) -> DataFrame:
    return t.raw("lineitem").groupBy("l_returnflag").agg(measures.mean2("l_quantity").alias("avg_quantity"))
