"""Visits, readmissions, conditions, code lists."""

import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from pairwell.functions import fixed_values, labels
from pairwell.operators import claims, code_lists, conditions, extracts, features, visits
from pairwell.plans import ingest
from pairwell.sources import sinks, tenants
from pairwell.session import new_path

CATS = ["ER", "Inpatient", "Avoidable ER"]
START = date(2020, 2, 1)


def lines(spark, data):
    """(member, first day, last day, category), days counted from 1 February 2020."""
    day = lambda n: None if n is None else START + timedelta(days=n)
    return spark.createDataFrame(
        [(m, day(a), day(b), c, None, None) for m, a, b, c in data],
        "member_id int, svc_start date, svc_end date, p_category string, o_category string, er_category string")


def bounds(df):
    return sorted(
        (r.member_id, (r.visit_start - START).days, (r.visit_end - START).days, r.visit_len)
        for r in df.collect())


def test_visits_merge_when_ranges_touch(spark, partitions):
    out = visits.visits(lines(spark, [
        (1, 0, 3, "ER"), (1, 3, 5, "ER"),                     # touch
        (2, 0, 9, "ER"), (2, 2, 3, "ER"), (2, 8, 12, "ER"),   # nested, then overlapping the longest
        (3, 0, 3, "ER"), (3, 4, 5, "ER"),                     # next day
        (4, 0, 0, "ER"), (4, 0, 0, "ER"), (4, 0, 2, "Inpatient"),
        (5, 27, 30, "ER"), (5, 29, 31, "ER"),                 # over 29 February
        (6, 0, 0, None),                                      # no category
    ]), CATS)
    assert bounds(out) == [
        (1, 0, 5, 6), (2, 0, 12, 13), (3, 0, 3, 4), (3, 4, 5, 2), (4, 0, 2, 3), (5, 27, 31, 5)]
    four = out.filter("member_id = 4").first()
    assert (four.er, four.inpatient, four.avoidable_er) == (1, 1, 0)


def test_line_without_end_lasts_one_day(spark):
    out = visits.visits(lines(spark, [(1, 0, None, "ER"), (1, 1, 2, "ER")]), CATS)
    assert bounds(out) == [(1, 0, 0, 1), (1, 1, 2, 2)]


def test_hot_member_is_reduced_to_days(spark):
    many = spark.range(30000).select(
        F.lit(1).alias("member_id"),
        F.date_add(F.lit(START), (F.col("id") % 50).cast("int") * 2).alias("svc_start"),
        F.date_add(F.lit(START), (F.col("id") % 50).cast("int") * 2).alias("svc_end"),
        F.lit("ER").alias("p_category"), F.lit(None).cast("string").alias("o_category"),
        F.lit(None).cast("string").alias("er_category"))
    assert visits.visits(many, CATS).count() == 50


def test_readmission_gap_is_between_one_and_thirty_days(spark, partitions):
    stays = []
    for member, gap in enumerate([1, 2, 29, 30]):
        stays += [(member, 0, 3, "Inpatient"), (member, 3 + gap, 3 + gap, "Inpatient")]
    stays += [(9, 0, 3, "Inpatient"), (9, 5, 5, "ER"), (9, 10, 10, "Inpatient"), (8, 0, 1, "ER"), (8, 4, 4, "Inpatient")]
    out = visits.mark_readmission(visits.visits(lines(spark, stays), CATS))
    again = sorted({r.member_id for r in out.filter("readmission = 1").collect()})
    assert again == [1, 2, 9]
    assert out.filter("member_id = 9 and er = 1 and readmission = 1").count() == 0


def test_avoidable_er_needs_er_without_admission(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 0, 0), (0, 1, 0)], "avoidable_er int, er int, inpatient int")
    assert [r.avoidable_er for r in visits.mark_avoidable_er(df).collect()] == [1, 0, 0, 0]


def test_blank_codes_do_not_match(spark):
    rows = spark.createDataFrame([(1, "", "", "Z")], "member_id int, code_pos string, code_rev string, dx1 string")
    codes = spark.createDataFrame([("", "1", "ER"), ("2", "", "Inpatient")], "p_code string, o_code string, category string")
    avoid = spark.createDataFrame([("Q", "Avoidable ER")], "ms_joiner string, category string")
    out = visits.code_lookup_3way(rows, codes, avoid).collect()
    assert len(out) == 1 and out[0].p_category is None and out[0].o_category is None


def test_conditions_need_two_dates_or_acute_first_diagnosis(spark):
    data = spark.createDataFrame([
        (1, date(2020, 1, 1), "a", None, None), (1, date(2020, 1, 1), "a", None, None),     # one date
        (2, date(2020, 1, 1), "a", None, None), (2, date(2020, 2, 1), "z", "a", None),      # two dates
        (3, date(2020, 1, 1), "a", None, "ER"), (4, date(2020, 1, 1), "z", "a", "ER"),      # first / second dx
    ], "member_id int, svc_start date, dx1 string, dx2 string, p_category string").withColumn(
        "o_category", F.lit(None).cast("string"))
    codes = spark.createDataFrame([("a", "ASTHMA"), ("", "COPD")], "ms_diag string, condition string")
    rx = spark.createDataFrame([(7, "COPD")], "member_id int, condition string")
    found = conditions.member_conditions(data, codes, rx)
    expected = [(2, "ASTHMA"), (3, "ASTHMA"), (7, "COPD")]
    assert sorted(map(tuple, found.select("member_id", "condition").collect())) == expected
    cond = conditions.condition_lookup(data, codes)
    separate = conditions.conditions_union(conditions.util_conditions(cond), conditions.dx_twice(cond), rx)
    assert sorted(map(tuple, separate.select("member_id", "condition").collect())) == expected
    flags = conditions.pivot_condition_flags(found, ["ASTHMA", "COPD"]).orderBy("member_id").collect()
    assert [tuple(r) for r in flags] == [(2, 1, 0), (3, 1, 0), (7, 0, 1)]


def test_distinct_counts_equal_plain_definition(spark):
    df = spark.createDataFrame([(1, "v1", 1), (1, "v1", 0), (1, "v2", 0), (1, None, 1), (2, "v1", 0)], "k int, v string, f int")
    out = code_lists.conditional_distinct_counts(df, ["k"], "v", {"all": F.lit(True), "flagged": F.col("f") == 1})
    assert sorted(map(tuple, out.collect())) == [(1, 2, 1), (2, 1, 0)]


def test_funnel_keeps_both_labels(spark):
    funnel = spark.createDataFrame(
        [(i, f"c{i}", "202001", "ORG", i, "Case Management", date(2020, 1, 1), date(2020, 1, 1)) for i in (1, 2, 3)],
        "person_id int, covrg_id string, utc_period string, org_nm string, care_plan_id int, program string, closed_on date, enrolled_on date")
    plans = spark.createDataFrame([(1, "s", 10), (1, "s", 11), (2, "s", 12), (3, "other", 10)],
                                  "care_plan_id int, alt_system string, alt_value int")
    done = spark.createDataFrame([(10, "Closed"), (12, "Open")], "enc_id int, status string")
    customers = spark.createDataFrame([("ORG",)], "edw_cust string")
    out = extracts.events_funnel(funnel, plans, done, customers, 2020, case_system="s")
    assert sorted((r.person_id, r.sub_category) for r in out.collect()) == [
        (1, "case closed"), (1, "no closed case"), (2, "no closed case"), (3, "no closed case")]


def test_every_revenue_rule_names_its_category(spark):
    names = {
        "Emergency Room Services": "ER", "Urgent Care Clinic": "UC", "Screening Mammography": "Mammogram",
        "Room & Board Private": "Inpatient", "All-inclusive room and board": "Inpatient", "Labor Room": "Inpatient",
        "Inpatient Renal Dialysis": "Inpatient", "Hospital Visit": "Inpatient", "Intensive Care": "Inpatient",
        "Coronary Care": "Inpatient", "Operating Room Services": "Surgery", "Laboratory": "x", "labor room": "x",
        "Emergency Room Urgent Care": "ER"}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select("name", labels.like_classify(F.col("name"), fixed_values.REVENUE_RULES).alias("category"))
    assert {r.name: r.category for r in got.collect()} == names


def test_versions_stay_readable(spark):
    path = new_path(spark, "versions")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    sinks.write_parquet_versioned(df, path, year=2023, version=1)
    sinks.write_parquet_versioned(df.filter("x = 1"), path, year=2023, version=2)
    sinks.write_parquet_versioned(df.filter("x = 2"), path, year=2023, version=2)
    stored = spark.read.parquet(path)
    assert sorted((r.x, r.export_ver) for r in stored.collect()) == [(1, 1), (2, 1), (2, 2)]


def test_schema_needs_every_table(spark):
    catalog = spark.createDataFrame(
        [("s_x_a_e", t) for t in tenants.REQUIRED_TABLES] + [("s_x_b_e", "medical")], "table_schema string, table_name string")
    assert [tuple(r) for r in tenants.sources_with_all_tables(catalog).collect()] == [("s_x_a_e", "a")]


def test_a_batch_written_again_replaces_itself(spark):
    path = new_path(spark, "batches")
    sinks.append_batch(spark.createDataFrame([(1, "a")], "x int, y string"), path, "1")
    for _ in range(2):
        sinks.append_batch(spark.createDataFrame([(2,), (2,)], "x int"), path, "2")
    rows = sinks.read_merged(spark, path)
    assert rows.columns == ["x", "y"] and sorted(map(tuple, rows.collect())) == [(1, "a"), (2, None), (2, None)]


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_two_hundred_tenants_are_one_scan(spark):
    root = new_path(spark, "tenants")
    rows = spark.range(400).select("id", (F.col("id") % 200).alias("n"), F.lit("x").alias("extra"))
    for part in (rows.filter("n < 7").drop("extra"), rows.filter("n >= 7")):
        part.withColumn("tenant", F.format_string("s%03d", "n")).drop("n").write.mode("append").partitionBy("tenant").parquet(root)
    spark.range(3).write.parquet(f"{root}/other/place")
    for schemas in (None, [f"tenant=s{i:03d}" for i in range(200)]):
        # Folders of the layout <tenant>/<table>; here each tenant folder is written as its own table.
        got = tenants.scan_tenants(spark, root, "*.parquet" if schemas is None else "", schemas=schemas)
        assert scans(got) == 1 and got.count() == 400
        assert got.filter("extra is null").count() == 14


def test_years_one_by_one_equal_all_lines_at_once(spark):
    rng = random.Random(6)
    new_year = date(2021, 1, 1)
    data = []
    for member in range(60):
        for _ in range(rng.randint(1, 12)):
            first = rng.choice([date(2020, 1, 1), new_year - timedelta(days=40), date(2022, 1, 1) - timedelta(days=20)])
            start = first + timedelta(days=rng.randint(0, 60))
            data.append((member, start, start + timedelta(days=rng.choice([-1, 0, 0, 1, 3, 10, 45, 500])), "P" if rng.random() < .6 else "Q"))
    lines = spark.createDataFrame(data, "member_id int, svc_start date, svc_end date, code_pos string").withColumns({
        "code_rev": F.lit("r"), "dx1": F.when(F.col("member_id") % 3 == 0, "a"), "pay": F.lit(1.5), "netpay": F.lit(1.0)})
    codes = spark.createDataFrame([("P", "", "Inpatient"), ("P", "", "ER"), ("Q", "", "ER"), ("", "", "ER")],
                                  "p_code string, o_code string, category string")
    avoidable = spark.createDataFrame([("a", "Avoidable ER"), ("", "Avoidable ER")], "ms_joiner string, category string")
    want = visits.add_util(visits.visits(visits.code_lookup_3way(lines, codes, avoidable), CATS))
    parts = list(ingest.visits_by_year(lines, codes, avoidable, [2020, 2021, 2022], categories=CATS))
    assert [year for year, _ in parts] == [2020, 2021, 2022, None]
    got = [tuple(r) for _, rows in parts for r in rows.select(*want.columns).collect()]
    assert sorted(got) == sorted(map(tuple, want.collect()))
    # Some visits last over one turn of the year, some over two, and some inpatients come back after one.
    assert parts[1][1].filter("visit_start < '2021-01-01'").count() and parts[2][1].filter("visit_start < '2021-01-01'").count()
    assert want.filter("readmission = 1 and visit_start >= '2021-01-01' and visit_start < '2021-01-20'").count()
    for year, rows in parts[:3]:
        assert rows.filter(F.year("visit_end") != year).count() == 0


def test_claims_read_the_medical_lines_once(spark, monkeypatch):
    path = new_path(spark, "lines")
    spark.createDataFrame(
        [(1, date(2020, 1, 3), date(2020, 1, 4), "P", "r", "a", Decimal("2.50"), Decimal("2.00")),
         (1, date(2020, 1, 3), date(2020, 1, 3), "x", "r", "a", Decimal("-1.00"), Decimal("-1.00")),
         (2, date(2020, 2, 3), None, "x", "r", "b", Decimal("4.00"), Decimal("3.00"))],
        "member_id int, svc_start date, svc_end date, code_pos string, code_rev string, dx1 string, pay decimal(12,2), netpay decimal(18,4)",
    ).write.parquet(path)
    codes = spark.createDataFrame([("P", "", "Inpatient"), ("P", "", "ER")], "p_code string, o_code string, category string")
    avoidable = spark.createDataFrame([], "ms_joiner string, category string")
    rx = spark.createDataFrame([], "member_id int, svcdate date, pay decimal(12,2), netpay decimal(18,4)")
    written = []
    kept = ingest.materialize
    monkeypatch.setattr(ingest, "materialize", lambda df, name: written.append(df) or kept(df, name))
    claims = ingest.build_claims(spark.read.parquet(path), rx, codes, avoidable, categories=CATS)
    assert len(written) == 1 and scans(written[0]) == 1 and path not in claims._jdf.queryExecution().toString()
    rows = {(r.member_id, r.service_month): (r.med_total, r.med_total_net, r.er, r.inpatient) for r in claims.collect()}
    assert rows == {(1, "202001"): (2.5, 2.0, 1, 1), (2, "202002"): (4.0, 3.0, 0, 0)}


def test_distinct_by_key_equals_distinct(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (1, "a", 2.0), (2, None, None), (2, None, None), (3, "c", 0.0)]
    df = spark.createDataFrame(rows, "k int, c string, v double")
    assert sorted(map(str, features.distinct_by_key(df, ["k", "c"]).collect())) == sorted(map(str, df.distinct().collect()))


def test_stacked_spend_equals_joined_spend(spark):
    keys = [(1, "202001"), (1, "202002"), (2, None), (None, "202001"), (None, None), (3, "202003")]
    medical = spark.createDataFrame(
        [(m, s, float(i), i / 2) for i, (m, s) in enumerate(keys[:5])],
        "member_id long, service_month string, med_total double, med_total_net double")
    pharmacy = spark.createDataFrame(
        [(m, s, i / 4, None) for i, (m, s) in enumerate(keys[1:], 9)],
        "member_id long, service_month string, pharma_total double, pharma_total_net double")
    joined = claims.join_spend(medical, pharmacy)
    for buckets in (None, 4):
        stacked = claims.stack_spend(medical, pharmacy, buckets)
        assert stacked.columns == joined.columns
        assert sorted(map(str, stacked.collect())) == sorted(map(str, joined.collect()))


def test_lines_are_shuffled_once_to_days_in_buckets(spark):
    codes = spark.createDataFrame([("R", "", "ER"), ("A", "", "Inpatient")], "p_code string, o_code string, category string")
    avoidable = spark.createDataFrame([("X", "Avoidable ER")], "ms_joiner string, category string")
    rows = [(i % 5, START + timedelta(days=i % 7), None, "RAN"[i % 3], "", "XY"[i % 2], Decimal(i % 4), Decimal(1)) for i in range(90)]
    data = spark.createDataFrame(rows, (
        "member_id long, svc_start date, svc_end date, code_pos string, code_rev string, dx1 string, "
        "pay decimal(12,2), netpay decimal(18,4)"))
    plain = visits.member_days(data, codes, avoidable, CATS)
    laid_out = visits.member_days(data, codes, avoidable, CATS, buckets=4)
    assert plain.schema == laid_out.schema
    assert sorted(map(str, plain.collect())) == sorted(map(str, laid_out.collect()))
    plan = laid_out.repartition(4, "member_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(member_id") == 1


def test_setting_holds_for_the_write_only(spark, partitions):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    sinks.materialize_by_member(spark.range(20).select(F.col("id").alias("member_id")), "numbers", 3)
    assert spark.conf.get(name) == "true"


def test_conditions_are_lowered_once(spark):
    rows = [(1, "asthma"), (1, "COPD"), (2, "Copd"), (2, None), (None, "ASTHMA")]
    flags = conditions.pivot_condition_flags(spark.createDataFrame(rows, "member_id int, condition string"), ["ASTHMA", "COPD"])
    assert sorted(map(tuple, flags.collect()), key=str) == sorted([(1, 1, 1), (2, 0, 1), (None, 1, 0)], key=str)
    assert flags._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
