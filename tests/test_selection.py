"""Windows, control months, claims around events, derived measures."""

from datetime import date

from pyspark.sql import functions as F

from pairwell import session
from pairwell.functions import labels, measures
from pairwell.operators import claims, cohorts, features, report
from pairwell.plans import select_cohorts
from pairwell.sources import sinks
from suite import cases_matching, cases_selection, registry, tables
from suite.tables import Tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def events(spark, data):
    return spark.createDataFrame(data, "person_id int, utc_period date, category string")


def test_clean_window_counts_both_edges(spark):
    e = events(spark, [
        (1, date(2020, 6, 1), "A"), (1, date(2020, 3, 1), "X"),   # three months before: out
        (2, date(2020, 6, 1), "A"), (2, date(2020, 2, 1), "X"),   # four months before: stays
        (3, date(2020, 6, 1), "A"), (3, date(2020, 6, 1), "X"),   # same month: out
        (4, date(2020, 6, 1), "A"), (4, date(2020, 7, 1), "X"),   # after, post = 0: stays
        (5, date(2020, 6, 1), "A"), (5, date(2020, 5, 1), "A"),   # own category: both stay
        (6, date(2020, 6, 1), "B"), (6, date(2020, 6, 1), "A"),   # unlisted category: stays
    ])
    kept = cohorts.clean_exposed(e, ["A"], ["X"], 3, 0)
    assert rows(kept, "person_id", "utc_period") == [
        (2, date(2020, 6, 1)), (4, date(2020, 6, 1)), (5, date(2020, 5, 1)),
        (5, date(2020, 6, 1)), (6, date(2020, 6, 1))]


def test_category_in_both_lists_excludes_others_only(spark):
    e = events(spark, [
        (1, date(2020, 6, 1), "A"), (1, date(2020, 5, 1), "A"),
        (2, date(2020, 6, 1), "A"), (2, date(2020, 5, 1), "B"),
    ])
    kept = cohorts.clean_exposed(e, ["A", "B"], ["A", "B"], 2, 0)
    assert rows(kept, "person_id", "utc_period", "category") == [
        (1, date(2020, 5, 1), "A"), (1, date(2020, 6, 1), "A"), (2, date(2020, 5, 1), "B")]


def test_eligibility_and_control_months_end_one_month_apart(spark):
    members = spark.createDataFrame(
        [(1, 1, date(2020, 1, 1), date(2020, 12, 1))],
        "member_id int, person_id int, start_date date, end_date date")
    spent = spark.createDataFrame(
        [(1, date(2019, 1, 1)), (1, date(2021, 12, 1))], "member_id int, service_month date")
    e = events(spark, [(1, date(2020, m, 1), "A") for m in range(1, 13)])
    kept = cohorts.limit_exposed(e, members, spent, 3, 5)
    assert [r[0].month for r in rows(kept, "utc_period")] == [4, 5, 6, 7]
    months = cohorts.control_months(members, spent, 3, 5)
    assert [r[0].month for r in rows(months, "utc_period")] == [4, 5, 6]


def test_control_months_start_on_month_starts(spark):
    members = spark.createDataFrame(
        [(1, date(2020, 1, 15), date(2020, 6, 15))], "member_id int, start_date date, end_date date")
    spent = spark.createDataFrame(
        [(1, date(2019, 1, 1)), (1, date(2021, 12, 1))], "member_id int, service_month date")
    months = cohorts.control_months(members, spent, 0, 0)
    assert [r[0] for r in rows(months, "utc_period")] == [date(2020, m, 1) for m in (2, 3, 4, 5)]


def test_drop_after_events(spark):
    e = events(spark, [(1, date(2020, 3, 1), "A")])
    grid = events(spark, [(1, date(2020, m, 1), "control") for m in range(1, 8)])
    left = cohorts.drop_after_events(grid, e, 2)
    assert [r[0].month for r in rows(left, "utc_period")] == [1, 2, 6, 7]


def spend(spark, data):
    return spark.createDataFrame(data, "member_id int, service_month date, x double, y double")


def test_panel_equals_merge_and_pivot(spark, partitions):
    data = [(m, date(2020, 1 + (m * 7 + i * 3) % 12, 1), float(m * 10 + i), float(i - 1))
            for m in range(1, 20) for i in range(6)]
    spent = spend(spark, data + data[:9])  # some member-months have several rows
    periods = spark.createDataFrame(
        [(m, date(2020, 1 + k, 1)) for m in range(1, 24) for k in (2, 5, 9)],
        "member_id int, utc_period date")
    wide = claims.pivot_claims(claims.merge_claims(periods, spent, 2, 3), ["x", "y"], ["x"], 2, 3)
    panel = claims.claims_panel(periods, spent, ["x", "y"], ["x"], 2, 3)
    assert wide.columns == panel.columns
    assert rows(wide, *wide.columns) == rows(panel, *wide.columns)
    assert panel.filter("member_id > 20").count() == 0


def test_panel_survives_a_hot_member(spark):
    hot = spark.range(20000).select(
        F.lit(1).alias("member_id"), F.lit(date(2020, 3, 1)).alias("service_month"), F.lit(1.0).alias("x"))
    periods = spark.createDataFrame([(1, date(2020, 3, 1))] * 500, "member_id int, utc_period date")
    panel = claims.claims_panel(periods, hot, ["x"], [], 1, 0)
    assert rows(panel, "x_m1", "x_p0") == [(0.0, 20000.0)]


def test_remove_negatives_and_outliers(spark):
    df = spark.createDataFrame([(30, 1.0, 0.0), (30, -1.0, 0.0), (17, 1.0, 0.0), (71, 1.0, 0.0),
                                (70, 250000.0, 0.0), (18, 249999.0, 0.0)], "age int, a double, b double")
    assert claims.remove_negatives(df, ["a", "b"]).count() == 5
    assert rows(claims.outlier_filter(df, ["a"], ["b"]), "age", "a") == [
        (18, 249999.0), (30, -1.0), (30, 1.0)]


def test_sum_periods_excludes_the_end(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0, 8.0)], "x_m2 double, x_m1 double, x_p0 double, x_p1 double")
    out = measures.sum_periods(measures.sum_periods(df, ["x"], -2, 0), ["x"], 0, 1).first()
    assert (out["x_m2_to_p0_sum"], out["x_p0_to_p1_sum"]) == (3.0, 4.0)


def test_round2_handles_ties_and_noise(spark):
    df = spark.createDataFrame([(1.005,), (-1.005,), (1.00499999999999,), (2.675,), (0.0,), (1.0049,)], "x double")
    assert [r[0] for r in df.select(measures.round2(F.col("x"))).collect()] == [1.01, -1.01, 1.01, 2.68, 0.0, 1.0]


def test_shares_are_guarded(spark):
    df = spark.createDataFrame([(1.0, 4.0), (0.0, 0.0), (3.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(measures.share(F.col("a"), F.col("b"))).collect()] == [0.25, 0.0, None]


def test_scaling_has_no_centring_and_constants_become_zero(spark):
    df = spark.createDataFrame([(i, float(i), 0.1) for i in range(1, 6)], "id int, x double, c double")
    out = features.scale_columns(df, ["x", "c"]).orderBy("id").collect()
    assert abs(out[0]["x"] - 1 / 2.5 ** 0.5) < 1e-12
    assert {r["c"] for r in out} == {0.0}


def test_one_hot_ignores_null_and_unlisted(spark):
    df = spark.createDataFrame([(1, "18-39"), (2, None), (3, "Blank"), (4, "60+")], "id int, band string")
    out = features.one_hot(df, ["id"], {"band": ["18-39", "60+"]})
    assert rows(out, "id", "band_1839", "band_60") == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]


def test_labels(spark):
    df = spark.createDataFrame([("Texas", "lowes", "x control"), ("Nowhere", "Acme", "x")], "s string, c string, l string")
    out = df.select(labels.map_state(F.col("s")), labels.map_customer(F.col("c")),
                    labels.collapse_control_label(F.col("l"))).collect()
    assert [tuple(r) for r in out] == [("TX", "LOWE'S", "control"), (None, "ACME", "x")]


def test_details_add_no_rows_and_discarded_keeps_unmatched(spark):
    ids = ["member_id", "category", "utc_period"]
    details = spark.createDataFrame(
        [(1, "A", 1, 5.0), (2, "control", 1, 6.0), (2, "control", 1, 6.0), (3, "control", 1, 7.0)],
        "member_id int, category string, utc_period int, v double")
    matched = spark.createDataFrame(
        [("k", 1, "A", 1), ("k", 2, "A control", 1)], "match_key string, member_id int, category string, utc_period int")
    out = report.attach_details(matched, details, ids)
    assert rows(out, "member_id", "category", "v") == [(1, "A", 5.0), (2, "A control", 6.0)]
    assert rows(report.discarded(details, matched, ids), "member_id") == [(3,)]


def test_sample_brings_its_controls(spark, partitions):
    matched = spark.createDataFrame(
        [(f"k{i}", i, "A") for i in range(20)] + [(f"k{i}", 100 + i, "A control") for i in range(20)],
        "match_key string, member_id int, category string")
    keys = [sorted(r[0] for r in report.sample_matches(matched, 3, seed=1).select("match_key").collect())]
    assert len(keys[0]) == 6 and keys[0][::2] == keys[0][1::2]


def ancestors_of_scans(df, name: str) -> list[list[str]]:
    """For every scan of a stored table in the plan, outside subqueries, the operators above it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    above, out = [], []
    for line in plan.splitlines():
        text = line.lstrip(" :+-")
        depth = len(line) - len(text)
        while above and above[-1][0] >= depth:
            above.pop()
        above.append((depth, text))
        if text.startswith("FileScan") and f".{name}[" in text and not any(t.startswith("Subquery") for _, t in above):
            out.append([t for _, t in above])
    return out


def test_stored_sides_are_not_shuffled(spark):
    sf_dir = "/root/testdata/sf0.001"
    t = Tables(spark, sf_dir)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claims_table = cases_selection.stored_claims(t)
        flags_table = cases_selection.stored_flags(t)
        names = [next(iter(x.inputFiles())).split("/")[-2].replace("-", "_") for x in (claims_table, flags_table)]
        plans = [(cases_selection.build_cohorts(t), names), (cases_selection.spend_around_events(t), names[:1])]
        for df, stored in plans:
            for name in stored:
                found = ancestors_of_scans(df, name)
                assert found and all("Bucketed: true" in path[-1] for path in found)
                for path in found:
                    # Claims reach the window of the panel, flags their join, as they are stored.
                    first_use = max(i for i, x in enumerate(path) if "Join" in x or x.startswith("Window"))
                    assert not any(x.startswith("Exchange") for x in path[first_use:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# Growth: what a task holds does not grow with the tables, and wide rows stay where they are

def test_partitions_follow_the_files(spark, tmp_path, monkeypatch):
    for name in ("customer", "part", "orders", "lineitem"):
        spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(session, "_PARTITION_BYTES", 4000)
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    try:
        paths = [f"{tmp_path}/{t}.parquet" for t in ("customer", "part", "orders", "lineitem")]
        few, many = session.partitions_for(spark, paths[:1]), session.partitions_for(spark, paths)
        assert 8 <= few < many
        assert Tables(spark, str(tmp_path)).buckets == many
        assert int(spark.conf.get(name)) >= many
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_cohort_rows_move_once_and_narrow(spark, capsys):
    spent = spark.createDataFrame(
        [(m, date(2020, k, 1), float(m * k), 1.0 - (m == 3 and k == 4) * 2) for m in range(1, 9) for k in (2, 4, 5, 9)],
        "member_id int, service_month date, x double, y double")
    flags = spark.createDataFrame([(m, 1) for m in range(1, 5)], "member_id int, asthma int")
    months = [(m, date(2020, k, 1), "a") for m in range(1, 12) for k in (1, 4, 7, 12)]
    cohort = spark.createDataFrame(
        [*months, *months[:3], (None, date(2020, 4, 1), "a"), (2, None, "a"), (2, date(2020, 4, 1), "b")],
        "member_id int, utc_period date, category string")
    by_member = [sinks.materialize_by_member(df, "test", 4) for df in (spent, flags)]
    window = select_cohorts.Windows(match_pre=2, match_post=1)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = select_cohorts.add_claims(cohort, *by_member, window, ["x", "y"], ["x"], buckets=4)
        names = claims.wide_columns(["x", "y"], ["x"], 2, 1)
        wide = claims.pivot_claims(claims.merge_claims(
            cohort.select("member_id", "utc_period").distinct(), spent, 2, 1), ["x", "y"], ["x"], 2, 1)
        want = cohort.distinct().join(
            claims.remove_negatives(wide, names), ["member_id", "utc_period"]).join(flags, "member_id", "left").na.fill(0)
        columns = ["member_id", "utc_period", "category", *names, "asthma"]
        assert got.columns == columns
        assert 0 < len(rows(got, *columns)) and rows(got, *columns) == rows(want, *columns)
        capsys.readouterr()
        got.explain()
        plan = capsys.readouterr().out
        assert "Window" not in plan and plan.count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_sum_of_rounded_columns_needs_one_rounding(spark):
    df = spark.range(3000).select(*[
        measures.round2(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(10**9)) / 1000 - F.lit(2e5)).alias(measures.offset_name("x", n)) for n in range(-3, 5)])
    once = measures.sum_periods(df, ["x"], -3, 5, rounded=True).select(F.col("x_m3_to_p5_sum").alias("once"))
    step = measures.sum_periods(df, ["x"], -3, 5).select(F.col("x_m3_to_p5_sum").alias("step"))
    assert sorted(r[0] for r in once.collect()) == sorted(r[0] for r in step.collect())


def test_few_columns_are_stored_without_the_others(spark, tmp_path):
    for name in ("customer", "part", "orders", "lineitem"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    t, built = Tables(spark, str(tmp_path)), []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (None, "b", None)], "k int, c string, v double")

    few = t.stored_part("wide", "few", build, ["k", "c"])
    assert few.columns == ["k", "c"] and spark.read.parquet(*few.inputFiles()).columns == ["k", "c"]
    t.stored_part("wide", "few", build, ["k", "c"])
    assert len(built) == 1 and sorted(map(str, few.collect())) == sorted(map(str, build().select("k", "c").collect()))
    wide = t.stored("wide", build)
    again = t.stored_part("wide", "few", build, ["k", "c"])
    assert len(built) == 3 and again.inputFiles() == wide.inputFiles()


def test_a_part_that_holds_the_columns_serves_others(spark, tmp_path):
    for name in ("customer", "part", "orders", "lineitem"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    t, built = Tables(spark, str(tmp_path)), []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "a", 2.0)], "k int, c string, v double")

    wider = t.stored_part("parts", "wider", build, ["k", "c"])
    assert t.stored_part("parts", "few", build, ["c"]).inputFiles() == wider.inputFiles() and len(built) == 1
    t.stored_part("parts", "other", build, ["v"])
    assert len(built) == 2


def test_matching_and_reports_store_the_columns_they_read(spark, monkeypatch):
    parts = ("cohorts", "cohorts_report", "cohorts_matching")
    monkeypatch.setattr(cases_matching.detail, "main_match", lambda cohorts, *more, **options: (cohorts, None))
    for query, part in (("full_vs_matched", "cohorts_report"), ("main_match", "cohorts_matching")):
        t = Tables(spark, "/root/testdata/sf0.001")
        for key in [k for k in tables._STORED if k[1] == t.sf_dir and k[2] in parts]:
            del tables._STORED[key]
        registry.queries()[query](spark, t.sf_dir)
        assert {k[2] for k in tables._STORED if k[1] == t.sf_dir} & set(parts) == {part}
