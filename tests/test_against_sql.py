"""Registered queries beside their SQL at the smallest scale.

The quick ones run by default; PAIRWELL_ALL=1 runs all of them.
"""

import os

import pytest

from suite import registry
from suite.compare import bag, database

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
QUICK = """
    parse_yyyymm month_offset calc_age age_band med_percent like_classify map_customers sum_periods
    clean_window_anti_join clean_window_shared_lists eligibility_interval_join limit_exposed
    control_month_grid shifted_anti_join claims_range_join pivot_claims claims_panel features_join
    build_cohorts full_transformation spend_around_events full_outer_spend left_join_util
    stack_categories merge_overlapping_visits pivot_visit_flags add_util count_util dx_twice
    member_conditions utilization_codes utilization_days demographics_rollup
    coded_demographics_rollup sources_with_all_tables customer_member_fallback events_spi
    events_hcc_clinical events_funnel events_engagement events_partner_enrollment events_outreach
    events_care_visits cohort_stats cohort_retention full_vs_matched main_match append_merge_schema
    knn_candidates_ivf sample_matches build_members build_events
""".split()
NAMES = sorted(SQL) if os.environ.get("PAIRWELL_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want = bag(names, result.fetchall())
    assert want and bag(df.columns, df.collect()) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
