"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores.
Each query is computed in full; its result is not collected.
"""

from __future__ import annotations

import json
import os
import time

from pairwell.operators import claims, cohorts, visits
from pairwell.plans import report_cohorts
from pairwell.session import configure
from suite import registry
from suite.cases_matching import match, matched_rows
from suite.cases_selection import (
    ID, build_cohorts, cohort_rows, control, stored_claims, stored_flags,
)
from suite.compare import session
from suite.oracle import LEADING, POST, PRE, TRAILING
from suite.tables import EXCLUDE, EXPOSED, Tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = configure(session(CPUS))
    t = Tables(spark, SF_DIR)
    queries = registry.queries()
    named = {
        "scan_warmup": lambda: t.raw("lineitem"),
        # Ingestion
        "med_spend_by_month": lambda: claims.spend_by_month(t.med_lines, "svc_start", "med"),
        "visits": lambda: visits.add_util(t.visit_rows),
        "build_claims": lambda: t.claims,
        "chronic_flags": lambda: t.flags,
        "utilization_days": lambda: queries["utilization_days"](spark, SF_DIR),
        # Stored inputs of the later steps
        "store_claims": lambda: stored_claims(t),
        "store_flags": lambda: stored_flags(t),
        # Selection
        "clean_window": lambda: cohorts.clean_exposed(t.events, EXPOSED, EXCLUDE, 3, 0),
        "control_month_grid": lambda: control(t),
        "claims_panel_control": lambda: claims.claims_panel(
            control(t).select("member_id", "utc_period"), stored_claims(t), LEADING, TRAILING, PRE, POST, buckets=t.buckets),
        "spend_around_events": lambda: report_cohorts.spend_around_events(
            t.events, t.members, stored_claims(t), EXPOSED, EXCLUDE, buckets=t.buckets),
        "build_cohorts": lambda: build_cohorts(t),
        "store_cohorts": lambda: cohort_rows(t),
        # Matching and reporting
        "knn_candidates_exact": lambda: queries["knn_candidates_exact"](spark, SF_DIR),
        "greedy_match_1to1": lambda: queries["greedy_match_1to1"](spark, SF_DIR),
        "match_many_cohorts": lambda: match(t),
        "store_matched": lambda: matched_rows(t),
        "compare": lambda: report_cohorts.compare(matched_rows(t), cohort_rows(t), ID),
        # Events
        "events_outreach": lambda: queries["events_outreach"](spark, SF_DIR),
        "events_funnel": lambda: queries["events_funnel"](spark, SF_DIR),
    }
    seconds = {}
    for name, build in named.items():
        start = time.time()
        run(build())
        seconds[name] = round(time.time() - start, 2)
    counted = {n: s for n, s in seconds.items() if n != "scan_warmup" and not n.startswith("store_")}
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(counted.values()), 2),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
