"""Before/after comparison of matched cohorts, and the headline report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import measures
from pairwell.operators import claims as claim_ops
from pairwell.operators import report as rep
from pairwell.plans.select_cohorts import Windows, select_exposed


def compare(
    matched: DataFrame, details: DataFrame, id_columns: Sequence[str], windows: Windows = Windows(),
    measure: str = "total_claims",
) -> DataFrame:
    """Mean spend by month offset of full and matched cohorts, with PMPM."""
    columns = [
        measures.offset_name(measure, n) for n in range(-windows.eval_pre, windows.eval_post + 1)
    ]
    attached = rep.attach_details(matched, details, id_columns)
    means = rep.full_vs_matched(details, attached, columns)
    return measures.pmpm(means, measure, windows.eval_pre, windows.eval_post)


def report(
    matched: DataFrame, details: DataFrame, id_columns: Sequence[str], windows: Windows = Windows(),
    measure: str = "total_claims",
) -> dict[str, DataFrame]:
    """The tables of a report on a matching.

    ``statistics`` per cohort; ``retention``, the share of each cohort that was
    matched; ``discarded``, the cohort rows that were not; ``comparison``, means
    by month of full and matched cohorts; ``chart``, the same in long form.
    """
    exposed = details.filter(F.col("category") != "control")
    compared = compare(matched, details, id_columns, windows, measure)
    months = [
        measures.offset_name(measure, n) for n in range(-windows.eval_pre, windows.eval_post + 1)
    ]
    return {
        "statistics": rep.cohort_stats(details, measures.offset_name(measure, 0)),
        "retention": rep.cohort_retention(
            matched.filter(~F.col("category").contains("control")), exposed),
        "discarded": rep.discarded(details, matched, id_columns),
        "comparison": compared,
        "chart": rep.chart_series(compared, months),
    }


def spend_around_events(
    events: DataFrame, members: DataFrame, claims: DataFrame,
    exposed: Sequence[str], exclude: Sequence[str], windows: Windows = Windows(),
    measure: str = "total_claims", *, buckets: int | None = None,
) -> DataFrame:
    """What exposed members cost per month around the event, per category.

    ``buckets`` is the number in which the claims are stored by member, if they are.
    """
    rows = claim_ops.by_member(
        select_exposed(events, members, claims, exposed, exclude, windows), buckets)
    pre, post = windows.match_pre, windows.match_post
    wide = claim_ops.claims_panel(
        rows.select("member_id", "utc_period"), claims, [measure], [measure], pre, post, buckets=buckets
    )
    columns = claim_ops.wide_columns([measure], [measure], pre, post)
    joined = rows.join(claim_ops.remove_negatives(wide, columns), ["member_id", "utc_period"])
    return measures.pmpm(rep.mean_by_offset(joined, columns), measure, pre, post)
