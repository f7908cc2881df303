"""Source lines to the member-month claims table and chronic flags."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from pairwell.functions import fixed_values as fixed
from pairwell.operators import claims, conditions, visits
from pairwell.session import materialize
from pairwell.sources.readers import year_slice
from pairwell.sources.sinks import materialize_by_member


def build_claims(
    med_lines: DataFrame,
    rx_lines: DataFrame,
    util_codes: DataFrame,
    avoidable: DataFrame,
    *,
    categories: Sequence[str] = fixed.VISIT_CATEGORIES,
    positive_only: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Spend and utilization per member and month.

    The medical lines are read once, into a written table by member and day;
    spend and visits both come from that.  With ``buckets`` of the member lines
    are shuffled once, and what is made of them only to meet the other spend.
    """
    days = visits.member_days(med_lines, util_codes, avoidable, categories, positive_only=positive_only, buckets=buckets)
    days = materialize(days, "member_days") if buckets is None else materialize_by_member(days, "member_days", buckets)
    spend = claims.stack_spend(
        claims.spend_of_days(days),
        claims.spend_by_month(rx_lines, "svcdate", "pharma", positive_only=positive_only),
        buckets,
    )
    found = visits.visits_of_days(visits.coded_days(days, categories), categories)
    return claims.join_utilization(spend, visits.count_util(visits.add_util(found)))


def visits_by_year(
    med_lines: DataFrame,
    util_codes: DataFrame,
    avoidable: DataFrame,
    years: Sequence[int],
    *,
    categories: Sequence[str] = fixed.VISIT_CATEGORIES,
) -> Iterator[tuple[int | None, DataFrame]]:
    """(year, visits closed in it), one service year after another, then (None, those still open).

    ``years`` follow one another.  Each year reads its own lines and the state
    that the year before left (:func:`pairwell.operators.visits.year_of_visits`),
    which is written, so a run can stop after any year and memory holds one.
    """
    carried = None
    for year in years:
        days = visits.coded_days(visits.member_days(
            year_slice(med_lines, "svc_start", year), util_codes, avoidable, categories), categories)
        days = materialize(days, f"days-{year}")
        closed, after = visits.year_of_visits(
            days, visits.no_carried(days) if carried is None else carried, year, categories)
        carried = materialize(after, f"carried-{year}")
        yield year, closed
    if carried is not None:
        yield None, visits.year_of_visits(days.limit(0), carried, None, categories)[0]


def build_chronic_flags(
    med_lines: DataFrame,
    rx_lines: DataFrame,
    util_codes: DataFrame,
    avoidable: DataFrame,
    condition_codes: DataFrame,
    drug_codes: DataFrame,
    *,
    names: Sequence[str] = fixed.CHRONIC_CONDITIONS,
) -> DataFrame:
    """One row of chronic-condition flags per member."""
    coded = visits.code_lookup_3way(med_lines, util_codes, avoidable)
    by_drug = conditions.drug_lookup_inner(rx_lines, drug_codes)
    return conditions.pivot_condition_flags(
        conditions.member_conditions(coded, condition_codes, by_drug), names
    )
