"""Events, members and claims to cohort rows with features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import dates, measures
from pairwell.operators import claims as claim_ops
from pairwell.operators import cohorts


@dataclass(frozen=True)
class Windows:
    """Months before and after the event, for each purpose."""

    clean_pre: int = 3
    clean_post: int = 0
    eval_pre: int = 3
    eval_post: int = 5
    match_pre: int = 3
    match_post: int = 5


LEADING = (
    "med_total", "med_total_net", "pharma_total", "pharma_total_net", "total_claims",
    "total_claims_net", "avoidable_er", "readmission", "office_visits", "er", "inpatient",
)
TRAILING = ("total_claims", "avoidable_er", "readmission")


def select_exposed(
    events: DataFrame, members: DataFrame, claims: DataFrame,
    exposed: Sequence[str], exclude: Sequence[str], windows: Windows = Windows(),
    *, customers: DataFrame | None = None, last_month: str | None = None,
) -> DataFrame:
    clean = cohorts.clean_exposed(
        events, exposed, exclude, windows.clean_pre, windows.clean_post
    )
    out = cohorts.limit_exposed(
        clean, members, claims, windows.eval_pre, windows.eval_post, last_month=last_month
    )
    return out if customers is None else out.join(customers, "edw_cust", "left_semi")


def add_claims(
    rows: DataFrame, claims: DataFrame, flags: DataFrame, windows: Windows = Windows(),
    leading: Sequence[str] = LEADING, trailing: Sequence[str] = TRAILING,
    *, buckets: int | None = None,
) -> DataFrame:
    """Wide claims features (required, none negative) and chronic flags.

    Overlapping profiles can repeat a row; repeats are dropped here, while rows
    are narrow.  With claims and flags stored in ``buckets`` of the member, the
    rows are the only thing moved, while they are narrow.
    """
    rows = claim_ops.by_member(rows, buckets).distinct()
    keys = ["member_id", "utc_period"]
    wide = claim_ops.add_panel(
        rows.select(*keys, *[c for c in rows.columns if c not in keys]), claims, leading, trailing,
        windows.match_pre, windows.match_post,
    )
    names = claim_ops.wide_columns(leading, trailing, windows.match_pre, windows.match_post)
    return cohorts.add_flags(claim_ops.remove_negatives(wide, names), flags)


def with_age(df: DataFrame) -> DataFrame:
    return df.withColumn("age", measures.age_years(F.col("birth_year"), F.col("utc_period")))


def derive_features(
    df: DataFrame, windows: Windows = Windows(),
    leading: Sequence[str] = LEADING, trailing: Sequence[str] = TRAILING,
) -> DataFrame:
    """Age, sums before and after, date as number, shares of spend.

    The wide columns have two decimals, as the claims panel gives them.
    """
    pre = windows.match_pre
    with_sums = measures.sum_periods(
        measures.sum_periods(
            with_age(df).withColumn("age_band", measures.age_band(F.col("age"))), leading, -pre, 0, rounded=True
        ),
        trailing, 0, windows.eval_post, rounded=True,
    )
    total = F.col(measures.sum_name("total_claims", -pre, 0))
    medical = F.col(measures.sum_name("med_total", -pre, 0))
    net = F.col(measures.sum_name("total_claims_net", -pre, 0))
    shares = with_sums.withColumns({
        "date_int": dates.date_int(F.col("utc_period")),
        "med_percent": measures.share(medical, total),
        "oop_percent": measures.share(net, total),
    })
    return shares.withColumn("med_percent_cat", measures.share_band(F.col("med_percent")))


def build_cohorts(
    exposed: DataFrame, control: DataFrame, claims: DataFrame, control_claims: DataFrame,
    flags: DataFrame, control_flags: DataFrame, windows: Windows = Windows(),
    leading: Sequence[str] = LEADING, trailing: Sequence[str] = TRAILING,
    *, buckets: int | None = None,
) -> DataFrame:
    """Exposed and control rows with features, outliers removed.

    The control side may come from another source with tables of its own; the
    columns both have are kept.  Where both sides read the same claims and
    flags, one panel serves both.  Ages that the outlier filter drops go before
    the panel is made.  ``buckets`` is the number in which all of
    these tables are stored by member, if they are.
    """
    exposed, control = (claim_ops.adults(with_age(df)).drop("age") for df in (exposed, control))
    if claims is control_claims and flags is control_flags:
        shared = [c for c in exposed.columns if c in control.columns]
        rows = exposed.select(*shared).unionByName(control.select(*shared))
        both = add_claims(rows, claims, flags, windows, leading, trailing, buckets=buckets)
    else:
        a = add_claims(exposed, claims, flags, windows, leading, trailing, buckets=buckets)
        b = add_claims(control, control_claims, control_flags, windows, leading, trailing, buckets=buckets)
        shared = [c for c in a.columns if c in b.columns]
        both = a.select(*shared).unionByName(b.select(*shared))
    rows = derive_features(both, windows, leading, trailing)
    months = [
        measures.offset_name("total_claims", n)
        for n in range(-windows.eval_pre, windows.eval_post + 1)
    ]
    return claim_ops.outlier_filter(
        measures.fill_zero(rows), months,
        [measures.sum_name("total_claims", 0, windows.eval_post)],
    )
