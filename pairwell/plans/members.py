"""Eligibility of all tenants to one members table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from pairwell.functions import fixed_values as fixed
from pairwell.operators import demographics
from pairwell.sources import tenants

PROFILE = ("table_schema", "member_id", "birth_year", "sex", "state", "dw_customer_nm", "msa_4")


def build_members(
    catalog: DataFrame, eligibility: DataFrame, customers: DataFrame, industries: DataFrame,
    year: int, *, as_of: Column, profile: Sequence[str] = PROFILE, like: str | None = None,
    exclude: Sequence[str] = (), placeholders: Sequence[str] = fixed.PLACEHOLDER_CUSTOMERS,
) -> DataFrame:
    """One row per member profile with employer, industry and state code.

    Only tenants that hold every required table are read.  Spans of the year
    roll up to profiles; an unnamed employer is that of the schema if it has
    only one; employers without an entry have industry ``unknown``.

    ``eligibility`` holds all tenants (see :func:`tenants.union_sources`) with
    ``table_schema``, the profile columns, ``start_date`` and ``end_date``;
    ``customers`` has ``acronym`` and ``cg_cust``; ``industries`` has
    ``edw_cust`` and ``industry``.
    """
    schemas = tenants.sources_with_all_tables(catalog, like=like, exclude=exclude)
    spans = eligibility.join(schemas.select("table_schema"), "table_schema", "left_semi")
    rolled = demographics.demographics_rollup(spans, list(profile), year, as_of=as_of)
    employers = tenants.customer_schema_join(customers, schemas, placeholders)
    named = tenants.customer_member_fallback(rolled, employers, placeholders)
    return demographics.add_state_code(tenants.industry_left_join(named, industries))
