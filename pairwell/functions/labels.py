"""Codes, names and labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import fixed_values as fixed


def lookup(mapping: dict[str, str], col: Column) -> Column:
    """Value of a constant map; a miss gives null."""
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(entries, col)


def decode_sex(col: Column) -> Column:
    return F.when(col == 1, "M").when(col == 2, "F")


def strip_prefix(col: Column, n: int) -> Column:
    return F.substring(col, F.lit(n + 1), F.length(col))


def revcode_to_r(col: Column) -> Column:
    """Revenue code with its first character replaced by ``R``."""
    return F.concat(F.lit("R"), strip_prefix(col, 1))


def strip_dots(col: Column) -> Column:
    return F.replace(col, F.lit("."), F.lit(""))


def strip_quote(col: Column) -> Column:
    return F.replace(col, F.lit("'"), F.lit(""))


def ilike_joiner(col: Column) -> Column:
    """Wildcard pattern that matches a code with or without its dots."""
    return F.concat(F.lit("%"), F.replace(col, F.lit("."), F.lit("%")), F.lit("%"))


def like_classify(col: Column, rules: Sequence[tuple[str, str]], default: str = "x") -> Column:
    """Category of the first LIKE pattern that matches."""
    out = F.lit(default)
    for pattern, category in reversed(rules):
        out = F.when(col.like(pattern), category).otherwise(out)
    return out


def like_any(col: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | col.like(pattern)
    return out


def map_state(col: Column) -> Column:
    return lookup(fixed.STATE_CODES, col)


def map_customer(col: Column, names: Mapping[str, str] = fixed.CUSTOMER_NAMES) -> Column:
    """Upper-cased employer name, replaced where ``names`` has another."""
    return F.coalesce(lookup(names, F.upper(col)), F.upper(col))


def coalesce_placeholder(
    col: Column, fallback: Column, placeholders: Sequence[str] = fixed.PLACEHOLDER_CUSTOMERS
) -> Column:
    """``col`` unless it is null or a placeholder, else ``fallback``."""
    return F.coalesce(F.when(~col.isin(*placeholders), col), fallback)


def program_group(col: Column, names: Sequence[str], group: str) -> Column:
    """Collapse the listed names into one."""
    return F.when(col.isin(*names), group).otherwise(col)


def keep_listed(col: Column, names: Sequence[str], other: str) -> Column:
    """Keep the listed names, everything else becomes ``other``."""
    return F.when(col.isin(*names), col).otherwise(other)


def clamp_end_date(col: Column, as_of: Column) -> Column:
    return F.least(col, as_of)


def sanitize_value(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, "[^a-zA-Z0-9]", ""))


def snake(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), " ", "_")


def snake_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def sanitize_name(value: str) -> str:
    return re.sub("[^a-zA-Z0-9]", "", value).lower()


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_name(c) for c in df.columns])


def collapse_control_label(col: Column) -> Column:
    return F.when(col.contains("control"), "control").otherwise(col)


def label_concat(*parts: Column | str, sep: str = " ") -> Column:
    """Label from columns and literal text; null if a column is null."""
    out: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            out.append(F.lit(sep))
        out.append(F.lit(part) if isinstance(part, str) else part.cast("string"))
    return F.concat(*out)


def zip_to_int(col: Column) -> Column:
    return F.coalesce(col.try_cast("int"), F.lit(0))
