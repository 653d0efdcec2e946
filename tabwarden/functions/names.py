"""Predicates over column names and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules


def forced_name_pattern() -> str:
    not_after = "".join(f"(?<!{stem})" for stem in rules.AGE_NOT_AFTER)
    return "(?i)" + "|".join((f"{not_after}{rules.AGE_PART}", *rules.FORCED_NAME_PARTS))


def is_forced_name(name: Column, label: Column) -> Column:
    """A sensitive topic is named by the column name or the label."""
    both = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(label, F.lit("")))
    return both.rlike(forced_name_pattern())


def _names_platform(text: Column) -> Column:
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")),
                                 rf"^[{rules.WS}]+|[{rules.WS}]+$", ""))
    part, unless = rules.PLATFORM_PART_UNLESS
    return (
        (t == rules.PLATFORM_EXACT)
        | t.contains(rules.PLATFORM_PART)
        | (t.contains(part) & ~t.contains(unless))
    )


def is_platform_name(name: Column, label: Column) -> Column:
    """The name or the label announces a crowd-work participant ID."""
    return _names_platform(name) | _names_platform(label)
