"""Row windows with a least number of values, ranks without nulls, and the nearest earlier reading.

All expressions over one key and order share a single exchange and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def last_rows(key: str, order: str, rows: int, until: int = 0) -> WindowSpec:
    """The current row and those before it, `rows` in all, ending `until` rows before the current one."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1) - until, -until)


def over_rows(key: str, order: str, rows: int, until: int = 0) -> str:
    """`last_rows` as SQL: what follows OVER."""
    end = "CURRENT ROW" if until == 0 else f"{until} PRECEDING"
    return f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {rows - 1 + until} PRECEDING AND {end})"


def gated(value: str, stat: str, over: str, least: int) -> str:
    """SQL of an aggregate over a window, NULL unless at least `least` values in it are present.

    These two are SQL text, since a plan with dozens of window columns is built several times faster from it than from
    Column calls, each of which goes to the JVM.
    """
    return f"CASE WHEN count({value}) OVER {over} >= {least} THEN {stat} OVER {over} END"


def nearest_prior(key: str, day: str, value: str, days: int, tolerance: int = 45) -> str:
    """SQL of the present value whose day is nearest to `days` before the row's own, at most `tolerance` days off
    (inclusive); of two equally near ones the earlier; NULL if there is none.

    `day` is an integer column of days. The candidates are the few rows of a range frame, so nothing is joined, and
    several of these share one sort. Rows of a key with the same day are candidates each; the smallest value wins.
    """
    over = f"(PARTITION BY {key} ORDER BY {day} RANGE BETWEEN {days + tolerance} PRECEDING AND {days - tolerance} PRECEDING)"
    near = f"collect_list(CASE WHEN {value} IS NOT NULL THEN struct({day} AS d, {value} AS v) END) OVER {over}"
    return f"array_min(transform({near}, x -> struct(abs(x.d - ({day} - {days})) AS gap, x.d AS d, x.v AS v))).v"


def percent_rank_max(value: Column, keys: Sequence[str | Column], least: int = 3) -> Column:
    """100 * (how many of the group are not above the value) / (how many are present); NULL for a missing value or a
    group with fewer than `least` present ones. Ties have the highest rank among them."""
    up_to = Window.partitionBy(*keys).orderBy(value.asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    n = F.count(value).over(Window.partitionBy(*keys))
    return F.when(value.isNotNull() & (n >= least), 100.0 * F.count(value).over(up_to) / n)


def percent_rank_average(value: Column, keys: Sequence[str | Column]) -> Column:
    """Average rank of ties / how many are present, in (0, 1]; NULL for a missing value."""
    w = Window.partitionBy(*keys).orderBy(value.asc_nulls_last())
    ties = F.count(value).over(Window.partitionBy(*keys, value))
    n = F.count(value).over(Window.partitionBy(*keys))
    return F.when(value.isNotNull(), (F.rank().over(w) + (ties - 1) / 2.0) / n)


def quantile_bucket(keys: Sequence[str | Column], order: Sequence[Column], buckets: int = 5) -> Column:
    """0-based bucket of equal-width quantile edges over the ranks 1..n of a group: the first rank is in bucket 0,
    rank r in bucket ceil((r - 1) * buckets / (n - 1)) - 1. It differs from ntile for most sizes."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    top = (r - 1) * buckets
    return F.when(r == 1, 0).otherwise(F.floor((top + n - 2) / (n - 1)).cast("int") - 1)


def median_of(values: Column) -> Column:
    """Median of the present numbers of an array; NULL for an empty one."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def mean_of(values: Sequence[Column]) -> Column:
    """Mean of the present ones of some columns; NULL if none is."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(n > 0, total / n)
