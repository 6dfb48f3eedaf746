"""Snapshot dates, and picking the daily row that is valid at each of them without a join."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_STALENESS_DAYS = 10


def day(d: date | Column) -> Column:
    """The day as a date column; columns (scalar subqueries over the data) stay as they are."""
    return d if isinstance(d, Column) else F.lit(d.isoformat()).cast("date")


def snapshot_calendar(spark: SparkSession, start: date | Column, today: date | Column) -> DataFrame:
    """(as_of): the quarter starts from the first one not before `start` up to `today`, and `today` itself; no rows if
    `start` is after `today`."""
    span = spark.range(1).select(day(start).alias("a"), day(today).alias("b")).where("a <= b")
    begin = F.trunc("a", "quarter")
    first = F.when(begin == F.col("a"), begin).otherwise(F.add_months(begin, 3))
    quarters = F.when(first <= F.col("b"), F.sequence(first, F.col("b"), F.expr("interval 3 months"))).otherwise(F.array().cast("array<date>"))
    return span.select(F.explode(F.array_union(quarters, F.array("b"))).alias("as_of"))


def next_quarter_start(day: Column) -> Column:
    """The first quarter start that is not before the day."""
    return F.add_months(F.trunc(F.date_sub(day, 1), "quarter"), 3)


def valid_snapshots(daily: DataFrame, key: str, at: str, start: date | Column, today: date | Column, stale_days: int = MAX_STALENESS_DAYS) -> DataFrame:
    """The rows of `daily` that are the last known at a snapshot date, with its `as_of`.

    A row is valid from its day until the day before the key's next row, but no longer than `stale_days` days; a key
    without a row that recent has no row for that date. `daily` has one row per key and day. Each row finds the quarter
    start in its span by arithmetic, so the as-of match costs a window over (key, day) and no join; stale_days is below
    the length of a quarter.
    """
    if not 0 <= stale_days < 89:
        raise ValueError("stale_days must be shorter than a quarter")
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    until = F.least(F.date_add(at, stale_days), F.coalesce(F.date_sub(following, 1), F.date_add(at, stale_days)))
    q = next_quarter_start(F.col(at))
    d = daily.withColumns({"__until": until, "__start": day(start), "__today": day(today)})
    at_quarter = F.when((q <= F.col("__until")) & (q >= F.col("__start")) & (q <= F.col("__today")), q)
    at_today = F.when((F.col(at) <= F.col("__today")) & (F.col("__today") <= F.col("__until")), F.col("__today"))
    dates = F.array_distinct(F.array_compact(F.array(at_quarter, at_today)))
    return d.select(*daily.columns, F.explode(dates).alias("as_of"))
