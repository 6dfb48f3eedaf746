"""Readers of the parquet tables of one directory, and where lineage may be cut."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import finite, nan_to_null

#: Missing columns a fundamentals table may lack; they are added as typed NULLs.
FUNDAMENTAL_FIELDS = [
    "trailing_pe", "price_to_book", "price_to_sales", "ev_to_ebitda", "price_to_fcf", "return_on_equity", "roic",
    "gross_margin", "operating_margin", "fcf_margin", "debt_to_equity", "net_debt_to_capital", "current_ratio",
    "asset_turnover", "sga_to_sales", "eps", "payout_ratio_ttm", "sales_per_share", "enterprise_value", "book_value",
]


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of a directory of parquet tables, only `columns` of it if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """As `read`, with NaN turned to NULL."""
    return nan_to_null(read(spark, sf_dir, name, *columns))


_stored: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """The table checkpointed to the shared folder of spark.checkpoint.dir; a folder of this machine only where none
    is named and the session is a local one. `release` deletes what was stored; it runs at the end of the program as well."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    if not _stored:
        atexit.register(release)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _stored.append(file.get())
    return out


def release() -> int:
    """Deletes the tables that `cut` has stored in this program, and says how many there were. Plans that read them cannot be
    run after it."""
    n, spark = 0, SparkSession.getActiveSession()
    while _stored:
        name = _stored.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            n += int(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
        except Exception:  # noqa: BLE001  the session has gone: nothing can be deleted through it
            continue
    return n


def usable_quotes(prices: DataFrame) -> DataFrame:
    """The quotes with ticker, date and a close above 0 whose quoted price, if there is one, is above 0 as well."""
    return nan_to_null(prices).where("ticker is not null and date is not null and close > 0" + (" and (close_raw is null or close_raw > 0)" if "close_raw" in prices.columns else ""))


def span_of(days: DataFrame, day: str = "date") -> tuple[Column, Column]:
    """First and last day of a table as scalar subqueries, so that nothing runs before the plan does; without rows the
    first day is after the last one."""
    end = lambda f, none: F.coalesce(days.select(F.to_date(day).alias("d")).agg(f("d")).scalar(), F.lit(none).cast("date"))
    return end(F.min, "9999-12-31"), end(F.max, "0001-01-01")


def by_day(prices: DataFrame) -> DataFrame:
    """One row per ticker and day, the last quote of the day (ties: the largest price_id), without unusable ones.

    Rows without ticker, date or close and rows whose close or quoted price is not above 0 are left out. What is left
    per ticker is bounded by the calendar, however many quotes a ticker has: the aggregate combines before it shuffles.
    """
    p = usable_quotes(prices)
    raw = F.col("close_raw") if "close_raw" in p.columns else F.col("close")
    p = p.select(
        "ticker", F.to_date("date").alias("date"), "close", raw.alias("close_raw"), "volume",
        (F.col("dividend") if "dividend" in p.columns else F.lit(0.0)).alias("dividend"),
        F.struct(F.col("date").alias("at"), F.col("price_id")).alias("o"),
    )
    last = F.max(F.struct("o", "close", "close_raw", "volume", "dividend")).alias("x")
    return p.groupBy("ticker", "date").agg(last).select(
        "ticker", "date", "x.close", "x.close_raw", "x.volume", "x.dividend"
    )


def by_quarter(fundamentals: DataFrame) -> DataFrame:
    """One row per ticker and period: the version with the latest available_date (rows without one come first), of
    equals the smallest fund_id. Rows without ticker or period are left out; NaN and infinite values become NULL."""
    fields = [c for c in FUNDAMENTAL_FIELDS if c in fundamentals.columns]
    f = fundamentals.withColumns({c: finite(c) for c in fields})
    best = F.max(F.struct("available_date", (-F.col("fund_id")).alias("k"), *fields)).alias("x")
    f = f.where("ticker is not null and period is not null").groupBy("ticker", "period").agg(best)
    return f.select("ticker", "period", "x.available_date", (-F.col("x.k")).alias("fund_id"), *[f"x.{c}" for c in fields])
