"""Taking in raw data: quarterly series from JSON, cached tables merged with new fetches, retries, reports, sinks."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECENT_DAYS, TRUNCATED_DAYS, WAITS = 3, 365, (5, 20, 60)
SERIES_SCHEMA = "struct<series: struct<quarterly: map<string, array<struct<period: string, v: double>>>, annual: map<string, array<struct<period: string, v: double>>>>>"


def quarterly_series(raw: DataFrame, names: dict[str, str], json_col: str = "payload") -> DataFrame:
    """(ticker, period, <column>...): the named series of a JSON payload per ticker, one row per period.

    `names` maps a series to its column; a series that no payload has is an all-NULL column; payloads that are no JSON
    and points without a period are left out; of a repeated period the first value stays.
    """
    s = raw.select("ticker", F.from_json(json_col, SERIES_SCHEMA).alias("j")).select("ticker", F.explode("j.series.quarterly").alias("name", "points"))
    s = s.where(F.col("name").isin(*names)).select("ticker", "name", F.posexplode("points").alias("k", "p"))
    s = s.select("ticker", "name", "k", F.to_date("p.period").alias("period"), F.col("p.v").alias("v")).where("period is not null")
    wide = s.groupBy("ticker", "period").pivot("name", list(names)).agg(F.min_by("v", "k"))
    return wide.select("ticker", "period", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def year_ends(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """(ticker, period): the distinct periods of all annual series of a payload."""
    s = raw.select("ticker", F.from_json(json_col, SERIES_SCHEMA).alias("j")).select("ticker", F.explode("j.series.annual").alias("name", "points"))
    return s.select("ticker", F.explode("points.period").alias("p")).select("ticker", F.to_date("p").alias("period")).where("period is not null").distinct()


def stale_tickers(cached: DataFrame, tickers: DataFrame, today: str, required: list[str]) -> DataFrame:
    """(ticker): those to fetch again: no rows, a last date more than three days ago, or all if a column is lacking."""
    if set(required) - set(cached.columns):
        return tickers.select("ticker")
    last = cached.groupBy("ticker").agg(F.max("date").alias("last"))
    t = tickers.select("ticker").join(last, "ticker", "left")
    return t.where(F.col("last").isNull() | (F.datediff(F.lit(today).cast("date"), F.to_date("last")) > RECENT_DAYS)).select("ticker")


def merged_history(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Per ticker the fetched history, or the cached one where nothing was fetched or the new one is truncated (it begins
    more than a year after the cached one). One aggregate per side decides; rows move once."""
    first = lambda d, n: d.groupBy("ticker").agg(F.min("date").alias(n))
    both = first(cached, "a").join(first(fetched, "b"), "ticker", "full")
    keep = both.where(F.col("b").isNull() | (F.datediff("b", "a") > TRUNCATED_DAYS)).select("ticker")
    old = cached.join(keep, "ticker", "left_semi")
    return fetched.join(keep, "ticker", "left_anti").unionByName(old, allowMissingColumns=True)


def quality_report(prices: DataFrame, quarters: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, issues): tickers with no prices, fewer than 60 rows, a close at or below 0, no fundamentals, no P/E at all,
    or a median of the last eight quarters' P/E below 1 or P/B below 0.1. Sorted by ticker."""
    p = prices.groupBy("ticker").agg(F.count("*").alias("n"), F.max((F.col("close") <= 0).cast("int")).alias("bad"))
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("period")))
    last8 = F.col("rn") <= 8
    q = quarters.withColumn("rn", rn).groupBy("ticker").agg(
        F.count("*").alias("nq"), F.count("trailing_pe").alias("npe"),
        F.percentile(F.when(last8, F.col("trailing_pe")), F.lit(0.5)).alias("pe"), F.percentile(F.when(last8, F.col("price_to_book")), F.lit(0.5)).alias("pb"),
    )
    t = tickers.select("ticker").distinct().join(p, "ticker", "left").join(q, "ticker", "left")
    say = lambda cond, text: F.when(cond, F.lit(text))
    issues = F.array_compact(F.array(
        say(F.col("n").isNull(), "no prices"), say(F.col("n") < 60, "short prices"), say(F.col("bad") == 1, "close not above 0"),
        say(F.col("nq").isNull(), "no fundamentals"), say(F.col("npe") == 0, "no P/E"), say(F.col("pe") < 1, "low P/E"), say(F.col("pb") < 0.1, "low P/B"),
    ))
    return t.select("ticker", F.concat_ws(", ", issues).alias("issues")).where("issues <> ''").orderBy("ticker")


def with_retry(call: Callable, retryable: Callable[[Exception], bool], waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep):  # noqa: ANN201
    """The result of `call`, tried again after each of the waits while its error is retryable; the last error is raised."""
    for wait in (*waits, None):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if wait is None or not retryable(e):
                raise
            sleep(wait)
    return None


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet partitioned by snapshot, so a report of one date reads that date only."""
    panel.repartition("as_of").write.mode("overwrite").partitionBy("as_of").parquet(path)


def write_prices(prices: DataFrame, path: str, buckets: int = 256) -> None:
    """Parquet in hash buckets of the ticker instead of a file for each ticker."""
    p = prices.withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(buckets)))
    p.repartition(buckets, "bucket").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("bucket").parquet(path)


def price_symbols(tickers: DataFrame) -> DataFrame:
    """(ticker, symbol): class shares have a dash instead of a dot where prices are fetched."""
    return tickers.select("ticker", F.replace("ticker", F.lit("."), F.lit("-")).alias("symbol"))


def raw_prices(fetched: DataFrame) -> DataFrame:
    """(ticker, date, close, close_raw, volume, dividend) of fetched rows, typed and with dividends of 0 where there are none; an
    empty fetch has the same schema. Times lose their zone."""
    have = set(fetched.columns)
    pick = lambda c, kind, otherwise=None: (F.coalesce(F.col(c).cast(kind), F.lit(otherwise)) if c in have else F.lit(otherwise).cast(kind)).alias(c)
    return fetched.select(pick("ticker", "string"), F.to_date("date").alias("date"), pick("close", "double"), (F.col("close_raw") if "close_raw" in have else F.col("close")).cast("double").alias("close_raw"), pick("volume", "double"), pick("dividend", "double", 0.0))


def collect(cached: DataFrame, tickers: DataFrame, fetch: Callable[[DataFrame], DataFrame], today: str, required: list[str], refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(history, failed): a collection, cache first. `fetch` gets the (ticker) table of those whose cache is stale, lacking a
    column or absent (all with `refresh`) and returns their rows; what it returns replaces the cache unless it is truncated.

    failed has the tickers without any row afterwards; a ticker that could not be fetched keeps its old rows.
    """
    ask = tickers.select("ticker").distinct() if refresh else stale_tickers(cached, tickers, today, required)
    history = merged_history(cached, fetch(ask))
    return history, tickers.select("ticker").distinct().join(history.select("ticker").distinct(), "ticker", "left_anti")


def write_report(report: DataFrame, path: str, most: int = 100_000) -> int:
    """One CSV file with a byte order mark, for spreadsheets; reports have a row per ticker. "{date}" in the path becomes the
    snapshot's date. Returns the rows written."""
    rows = report.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a report may have {most} rows; write it with Spark instead")
    if "{date}" in path:
        path = path.replace("{date}", str(rows["as_of"].iloc[0]) if len(rows) and "as_of" in rows else "none")
    Path(path).write_text(rows.to_csv(index=False), encoding="utf-8-sig")
    return len(rows)


def compare_with_reference(panel: DataFrame, reference: DataFrame, column: str, tolerance: float = 0.15) -> DataFrame:
    """Latest value of a multiple per ticker against a supplied reference table: (ticker, ours, theirs, ratio, close)."""
    last = panel.groupBy("ticker").agg(F.max_by(column, "as_of").alias("ours"))
    r = last.join(reference.select("ticker", F.col(column).alias("theirs")), "ticker")
    ratio = F.try_divide("ours", "theirs")
    return r.withColumns({"ratio": ratio, "close": F.coalesce(F.abs(ratio - 1) <= tolerance, F.lit(False))})
