"""Keeping the latest quote of each ticker and the daily bars from a stream of quotes, with late and repeated ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUOTE_SCHEMA = "price_id bigint, ticker string, date timestamp, close double, close_raw double, volume double, dividend double"


def usable_quotes(quotes: DataFrame, late: str = "10 days") -> DataFrame:
    """Quotes with a ticker, a time and a price above 0, each price_id once, under a watermark."""
    q = quotes.where("ticker is not null and date is not null and close > 0 and not isnan(close)")
    return q.withWatermark("date", late).dropDuplicatesWithinWatermark(["price_id"])


def daily_bars(quotes: DataFrame) -> DataFrame:
    """(ticker, day, close, low, high, volume, n) per ticker and day; a day is final once the watermark has passed it."""
    w = F.window("date", "1 day")
    g = quotes.groupBy("ticker", w).agg(
        F.max_by("close", F.struct("date", "price_id")).alias("close"), F.min("close").alias("low"), F.max("close").alias("high"),
        F.sum("volume").alias("volume"), F.count("*").alias("n"),
    )
    return g.select("ticker", F.col("window.start").cast("date").alias("day"), "close", "low", "high", "volume", "n")


def upsert_latest(path: str, spark_read: Callable[[str], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps under `path` one version per batch of the latest quote of each ticker.

    Each batch reads the version before and writes its own, so a batch that is run again after a loss overwrites its own
    version only (exactly once by batch number).
    """

    def write(batch: DataFrame, number: int) -> None:
        best = F.max(F.struct("date", "price_id", "close", "close_raw")).alias("x")
        new = batch.select("ticker", "date", "price_id", "close", "close_raw")
        fs = batch.sparkSession
        try:
            old = (spark_read or fs.read.parquet)(f"{path}/v={number - 1}")
            new = new.unionByName(old.select(*new.columns))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.groupBy("ticker").agg(best).select("ticker", "x.*").write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def run_latest(quotes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the upsert over what is available now; the query ends when all of it is taken in."""
    return usable_quotes(quotes).writeStream.foreachBatch(upsert_latest(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
