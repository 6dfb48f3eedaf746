"""Price and volume indicators over the daily rows of a ticker, and returns that lie ahead of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators.lastknown import change_history, last_known
from tidemark.operators.windows import last_rows

TECHNICALS = ["ma50_vs_ma200", "pct_from_52w_high", "volatility_63d", "relative_volume", "price_spike_5d", "volume_zscore_63d"]
LEAST_ROWS, YEAR_ROWS = 60, 252
#: Months ahead -> days ahead.
HORIZONS = {1: 30, 3: 91, 6: 182, 12: 365}


def technicals(daily: DataFrame) -> DataFrame:
    """`daily` (one row per ticker and day) with TECHNICALS, each over rows up to the row itself.

    All are NULL before a ticker's 60th row; the moving averages need 200 rows, the volatility more than 5 returns;
    missing volumes are skipped; divisors of 0 give NULL. The windows share one exchange and sort by ticker.
    """
    c = F.col
    w = lambda n: last_rows("ticker", "date", n)
    order = Window.partitionBy("ticker").orderBy("date")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("__rn", F.row_number().over(order)).withColumns({
        "__ret": c("close") / F.lag("close", 1).over(order) - 1, "__block": F.floor((c("__rn") - 1) / YEAR_ROWS),
        "__close": F.sum("close").over(so_far), "__vol": F.sum("volume").over(so_far), "__nvol": F.count("volume").over(so_far),
    })
    # A long sliding frame is evaluated anew for every row. Means come from running sums instead, and the highest close of
    # 252 rows from running maxima of fixed blocks of 252 rows, forwards and backwards: constant work per row.
    block = Window.partitionBy("ticker", "__block")
    d = d.withColumns({
        "__ahead": F.max("close").over(block.orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)),
        "__behind": F.max("close").over(block.orderBy(F.desc("__rn")).rowsBetween(Window.unboundedPreceding, 0)),
    })
    last = lambda x, n: c(x) - F.coalesce(F.lag(x, n).over(order), F.lit(0))
    mean = lambda x, n: last(x, n) / F.least(c("__rn"), F.lit(n))
    volume = lambda n: F.try_divide(F.coalesce(last("__vol", n), F.lit(0.0)), last("__nvol", n))
    gate = c("__rn") >= LEAST_ROWS
    high = F.greatest("__ahead", F.lag("__behind", YEAR_ROWS - 1).over(order))
    mean63, std63 = volume(63), F.stddev_samp("volume").over(w(63))
    # The 63 returns of the last 63 rows; a ticker's first row has none.
    vol = F.when(F.count("__ret").over(w(63)) > 5, F.stddev_samp("__ret").over(w(63)) * F.sqrt(F.lit(252.0)))
    new = {
        "ma50_vs_ma200": F.when(c("__rn") >= 200, mean("__close", 50) / mean("__close", 200) - 1),
        "pct_from_52w_high": (high - c("close")) / high,
        "volatility_63d": vol,
        "relative_volume": F.try_divide(volume(21), mean63),
        "price_spike_5d": F.ln(c("close") / F.lag("close", 5).over(order)),
        "volume_zscore_63d": F.try_divide(c("volume") - mean63, std63),
    }
    return d.select(*[x for x in daily.columns if x not in new], *[F.when(gate, v).alias(k) for k, v in new.items()])


def forward_returns(snapshots: DataFrame, daily: DataFrame) -> DataFrame:
    """`snapshots` (ticker, as_of, close, ...) with fwd_return_1m, _3m, _6m and _12m: the log of the last close in
    (as_of, as_of + days] over the snapshot's close; NULL unless the ticker's prices reach the target day, or when no
    close lies in between."""
    ends = daily.groupBy(F.col("ticker").alias("__t")).agg(F.max("date").alias("__end"))
    closes = daily.withColumn("__tie", F.lit(0))
    history = change_history(closes, "ticker", "date", ["date"], "__tie", ["close"])
    wide = snapshots.select("ticker", "as_of", "close", F.explode(F.array(*[F.lit(d) for d in HORIZONS.values()])).alias("days"))
    wide = wide.dropDuplicates(["ticker", "as_of", "days"]).withColumn("target", F.date_add("as_of", F.col("days")))
    asked = wide.select(F.col("ticker").alias("key"), micros("target").alias("t"), F.struct("ticker", "as_of", "close", "days", "target").alias("e"))
    wide = last_known(history, asked, ["date"], "date", ["__x"])
    wide = wide.join(ends, F.col("ticker") == F.col("__t"), "left")
    ok = (F.col("__end") >= F.col("target")) & (F.col("__x.known_us") > micros("as_of"))
    value = F.when(ok, F.ln(F.col("__x.value") / F.col("close")))
    one = lambda d, m: F.max(F.when(F.col("days") == d, value)).alias(f"fwd_return_{m}m")
    got = wide.groupBy("ticker", "as_of").agg(*[one(d, m) for m, d in HORIZONS.items()])
    return snapshots.join(got, ["ticker", "as_of"], "left")


