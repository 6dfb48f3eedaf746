"""When a quarter became known, and multiples brought from the period's price to the snapshot's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUARTER_LAG_DAYS, YEAR_LAG_DAYS, YEAR_END_TOLERANCE = 45, 75, 20
RESCALED = ["trailing_pe", "price_to_book", "price_to_sales", "price_to_fcf"]


def with_reporting_lag(quarters: DataFrame, year_ends: DataFrame) -> DataFrame:
    """`quarters` with is_fiscal_q4, fiscal_year_end_assumed and known_date = period + 75 days for a fiscal year's last
    quarter, else + 45 days.

    A period is a last quarter if it lies within 20 days (inclusive) of one of the ticker's known closing days (month and
    day, at most the 28th of February) in the year before, of or after it; a ticker without any is taken to close on
    December 31. The closing days of a ticker are at most 366, one array per ticker.
    """
    ends = year_ends.where("ticker is not null and period is not null").select(
        F.col("ticker").alias("__t"), F.month("period").alias("m"), F.when(F.month("period") == 2, F.least(F.dayofmonth("period"), F.lit(28))).otherwise(F.dayofmonth("period")).alias("d")
    )
    ends = ends.groupBy("__t").agg(F.collect_set(F.struct("m", "d")).alias("__ends"))
    q = quarters.join(ends, F.col("ticker") == F.col("__t"), "left").drop("__t")
    days = F.coalesce("__ends", F.array(F.struct(F.lit(12).alias("m"), F.lit(31).alias("d"))))
    near = lambda e: F.exists(F.array(*[F.lit(x) for x in (-1, 0, 1)]), lambda y: F.abs(F.datediff(F.col("period"), F.make_date(F.year("period") + y, e["m"], e["d"]))) <= YEAR_END_TOLERANCE)
    q = q.withColumns({"is_fiscal_q4": F.exists(days, near), "fiscal_year_end_assumed": F.col("__ends").isNull()})
    lag = F.when(F.col("is_fiscal_q4"), YEAR_LAG_DAYS).otherwise(QUARTER_LAG_DAYS)
    return q.withColumn("known_date", F.date_add("period", lag)).drop("__ends")


def rescaled(df: DataFrame, price: str = "price", period_price: str = "period_price", ev: bool = True) -> DataFrame:
    """Multiples times price / period price; the former ones are kept as <multiple>_reported.

    EV/EBITDA moves only by the market value's part of the enterprise value: factor 1 + (P/B * book / EV) * (ratio - 1),
    the plain ratio where one of the two values is unknown or not above 0, NULL where the factor is not above 0; unchanged if `ev` is off. Rows
    without one of the two prices above 0 keep their multiples.
    """
    c = F.col
    ratio = F.when((c(price) > 0) & (c(period_price) > 0), c(price) / c(period_price))
    new = {f"{m}_reported": c(m) for m in [*RESCALED, "ev_to_ebitda"]}
    new |= {m: F.when(ratio.isNotNull(), c(m) * ratio).otherwise(c(m)) for m in RESCALED}
    if ev:
        worth = c("price_to_book") * c("book_value")
        part = F.when((c("enterprise_value") > 0) & (worth > 0), worth / c("enterprise_value"))
        factor = F.coalesce(1 + part * (ratio - 1), ratio)
        new["ev_to_ebitda"] = F.when(ratio.isNull(), c("ev_to_ebitda")).when(factor > 0, c("ev_to_ebitda") * factor)
    return df.select(*[x for x in df.columns if x not in new], *[v.alias(k) for k, v in new.items()])


def sized(df: DataFrame, period_price: str = "period_price") -> DataFrame:
    """log_book_value, log_revenue and normalized_pe; NULL unless everything in them is above 0."""
    c = F.col
    book = F.when(c("book_value") > 0, c("book_value"))
    shares = F.when((c("price_to_book_reported") > 0) & (c(period_price) > 0), c("price_to_book_reported") * book / c(period_price))
    return df.withColumns({
        "log_book_value": F.ln(book), "log_revenue": F.when(c("sps_ttm") > 0, F.ln(c("sps_ttm") * shares)),
        "normalized_pe": F.when(c("eps_avg_3y") > 0, c("price") / (4 * c("eps_avg_3y"))),
    })
