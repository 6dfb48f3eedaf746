"""Queries of the panel pipeline over prices, fundamentals, fiscal_year_ends and universe, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import real_number
from tidemark.operators import calendar, dividends, reporting, technicals, trends
from tidemark.operators.lastknown import attributes_as_of
from tidemark.operators.windows import nearest_prior
from tidemark.plans import panel as plan
from tidemark.sources.tables import by_day, by_quarter, read, span_of, usable_quotes

def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show."""
    return df.withColumns({c: F.round(F.col(c), digits) for c, k in df.dtypes if k == "double"})


def _fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "fundamentals").withColumns({c: real_number(c) for c in ("eps", "sales_per_share")})


def _snapshots(spark: SparkSession, sf: str, daily: DataFrame) -> DataFrame:
    """The daily rows that are valid at a snapshot between the first and the last day of the prices."""
    return calendar.valid_snapshots(daily, "ticker", "date", *span_of(usable_quotes(read(spark, sf, "prices"))))


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    prices = read(spark, sf, "prices")
    return plan.priced_snapshots(prices, *span_of(usable_quotes(prices)))


def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    return by_quarter(_fundamentals(spark, sf)).withColumn("net_margin", F.try_divide("eps", "sales_per_share"))


def s08_daily_rows(spark: SparkSession, sf: str) -> DataFrame:
    return by_day(read(spark, sf, "prices"))


def s02_quarters(spark: SparkSession, sf: str) -> DataFrame:
    q = _quarters(spark, sf)
    return q.select("ticker", "period", "available_date", "fund_id", "eps", "sales_per_share", "book_value")


def j01_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot dates between the first and the last day of the usable prices."""
    return calendar.snapshot_calendar(spark, *span_of(usable_quotes(read(spark, sf, "prices"))))


def j02_prior_reading(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest earlier reading of eps and sales_per_share, one and three years back."""
    q = _quarters(spark, sf).withColumn("d", F.unix_date("period"))
    near = lambda c, n: F.expr(nearest_prior("ticker", "d", c, n)).alias(f"{c}_{n}")
    return q.select("ticker", "period", *[near(c, n) for c in ("eps", "sales_per_share") for n in (365, 1095)])


def j03_known_quarter(spark: SparkSession, sf: str) -> DataFrame:
    """Per snapshot of a traded ticker the quarter that counts as known."""
    snaps = _snapshots(spark, sf, by_day(read(spark, sf, "prices"))).select("ticker", "as_of")
    q = reporting.with_reporting_lag(by_quarter(_fundamentals(spark, sf)), read(spark, sf, "fiscal_year_ends"))
    out = plan.with_fundamentals(snaps, q.select("ticker", "period", "known_date", "is_fiscal_q4", "fund_id"))
    return out.select("ticker", "as_of", "fundamentals_period", "known_date", "is_fiscal_q4", "fund_id")


def j04_price_at_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Last trade at most 10 days before each snapshot, and the last quoted price of any age."""
    return _priced(spark, sf).select("ticker", "as_of", "date", "close", "price")


def j06_price_at_period(spark: SparkSession, sf: str) -> DataFrame:
    """Last quoted price up to each quarter's end, of any age."""
    daily = by_day(read(spark, sf, "prices")).select("ticker", "date", F.col("close_raw").alias("period_price"), F.lit(0).alias("z"))
    q = by_quarter(_fundamentals(spark, sf)).select("ticker", "period")
    return attributes_as_of(q, daily, event_key="ticker", event_time="period", row_key="ticker", known_at="date", latest_by=["date"], tie="z", attributes=["period_price"])


def j08_forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    daily = by_day(read(spark, sf, "prices"))
    snaps = _snapshots(spark, sf, daily).select("ticker", "as_of", "close")
    return rounded(technicals.forward_returns(snaps, daily))


def f01_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Growth, rolling levels, volatilities, earnings growth, trajectory."""
    t = trends.trends(_quarters(spark, sf))
    return rounded(t.select("ticker", "period", *[c for c in trends.TREND_COLUMNS if "period" not in c and "ratio" not in c]), 9)


def f22_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """one-off earnings and per-share breaks within the last four quarters."""
    t = trends.trends(_quarters(spark, sf))
    return rounded(t.select("ticker", "period", "eps_one_off_period", "eps_one_off_ratio", "per_share_break_period", "per_share_break_ratio"))


def l01_reporting_lag(spark: SparkSession, sf: str) -> DataFrame:
    q = reporting.with_reporting_lag(by_quarter(_fundamentals(spark, sf)), read(spark, sf, "fiscal_year_ends"))
    return q.select("ticker", "period", "is_fiscal_q4", "fiscal_year_end_assumed", "known_date")


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return plan.raw_panel(read(spark, sf, "prices"), _fundamentals(spark, sf), read(spark, sf, "fiscal_year_ends"), read(spark, sf, "universe"))


def l04_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    """Multiples at the snapshot's price, sizes, normalized P/E."""
    p = _panel(spark, sf)
    cols = ["price", "period_price", *[f"{m}_reported" for m in (*reporting.RESCALED, "ev_to_ebitda")], *reporting.RESCALED, "ev_to_ebitda", "log_book_value", "log_revenue", "normalized_pe"]
    return rounded(p.select("ticker", "as_of", *cols), 7)


def v01_dividends(spark: SparkSession, sf: str) -> DataFrame:
    daily = by_day(read(spark, sf, "prices"))
    snaps = _priced(spark, sf).select("ticker", "as_of", "price")
    return rounded(dividends.dividend_features(snaps, daily))


def x01_technicals(spark: SparkSession, sf: str) -> DataFrame:
    p = _priced(spark, sf)
    return rounded(p.select("ticker", "as_of", *technicals.TECHNICALS))


def built_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The whole panel with percentiles and scores (B1 to B4), from the first to the last day of the prices."""
    return plan.scores(plan.add_percentiles(_panel(spark, sf)))


def b02_panel(spark: SparkSession, sf: str) -> DataFrame:
    """`built_panel`, rounded."""
    return rounded(built_panel(spark, sf), 9)


def _given(spark: SparkSession, sf: str) -> DataFrame:
    """The given panel, one row per ticker and snapshot (the smallest panel_id), without infinities and filler codes."""
    p = read(spark, sf, "panel").where("ticker is not null and as_of is not null")
    num = [c for c, k in p.dtypes if k == "double"]
    p = p.groupBy("ticker", "as_of").agg(F.min(F.struct("panel_id", *[c for c in p.columns if c not in ("ticker", "as_of", "panel_id")])).alias("x")).select("ticker", F.to_date("as_of").alias("as_of"), "x.*")
    return p.withColumns({c: real_number(c) for c in num})


def b03_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = _given(spark, sf).where("sector is not null")
    out = plan.scores(plan.add_percentiles(p))
    return rounded(out.select("ticker", "as_of", *[c for c in out.columns if c.endswith("_pct")], "valuation_score", "quality_score", "momentum_score", "sector_valuation_rank"))


def b05_missing(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "panel")
    return rounded(plan.missing_report(p, [c for c, k in p.dtypes if k == "double"]), 9)


def b05_payers(spark: SparkSession, sf: str) -> DataFrame:
    """Share of dividend payers in the last snapshot of the given panel."""
    p = read(spark, sf, "panel").where("as_of is not null").withColumn("dividend_yield", real_number("dividend_yield"))
    return rounded(plan.payer_share(p), 9)


def b06_eps_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Price over earnings of four quarters against the reported P/E, on the built panel."""
    return rounded(plan.eps_basis(_panel(spark, sf)))


QUERIES = {f.__name__: f for f in (s02_quarters, s08_daily_rows, j01_calendar, j02_prior_reading, j03_known_quarter, j04_price_at_snapshot, j06_price_at_period, j08_forward_returns, f01_trends, f22_breaks, l01_reporting_lag, l04_rescaled, v01_dividends, x01_technicals, b02_panel, b03_percentiles, b05_missing, b05_payers, b06_eps_basis)}
