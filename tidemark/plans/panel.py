"""The point-in-time panel: one row per ticker and snapshot, from prices, fundamentals, closing dates and the universe.

Nothing in a row was known later than its as_of but the forward returns, which are labels. Exchanges: prices by ticker
(daily rows, technicals, spans), fundamentals by ticker (trends), and the joins by (ticker, as_of) or (ticker, period).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import dividends, reporting, technicals, trends
from tidemark.operators.calendar import valid_snapshots
from tidemark.operators.lastknown import ROW, attributes_as_of
from tidemark.operators.windows import mean_of, percent_rank_max
from tidemark.sources.tables import by_day, by_quarter, cut, span_of

#: Indicator -> whether a lower value is better. Fixed choices of the percentile table.
INDICATORS = {
    "trailing_pe": True, "price_to_book": True, "price_to_sales": True, "ev_to_ebitda": True, "price_to_fcf": True,
    "debt_to_equity": True, "pct_from_52w_high": True, "volatility_63d": True, "dividend_yield": False,
    "return_on_equity": False, "operating_margin": False, "revenue_growth_yoy": False, "ma50_vs_ma200": False,
    "relative_volume": False,
}
VALUATION = ["trailing_pe", "price_to_book", "price_to_sales", "ev_to_ebitda", "price_to_fcf", "dividend_yield"]
QUALITY = ["return_on_equity", "debt_to_equity", "operating_margin", "revenue_growth_yoy"]
MOMENTUM = ["ma50_vs_ma200", "pct_from_52w_high"]


def priced_snapshots(prices: DataFrame, start: date | Column, today: date | Column) -> DataFrame:
    """(ticker, as_of, date, close, price, technicals...): the last trade at most 10 days before each snapshot, and the
    last quoted price, which can be older. A ticker without such a trade has no row."""
    return snapshots_of(by_day(prices), start, today)


def snapshots_of(daily: DataFrame, start: date | Column, today: date | Column) -> DataFrame:
    """`priced_snapshots` from the rows of `sources.tables.by_day`."""
    quoted = F.last("close_raw", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = technicals.technicals(daily).withColumn("price", quoted)
    return valid_snapshots(rows, "ticker", "date", start, today)


def known_quarters(fundamentals: DataFrame, year_ends: DataFrame, daily: DataFrame) -> DataFrame:
    """Quarters with trends, the day they count as known and the quoted price at the period's end (any age)."""
    q = by_quarter(fundamentals)
    if "net_margin" not in q.columns:
        q = q.withColumn("net_margin", F.try_divide("eps", "sales_per_share"))
    q = reporting.with_reporting_lag(trends.trends(q), year_ends)
    quotes = daily.select("ticker", "date", F.col("close_raw").alias("period_price"), F.lit(0).alias("zero"))
    return attributes_as_of(
        q, quotes, event_key="ticker", event_time="period", row_key="ticker", known_at="date", latest_by=["date"],
        tie="zero", attributes=["period_price"],
    )


def with_fundamentals(snapshots: DataFrame, quarters: DataFrame) -> DataFrame:
    """`snapshots` with the columns of the quarter that was known last at as_of (of the same day the later period)."""
    q = quarters.withColumn("__day", F.unix_date("period"))
    s = attributes_as_of(
        snapshots, q, event_key="ticker", event_time="as_of", row_key="ticker", known_at="known_date",
        latest_by=["known_date", "period"], tie="__day", attributes=[ROW],
    )
    q = q.withColumnsRenamed({"ticker": "__t", "period": "fundamentals_period"})
    clash = [c for c in q.columns if c in s.columns]
    return s.join(q.drop(*clash), (F.col("ticker") == F.col("__t")) & (F.col("row_from") == F.col("__day")), "left").drop("__t", "__day", "row_from")


def with_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Sector, size group and industry of the ticker; defaults Unknown, large and '<sector> 기타'."""
    u = universe.select(F.col("ticker").alias("__t"), "sector", "size_group", "industry").dropDuplicates(["__t"])
    df = df.drop("sector", "size_group", "industry").join(u, F.col("ticker") == F.col("__t"), "left").drop("__t")
    sector = F.coalesce("sector", F.lit("Unknown"))
    return df.withColumns({"sector": sector, "size_group": F.coalesce("size_group", F.lit("large")), "industry": F.coalesce("industry", F.concat(sector, F.lit(" 기타")))})


def raw_panel(
    prices: DataFrame, fundamentals: DataFrame, year_ends: DataFrame, universe: DataFrame, start: date | None = None, today: date | None = None,
) -> DataFrame:
    """The panel without percentiles; start and today are the first and last day of usable prices unless given.

    The daily rows feed four branches, the quarters and the snapshots two each, so all three are written once to the checkpoint
    folder instead of being computed from the raw tables for each.
    """
    daily = cut(by_day(prices))
    low, high = span_of(daily)
    quarters = cut(known_quarters(fundamentals, year_ends, daily))
    snaps = cut(snapshots_of(daily, start or low, today or high))
    p = with_fundamentals(snaps, quarters)
    p = with_universe(p, universe).withColumn("fiscal_year_end_assumed", F.coalesce("fiscal_year_end_assumed", F.lit(True)))
    p = dividends.dividend_features(reporting.sized(reporting.rescaled(p)), daily)
    ahead = technicals.forward_returns(snaps.select("ticker", "as_of", "close"), daily).drop("close")
    return p.join(ahead, ["ticker", "as_of"], "left")


def add_percentiles(panel: DataFrame, by: tuple[str, str] = ("as_of", "sector")) -> DataFrame:
    """<indicator>_pct: the percentile within (as_of, sector), high for good; NULL for a missing value and in groups
    with fewer than three present values. Indicators that the panel lacks are skipped."""
    have = {k: low for k, low in INDICATORS.items() if k in panel.columns}
    rank = {k: percent_rank_max(F.col(k), by) for k in have}
    return panel.withColumns({f"{k}_pct": (100.0 - rank[k]) if low else rank[k] for k, low in have.items()})


def scores(panel: DataFrame) -> DataFrame:
    """Means of the present percentiles: valuation_score, quality_score, momentum_score; and sector_valuation_rank."""
    of = lambda names: mean_of([F.col(f"{n}_pct") for n in names if f"{n}_pct" in panel.columns])
    s = panel.withColumns({"valuation_score": of(VALUATION), "quality_score": of(QUALITY), "momentum_score": of(MOMENTUM)})
    return s.withColumn("sector_valuation_rank", percent_rank_max(F.col("valuation_score"), ["as_of", "sector"]))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, missing_share): share of NULL or NaN values per column; one pass."""
    share = lambda c: F.avg((F.col(c).isNull() | F.isnan(c)).cast("double"))
    wide = df.agg(*[share(c).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "missing_share")


def payer_share(panel: DataFrame) -> DataFrame:
    """(as_of, payers): share of the rows of the last snapshot that pay dividends; no yield counts as none."""
    last = panel.where(F.col("as_of") == panel.agg(F.max("as_of")).scalar())
    return last.groupBy("as_of").agg(F.avg((F.coalesce(F.col("dividend_yield"), F.lit(0.0)) > 0).cast("double")).alias("payers"))


def eps_basis(panel: DataFrame) -> DataFrame:
    """(median_ratio, share_within_15pct): how price / eps_ttm compares with trailing_pe, over rows with both above 0. The median
    has bounded state (percentile_approx, the lower one of two)."""
    r = panel.where("eps_ttm > 0 and trailing_pe > 0").select((F.col("price") / F.col("eps_ttm") / F.col("trailing_pe")).alias("r")).where("r is not null")
    return r.agg(F.percentile_approx("r", 0.5, 10_000).alias("median_ratio"), F.avg((F.abs(F.col("r") - 1) <= 0.15).cast("double")).alias("share_within_15pct"))
