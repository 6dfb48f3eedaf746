"""Trends of quarterly fundamentals: growth, rolling levels and volatilities, one-off and per-share breaks.

One row per ticker and period comes in (`sources.tables.by_quarter`) and goes out. Everything is windows over
(ticker, period), so there is one exchange; per ticker there are no more rows than the calendar has quarters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ensure_columns
from tidemark.operators.windows import gated, nearest_prior, over_rows

YEAR, THREE_YEARS = 365, 1095
ONE_OFF_FACTOR, PER_SHARE_FACTOR, SPAN_DAYS = 3.0, 1.5, 300
NEEDED = ["sales_per_share", "operating_margin", "return_on_equity", "eps", "gross_margin", "fcf_margin", "book_value", "net_margin"]

TREND_COLUMNS = [
    "revenue_growth_yoy", "sps_ttm", "revenue_cagr_3y", "op_margin_volatility", "op_margin_avg_3y", "roe_avg_3y",
    "eps_ttm", "eps_avg_3y", "roe_spike", "eps_spike", "eps_cagr_3y", "earnings_cagr_3y", "earnings_turnaround_3y",
    "growth_consistency_3y", "eps_volatility_3y", "roe_volatility_3y", "gross_margin_volatility_3y", "loss_share_3y",
    "cash_conversion_3y", "revenue_growth_accel", "revenue_growth_ttm", "revenue_growth_ttm_accel", "op_margin_change_1y",
    "gross_margin_change_1y", "eps_one_off_period", "eps_one_off_ratio", "per_share_break_period", "per_share_break_ratio",
]


def _cagr3(now: Column, then: Column) -> Column:
    """Yearly growth over three years; NULL unless both are above 0."""
    return F.when((now > 0) & (then > 0), F.pow(now / then, F.lit(1.0 / 3)) - 1)


def _share(x: Column, of: Column) -> Column:
    """(x - of) / |of|; NULL when of is 0."""
    return F.try_divide(x - of, F.abs(of))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _outside(r: Column, factor: float) -> Column:
    return (r > factor) | (r < 1 / factor)


def trends(quarters: DataFrame) -> DataFrame:
    """`quarters` with the columns TREND_COLUMNS.

    Windows count rows, their least sizes count present values. "ttm" sums need four present quarters that span at most
    300 days; three-year means need 8 of 12 rows (the EPS mean all 12 within 1095 days); "prior" values are the nearest
    reading to one or three years before within 45 days. Missing input columns count as all missing. NULL wherever a
    part is missing or a divisor is 0. A hit of a break is dated to the row itself or the nearest of the three before.
    """
    q = ensure_columns(quarters, dict.fromkeys(NEEDED, "double")).withColumn("__day", F.datediff("period", F.lit("1970-01-01").cast("date")))
    c = F.col
    w4, w12 = over_rows("ticker", "__day", 4), over_rows("ticker", "__day", 12)
    rows = "(PARTITION BY ticker ORDER BY __day)"
    prior = lambda x, d: F.expr(nearest_prior("ticker", "__day", x, d))
    lag = lambda x, k: F.expr(f"lag({x}, {k}) OVER {rows}")
    within = lambda k, days, then: F.expr(f"CASE WHEN __day - lag(__day, {k}) OVER {rows} <= {days} THEN {then} END")
    ttm = lambda x: within(3, SPAN_DAYS, gated(x, f"sum({x})", w4, 4))
    avg = lambda x: F.expr(gated(x, f"avg({x})", w12, 8))
    std = lambda x: F.expr(gated(x, f"stddev_samp({x})", w12, 8))

    q = q.withColumns({
        "__sps_1y": prior("sales_per_share", YEAR), "__eps_1y": prior("eps", YEAR), "sps_ttm": ttm("sales_per_share"), "eps_ttm": ttm("eps"),
        "__net_income": F.when(c("book_value") > 0, c("return_on_equity") * c("book_value")),
    })
    q = q.withColumns({
        "revenue_growth_yoy": _share(c("sales_per_share"), c("__sps_1y")),
        "__sps_ttm_1y": prior("sps_ttm", YEAR), "__sps_ttm_3y": prior("sps_ttm", THREE_YEARS), "__eps_ttm_3y": prior("eps_ttm", THREE_YEARS),
        "__ni_3y": prior("__net_income", THREE_YEARS),
        "__om_1y": prior("operating_margin", YEAR), "__gm_1y": prior("gross_margin", YEAR),
        "op_margin_volatility": std("operating_margin"), "op_margin_avg_3y": avg("operating_margin"), "roe_avg_3y": avg("return_on_equity"),
        "eps_avg_3y": within(11, THREE_YEARS, gated("eps", "avg(eps)", w12, 12)),
        "roe_volatility_3y": std("return_on_equity"), "gross_margin_volatility_3y": std("gross_margin"),
        "__eps_mean": avg("eps"), "__eps_std": std("eps"), "__loss": (c("eps") <= 0).cast("double"),
        "__fcf_mean": avg("fcf_margin"), "__net_mean": avg("net_margin"),
        "__eps_typical": F.expr(gated("eps", "percentile(eps, 0.5)", over_rows("ticker", "__day", 8, 1), 6)),
        "__sps_last": lag("sales_per_share", 1),
    })
    has_eps = c("eps_ttm").isNotNull() & c("__eps_ttm_3y").isNotNull()
    now, then = F.when(has_eps, c("eps_ttm")).otherwise(c("__net_income")), F.when(has_eps, c("__eps_ttm_3y")).otherwise(c("__ni_3y"))
    eps_year = F.when(c("__eps_1y") > 0, c("eps") / c("__eps_1y"))
    eps_usual = F.when(c("__eps_typical") > 0, c("eps") / c("__eps_typical"))
    sps_year = F.when(c("__sps_1y") > 0, c("sales_per_share") / c("__sps_1y"))
    sps_last = F.when(c("__sps_last") > 0, c("sales_per_share") / c("__sps_last"))
    q = q.withColumns({
        "revenue_cagr_3y": _cagr3(c("sps_ttm"), c("__sps_ttm_3y")), "eps_cagr_3y": _cagr3(c("eps_ttm"), c("__eps_ttm_3y")),
        "earnings_cagr_3y": _cagr3(now, then), "earnings_turnaround_3y": F.when(now.isNotNull() & then.isNotNull(), ((now > 0) & (then <= 0)).cast("double")),
        "roe_spike": c("return_on_equity") - c("roe_avg_3y"), "eps_spike": F.when(c("eps_avg_3y") > 0, c("eps_ttm") / (4 * c("eps_avg_3y"))),
        "__grows": (c("revenue_growth_yoy") > 0).cast("double"),
        "eps_volatility_3y": F.when(c("__eps_mean") > 0, c("__eps_std") / c("__eps_mean")), "loss_share_3y": avg("__loss"),
        "cash_conversion_3y": F.when(c("__net_mean") > 0, c("__fcf_mean") / c("__net_mean")),
        "revenue_growth_ttm": F.when((c("__sps_ttm_1y") > 0) & (c("sps_ttm") > 0), c("sps_ttm") / c("__sps_ttm_1y") - 1),
        "__growth_1y": prior("revenue_growth_yoy", YEAR),
        "op_margin_change_1y": c("operating_margin") - c("__om_1y"), "gross_margin_change_1y": c("gross_margin") - c("__gm_1y"),
        "__off": F.when(_yes(_outside(eps_usual, ONE_OFF_FACTOR) & _outside(eps_year, ONE_OFF_FACTOR)), F.struct(c("period").alias("p"), eps_year.alias("r"))),
        "__jump": F.when(_yes(_outside(sps_last, PER_SHARE_FACTOR) & _outside(sps_year, PER_SHARE_FACTOR)), F.struct(c("period").alias("p"), sps_year.alias("r"))),
    })
    recent = lambda x: F.coalesce(c(x), *[within(k, SPAN_DAYS, f"lag({x}, {k}) OVER {rows}") for k in (1, 2, 3)])
    q = q.withColumns({
        "growth_consistency_3y": avg("__grows"), "revenue_growth_accel": c("revenue_growth_yoy") - c("__growth_1y"),
        "__ttm_growth_1y": prior("revenue_growth_ttm", YEAR), "__one_off": recent("__off"), "__break": recent("__jump"),
    })
    q = q.withColumns({
        "revenue_growth_ttm_accel": c("revenue_growth_ttm") - c("__ttm_growth_1y"),
        "eps_one_off_period": c("__one_off.p"), "eps_one_off_ratio": c("__one_off.r"),
        "per_share_break_period": c("__break.p"), "per_share_break_ratio": c("__break.r"),
    })
    return q.select(*[x for x in quarters.columns if x not in TREND_COLUMNS], *TREND_COLUMNS)
