"""Known answers and properties of the panel pipeline."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, dividends, reporting, technicals, trends
from tidemark.operators.windows import nearest_prior, percent_rank_average, percent_rank_max, quantile_bucket
from tidemark.plans import panel

D = dt.date


def quarter_ends(n, first=(2016, 3)):
    y, m = first
    out = []
    for _ in range(n):
        nxt = D(y + (m == 12), m % 12 + 1, 1)
        out.append(nxt - dt.timedelta(days=1))
        y, m = (y, m + 3) if m < 12 else (y + 1, 3)
    return out


def quarters(spark, **cols):
    n = len(next(iter(cols.values())))
    p = quarter_ends(n)
    names = list(cols)
    rows = [("x", p[i], *[None if v[i] is None else float(v[i]) for v in cols.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, period date, " + ", ".join(f"{k} double" for k in names))


def test_growth_and_rolling_windows(spark):
    sales = [10 * 1.08 ** (i / 4) for i in range(24)]
    t = trends.trends(quarters(spark, sales_per_share=sales, operating_margin=[0.1 if i % 2 else 0.2 for i in range(24)])).orderBy("period").toPandas()
    assert t.revenue_growth_yoy.notna().sum() == 20 and np.allclose(t.revenue_growth_yoy.dropna(), 0.08, atol=1e-9)
    assert t.revenue_cagr_3y.notna().sum() == 24 - 12 - 3 and np.allclose(t.revenue_cagr_3y.dropna(), 0.08)
    assert t.op_margin_volatility.isna().sum() == 7


def last_row(spark, **cols):
    return trends.trends(quarters(spark, **cols)).orderBy("period").toPandas().iloc[-1]


def test_multi_year_measures(spark):
    n = 20
    grow = [3 * 1.21 ** (i / 4) for i in range(n)]  # 21% a year
    r = last_row(spark, eps=grow, sales_per_share=[40 - i for i in range(n)], fcf_margin=[0.06] * n, net_margin=[0.24] * n, gross_margin=[0.3 + 0.1 * (i % 2) for i in range(n)])
    assert r.eps_cagr_3y == r.earnings_cagr_3y == pytest.approx(0.21) and r.cash_conversion_3y == pytest.approx(0.25)
    assert r.growth_consistency_3y == 0 and r.loss_share_3y == 0 and r.earnings_turnaround_3y == 0  # sales fall every year
    assert r.gross_margin_volatility_3y == pytest.approx(np.std([0.3, 0.4] * 6, ddof=1))
    losses = [-2.0 if i in (9, 13, 14) else 2.0 for i in range(n)]
    assert last_row(spark, eps=losses).loss_share_3y == pytest.approx(3 / 12)
    # The year three years ago lost money: there is a turn and no growth rate. Without EPS, income comes from equity.
    turn = last_row(spark, eps=[-1.0] * 8 + [0.5] * 12)
    assert turn.earnings_turnaround_3y == 1 and math.isnan(turn.earnings_cagr_3y)
    fund = last_row(spark, eps=[None] * n, return_on_equity=[0.08] * n, book_value=[70 * 1.331 ** (i / 12) for i in range(n)])
    assert fund.earnings_cagr_3y == pytest.approx(0.1) and math.isnan(fund.eps_cagr_3y)


def test_breaks(spark):
    """Earnings that leave both their usual level and the year before are one-offs; sales per share that jump against the quarter
    and the year before are breaks; both are dated, and forgotten after four quarters. A season is neither."""
    p = quarter_ends(18)
    eps, sps = [1.0 + 0.05 * i for i in range(18)], [20.0 + 0.2 * i for i in range(18)]
    eps[11] = 9.0
    sps[13:] = [x / 2.5 for x in sps[13:]]
    t = trends.trends(quarters(spark, eps=eps, sales_per_share=sps)).orderBy("period").toPandas()
    assert t.eps_one_off_period.tolist()[10:16] == [None, p[11], p[11], p[11], p[11], None]
    assert t.eps_one_off_ratio[12] == pytest.approx(9.0 / 1.35)
    assert t.per_share_break_period[12] is None and t.per_share_break_period[13] == t.per_share_break_period[16] == p[13]
    assert t.per_share_break_ratio[14] == pytest.approx(sps[13] / sps[9])
    yearly = trends.trends(quarters(spark, eps=[0.5, 4.0, 0.6, 0.4] * 5, sales_per_share=[9, 21, 10, 8] * 5)).toPandas()
    assert yearly.eps_one_off_period.isna().all() and yearly.per_share_break_period.isna().all()


def test_nearest_prior_ties_and_tolerance(spark):
    days = [0, 10, 320, 365, 410, 411]
    df = spark.createDataFrame([("x", d, float(d), v) for d, v in zip(days, [1.0, None, 3.0, 4.0, 5.0, 6.0], strict=True)], "k string, d int, dd double, v double")
    got = {r["d"]: r["p"] for r in df.select("d", F.expr(nearest_prior("k", "d", "v", 365)).alias("p")).collect()}
    assert got == {0: None, 10: None, 320: 1.0, 365: 1.0, 410: 1.0, 411: None}
    df = spark.createDataFrame([("x", d, float(d)) for d in (0, 20, 375)], "k string, d int, v double")
    assert {r["d"]: r["p"] for r in df.select("d", F.expr(nearest_prior("k", "d", "v", 365)).alias("p")).collect()}[375] == 0.0  # equally near: the earlier


def test_ranks_and_buckets(spark):
    rng = np.random.default_rng(1)
    v = [None if rng.random() < 0.1 else float(round(rng.normal(), 1)) for _ in range(137)]
    df = spark.createDataFrame([(i, "g", x) for i, x in enumerate(v)], "i long, g string, v double")
    got = df.select("i", percent_rank_max(F.col("v"), ["g"]).alias("m"), percent_rank_average(F.col("v"), ["g"]).alias("a")).orderBy("i").toPandas()
    s = pd.Series(v, dtype=float)
    assert np.allclose(got.m, 100 * s.rank(method="max") / s.count(), equal_nan=True)
    assert np.allclose(got.a, s.rank(pct=True), equal_nan=True)
    for n in (25, 27, 63, 128):
        df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
        b = df.select("v", quantile_bucket(["g"], [F.col("v")]).alias("b")).orderBy("v").toPandas().b
        assert list(b) == list(pd.qcut(pd.Series(range(n)).rank(method="first"), 5, labels=False))
    few = spark.createDataFrame([("g", 1.0), ("g", 2.0)], "g string, v double")
    assert few.select(percent_rank_max(F.col("v"), ["g"]).alias("m")).where("m is not null").count() == 0


def test_calendar(spark):
    days = lambda a, b: [r[0] for r in calendar.snapshot_calendar(spark, a, b).orderBy("as_of").collect()]
    assert days(D(2020, 1, 1), D(2020, 7, 1)) == [D(2020, 1, 1), D(2020, 4, 1), D(2020, 7, 1)]
    assert days(D(2020, 1, 2), D(2020, 7, 9)) == [D(2020, 4, 1), D(2020, 7, 1), D(2020, 7, 9)]
    assert days(D(2020, 1, 2), D(2020, 2, 1)) == [D(2020, 2, 1)]


def test_listing_delisting_and_staleness(spark):
    rows = [("x", D(2019, 6, 3) + dt.timedelta(days=i), 1.0) for i in range(0, 257)]  # to 2020-02-14
    rows += [("y", D(2020, 3, 22), 1.0), ("y", D(2020, 6, 20), 2.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = calendar.valid_snapshots(df, "ticker", "date", D(2019, 1, 1), D(2020, 7, 1)).collect()
    assert sorted((r["ticker"], r["as_of"]) for r in got) == [("x", D(2019, 7, 1)), ("x", D(2019, 10, 1)), ("x", D(2020, 1, 1)), ("y", D(2020, 4, 1))]


def test_reporting_lag_table(spark):
    ends = spark.createDataFrame([("a", D(2025, 9, 27)), ("a", D(2024, 9, 28)), ("b", D(2026, 1, 31)), (None, D(2020, 1, 1))], "ticker string, period date")
    q = spark.createDataFrame([("a", D(2025, 9, 27)), ("a", D(2025, 10, 18)), ("a", D(2025, 12, 27)), ("b", D(2026, 1, 31)), ("b", D(2025, 10, 31)), ("c", D(2021, 12, 31)), ("c", D(2021, 9, 30))], "ticker string, period date")
    got = {(r["ticker"], r["period"]): (r["is_fiscal_q4"], (r["known_date"] - r["period"]).days, r["fiscal_year_end_assumed"]) for r in reporting.with_reporting_lag(q, ends).collect()}
    assert got["a", D(2025, 9, 27)] == (True, 75, False) and got["a", D(2025, 10, 18)][0] and not got["a", D(2025, 12, 27)][0]
    assert got["b", D(2026, 1, 31)][0] and got["b", D(2025, 10, 31)] == (False, 45, False)
    assert got["c", D(2021, 12, 31)] == (True, 75, True) and got["c", D(2021, 9, 30)] == (False, 45, True)


def test_rescaling(spark):
    row = ("x", 150.0, 100.0, 20.0, 4.0, 2.0, 25.0, 10.0, 500.0, 100.0)
    cols = "ticker string, price double, period_price double, trailing_pe double, price_to_book double, price_to_sales double, price_to_fcf double, ev_to_ebitda double, enterprise_value double, book_value double"
    got = reporting.rescaled(spark.createDataFrame([row, ("y", 150.0, None, *row[3:]), ("z", 150.0, 100.0, 20.0, 4.0, 2.0, 25.0, 10.0, None, 100.0)], cols)).toPandas().set_index("ticker")
    x = got.loc["x"]
    assert (x.trailing_pe, x.price_to_book, x.price_to_sales, x.price_to_fcf, x.ev_to_ebitda) == (30, 6, 3, 37.5, pytest.approx(14))
    assert x.trailing_pe_reported == 20 and got.loc["y"].trailing_pe == 20 and got.loc["z"].ev_to_ebitda == 15


def test_dividends(spark):
    """A monthly payer that raises, cuts to two thirds and pays a special; a yearly payer; one that has stopped; one without."""
    month = lambda k: D(2014 + k // 12, k % 12 + 1, 10)
    paid = [("m", month(k), 0.12 if k < 40 else 0.08 if k < 100 else 0.1) for k in range(110)] + [("m", D(2020, 6, 20), 1.0)]
    paid += [("y", D(2012 + k, 5, 5), 2.0 * 1.1**k) for k in range(11)] + [("s", D(2019, 1, 1), 3.0)]
    daily = spark.createDataFrame(paid, "ticker string, date date, dividend double")
    at = D(2022, 12, 31)
    snaps = spark.createDataFrame([(k, at, 24.0) for k in "myso"] + [("m", D(2022, 12, 30), None)], "ticker string, as_of date, price double")
    got = {(r["ticker"], r["as_of"]): r for r in dividends.dividend_features(snaps, daily).collect()}
    m, y = got["m", at], got["y", at]
    assert m["dividend_yield"] == pytest.approx(12 * 0.1 / 24)
    # Three years before, at the end of 2019, four payments of 0.08 had just come; the cut was in May 2017.
    assert m["dividend_growth_3y"] == pytest.approx((0.1 / 0.08) ** (1 / 3) - 1)
    assert m["dividend_years_no_cut"] == pytest.approx((at - month(40)).days / 365.25)
    amounts = [2.0 * 1.1**k for k in range(11)]
    assert y["dividend_yield"] == pytest.approx(amounts[-1] / 24)
    assert y["dividend_growth_3y"] == pytest.approx((np.median(amounts[7:]) / np.median(amounts[4:8])) ** (1 / 3) - 1)
    assert y["dividend_years_no_cut"] == pytest.approx((at - D(2012, 5, 5)).days / 365.25)
    for k in (("s", at), ("o", at), ("m", D(2022, 12, 30))):
        assert (got[k]["dividend_yield"], got[k]["dividend_growth_3y"], got[k]["dividend_years_no_cut"]) == (0, None, 0)


def test_technicals_against_pandas(spark):
    rng = np.random.default_rng(2)
    n = 300
    close, vol = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), rng.integers(1, 9, n).astype(float)
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    df = spark.createDataFrame([("x", d, float(c), float(v)) for d, c, v in zip(days, close, vol, strict=True)], "ticker string, date date, close double, volume double")
    got = technicals.technicals(df).orderBy("date").toPandas()
    c, v = pd.Series(close), pd.Series(vol)
    for i in (58, 59, 150, 299):
        r = got.iloc[i]
        if i < 59:
            assert r[technicals.TECHNICALS].isna().all()
            continue
        w = c[max(0, i - 259) : i + 1]
        assert r.pct_from_52w_high == pytest.approx((w.tail(252).max() - c[i]) / w.tail(252).max())
        assert r.volatility_63d == pytest.approx(w.pct_change().tail(63).std() * math.sqrt(252))
        assert r.relative_volume == pytest.approx(v[: i + 1].tail(21).mean() / v[: i + 1].tail(63).mean())
        assert r.price_spike_5d == pytest.approx(math.log(c[i] / c[i - 5]))
        assert math.isnan(r.ma50_vs_ma200) == (i < 199)


def world(spark, seed=0, until=D(2024, 6, 28)):
    rng = np.random.default_rng(seed)
    pr, fu = [], []
    k = 0
    for t in range(8):
        c = 50.0
        d = D(2018, 1, 1)
        while d <= D(2022, 12, 31):
            if d.weekday() < 5:
                c *= math.exp(rng.normal(0, 0.015))
                pr.append((k, f"T{t}", dt.datetime.combine(d, dt.time(20)), c * 0.9, c, 1e6, 0.3 if d.day == 15 and d.month % 3 == 0 else 0.0))
                k += 1
            d += dt.timedelta(days=1)
        for i, p in enumerate(quarter_ends(24, (2017, 3))):
            fu.append((len(fu), f"T{t}", p, None, *rng.uniform(0.5, 2, 20).tolist()))
    from tidemark.sources.tables import FUNDAMENTAL_FIELDS

    prices = spark.createDataFrame(pr, "price_id long, ticker string, date timestamp_ntz, close double, close_raw double, volume double, dividend double")
    funds = spark.createDataFrame(fu, "fund_id long, ticker string, period date, available_date timestamp_ntz, " + ", ".join(f"{c} double" for c in FUNDAMENTAL_FIELDS))
    ends = spark.createDataFrame([("T0", D(2019, 9, 30))], "ticker string, period date")
    uni = spark.createDataFrame([(f"T{t}", f"n{t}", "AB"[t % 2], "large", "I") for t in range(7)], "ticker string, name string, sector string, size_group string, industry string")
    return prices, funds, ends, uni


def test_rows_do_not_change_when_the_future_does(spark):
    prices, funds, ends, uni = world(spark)
    start, today, cut = D(2019, 1, 1), D(2022, 10, 1), "2021-04-01"
    build = lambda p, f: panel.raw_panel(p, f, ends, uni, start, today)
    first = build(prices, funds)
    keep = [c for c in first.columns if not c.startswith("fwd_return")]
    later = F.to_date("date") > F.lit(cut).cast("date")
    p2 = prices.withColumns({c: F.when(later, F.col(c) * 7).otherwise(F.col(c)) for c in ("close", "close_raw", "volume")})
    f2 = funds.withColumns({c: F.when(F.col("period") > F.lit("2021-03-31").cast("date"), F.col(c) * -3).otherwise(F.col(c)) for c in ("eps", "sales_per_share", "book_value", "trailing_pe")})
    f2 = f2.withColumn("eps", F.when(F.col("period") >= F.lit("2021-01-01").cast("date"), F.lit(99.0)).otherwise(F.col("eps")))
    old = lambda df: df.select(*keep).where(F.col("as_of") <= F.lit(cut).cast("date")).orderBy("ticker", "as_of").toPandas()
    a, b = old(first), old(build(p2, f2))
    assert len(a) > 60
    pd.testing.assert_frame_equal(a, b)


def test_universe_defaults_and_empty_inputs(spark):
    prices, funds, ends, uni = world(spark)
    one = panel.raw_panel(prices, funds, ends, uni, D(2022, 1, 1), D(2022, 10, 1))
    row = one.where("ticker = 'T7'").first()
    assert (row["sector"], row["size_group"], row["industry"], row["fiscal_year_end_assumed"]) == ("Unknown", "large", "Unknown 기타", True)
    none = panel.raw_panel(prices.limit(0), funds, ends, uni, D(2022, 1, 1), D(2022, 10, 1))
    assert none.count() == 0 and none.columns == one.columns
    bare = panel.raw_panel(prices, funds.limit(0), ends.limit(0), uni.limit(0), D(2022, 1, 1), D(2022, 10, 1))
    assert bare.where("eps is not null").count() == 0 and bare.count() == one.count()


def test_bad_prices_are_skipped(spark):
    prices, funds, ends, uni = world(spark)
    bad = prices.limit(3).selectExpr("price_id + 1000000 price_id", "ticker", "timestamp_ntz'2022-09-30 21:00:00' date", "case when price_id % 2 = 0 then double('NaN') else 0.0 end close", "close_raw", "volume", "dividend")
    a = panel.priced_snapshots(prices, D(2022, 1, 1), D(2022, 10, 1)).orderBy("ticker", "as_of").toPandas()
    b = panel.priced_snapshots(prices.unionByName(bad), D(2022, 1, 1), D(2022, 10, 1)).orderBy("ticker", "as_of").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_registered_panel_spans_the_prices(spark):
    from tidemark.queries.pipeline import b02_panel
    from tidemark.sources.tables import by_day, read

    sf = "/root/testdata/sf0.001"
    daily = by_day(read(spark, sf, "prices"))
    low, high = daily.selectExpr("min(date)", "max(date)").first()
    want = {r["as_of"] for r in calendar.valid_snapshots(daily, "ticker", "date", low, high).collect()}
    got = {r["as_of"] for r in b02_panel(spark, sf).select("as_of").distinct().collect()}
    assert got == want and max(got) == high and D(2015, 4, 1) in got


def test_span_without_prices(spark):
    prices, funds, ends, uni = world(spark)
    assert panel.raw_panel(prices.limit(0), funds, ends, uni).count() == 0
