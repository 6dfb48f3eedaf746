"""DuckDB SQL of the core queries, written from their definitions and not from their Spark plans."""

from __future__ import annotations

# Names of columns; the SQL takes no constant or list from the library.
FUNDAMENTAL_FIELDS = "trailing_pe price_to_book price_to_sales ev_to_ebitda price_to_fcf return_on_equity roic gross_margin operating_margin fcf_margin debt_to_equity net_debt_to_capital current_ratio asset_turnover sga_to_sales eps payout_ratio_ttm sales_per_share enterprise_value book_value".split()
TREND_COLUMNS = "revenue_growth_yoy sps_ttm revenue_cagr_3y op_margin_volatility op_margin_avg_3y roe_avg_3y eps_ttm eps_avg_3y roe_spike eps_spike eps_cagr_3y earnings_cagr_3y earnings_turnaround_3y growth_consistency_3y eps_volatility_3y roe_volatility_3y gross_margin_volatility_3y loss_share_3y cash_conversion_3y revenue_growth_accel revenue_growth_ttm revenue_growth_ttm_accel op_margin_change_1y gross_margin_change_1y".split()
LOW_IS_GOOD = "trailing_pe price_to_book price_to_sales ev_to_ebitda price_to_fcf debt_to_equity pct_from_52w_high volatility_63d".split()
HIGH_IS_GOOD = "dividend_yield return_on_equity operating_margin revenue_growth_yoy ma50_vs_ma200 relative_volume".split()
INDICATORS = {k: k in LOW_IS_GOOD for k in LOW_IS_GOOD + HIGH_IS_GOOD}

FINITE = "CASE WHEN NOT isnan({0}) AND NOT isinf({0}) THEN {0} END AS {0}"
# No infinity, and no number that consists of nines from 999 on or is a power of ten from a million on.
_CODE = "regexp_full_match(format('{{:.2f}}', abs({0})), '9{{3,}}[.](00|90|99)|10{{6,}}[.]00')"
REAL = "CASE WHEN NOT isnan({0}) AND NOT isinf({0}) AND NOT " + _CODE + " THEN {0} END"
SANE = REAL + " AS {0}"


def nn(c: str) -> str:
    return f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)"


DAILY = f"""daily AS (
  SELECT ticker, d AS date, close, close_raw, volume, dividend FROM (
    SELECT ticker, CAST(date AS DATE) AS d, {nn('close')} AS close, {nn('close_raw')} AS close_raw, {nn('volume')} AS volume, {nn('dividend')} AS dividend,
      row_number() OVER (PARTITION BY ticker, CAST(date AS DATE) ORDER BY date DESC, price_id DESC) AS rn
    FROM prices WHERE ticker IS NOT NULL AND date IS NOT NULL AND {nn('close')} > 0 AND coalesce({nn('close_raw')} > 0, true)
  ) WHERE rn = 1
)"""
QUARTERS = f"""quarters AS (
  SELECT *, CASE WHEN sales_per_share <> 0 THEN eps / sales_per_share END AS net_margin FROM (
    SELECT ticker, period, available_date, fund_id, {', '.join((SANE if f in ('eps', 'sales_per_share') else FINITE).format(f) for f in FUNDAMENTAL_FIELDS)},
      row_number() OVER (PARTITION BY ticker, period ORDER BY available_date DESC NULLS LAST, fund_id) AS rn
    FROM fundamentals WHERE ticker IS NOT NULL AND period IS NOT NULL
  ) WHERE rn = 1
)"""
CALENDAR = """span AS (SELECT min(date) AS lo, max(date) AS hi FROM daily),
calendar AS (
  SELECT CAST(unnest(generate_series(CAST(CASE WHEN date_trunc('quarter', lo) = lo THEN lo ELSE date_trunc('quarter', lo) + INTERVAL 3 MONTH END AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 3 MONTH)) AS DATE) AS as_of FROM span
  UNION SELECT hi FROM span
)"""
SNAPS = """snaps AS (
  SELECT ticker, as_of, date, close FROM (
    SELECT p.ticker, c.as_of, p.date, p.close, row_number() OVER (PARTITION BY p.ticker, c.as_of ORDER BY p.date DESC) AS rn
    FROM calendar c JOIN daily p ON p.date <= c.as_of AND p.date >= c.as_of - 10
  ) WHERE rn = 1
)"""
QUOTED = """quoted AS (
  SELECT s.ticker, s.as_of, s.date, s.close, q.close_raw AS price FROM snaps s
  ASOF LEFT JOIN (SELECT ticker, date, close_raw FROM daily WHERE close_raw IS NOT NULL) q ON s.ticker = q.ticker AND s.as_of >= q.date
)"""
LAGGED = """lagged AS (
  SELECT q.*, coalesce(y.q4, CASE WHEN e.ticker IS NULL THEN least(
      abs(q.period - make_date(year(q.period) - 1, 12, 31)), abs(q.period - make_date(year(q.period), 12, 31)), abs(q.period - make_date(year(q.period) + 1, 12, 31))) <= 20 END, false) AS is_fiscal_q4,
    e.ticker IS NULL AS fiscal_year_end_assumed
  FROM quarters q
  LEFT JOIN (SELECT DISTINCT ticker FROM fiscal_year_ends WHERE period IS NOT NULL) e ON q.ticker = e.ticker
  LEFT JOIN (
    SELECT a.ticker, a.period, bool_or(abs(a.period - make_date(year(a.period) + o.o, b.m, b.d)) <= 20) AS q4
    FROM quarters a JOIN (
      SELECT DISTINCT ticker, month(period) AS m, CASE WHEN month(period) = 2 THEN least(day(period), 28) ELSE day(period) END AS d
      FROM fiscal_year_ends WHERE ticker IS NOT NULL AND period IS NOT NULL
    ) b ON a.ticker = b.ticker, (VALUES (-1), (0), (1)) o(o) GROUP BY 1, 2
  ) y ON q.ticker = y.ticker AND q.period = y.period
), known AS (SELECT *, period + CASE WHEN is_fiscal_q4 THEN 75 ELSE 45 END AS known_date FROM lagged)"""
PERIOD_PRICE = """period_prices AS (
  SELECT q.ticker, q.period, d.close_raw AS period_price FROM quarters q
  ASOF LEFT JOIN (SELECT ticker, date, close_raw FROM daily WHERE close_raw IS NOT NULL) d ON q.ticker = d.ticker AND q.period >= d.date
)"""


def prior(name: str, table: str, value: str, days: int) -> str:
    """CTE `name` (ticker, period, v): the nearest present value `days` before each period within 45 days."""
    return f"""{name} AS (
  SELECT ticker, period, v FROM (
    SELECT a.ticker, a.period, b.{value} AS v, row_number() OVER (
      PARTITION BY a.ticker, a.period ORDER BY abs(b.period - (a.period - {days})), b.period) AS rn
    FROM {table} a JOIN {table} b ON a.ticker = b.ticker AND b.{value} IS NOT NULL AND abs(b.period - (a.period - {days})) <= 45
  ) WHERE rn = 1
)"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n" + body


def r(c: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({c}, {digits}) AS {name or c.split('.')[-1]}"


# --- trends -----------------------------------------------------------------------------------------------------------
_W = "(PARTITION BY ticker ORDER BY period ROWS BETWEEN {} PRECEDING AND {})"
W4, W12 = _W.format(3, "CURRENT ROW"), _W.format(11, "CURRENT ROW")
O = "(PARTITION BY ticker ORDER BY period)"


def gate(stat: str, c: str, w: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {w} >= {n} THEN {stat} OVER {w} END"


def cagr(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN pow({a} / {b}, 1.0 / 3) - 1 END"


T1 = f"""t1 AS (
  SELECT *, CASE WHEN period - lag(period, 3) OVER {O} <= 300 THEN {gate('sum(sales_per_share)', 'sales_per_share', W4, 4)} END AS sps_ttm,
    CASE WHEN period - lag(period, 3) OVER {O} <= 300 THEN {gate('sum(eps)', 'eps', W4, 4)} END AS eps_ttm,
    CASE WHEN book_value > 0 THEN return_on_equity * book_value END AS ni FROM quarters
)"""
PRIORS = [
    ("p_sps", "sales_per_share", 365), ("p_eps", "eps", 365), ("p_ttm1", "sps_ttm", 365), ("p_ttm3", "sps_ttm", 1095),
    ("p_et3", "eps_ttm", 1095), ("p_ni3", "ni", 1095), ("p_om", "operating_margin", 365), ("p_gm", "gross_margin", 365),
]
T2 = f"""t2 AS (
  SELECT t1.*, {', '.join(f'{n}.v AS {n}' for n, _, _ in PRIORS)} FROM t1
  {' '.join(f'LEFT JOIN {n} ON {n}.ticker = t1.ticker AND {n}.period = t1.period' for n, _, _ in PRIORS)}
), t3 AS (
  SELECT *, CASE WHEN p_sps <> 0 THEN (sales_per_share - p_sps) / abs(p_sps) END AS revenue_growth_yoy,
    CASE WHEN p_ttm1 > 0 AND sps_ttm > 0 THEN sps_ttm / p_ttm1 - 1 END AS revenue_growth_ttm,
    CASE WHEN eps_ttm IS NOT NULL AND p_et3 IS NOT NULL THEN eps_ttm ELSE ni END AS e_now,
    CASE WHEN eps_ttm IS NOT NULL AND p_et3 IS NOT NULL THEN p_et3 ELSE p_ni3 END AS e_then,
    CASE WHEN eps IS NOT NULL THEN CAST(eps <= 0 AS INT) END AS loss,
    {gate('median(eps)', 'eps', _W.format(8, '1 PRECEDING'), 6)} AS eps_usual,
    lag(sales_per_share) OVER {O} AS sps_last
  FROM t2
)"""
TRENDS = [QUARTERS, T1, *[prior(n, "t1", v, d) for n, v, d in PRIORS], T2, prior("g1", "t3", "revenue_growth_yoy", 365), prior("g2", "t3", "revenue_growth_ttm", 365)]
_std = lambda c: gate(f"stddev_samp({c})", c, W12, 8)
_avg = lambda c: gate(f"avg({c})", c, W12, 8)
F01 = {
    "revenue_growth_yoy": "revenue_growth_yoy", "sps_ttm": "sps_ttm", "revenue_cagr_3y": cagr("sps_ttm", "p_ttm3"),
    "op_margin_volatility": _std("operating_margin"), "op_margin_avg_3y": _avg("operating_margin"), "roe_avg_3y": _avg("return_on_equity"),
    "eps_ttm": "eps_ttm", "eps_avg_3y": f"CASE WHEN period - lag(period, 11) OVER {O} <= 1095 THEN {gate('avg(eps)', 'eps', W12, 12)} END",
    "roe_spike": f"return_on_equity - ({_avg('return_on_equity')})", "eps_cagr_3y": cagr("eps_ttm", "p_et3"), "earnings_cagr_3y": cagr("e_now", "e_then"),
    "earnings_turnaround_3y": "CASE WHEN e_now IS NOT NULL AND e_then IS NOT NULL THEN CAST(e_now > 0 AND e_then <= 0 AS DOUBLE) END",
    "growth_consistency_3y": _avg("CASE WHEN revenue_growth_yoy IS NOT NULL THEN CAST(revenue_growth_yoy > 0 AS INT) END"),
    "eps_volatility_3y": f"CASE WHEN ({_avg('eps')}) > 0 THEN ({_std('eps')}) / ({_avg('eps')}) END",
    "roe_volatility_3y": _std("return_on_equity"), "gross_margin_volatility_3y": _std("gross_margin"), "loss_share_3y": _avg("loss"),
    "cash_conversion_3y": f"CASE WHEN ({_avg('net_margin')}) > 0 THEN ({_avg('fcf_margin')}) / ({_avg('net_margin')}) END",
    "revenue_growth_accel": "revenue_growth_yoy - g1", "revenue_growth_ttm": "revenue_growth_ttm", "revenue_growth_ttm_accel": "revenue_growth_ttm - g2",
    "op_margin_change_1y": "operating_margin - p_om", "gross_margin_change_1y": "gross_margin - p_gm",
}
T4 = "t4 AS (SELECT t3.*, g1.v AS g1, g2.v AS g2 FROM t3 LEFT JOIN g1 USING (ticker, period) LEFT JOIN g2 USING (ticker, period))"
F01_SQL = with_(
    *TRENDS, T4, "t5 AS (SELECT ticker, period, eps_ttm AS et, " + ", ".join(f"{v} AS {k}" for k, v in F01.items()) + " FROM t4)",
    body="SELECT ticker, period, " + ", ".join(r("CASE WHEN eps_avg_3y > 0 THEN et / (4 * eps_avg_3y) END", 9, "eps_spike") if c == "eps_spike" else r(c, 9) for c in TREND_COLUMNS ) + " FROM t5",
)
_off = lambda x, f: f"({x} > {f} OR {x} < 1 / {f})"
F22_SQL = with_(
    *TRENDS,
    f"""h AS (
  SELECT ticker, period, eps / p_eps AS er, sales_per_share / p_sps AS sr,
    coalesce(p_eps > 0 AND eps_usual > 0 AND {_off('(eps / eps_usual)', '3.0')} AND {_off('(eps / p_eps)', '3.0')}, false) AS eh,
    coalesce(p_sps > 0 AND sps_last > 0 AND {_off('(sales_per_share / sps_last)', '1.5')} AND {_off('(sales_per_share / p_sps)', '1.5')}, false) AS sh,
    row_number() OVER {O} AS n FROM t3
), near AS (
  SELECT a.ticker, a.period, max(b.period) FILTER (WHERE b.eh) AS ep, max(b.period) FILTER (WHERE b.sh) AS sp
  FROM h a JOIN h b ON a.ticker = b.ticker AND b.n BETWEEN a.n - 3 AND a.n AND a.period - b.period <= 300 GROUP BY 1, 2
)""",
    body=f"""SELECT near.ticker, near.period, ep AS eps_one_off_period, {r('e.er', name='eps_one_off_ratio')}, sp AS per_share_break_period, {r('s.sr', name='per_share_break_ratio')}
FROM near LEFT JOIN h e ON e.ticker = near.ticker AND e.period = ep LEFT JOIN h s ON s.ticker = near.ticker AND s.period = sp""",
)

# --- technicals, dividends, returns -----------------------------------------------------------------------------------
_D = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
DO = "(PARTITION BY ticker ORDER BY date)"
TECH = f"""rets AS (SELECT *, row_number() OVER {DO} AS n, close / lag(close) OVER {DO} - 1 AS ret FROM daily), tech AS (
  SELECT ticker, date,
    CASE WHEN n >= 200 THEN avg(close) OVER {_D.format(49)} / avg(close) OVER {_D.format(199)} - 1 END AS ma50_vs_ma200,
    (max(close) OVER {_D.format(251)} - close) / max(close) OVER {_D.format(251)} AS pct_from_52w_high,
    CASE WHEN count(ret) OVER {_D.format(62)} > 5 THEN stddev_samp(ret) OVER {_D.format(62)} * sqrt(252) END AS volatility_63d,
    CASE WHEN avg(volume) OVER {_D.format(62)} <> 0 THEN avg(volume) OVER {_D.format(20)} / avg(volume) OVER {_D.format(62)} END AS relative_volume,
    ln(close / lag(close, 5) OVER {DO}) AS price_spike_5d,
    CASE WHEN stddev_samp(volume) OVER {_D.format(62)} <> 0 THEN (volume - avg(volume) OVER {_D.format(62)}) / stddev_samp(volume) OVER {_D.format(62)} END AS volume_zscore_63d, n
  FROM rets
)"""
_T = ["ma50_vs_ma200", "pct_from_52w_high", "volatility_63d", "relative_volume", "price_spike_5d", "volume_zscore_63d"]
X01_SQL = with_(DAILY, CALENDAR, SNAPS, TECH, body="SELECT s.ticker, s.as_of, " + ", ".join(r(f"CASE WHEN n >= 60 THEN {c} END", name=c) for c in _T) + " FROM snaps s JOIN tech t ON s.ticker = t.ticker AND s.date = t.date")
J08_SQL = with_(
    DAILY, CALENDAR, SNAPS, "ends AS (SELECT ticker AS et, max(date) AS e FROM daily GROUP BY 1)",
    body="SELECT s.ticker, s.as_of, s.close, " + ", ".join(
        f"round((SELECT CASE WHEN max(e.e) >= s.as_of + {d} THEN ln(arg_max(p.close, p.date) / s.close) END FROM daily p JOIN ends e ON e.et = p.ticker WHERE p.ticker = s.ticker AND p.date > s.as_of AND p.date <= s.as_of + {d}), 6) AS fwd_return_{m}m"
        for m, d in ((1, 30), (3, 91), (6, 182), (12, 365))) + " FROM snaps s",
).replace("s.close, round", "round(s.close, 6) AS close, round", 1)
V01_SQL = with_(
    DAILY, CALENDAR, SNAPS, QUOTED,
    """pay AS (SELECT ticker, date, dividend AS a FROM daily WHERE dividend > 0),
past AS (
  SELECT q.ticker, q.as_of, q.price, p.date, p.a, row_number() OVER (PARTITION BY q.ticker, q.as_of ORDER BY p.date DESC) AS k,
    row_number() OVER (PARTITION BY q.ticker, q.as_of ORDER BY p.date) AS n,
    CASE WHEN p.date > q.as_of - 730 AND lag(p.date) OVER (PARTITION BY q.ticker, q.as_of ORDER BY p.date) > q.as_of - 730
      THEN p.date - lag(p.date) OVER (PARTITION BY q.ticker, q.as_of ORDER BY p.date) END AS gap
  FROM quoted q JOIN pay p ON p.ticker = q.ticker AND p.date <= q.as_of
), f AS (
  SELECT ticker, as_of, any_value(price) AS price, max(date) AS last, least(greatest(coalesce(round_even(365.0 / median(gap), 0), 1), 1), 12) AS freq,
    count(*) FILTER (WHERE date <= as_of - 1095) AS n_then, min(date) AS first
  FROM past GROUP BY 1, 2
), then4 AS (
  SELECT ticker, as_of, median(a) AS m FROM (SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY date DESC) AS j FROM past WHERE date <= as_of - 1095) WHERE j <= 4 GROUP BY 1, 2
), now4 AS (SELECT ticker, as_of, median(a) AS m FROM past WHERE k <= 4 GROUP BY 1, 2),
yearly AS (SELECT p.ticker, p.as_of, median(p.a) * any_value(f.freq) AS y FROM past p JOIN f USING (ticker, as_of) WHERE p.k <= f.freq GROUP BY 1, 2),
seq AS (SELECT ticker, date, a, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, median(a) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m4 FROM pay)""",
    """clock AS (
  SELECT ticker, i, date, date AS since, CAST(-4 AS BIGINT) AS last FROM seq WHERE i = 0
  UNION ALL
  SELECT s.ticker, s.i, s.date, CASE WHEN s.i >= 4 AND s.i - c.last >= 4 AND s.a < 0.95 * s.m4 THEN s.date ELSE c.since END,
    CASE WHEN s.i >= 4 AND s.i - c.last >= 4 AND s.a < 0.95 * s.m4 THEN s.i ELSE c.last END
  FROM clock c JOIN seq s ON s.ticker = c.ticker AND s.i = c.i + 1
)""",
    body="""SELECT q.ticker, q.as_of, round(q.price, 6) AS price,
  round(CASE WHEN pays THEN y.y / q.price ELSE 0 END, 6) AS dividend_yield,
  round(CASE WHEN pays AND f.n_then >= 4 AND n4.m > 0 AND t4.m > 0 THEN pow(n4.m / t4.m, 1.0 / 3) - 1 END, 6) AS dividend_growth_3y,
  round(CASE WHEN pays THEN least(25.0, (q.as_of - c.since) / 365.25) ELSE 0 END, 6) AS dividend_years_no_cut
FROM quoted q LEFT JOIN (SELECT *, as_of - last <= 400 AND price > 0 AS pays FROM f) f USING (ticker, as_of) LEFT JOIN yearly y USING (ticker, as_of)
LEFT JOIN now4 n4 USING (ticker, as_of) LEFT JOIN then4 t4 USING (ticker, as_of) LEFT JOIN clock c ON c.ticker = q.ticker AND c.date = f.last""",
).replace("WITH ", "WITH RECURSIVE ", 1)

# --- panel ------------------------------------------------------------------------------------------------------------
PICKED = """picked AS (
  SELECT q.ticker, q.as_of, q.price, q.close, k.* EXCLUDE (ticker) FROM quoted q LEFT JOIN (
    SELECT ticker AS kt, as_of AS ka, period AS kp FROM (
      SELECT s.ticker, s.as_of, k.period, row_number() OVER (PARTITION BY s.ticker, s.as_of ORDER BY k.known_date DESC, k.period DESC) AS rn
      FROM snaps s JOIN known k ON k.ticker = s.ticker AND k.known_date <= s.as_of) WHERE rn = 1
  ) x ON x.kt = q.ticker AND x.ka = q.as_of LEFT JOIN known k ON k.ticker = q.ticker AND k.period = x.kp
)"""
J03_SQL = with_(DAILY, QUARTERS, CALENDAR, SNAPS, QUOTED, LAGGED, PICKED, body="SELECT ticker, as_of, period AS fundamentals_period, known_date, is_fiscal_q4, fund_id FROM picked")
_ratio = "(CASE WHEN p.price > 0 AND pp.period_price > 0 THEN p.price / pp.period_price END)"
_mc = "(p.price_to_book * p.book_value)"
_factor = f"coalesce(CASE WHEN p.enterprise_value > 0 AND {_mc} > 0 THEN 1 + {_mc} / p.enterprise_value * ({_ratio} - 1) END, {_ratio})"
_M = ["trailing_pe", "price_to_book", "price_to_sales", "price_to_fcf"]
_TTM = f"""ttm AS (SELECT ticker, period, CASE WHEN period - lag(period, 3) OVER {O} <= 300 THEN {gate('sum(sales_per_share)', 'sales_per_share', W4, 4)} END AS sps_ttm,
  CASE WHEN period - lag(period, 11) OVER {O} <= 1095 THEN {gate('avg(eps)', 'eps', W12, 12)} END AS eps_avg_3y FROM quarters)"""
L04_SQL = with_(
    DAILY, QUARTERS, CALENDAR, SNAPS, QUOTED, LAGGED, PICKED, PERIOD_PRICE, _TTM,
    body="SELECT p.ticker, p.as_of, " + ", ".join([r("p.price", 7), r("pp.period_price", 7), *[r(f"p.{m}", 7, f"{m}_reported") for m in (*_M, "ev_to_ebitda")], *[r(f"p.{m} * coalesce({_ratio}, 1)", 7, m) for m in _M]])
    + f""", round(CASE WHEN {_ratio} IS NULL THEN p.ev_to_ebitda WHEN {_factor} > 0 THEN p.ev_to_ebitda * {_factor} END, 7) AS ev_to_ebitda,
  round(CASE WHEN p.book_value > 0 THEN ln(p.book_value) END, 7) AS log_book_value,
  round(CASE WHEN t.sps_ttm > 0 AND p.price_to_book > 0 AND p.book_value > 0 AND pp.period_price > 0 THEN ln(t.sps_ttm * (p.price_to_book * p.book_value / pp.period_price)) END, 7) AS log_revenue,
  round(CASE WHEN t.eps_avg_3y > 0 THEN p.price / (4 * t.eps_avg_3y) END, 7) AS normalized_pe
FROM picked p LEFT JOIN period_prices pp ON pp.ticker = p.ticker AND pp.period = p.period LEFT JOIN ttm t ON t.ticker = p.ticker AND t.period = p.period""",
)
GIVEN = f"""given AS (
  SELECT * REPLACE (CAST(as_of AS DATE) AS as_of, {{num}}) FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY panel_id) AS rn FROM panel WHERE ticker IS NOT NULL AND as_of IS NOT NULL
  ) WHERE rn = 1
)"""
_NUM = ["price", "trailing_pe", "price_to_book", "price_to_sales", "ev_to_ebitda", "price_to_fcf", "return_on_equity", "roic", "gross_margin", "operating_margin", "debt_to_equity", "payout_ratio_ttm", "book_value", "volatility_63d", "dividend_yield"]
GIVEN = GIVEN.format(num=", ".join(SANE.format(c) for c in _NUM))


def pct_max(c: str, keys: str, least: int = 3) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY {keys}) >= {least} THEN 100.0 * (SELECT 1) * count({c}) OVER (PARTITION BY {keys} ORDER BY {c} NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count({c}) OVER (PARTITION BY {keys}) END".replace(" * (SELECT 1)", "")


_HAVE = [k for k in INDICATORS if k in _NUM]
_mean = lambda names: "list_avg(list_filter([" + ", ".join(f"{n}_pct" for n in names if n in _HAVE) + "], lambda x: x IS NOT NULL))"
B03_SQL = with_(
    GIVEN, "pct AS (SELECT ticker, as_of, sector, " + ", ".join((f"100.0 - ({pct_max(k, 'as_of, sector')})" if INDICATORS[k] else pct_max(k, "as_of, sector")) + f" AS {k}_pct" for k in _HAVE) + " FROM given WHERE sector IS NOT NULL)",
    f"""sc AS (SELECT *, {_mean(['trailing_pe', 'price_to_book', 'price_to_sales', 'ev_to_ebitda', 'price_to_fcf', 'dividend_yield'])} AS valuation_score,
  {_mean(['return_on_equity', 'debt_to_equity', 'operating_margin'])} AS quality_score, CAST(NULL AS DOUBLE) AS momentum_score FROM pct)""",
    body="SELECT ticker, as_of, " + ", ".join(r(f"{k}_pct") for k in _HAVE) + f", {r('valuation_score')}, {r('quality_score')}, momentum_score, {r(pct_max('valuation_score', 'as_of, sector'), name='sector_valuation_rank')} FROM sc",
)
B05_SQL = "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1.0 ELSE 0.0 END), 9) AS missing_share FROM panel" for c in _NUM)
B05_PAYERS_SQL = f"SELECT as_of, round(avg(CASE WHEN {REAL.format('dividend_yield')} > 0 THEN 1.0 ELSE 0.0 END), 9) AS payers FROM panel WHERE as_of = (SELECT max(as_of) FROM panel) GROUP BY 1"
# --- the built panel ------------------------------------------------------------------------------------------------------
def unrounded(sql: str) -> str:
    """The SQL without its round(x, digits): parts of the panel are compared exactly by its ranks."""
    while (at := sql.find("round(")) >= 0:
        depth, comma, end = 0, 0, at + 5
        for end in range(at + 5, len(sql)):
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[end], 0)
            if depth == 1 and sql[end] == ",":
                comma = end
            if not depth:
                break
        sql = sql[:at] + "(" + sql[at + 6 : comma] + ")" + sql[end + 1 :]
    return sql


_PRICED = [*_M, "ev_to_ebitda"]
_PARTS = {
    "known_q": J03_SQL, "trend_q": F01_SQL, "break_q": F22_SQL, "scaled_q": L04_SQL, "tech_q": X01_SQL, "paid_q": V01_SQL, "ahead_q": J08_SQL,
    "lag_q": with_(QUARTERS, LAGGED, body="SELECT ticker, period, fiscal_year_end_assumed FROM known"),
}
_OWN = [f for f in FUNDAMENTAL_FIELDS if f not in _PRICED] + ["net_margin"]
_AHEAD = [f"fwd_return_{m}m" for m in (1, 3, 6, 12)]
BUILT = [
    DAILY, QUARTERS, CALENDAR, SNAPS, QUOTED, *[f"{k} AS ({unrounded(v)})" for k, v in _PARTS.items()],
    f"""built0 AS (
  SELECT p.ticker, p.as_of, p.date, p.close, p.price, d.close_raw, d.volume, d.dividend, {', '.join(f't.{c}' for c in _T)}, k.fundamentals_period, k.known_date, k.is_fiscal_q4, k.fund_id,
    q.available_date, {', '.join(f'q.{c}' for c in _OWN)}, {', '.join(f'f.{c}' for c in TREND_COLUMNS)}, b.eps_one_off_period, b.eps_one_off_ratio, b.per_share_break_period, b.per_share_break_ratio,
    coalesce(g.fiscal_year_end_assumed, true) AS fiscal_year_end_assumed, l.period_price, {', '.join(f'l.{m}, l.{m}_reported' for m in _PRICED)}, l.log_book_value, l.log_revenue, l.normalized_pe,
    v.dividend_yield, v.dividend_growth_3y, v.dividend_years_no_cut, {', '.join(f'a.{c}' for c in _AHEAD)},
    coalesce(u.sector, 'Unknown') AS sector, coalesce(u.size_group, 'large') AS size_group, coalesce(u.industry, coalesce(u.sector, 'Unknown') || ' 기타') AS industry
  FROM quoted p JOIN daily d ON d.ticker = p.ticker AND d.date = p.date
  LEFT JOIN known_q k ON k.ticker = p.ticker AND k.as_of = p.as_of
  LEFT JOIN quarters q ON q.ticker = p.ticker AND q.period = k.fundamentals_period LEFT JOIN trend_q f ON f.ticker = p.ticker AND f.period = k.fundamentals_period
  LEFT JOIN break_q b ON b.ticker = p.ticker AND b.period = k.fundamentals_period LEFT JOIN lag_q g ON g.ticker = p.ticker AND g.period = k.fundamentals_period
  LEFT JOIN scaled_q l ON l.ticker = p.ticker AND l.as_of = p.as_of LEFT JOIN tech_q t ON t.ticker = p.ticker AND t.as_of = p.as_of
  LEFT JOIN paid_q v ON v.ticker = p.ticker AND v.as_of = p.as_of LEFT JOIN ahead_q a ON a.ticker = p.ticker AND a.as_of = p.as_of LEFT JOIN universe u ON u.ticker = p.ticker
)""",
    "built1 AS (SELECT *, " + ", ".join((f"100.0 - ({pct_max(k, 'as_of, sector')})" if low else pct_max(k, "as_of, sector")) + f" AS {k}_pct" for k, low in INDICATORS.items()) + " FROM built0)",
    "built2 AS (SELECT *, " + ", ".join("list_avg(list_filter([" + ", ".join(f"{n}_pct" for n in names.split()) + f"], lambda x: x IS NOT NULL)) AS {score}" for score, names in {
        "valuation_score": "trailing_pe price_to_book price_to_sales ev_to_ebitda price_to_fcf dividend_yield", "quality_score": "return_on_equity debt_to_equity operating_margin revenue_growth_yoy",
        "momentum_score": "ma50_vs_ma200 pct_from_52w_high"}.items()) + " FROM built1)",
    f"built AS MATERIALIZED (SELECT *, {pct_max('valuation_score', 'as_of, sector')} AS sector_valuation_rank FROM built2)",
]
_PLAIN_COLUMNS = "ticker as_of date fundamentals_period available_date fund_id eps_one_off_period per_share_break_period is_fiscal_q4 fiscal_year_end_assumed known_date sector size_group industry".split()
_DOUBLES = [
    "close", "price", "close_raw", "volume", "dividend", *_T, *_OWN, *TREND_COLUMNS, "eps_one_off_ratio", "per_share_break_ratio", "period_price", *[x for m in _PRICED for x in (m, f"{m}_reported")],
    "log_book_value", "log_revenue", "normalized_pe", "dividend_yield", "dividend_growth_3y", "dividend_years_no_cut", *_AHEAD, *[f"{k}_pct" for k in INDICATORS], "valuation_score", "quality_score", "momentum_score", "sector_valuation_rank",
]
B06_SQL = with_(*BUILT, body="""SELECT round(quantile_disc(r, 0.5), 6) AS median_ratio, round(avg(CASE WHEN abs(r - 1) <= 0.15 THEN 1.0 ELSE 0.0 END), 6) AS share_within_15pct
FROM (SELECT price / eps_ttm / trailing_pe AS r FROM built WHERE eps_ttm > 0 AND trailing_pe > 0) WHERE r IS NOT NULL""")
B02_SQL = with_(*BUILT, body="SELECT " + ", ".join([*_PLAIN_COLUMNS, *[r(c, 9) for c in _DOUBLES]]) + " FROM built")

# --- data quality -----------------------------------------------------------------------------------------------------
P3_SQL = """SELECT panel_id, fund_id FROM (
  SELECT p.panel_id, f.fund_id, row_number() OVER (PARTITION BY p.panel_id ORDER BY f.period DESC, f.available_date DESC, f.fund_id) AS rn
  FROM panel p JOIN fundamentals f ON f.ticker = p.ticker AND f.available_date <= p.as_of AND f.available_date >= f.period
) WHERE rn = 1"""


def p3_attributes_sql() -> str:
    one = lambda a: f"arg_max(f.{a}, (f.period, f.available_date, -f.fund_id)) FILTER (WHERE f.{a} IS NOT NULL AND NOT isnan(f.{a})) AS {a}"
    return f"""SELECT p.panel_id, any_value(p.ticker) AS ticker, any_value(p.as_of) AS as_of, {', '.join(one(a) for a in FUNDAMENTAL_FIELDS)}
FROM panel p LEFT JOIN fundamentals f ON f.ticker = p.ticker AND f.available_date <= p.as_of AND f.available_date >= f.period
WHERE p.as_of IS NOT NULL GROUP BY p.panel_id"""


_missing = ["", "-", "--", "?", "n/a", "na", "#n/a", "none", "null", "nan", "tbd", "unknown", "not available", "other", "misc"]
P5_SQL = "WITH good AS (SELECT DISTINCT lower(trim(sector)) AS s FROM universe WHERE sector IS NOT NULL AND lower(trim(sector)) NOT IN (" + ", ".join(f"'{w}'" for w in _missing) + """))
SELECT panel_id, 'return_on_equity' AS field FROM panel WHERE ({roe}) IS NULL
UNION ALL SELECT panel_id, 'operating_margin' FROM panel WHERE ({om}) IS NULL
UNION ALL SELECT panel_id, 'sector' FROM panel LEFT JOIN good ON lower(trim(sector)) = s WHERE s IS NULL
UNION ALL SELECT panel_id, 'as_of' FROM panel WHERE as_of IS NULL""".format(roe=REAL.format("return_on_equity"), om=REAL.format("operating_margin"))

# --- profiles and masks ---------------------------------------------------------------------------------------------------
_TEXTS = {"ticker": "text", "as_of": "time", "sector": "text", "industry": "text", "size_group": "text", "fiscal_year_end_assumed": "time"}


def _digits(t: str) -> str:
    """First significant digit to 1, 4 or 9, the others to 9; sign, point and leading zeros stay."""
    rest = f"ltrim(ltrim({t}, '-'), '0.')"
    head = f"left(ltrim({t}, '-'), length(ltrim({t}, '-')) - length({rest}))"
    return f"CASE WHEN {rest} = '' THEN '0' ELSE CASE WHEN {t}[1] = '-' THEN '-' ELSE '' END || {head} || translate({rest}[1], '2345678', '4449999') || translate(substr({rest}, 2), '012345678', '999999999') END"


_PLAIN = "CASE WHEN abs(v) < 1e15 THEN rtrim(rtrim(CAST(TRY_CAST(v AS DECIMAL(38, 10)) AS VARCHAR), '0'), '.') WHEN NOT isinf(v) THEN format('{:.0f}', v) END"


def _cells(columns: list[str]) -> str:
    """CTEs cells (load_id, column_name, v, s, kind) and counted (... , plain, n): values of the columns and how often they occur."""
    one = lambda c: f"SELECT load_id, '{c}' AS column_name, CAST({c if c not in _TEXTS else 'NULL'} AS DOUBLE) AS v, CAST({c if c in _TEXTS else 'NULL'} AS VARCHAR) AS s, '{_TEXTS.get(c, 'number')}' AS kind FROM panel"
    return "cells AS (" + " UNION ALL ".join(one(c) for c in columns) + f"), counted AS (SELECT *, {_PLAIN} AS plain FROM (SELECT load_id, column_name, v, s, kind, count(*) AS n FROM cells GROUP BY ALL))"


_TEXT_MASK = r"regexp_replace(regexp_replace(regexp_replace(s, '\p{Lu}+', 'A', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+', 'a', 'g'), '\p{Nd}+', '9', 'g')"
MASKED = f"""masked AS (SELECT *, CASE WHEN v IS NULL AND s IS NULL THEN 'null' WHEN kind = 'text' THEN {_TEXT_MASK} WHEN kind = 'time' THEN translate(s, '012345678', '999999999')
  WHEN isnan(v) THEN 'nan' WHEN isinf(v) THEN CASE WHEN v > 0 THEN 'inf' ELSE '-inf' END ELSE {_digits('plain')} END AS mask FROM counted)"""
_fin = "CASE WHEN NOT isnan(v) AND NOT isinf(v) THEN v END"
_Q = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
_where = lambda cond: f"count(*) FILTER (WHERE {cond})"
PROFILED = f"""seen AS (SELECT load_id, column_name, count(*) AS n_distinct, max(n) AS top_count, sum(n * CASE WHEN contains(plain, '.') THEN length(plain) - instr(plain, '.') ELSE 0 END) AS sum_decimals
  FROM counted WHERE s IS NOT NULL OR (v IS NOT NULL AND NOT isnan(v)) GROUP BY ALL),
prof AS (
  SELECT c.load_id, c.column_name, count(*) AS n_rows, {_where('s IS NULL AND (v IS NULL OR isnan(v))')} AS n_missing, {_where('s IS NULL AND v IS NULL')} AS n_null,
    coalesce(any_value(n_distinct), 0) AS n_distinct, coalesce(any_value(top_count), 0) AS top_count, min({nn('v')}) AS min_value, max({nn('v')}) AS max_value,
    {', '.join(f'quantile_disc({_fin}, {q}) AS {k}' for k, q in _Q.items())}, round(avg({_fin}), 6) AS mean_value,
    {_where(f"{nn('v')} < 0")} AS n_negative, {_where('v = 0')} AS n_zero, {_where('isinf(v)')} AS n_infinite, coalesce(any_value(sum_decimals), 0) AS sum_decimals
  FROM cells c LEFT JOIN seen s ON c.load_id IS NOT DISTINCT FROM s.load_id AND c.column_name = s.column_name GROUP BY 1, 2
)"""
_ALL = [*_TEXTS, *_NUM]
P4_PROFILE_SQL = with_(_cells(_ALL), PROFILED, body="SELECT * FROM prof")
P4_MASKS_SQL = with_(
    _cells(_ALL), MASKED, "m AS (SELECT column_name, mask, CAST(sum(n) AS BIGINT) AS n FROM masked GROUP BY ALL)",
    body="""SELECT column_name, mask, n, round(n / sum(n) OVER w, 9) AS share, n / sum(n) OVER w >= 0.05 OR row_number() OVER (PARTITION BY column_name ORDER BY n DESC, mask) = 1 AS dominant, n / sum(n) OVER w < 0.001 AS rare
FROM m WINDOW w AS (PARTITION BY column_name)""",
)
_WATCHED = ["payout_ratio_ttm", "trailing_pe", "roic"]
_sf = "IS NOT DISTINCT FROM"
SHARED = f"""tagged AS (SELECT m.load_id, f.feed, m.column_name, mask, sum(n) AS n FROM masked m LEFT JOIN (SELECT load_id, any_value(feed) AS feed FROM loads GROUP BY 1) f ON f.load_id = m.load_id GROUP BY ALL),
every AS (SELECT feed, column_name, mask, sum(n) AS n FROM tagged GROUP BY ALL), sizes AS (SELECT load_id, feed, column_name, sum(n) AS n_rows FROM tagged GROUP BY ALL),
whole AS (SELECT feed, column_name, sum(n_rows) AS all_rows FROM sizes GROUP BY ALL),
pq AS (
  SELECT z.load_id, z.feed, z.column_name, e.mask, z.n_rows, w.all_rows, coalesce(t.n, 0) AS own, e.n - coalesce(t.n, 0) AS others,
    coalesce(t.n, 0) / z.n_rows AS p, (e.n - coalesce(t.n, 0)) / (w.all_rows - z.n_rows) AS q
  FROM sizes z JOIN whole w ON w.feed {_sf} z.feed AND w.column_name = z.column_name AND w.all_rows > z.n_rows
  JOIN every e ON e.feed {_sf} z.feed AND e.column_name = z.column_name
  LEFT JOIN tagged t ON t.load_id {_sf} z.load_id AND t.column_name = z.column_name AND t.mask = e.mask
)"""
P4_VIOLATIONS_SQL = with_(_cells(_WATCHED), MASKED, SHARED, body="SELECT load_id, feed, column_name, mask, CAST(own AS BIGINT) AS n, CAST(others AS BIGINT) AS n_others FROM pq WHERE own > 0 AND q < 0.001")
_STATS = ["missing", "level", "spread", "width", "negative", "zero", "uniq", "top", "decimals", "divergence"]
_share = lambda c: f"CASE WHEN n_rows > n_missing THEN {c} / (n_rows - n_missing) END"
_fromshare = lambda s, k: f"({s} - mid_{s}) / sqrt(mid_{s} * (1 - mid_{s}) / greatest({k}, 1) + 1e-4)"
_fromratio = lambda s: f"CASE WHEN mid_{s} > 0 AND {s} + mid_{s} * 1e-6 > 0 THEN ln(({s} + mid_{s} * 1e-6) / mid_{s}) * sqrt(greatest(n, 1)) / 1.2 END"
_DIST = {
    "missing": _fromshare("missing", "n_rows"), "level": "CASE WHEN mid_spread > 0 THEN (level - mid_level) / (0.93 * mid_spread / sqrt(greatest(n, 1))) END",
    "spread": _fromratio("spread"), "width": _fromratio("width"), "negative": _fromshare("negative", "n"), **{s: f"{s} - mid_{s}" for s in ("zero", "uniq", "top", "decimals", "divergence")},
}
_far = [f"abs(d_{s}) > 6" for s in ("missing", "negative", "level", "spread", "width")] + [f"abs(d_{s}) > 0.2" for s in ("zero", "uniq", "top")] + ["abs(d_decimals) > 0.4"]
_gap = lambda t: f"{t}.feed {_sf} a.feed AND {t}.column_name = a.column_name"
P4_DRIFT_SQL = with_(
    _cells(_WATCHED), MASKED, PROFILED, SHARED,
    """div AS (SELECT load_id, column_name, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END) - sum(coalesce(t * (1 - t) / nullif((1 - t) + 5.545 * n_rows * t, 0), 0)) AS divergence FROM (SELECT *, (own + others) / all_rows AS t FROM pq) GROUP BY load_id, column_name)""",
    f"""a AS (SELECT p.load_id, z.feed, p.column_name, p.n_rows, p.n_rows - n_missing AS n, n_missing / p.n_rows AS missing, p50 AS level, p75 - p25 AS spread, p95 - p05 AS width, {', '.join(_share(c).replace('n_rows', 'p.n_rows') + f' AS {k}' for c, k in (('n_negative', 'negative'), ('n_zero', 'zero'), ('n_distinct', 'uniq'), ('top_count', 'top'), ('sum_decimals', 'decimals')))}, divergence
  FROM prof p JOIN sizes z ON z.load_id {_sf} p.load_id AND z.column_name = p.column_name LEFT JOIN div d ON d.load_id {_sf} p.load_id AND d.column_name = p.column_name)""",
    f"""mid AS (SELECT feed, column_name, count(*) AS n_loads, {', '.join(f'quantile_disc({x}, 0.5) AS mid_{x}' for x in _STATS)} FROM a WHERE n_rows >= 10 GROUP BY ALL)""",
    f"""d AS (SELECT a.*, n_loads, {', '.join(f'{e} AS d_{k}' for k, e in _DIST.items())} FROM a LEFT JOIN mid ON {_gap('mid')})""",
    f"""noisy AS (SELECT feed, column_name, 1.4826 * quantile_disc(abs(d_divergence), 0.5) AS noise FROM d WHERE n_rows >= 10 GROUP BY ALL)""",
    f"""y AS (SELECT a.*, n_rows >= 10 AND n_loads > 1 AND coalesce(d_divergence > greatest(0.05 + 3.0 / n_rows, 3.0 * noise), false) AS by_masks, n_rows >= 10 AND n_loads > 1 AND ({' OR '.join(f'coalesce({f}, false)' for f in _far)}) AS by_statistics FROM d a LEFT JOIN noisy ON {_gap('noisy')})""",
    body=f"SELECT load_id, feed, column_name, n_rows, {', '.join(f"round(d_{k}, 6) AS d_{dict(uniq='distinct', width='range').get(k, k)}" for k in _STATS)}, by_masks, by_statistics, by_masks OR by_statistics AS departs FROM y",
)
P4_SQL = f"SELECT load_id, column_name FROM ({P4_DRIFT_SQL}) WHERE departs"


def _mode(name: str, table: str, key: str, value: str, least: int) -> str:
    """CTE (k, v): the most frequent present value of a key with `least` of them; of equals the smallest."""
    return f"""{name} AS (SELECT k, v FROM (SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS r, sum(count(*)) OVER (PARTITION BY {key}) AS n
  FROM {table} WHERE {key} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1, 2) WHERE r = 1 AND n >= {least})"""


def _typical(name: str, value: str, keys: list[str]) -> str:
    """CTE: the lower median of a group of five present values or more."""
    k = "".join(f"{x}, " for x in keys)
    there = "".join(f" AND {x} IS NOT NULL" for x in keys)
    return f"{name} AS (SELECT {k}quantile_disc({value}, 0.5) AS v FROM b WHERE {value} IS NOT NULL{there} GROUP BY {k}'' HAVING count(*) >= 5)"


_LEVELS = [("ticker", ["ticker"]), ("snapshot, sector and size", ["fa", "fs", "size_group"]), ("snapshot and sector", ["fa", "fs"]), ("snapshot", ["fa"]), ("all", [])]


def p5_filled_sql() -> str:
    fields = {"return_on_equity": "roe", "operating_margin": "om"}
    ctes = [
        "good AS (SELECT DISTINCT lower(trim(sector)) AS s FROM universe WHERE sector IS NOT NULL AND lower(trim(sector)) NOT IN (" + ", ".join(f"'{w}'" for w in _missing) + "))",
        "p AS (SELECT panel.*, CASE WHEN s IS NOT NULL THEN sector END AS os, " + ", ".join(f"{REAL.format(f)} AS {x}" for f, x in fields.items()) + " FROM panel LEFT JOIN good ON lower(trim(sector)) = s)",
        _mode("ml", "p", "load_id", "as_of", 1),
        "a AS (SELECT p.*, coalesce(p.as_of, ml.v) AS fa FROM p LEFT JOIN ml ON ml.k = p.load_id)",
        _mode("s1", "a", "ticker", "os", 2), _mode("s2", "a", "industry", "os", 2), _mode("s3", "a", "load_id", "os", 2),
        "b AS (SELECT a.*, coalesce(os, s1.v, s2.v, s3.v) AS fs, CASE WHEN os IS NULL THEN CASE WHEN s1.v IS NOT NULL THEN 'ticker' WHEN s2.v IS NOT NULL THEN 'industry' WHEN s3.v IS NOT NULL THEN 'load' END END AS sl FROM a LEFT JOIN s1 ON s1.k = ticker LEFT JOIN s2 ON s2.k = industry LEFT JOIN s3 ON s3.k = load_id)",
    ]
    cols, joins = [], []
    for f, x in fields.items():
        names = [f"{x}{i}" for i in range(len(_LEVELS))]
        ctes += [_typical(n, x, keys) for n, (_, keys) in zip(names, _LEVELS, strict=True)]
        joins += [f"LEFT JOIN {n} ON true" + "".join(f" AND {n}.{k} = b.{k}" for k in keys) for n, (_, keys) in zip(names, _LEVELS, strict=True)]
        value = f"coalesce(b.{x}, {', '.join(f'{n}.v' for n in names)})"
        level = f"CASE WHEN b.{x} IS NULL THEN CASE " + " ".join(f"WHEN {n}.v IS NOT NULL THEN '{name}'" for n, (name, _) in zip(names, _LEVELS, strict=True)) + " END END"
        cols.append(f"{value} AS {f}, {level} IS NOT NULL AS {f}_filled, {level} AS {f}_level")
    cols.append("b.fs AS sector, b.sl IS NOT NULL AS sector_filled, b.sl AS sector_level")
    cols.append("b.fa AS as_of, b.as_of IS NULL AND b.fa IS NOT NULL AS as_of_filled, CASE WHEN b.as_of IS NULL AND b.fa IS NOT NULL THEN 'load' END AS as_of_level")
    return "WITH " + ", ".join(ctes) + "\nSELECT b.panel_id, " + ", ".join(cols) + " FROM b " + " ".join(joins)


ORACLE = {
    "s02_quarters": with_(QUARTERS, body="SELECT ticker, period, available_date, fund_id, eps, sales_per_share, book_value FROM quarters"),
    "s08_daily_rows": with_(DAILY, body="SELECT * FROM daily"),
    "j01_calendar": with_(DAILY, CALENDAR, body="SELECT as_of FROM calendar"),
    "j02_prior_reading": with_(
        QUARTERS, *[prior(f"{c[:3]}{n}", "quarters", c, n) for c in ("eps", "sales_per_share") for n in (365, 1095)],
        body="SELECT q.ticker, q.period, " + ", ".join(f"{c[:3]}{n}.v AS {c}_{n}" for c in ("eps", "sales_per_share") for n in (365, 1095)) + " FROM quarters q " + " ".join(f"LEFT JOIN {c[:3]}{n} ON {c[:3]}{n}.ticker = q.ticker AND {c[:3]}{n}.period = q.period" for c in ("eps", "sales_per_share") for n in (365, 1095)),
    ),
    "j03_known_quarter": J03_SQL,
    "j04_price_at_snapshot": with_(DAILY, CALENDAR, SNAPS, QUOTED, body="SELECT ticker, as_of, date, close, price FROM quoted"),
    "j06_price_at_period": with_(DAILY, QUARTERS, PERIOD_PRICE, body="SELECT ticker, period, period_price FROM period_prices"),
    "j08_forward_returns": J08_SQL, "f01_trends": F01_SQL, "f22_breaks": F22_SQL,
    "l01_reporting_lag": with_(QUARTERS, LAGGED, body="SELECT ticker, period, is_fiscal_q4, fiscal_year_end_assumed, known_date FROM known"),
    "l04_rescaled": L04_SQL, "v01_dividends": V01_SQL, "x01_technicals": X01_SQL, "b02_panel": B02_SQL, "b03_percentiles": B03_SQL, "b05_missing": B05_SQL, "b05_payers": B05_PAYERS_SQL, "b06_eps_basis": B06_SQL,
    "p3_found": P3_SQL, "p3_attributes": p3_attributes_sql(), "p4_found": P4_SQL, "p4_profile": P4_PROFILE_SQL, "p4_masks": P4_MASKS_SQL, "p4_violations": P4_VIOLATIONS_SQL, "p4_drift": P4_DRIFT_SQL, "p5_found": P5_SQL, "p5_filled": p5_filled_sql(),
}
