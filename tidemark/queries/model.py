"""Queries of the valuation model, its diagnostics, tests and labels over the given panel, with their SQL.

Where SQL has to follow, the gaps are those of the sector-median baseline, which is the model's yardstick on the same
folds and an expression of SQL; the ridge itself is tested against brute force and runs on the panel that the pipeline
builds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import technicals, universe
from tidemark.plans import diagnostics, fairvalue, hypothesis, labels, report
from tidemark.queries.pipeline import _fundamentals, _given, _snapshots, built_panel, rounded
from tidemark.queries.sql import BUILT, CALENDAR, DAILY, GIVEN, QUARTERS, SNAPS, pct_max, with_
from tidemark.sources import ingest
from tidemark.sources.tables import by_day, by_quarter, cut, read

#: Least rows of a cross-section here: the smallest tables have 51 companies, and 50 is the model's own bound.
MIN_ROWS = 15
FEATURES = ["return_on_equity", "operating_margin", "debt_to_equity"]


def _built(spark: SparkSession, sf: str) -> DataFrame:
    """The panel of the pipeline with all features of the model and columns of the flags, stored once."""
    return cut(built_panel(spark, sf))


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return fairvalue.eligible(_given(spark, sf), min_rows=MIN_ROWS)


def _baseline(panel: DataFrame) -> DataFrame:
    f = fairvalue.sector_baseline(fairvalue.eligible(panel, min_rows=MIN_ROWS))
    return f.withColumn("gap", F.col("y") - F.col("pred"))


def _fits(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline(_given(spark, sf))


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return fairvalue.verdict(_given(spark, sf), _fits(spark, sf))


def _with_returns(spark: SparkSession, sf: str) -> DataFrame:
    daily = by_day(read(spark, sf, "prices"))
    snaps = _snapshots(spark, sf, daily).select("ticker", "as_of", "close")
    ret = technicals.forward_returns(snaps, daily).drop("close")
    seen = _seen(spark, sf).select("as_of", "ticker", "size_group", F.col("valuation_gap").alias("gap"))
    return seen.join(ret, ["ticker", "as_of"])


def m02_rank_transform(spark: SparkSession, sf: str) -> DataFrame:
    out = fairvalue.rank_transform(_long(spark, sf), FEATURES)
    return rounded(out.select("as_of", "target", "ticker", *FEATURES), 9)


def m03_winsor_transform(spark: SparkSession, sf: str) -> DataFrame:
    out = fairvalue.winsor_transform(_long(spark, sf), FEATURES)
    return rounded(out.select("as_of", "target", "ticker", *FEATURES), 7)


def m08_ridge_of_two(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold ridge of two ranked features with one penalty, and the part of each (M2, M7 to M11), which SQL can solve."""
    g = _given(spark, sf).where("return_on_equity is not null and debt_to_equity is not null")
    fits = fairvalue.fit(g, min_rows=MIN_ROWS, features={t.key: FEATURES[::2] for t in cfg.TARGETS}, penalties=(10.0,), sectors=False)
    part = lambda f: F.element_at("contrib", f).alias(f"of_{f}")
    return rounded(fits.select("as_of", "target", "ticker", F.col("fold").cast("bigint").alias("fold"), "pred", "gap", *[part(f) for f in FEATURES[::2]]), 8)


def m10_fair_value(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold ridge with its parts."""
    return fairvalue.fit(_built(spark, sf), min_rows=MIN_ROWS)


def m12_sector_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Folds (M9) and the out-of-fold sector median."""
    return rounded(_fits(spark, sf).select("as_of", "target", "ticker", F.col("fold").cast("bigint").alias("fold"), "y", "pred"), 9)


def m13_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients over dates."""
    return diagnostics.coefficient_summary(fairvalue.coefficients(_built(spark, sf), min_rows=MIN_ROWS))


def m15_diagnostics_of_the_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """M14 on the ridge: its measures beside the baseline's, the penalty and the number of coefficients."""
    g = _built(spark, sf)
    sections = diagnostics.cross_sections(fairvalue.fit(g, min_rows=MIN_ROWS, contributions=False), _baseline(g), fairvalue.coefficients(g, min_rows=MIN_ROWS))
    return rounded(sections.withColumn("coef", F.size("coef")), 6)


def m14_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.cross_sections(_fits(spark, sf)))


def m16_verdict(spark: SparkSession, sf: str) -> DataFrame:
    v = _seen(spark, sf).select("as_of", "ticker", "loss", "valuation_gap", F.col("n_gaps").cast("bigint").alias("n_gaps"), "gap_agreement", "valuation_basis")
    return rounded(v, 9)


def m17_compare_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Mean r2 of the features in use, with two candidates, clipped instead of ranked, and of the sector median."""
    return diagnostics.compare_sets(diagnostics.feature_sets(_built(spark, sf), MIN_ROWS, ["roic", "revenue_growth_ttm"]), "current")


def m19_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.summary(diagnostics.cross_sections(_fits(spark, sf))))


def m21_r2_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.r2_by_group(_fits(spark, sf), "size_group", 5))


def m23_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive snapshots."""
    return rounded(diagnostics.stability(_seen(spark, sf).select("as_of", "ticker", F.col("valuation_gap").alias("gap")), 20))


def m24_top_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.top_overlap(_seen(spark, sf), "pe_gap", "pb_gap"))


def m25_error_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.error_spread(_fits(spark, sf)))


def _screened(spark: SparkSession, sf: str) -> DataFrame:
    """The built panel with the verdict of the sector-median baseline, labels and flags; rows with eps, breaks and reported
    multiples."""
    g = _built(spark, sf)
    return labels.screened(fairvalue.verdict(g, _baseline(g)))


def m26_ttm_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Breaks in the tails, plain and normalized P/E gaps of flagged rows, and their rank correlation."""
    return rounded(diagnostics.ttm_reliability(_screened(spark, sf)))


def m27_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How far the views agree."""
    return rounded(diagnostics.agreement(_seen(spark, sf)), 9)


def h01_ic_and_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation and quintile spread per date, for all and each size group (H1, H2, H6)."""
    p = hypothesis.per_date(hypothesis.long_returns(_with_returns(spark, sf), by="size_group"))
    return rounded(p.select("grp", "horizon", "as_of", "n", "ic", "spread"))


def h02_mean_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Means over dates of rank correlation and spread with their robust t (H3, H4), on the baseline's gaps."""
    t = hypothesis.tests(hypothesis.per_date(hypothesis.long_returns(_with_returns(spark, sf), by="size_group")))
    return rounded(t.select("grp", "split", "horizon", "test", F.col("n_dates").cast("bigint").alias("n_dates"), "mean", "t_stat"))


def h03_gap_return_test(spark: SparkSession, sf: str) -> DataFrame:
    """The whole test table (H1 to H7) of the ridge's gaps; the built panel has the returns."""
    p = _built(spark, sf)
    seen = fairvalue.verdict(p, fairvalue.fit(p, min_rows=MIN_ROWS, contributions=False))
    return hypothesis.gap_return_test(seen.withColumn("gap", F.col("valuation_gap")), by="size_group")


def h05_false_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Rate control over a table of per-date numbers taken as p values."""
    p = hypothesis.per_date(hypothesis.long_returns(_with_returns(spark, sf))).select("horizon", "as_of", F.round(F.abs("ic"), 6).alias("p_value"))
    return rounded(hypothesis.with_fdr(p, alpha=0.2), 9)


def a01_labels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.add_labels(_seen(spark, sf)).select("as_of", "ticker", "cheapness_rank", "valuation_label"))


def a03_expectations(spark: SparkSession, sf: str) -> DataFrame:
    """Growth in the price against the medians of the date (A3), on the built panel."""
    p = labels.add_expectations(_built(spark, sf))
    return rounded(p.select("as_of", "ticker", "median_pe", "implied_excess_growth", "earnings_cagr_3y_median"), 9)


def a04_label_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Label, its detail and the view (A4), on the built panel."""
    return rounded(_screened(spark, sf).select("as_of", "ticker", "valuation_label", "realized_excess_growth", "label_detail", "valuation_view"), 9)


def a05_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The warning flags with their reasons (A5 to A9), on the built panel."""
    names = ("meme", "value_trap", "report_lag", "fundamental_break", "single_view")
    cells = [F.struct(F.lit(n).alias("flag"), F.col(f"{n}_reason").alias("reason"), F.col(f"{n}_flag").alias("hit")) for n in names]
    return _screened(spark, sf).select("as_of", "ticker", F.inline(F.array(*cells))).where("hit").drop("hit")


def a10_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Flips from cheap to expensive, what moved and the reason (A10), on the built panel."""
    return _screened(spark, sf).where("transition_flag").select("as_of", "ticker", "transition_type", "transition_reason")


def a13_flag_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Of the last snapshot the up to 15 rows of each flag that are nearest to the ends of the ranking."""
    return report.flagged(report.report_at(_screened(spark, sf), [*_REPORTED, *[f"{f}_{x}" for f in report.FLAGS for x in ("flag", "reason")]]))


def a12_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the last snapshot (P10) on the baseline's verdict."""
    return rounded(report.report_at(_screened(spark, sf), [*_REPORTED, "valuation_gap_pct", "pe_gap"]), 9)


_REPORTED = ["ticker", "as_of", "sector", "size_group", "valuation_label", "label_detail", "valuation_view", "cheapness_rank"]


def a14_screened(spark: SparkSession, sf: str) -> DataFrame:
    """All labels and flags on the ridge's verdict."""
    g = _built(spark, sf)
    return labels.screened(fairvalue.verdict(g, fairvalue.fit(g, min_rows=MIN_ROWS, contributions=False)))


def a15_size_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of labels by size group."""
    c = report.crosstab(labels.add_labels(_seen(spark, sf)), "size_group", "valuation_label", [cfg.LABEL_CHEAP, cfg.LABEL_MID, cfg.LABEL_RICH])
    return c.toDF("size_group", "cheap", "mid", "rich")


def a11_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """A text per row of the last snapshot with the strongest drivers."""
    g = _built(spark, sf)
    last = g.join(g.agg(F.max("as_of").alias("as_of")), "as_of", "left_semi")  # fits and labels are per snapshot
    fits = fairvalue.fit(last, min_rows=MIN_ROWS)
    return report.explained(labels.screened(fairvalue.verdict(last, fits)), fits)


def u02_industry_groups(spark: SparkSession, sf: str) -> DataFrame:
    u = read(spark, sf, "universe").withColumnRenamed("industry", "sub_industry")
    return universe.industry_groups(u, least=4).select("ticker", "industry")


def u04_size_counts(spark: SparkSession, sf: str) -> DataFrame:
    return universe.size_counts(read(spark, sf, "universe"))


def c01_stale(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.stale_tickers(by_day(read(spark, sf, "prices")), read(spark, sf, "universe", "ticker"), "2024-06-28", ["close"])


def c05_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "prices").where("ticker is not null").select("ticker", F.when(~F.isnan("close"), F.col("close")).alias("close"))
    return ingest.quality_report(p, by_quarter(_fundamentals(spark, sf)), read(spark, sf, "universe", "ticker"))


QUERIES = {f.__name__: f for f in (m02_rank_transform, m03_winsor_transform, m08_ridge_of_two, m10_fair_value, m12_sector_baseline, m13_coefficients, m14_diagnostics, m15_diagnostics_of_the_ridge, m16_verdict, m17_compare_sets, m19_summary, m21_r2_by_group, m23_stability, m24_top_overlap, m25_error_spread, m26_ttm_reliability, m27_agreement, h01_ic_and_spread, h02_mean_tests, h03_gap_return_test, h05_false_discovery, a01_labels, a03_expectations, a04_label_detail, a05_flags, a10_transitions, a11_explanations, a12_report, a13_flag_lists, a14_screened, a15_size_by_label, u02_industry_groups, u04_size_counts, c01_stale, c05_quality_report)}

# --- SQL ----------------------------------------------------------------------------------------------------------------
# Targets as the SQL knows them: key, column, bounds, label; price to sales and the two below it leave financials out.
_T = [("pe", "trailing_pe", 1, 100, "PER"), ("pb", "price_to_book", 0.1, 20, "PBR"), ("ps", "price_to_sales", 0.05, 40, "PSR"), ("ev_ebitda", "ev_to_ebitda", 1, 60, "EV/EBITDA"), ("pfcf", "price_to_fcf", 1, 100, "P/FCF")]
_NORM = ("pe_norm", "normalized_pe", 1, 100, "")
_ok = lambda t: f"{t[1]} BETWEEN {t[2]} AND {t[3]}" + (" AND coalesce(sector <> 'Financials', true)" if t[0] in ("ps", "ev_ebitda", "pfcf") else "")


def long_sql(table: str, targets: list[tuple]) -> str:
    rows = " UNION ALL ".join(f"SELECT as_of, '{t[0]}' AS target, ticker, sector, size_group, {', '.join(FEATURES)}, ln({t[1]}) AS y FROM {table} WHERE {_ok(t)}" for t in targets)
    return f"elig AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY as_of, target) AS cs FROM ({rows})) WHERE cs >= 15)"


LONG = long_sql("given", _T)
FITS = """folded AS (SELECT *, (dense_rank() OVER (PARTITION BY as_of, target ORDER BY ticker DESC) - 1) % 5 AS fold FROM elig),
outs AS (SELECT f.*, k.k AS out FROM folded f, (VALUES (0), (1), (2), (3), (4)) k(k) WHERE f.fold <> k.k),
ms AS (SELECT as_of, target, sector, out, median(y) AS m FROM outs GROUP BY ALL), ma AS (SELECT as_of, target, out, median(y) AS m FROM outs GROUP BY ALL),
fits AS (SELECT f.*, coalesce(ms.m, ma.m) AS pred, f.y - coalesce(ms.m, ma.m) AS gap FROM folded f
  LEFT JOIN ms ON ms.as_of = f.as_of AND ms.target = f.target AND ms.sector = f.sector AND ms.out = f.fold
  LEFT JOIN ma ON ma.as_of = f.as_of AND ma.target = f.target AND ma.out = f.fold)"""
SPLIT = "CASE WHEN as_of <= DATE '2019-12-31' THEN 'train' WHEN as_of <= DATE '2023-12-31' THEN 'val' ELSE 'test' END"


def avg_rank(c: str, keys: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {keys}) END"


K = "as_of, target"
RANKED = f"ranked AS (SELECT *, {avg_rank('y', K)} AS ry, {avg_rank('pred', K)} AS rp FROM fits)"
SECTIONS = "sections AS (SELECT as_of, target, count(*) AS n, CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - pred) ** 2) / (var_pop(y) * count(y)) END AS r2, avg(abs(y - pred)) AS mae, corr(ry, rp) AS spearman FROM ranked GROUP BY 1, 2)"


def seen_sql(table: str, targets: list[tuple], loss: str) -> str:
    gaps = [t[0] for t in targets]
    return f"""wide AS (SELECT as_of, ticker, {', '.join(f"max(gap) FILTER (WHERE target = '{k}') AS {k}_gap" for k in gaps)} FROM fits GROUP BY 1, 2),
seen0 AS (SELECT g.*, NOT coalesce(g.trailing_pe > 0, false) AND ({loss}) AS loss, {', '.join(f'w.{k}_gap' for k in gaps)} FROM {table} g LEFT JOIN wide w ON g.as_of = w.as_of AND g.ticker = w.ticker),
seen1 AS (SELECT *, CASE WHEN NOT loss THEN list_filter([{', '.join(f'{t[0]}_gap' for t in _T)}], lambda x: x IS NOT NULL) ELSE [] END AS gaps,
  CASE WHEN loss THEN '' ELSE concat_ws('+', {', '.join(f"CASE WHEN {t[0]}_gap IS NOT NULL THEN '{t[4]}' END" for t in _T)}) END AS valuation_basis FROM seen0),
seen2 AS (SELECT *, list_avg(gaps) AS valuation_gap, len(gaps) AS n_gaps FROM seen1),
seen AS (SELECT *, CASE WHEN n_gaps > 0 THEN len(list_filter(gaps, lambda x: sign(x) = sign(valuation_gap))) / n_gaps END AS gap_agreement FROM seen2)"""


SEEN = seen_sql("given", _T, "coalesce(g.return_on_equity < 0, false)")
BASE = [GIVEN, LONG, FITS]
_CHEAP, _RICH, _MID, _NONE, _LOSS = "저평가", "고평가", "중립", "데이터 부족", "판단 보류(적자)"
LABELS = f"labelled0 AS (SELECT *, {pct_max('(-valuation_gap)', 'as_of')} AS cheapness_rank FROM seen), labelled AS (SELECT *, CASE WHEN cheapness_rank >= 80 THEN '{_CHEAP}' WHEN cheapness_rank <= 20 THEN '{_RICH}' WHEN cheapness_rank IS NOT NULL THEN '{_MID}' WHEN loss THEN '{_LOSS}' ELSE '{_NONE}' END AS valuation_label FROM labelled0)"
_tail = lambda c: f"CASE WHEN {c} > 0.8 THEN 'cheap' WHEN {c} <= 0.2 THEN 'rich' WHEN {c} IS NOT NULL THEN 'mid' END"
RETURNS = f"""ends AS (SELECT ticker AS et, max(date) AS e FROM daily GROUP BY 1),
rets AS (SELECT s.ticker, s.as_of, h.m AS horizon, (SELECT CASE WHEN max(e.e) >= s.as_of + h.d THEN ln(arg_max(p.close, p.date) / s.close) END FROM daily p JOIN ends e ON e.et = p.ticker WHERE p.ticker = s.ticker AND p.date > s.as_of AND p.date <= s.as_of + h.d) AS ret FROM snaps s, (VALUES (1, 30), (3, 91), (6, 182), (12, 365)) h(m, d)),
pairs0 AS (SELECT s.size_group, s.as_of, s.ticker, r.horizon, -s.valuation_gap AS signal, r.ret FROM seen s JOIN rets r ON r.ticker = s.ticker AND r.as_of = s.as_of WHERE s.valuation_gap IS NOT NULL AND r.ret IS NOT NULL),
pairs AS (SELECT 'all' AS grp, * EXCLUDE (size_group) FROM pairs0 UNION ALL SELECT size_group, * EXCLUDE (size_group) FROM pairs0 WHERE size_group IS NOT NULL AND size_group <> 'all'),
pr AS (SELECT *, {avg_rank('signal', 'grp, horizon, as_of')} AS rs, {avg_rank('ret', 'grp, horizon, as_of')} AS rr, row_number() OVER (PARTITION BY grp, horizon, as_of ORDER BY signal, ticker) AS k, count(*) OVER (PARTITION BY grp, horizon, as_of) AS n FROM pairs),
ics AS (SELECT grp, horizon, as_of, count(*) AS n, corr(rs, rr) AS ic, avg(ret) FILTER (WHERE b = 4) - avg(ret) FILTER (WHERE b = 0) AS spread FROM (SELECT *, CASE WHEN k = 1 THEN 0 ELSE ((k - 1) * 5 + n - 2) // (n - 1) - 1 END AS b FROM pr WHERE n >= 25) GROUP BY 1, 2, 3)"""
_keep = ", ".join
# Labels and flags of the baseline's verdict on the built panel.
EXPECTED = """expected AS (SELECT *, CASE WHEN trailing_pe > 0 AND median_pe > 0 THEN pow(trailing_pe / median_pe, 0.1) - 1 END AS implied_excess_growth FROM (
  SELECT *, median(CASE WHEN trailing_pe BETWEEN 1 AND 100 THEN trailing_pe END) OVER (PARTITION BY as_of) AS median_pe, median(earnings_cagr_3y) OVER (PARTITION BY as_of) AS earnings_cagr_3y_median FROM labelled))"""
SCREEN = [
    *BUILT, long_sql("built", [*_T, _NORM]), FITS, seen_sql("built", [*_T, _NORM], "coalesce(g.eps <= 0, false) OR coalesce(g.return_on_equity < 0, false) OR coalesce(g.eps_ttm <= 0, false)"), LABELS, EXPECTED,
    """screened AS (
  SELECT *, (1 + earnings_cagr_3y) / (1 + earnings_cagr_3y_median) - 1 AS realized_excess_growth, eps_one_off_period IS NOT NULL OR per_share_break_period IS NOT NULL AS broken,
    coalesce(CASE WHEN price_to_book / price_to_book_reported > 0 THEN price_to_book / price_to_book_reported END, CASE WHEN price_to_sales / price_to_sales_reported > 0 THEN price_to_sales / price_to_sales_reported END,
      CASE WHEN trailing_pe / trailing_pe_reported > 0 THEN trailing_pe / trailing_pe_reported END, CASE WHEN price_to_fcf / price_to_fcf_reported > 0 THEN price_to_fcf / price_to_fcf_reported END) AS moved,
    lag(valuation_label) OVER t AS was_label, CASE WHEN price > 0 AND lag(price) OVER t > 0 THEN ln(price / lag(price) OVER t) END AS dp, CASE WHEN eps > 0 AND lag(eps) OVER t > 0 THEN ln(eps / lag(eps) OVER t) END AS de,
    count(*) FILTER (WHERE valuation_label = '저평가') OVER (PARTITION BY ticker ORDER BY as_of ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS streak
  FROM expected WINDOW t AS (PARTITION BY ticker ORDER BY as_of)
)""",
]
_NOTES = "CASE WHEN broken THEN ' (일회성 손익 가능)' ELSE '' END"
DETAIL = f"""detailed AS (SELECT *, CASE WHEN valuation_label NOT IN ('저평가', '고평가', '중립') THEN '' WHEN coalesce(earnings_turnaround_3y = 1, false) THEN '흑자 전환' || {_NOTES}
  WHEN realized_excess_growth - implied_excess_growth IS NULL THEN '성장 이력 없음'
  ELSE CASE WHEN abs(realized_excess_growth - implied_excess_growth) < 0.02 THEN '요구 성장 ≈ 과거 성장' WHEN realized_excess_growth > implied_excess_growth THEN '과거 성장 > 요구 성장' ELSE '요구 성장 > 과거 성장' END || {_NOTES} || CASE WHEN earnings_cagr_3y > 1 THEN ' (기저 효과 가능)' ELSE '' END END AS label_detail FROM screened),
viewed AS (SELECT *, CASE WHEN label_detail <> '' THEN valuation_label || ' · ' || label_detail ELSE valuation_label END AS valuation_view FROM detailed)"""
_pct1 = lambda c: f"format('{{:+.1f}}%', 100 * {c})"
REASONS = f"""flags AS (
  SELECT as_of, ticker, 'meme' AS flag, '최근 5거래일 ' || CASE WHEN price_spike_5d > 0 THEN '급등' ELSE '급락' END || ' (' || {_pct1('price_spike_5d')} || ') + 거래량 이상치(63일 평균 대비 ' || format('{{:.1f}}', volume_zscore_63d) || '표준편차) — 밸류에이션 판단 신뢰도 낮음' AS reason
  FROM screened WHERE abs(price_spike_5d) > 0.15 AND volume_zscore_63d > 3
  UNION ALL SELECT as_of, ticker, 'value_trap', '최근 4개 시점 연속 저평가 + 매출성장률은 섹터 하위 40% 이내 — 모델이 못 보는 이유로 계속 싼 것일 수 있음 (지속 할인·저성장 경고; 밸류트랩인지는 검증하지 않은 규칙)' FROM screened WHERE streak = 4 AND revenue_growth_yoy_pct <= 40
  UNION ALL SELECT as_of, ticker, 'report_lag', '마지막 재무 기준일(' || coalesce(CAST(fundamentals_period AS VARCHAR), '?') || ') 이후 주가 ' || format('{{:+.0f}}%', 100 * (moved - 1)) || ' — 분사·인수합병·실적 충격이 아직 재무 지표에 반영되지 않았을 수 있음 (배수 괴리가 과장될 수 있으니 뉴스 먼저 확인)' FROM screened WHERE abs(ln(moved)) > 0.4
  UNION ALL SELECT as_of, ticker, 'fundamental_break', concat_ws(' / ', CASE WHEN eps_one_off_period IS NOT NULL THEN CAST(eps_one_off_period AS VARCHAR) || ' 분기 EPS가 평소와 크게 다름(' || CASE WHEN eps_one_off_ratio > 0 THEN '전년 같은 분기의 ' || format('{{:.1f}}배', eps_one_off_ratio) ELSE '전년 같은 분기와 부호가 반대(적자)' END || ') — 일회성 손익 의심' END,
    CASE WHEN per_share_break_period IS NOT NULL THEN CAST(per_share_break_period AS VARCHAR) || ' 분기 주당매출이 전년 대비 ' || format('{{:.1f}}배', per_share_break_ratio) || '로 급변 — 분사·인수합병·주식 수 기준 변경·데이터 오류 의심' END) || ' (최근 12개월 배수가 서로 다른 분기를 섞고 있어 괴리를 그대로 믿기 어려움)' FROM screened WHERE broken
  UNION ALL SELECT as_of, ticker, 'single_view', valuation_basis || ' 한 가지 배수로만 판단 — 다른 배수는 범위 밖이거나 값이 없어 교차 확인이 안 됨 (신뢰도 낮음)' FROM screened WHERE valuation_label IN ('저평가', '고평가') AND n_gaps = 1
)"""
_show = lambda c: f"CASE WHEN {c} IS NULL THEN '데이터 부족' ELSE {_pct1(c)} END"
FLIPS = f"""flips AS (
  SELECT as_of, ticker, {_show('dp')} AS p, {_show('de')} AS e, CASE WHEN dp > 0.15 AND de < -0.15 THEN '복합형' WHEN dp > 0.15 THEN '주가 상승형' WHEN de < -0.15 THEN '실적 악화형' WHEN dp < -0.15 THEN '가격 급락형' ELSE '불분명' END AS transition_type
  FROM screened WHERE was_label = '저평가' AND valuation_label = '고평가'
), reasoned AS (SELECT *, CASE transition_type
  WHEN '복합형' THEN '주가 ' || p || ' 상승과 EPS ' || e || ' 하락이 겹침 — 단순 재평가로 읽으면 안 됨' WHEN '주가 상승형' THEN '주가가 ' || p || ' 오르며 적정가를 넘어섬 (EPS ' || e || ')'
  WHEN '실적 악화형' THEN 'EPS가 ' || e || ' 줄며 배수가 기계적으로 상승 (주가 ' || p || ') — 재평가보다 이익 훼손에 가까움'
  WHEN '가격 급락형' THEN '주가가 ' || p || ' 떨어졌는데도 고평가로 전환 (EPS ' || e || ') — ROE·성장률 등 펀더멘털이 더 크게 나빠져 적정 배수가 내려갔을 가능성'
  ELSE '주가(' || p || ')·EPS(' || e || ') 움직임으로는 설명되지 않음 — 다른 재무 지표 변화로 적정 배수가 바뀌었거나 시장 전체의 가격 결정이 달라진 영향' END AS reason FROM flips)"""
LAST = "last_rows AS (SELECT * FROM viewed WHERE as_of = (SELECT max(as_of) FROM viewed))"
ORACLE = {
    "a03_expectations": with_(*BUILT, "labelled AS (SELECT * FROM built)", EXPECTED, body="SELECT as_of, ticker, round(median_pe, 9) AS median_pe, round(implied_excess_growth, 9) AS implied_excess_growth, round(earnings_cagr_3y_median, 9) AS earnings_cagr_3y_median FROM expected"),
    "a04_label_detail": with_(*SCREEN, DETAIL, body="SELECT as_of, ticker, valuation_label, round(realized_excess_growth, 9) AS realized_excess_growth, label_detail, valuation_view FROM viewed"),
    "a05_flags": with_(*SCREEN, REASONS, body="SELECT * FROM flags"),
    "a10_transitions": with_(*SCREEN, FLIPS, body="SELECT as_of, ticker, transition_type, reason AS transition_reason FROM reasoned"),
    "a12_report": with_(*SCREEN, DETAIL, LAST, body="SELECT ticker, as_of, sector, size_group, valuation_label, label_detail, valuation_view, round(cheapness_rank, 9) AS cheapness_rank, round(exp(valuation_gap) - 1, 9) AS valuation_gap_pct, round(exp(pe_gap) - 1, 9) AS pe_gap FROM last_rows"),
    "a13_flag_lists": with_(
        *SCREEN, DETAIL, LAST, REASONS, FLIPS, "marked AS (SELECT f.flag, l.ticker, l.valuation_label, f.reason, coalesce(abs(l.cheapness_rank - 50), -1) AS far FROM last_rows l JOIN (SELECT * FROM flags UNION ALL SELECT as_of, ticker, 'transition', reason FROM reasoned) f ON f.ticker = l.ticker AND f.as_of = l.as_of)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY far DESC, ticker) AS place, count(*) OVER (PARTITION BY flag) AS n FROM marked)",
        body="SELECT flag, place, n, ticker, valuation_label, reason FROM placed WHERE place <= 15",
    ),
    "m26_ttm_reliability": with_(
        *SCREEN, f"v AS (SELECT *, {avg_rank('valuation_gap', 'as_of')} AS r FROM screened WHERE valuation_gap IS NOT NULL)", "w AS (SELECT * FROM v WHERE pe_gap IS NOT NULL AND pe_norm_gap IS NOT NULL)",
        f"x AS (SELECT as_of, {avg_rank('pe_gap', 'as_of')} AS a, {avg_rank('pe_norm_gap', 'as_of')} AS b FROM w)", "c AS (SELECT as_of, corr(a, b) AS c FROM x GROUP BY 1)",
        body="""SELECT CASE WHEN r <= 0.2 THEN 'cheap' WHEN r > 0.8 THEN 'expensive' ELSE 'middle' END AS part, count(*) AS n, round(avg(CAST(broken AS INT)), 6) AS break_share, CAST(NULL AS DOUBLE) AS mean_abs_pe, CAST(NULL AS DOUBLE) AS mean_abs_pe_norm, CAST(NULL AS DOUBLE) AS rank_corr FROM v GROUP BY 1
UNION ALL SELECT 'all', count(*), round(avg(CAST(broken AS INT)), 6), NULL, NULL, NULL FROM v HAVING count(*) > 0
UNION ALL SELECT CASE WHEN broken THEN 'flagged' ELSE 'not flagged' END, count(*), NULL, round(avg(abs(pe_gap)), 6), round(avg(abs(pe_norm_gap)), 6), NULL FROM w GROUP BY 1
UNION ALL SELECT 'correlation', count(CASE WHEN NOT isnan(c) THEN c END), NULL, NULL, NULL, round(avg(CASE WHEN NOT isnan(c) THEN c END), 6) FROM c""",
    ),
    "m27_agreement": with_(*BASE, SEEN, body="SELECT count(*) AS n, round(avg(gap_agreement), 9) AS mean_agreement, round(avg(CAST(gap_agreement = 1 AS INT)), 9) AS all_agree FROM seen WHERE valuation_gap IS NOT NULL AND n_gaps > 1"),
    "m02_rank_transform": with_(GIVEN, LONG, body="SELECT as_of, target, ticker, " + _keep(f"round({avg_rank(f, K)}, 9) AS {f}" for f in FEATURES) + " FROM elig"),
    "m03_winsor_transform": with_(
        GIVEN, LONG, "qs AS (SELECT as_of, target, " + _keep(f"quantile_cont({f}, 0.02) AS {f}_lo, quantile_cont({f}, 0.98) AS {f}_hi, count({f}) AS {f}_n" for f in FEATURES) + " FROM elig GROUP BY 1, 2)",
        body="SELECT e.as_of, e.target, e.ticker, " + _keep(f"round(CASE WHEN {f} IS NULL THEN NULL WHEN {f}_n >= 3 THEN least(greatest({f}, {f}_lo), {f}_hi) ELSE {f} END, 7) AS {f}" for f in FEATURES) + " FROM elig e JOIN qs ON qs.as_of = e.as_of AND qs.target = e.target",
    ),
    "m08_ridge_of_two": with_(
        GIVEN.replace("given AS (", "given AS (SELECT * FROM (", 1) + " WHERE return_on_equity IS NOT NULL AND debt_to_equity IS NOT NULL)", LONG,
        "folded AS (SELECT *, (dense_rank() OVER (PARTITION BY as_of, target ORDER BY ticker DESC) - 1) % 5 AS fold FROM elig)",
        f"x AS (SELECT as_of, target, ticker, fold, y, {avg_rank('return_on_equity', K)} AS a, {avg_rank('debt_to_equity', K)} AS b FROM folded)",
        "t AS (SELECT x.as_of, x.target, k.k AS held, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS ba FROM x, (VALUES (0), (1), (2), (3), (4)) k(k) WHERE x.fold <> k.k GROUP BY 1, 2, 3)",
        # Normal equations of the standardised features: (n + 10) on the diagonal, n * correlation beside it.
        "s AS (SELECT *, n * ab / (sa * sb) AS r, n * ay / sa AS u, n * ba / sb AS v, (n + 10.0) AS d FROM t)",
        "w AS (SELECT *, (d * u - r * v) / (d * d - r * r) AS wa, (d * v - r * u) / (d * d - r * r) AS wb FROM s)",
        "p AS (SELECT x.*, w.my, (a - ma) / sa * wa AS pa, (b - mb) / sb * wb AS pb FROM x JOIN w ON w.as_of = x.as_of AND w.target = x.target AND w.held = x.fold)",
        body="SELECT as_of, target, ticker, fold, round(my + pa + pb, 8) AS pred, round(y - (my + pa + pb), 8) AS gap, round(pa, 8) AS of_return_on_equity, round(pb, 8) AS of_debt_to_equity FROM p",
    ),
    "h02_mean_tests": with_(
        *BASE, SEEN, DAILY, CALENDAR, SNAPS, RETURNS,
        f"l AS (SELECT grp, {SPLIT} AS split, horizon, t.test, as_of, CASE t.test WHEN 'ic' THEN ic ELSE spread END AS v FROM ics, (VALUES ('ic'), ('spread')) t(test))",
        "e AS (SELECT *, v - avg(v) OVER w AS e, row_number() OVER (PARTITION BY grp, split, horizon, test ORDER BY as_of) AS i, greatest(0, ceil(horizon / 3.0) - 1) AS lags FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY grp, split, horizon, test))",
        "c AS (SELECT a.grp, a.split, a.horizon, a.test, sum(2 * (1 - (a.i - b.i) / (a.lags + 1)) * a.e * b.e) AS c FROM e a JOIN e b ON a.grp = b.grp AND a.split = b.split AND a.horizon = b.horizon AND a.test = b.test AND a.i - b.i BETWEEN 1 AND a.lags GROUP BY 1, 2, 3, 4)",
        "g AS (SELECT grp, split, horizon, test, count(*) AS n, avg(v) AS m, sum(e * e) AS s, max(lags) AS lags FROM e GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4)",
        "q AS (SELECT g.*, CASE WHEN lags = 0 THEN s / (n - 1) / n ELSE (s + coalesce(c, 0)) / (n * n) END AS var FROM g LEFT JOIN c ON c.grp = g.grp AND c.split = g.split AND c.horizon = g.horizon AND c.test = g.test)",
        body="SELECT grp, split, horizon, test, n AS n_dates, round(m, 6) AS mean, round(CASE WHEN var > 0 THEN m / sqrt(var) END, 6) AS t_stat FROM q",
    ),
    "m12_sector_baseline": with_(*BASE, body="SELECT as_of, target, ticker, fold, round(y, 9) AS y, round(pred, 9) AS pred FROM fits"),
    "m14_diagnostics": with_(*BASE, RANKED, SECTIONS, body="SELECT as_of, target, n, round(r2, 6) AS r2, round(mae, 6) AS mae, round(spearman, 6) AS spearman FROM sections"),
    "m16_verdict": with_(*BASE, SEEN, body="SELECT as_of, ticker, loss, round(valuation_gap, 9) AS valuation_gap, n_gaps, round(gap_agreement, 9) AS gap_agreement, valuation_basis FROM seen"),
    "m19_summary": with_(*BASE, RANKED, SECTIONS, body=f"SELECT target, {SPLIT} AS split, round(avg(r2), 6) AS r2, round(avg(mae), 6) AS mae, round(avg(spearman), 6) AS spearman, count(*) AS n_dates FROM sections GROUP BY ALL"),
    "m21_r2_by_group": with_(*BASE, "g AS (SELECT as_of, target, size_group, count(*) AS n, 1 - sum((y - pred) ** 2) / (CASE WHEN var_pop(y) > 0 THEN var_pop(y) * count(y) END) AS r2 FROM fits GROUP BY 1, 2, 3)", body=f"SELECT target, {SPLIT} AS split, size_group, round(avg(r2), 6) AS r2, round(avg(n), 6) AS rows_per_date, count(*) AS n_dates FROM g WHERE n >= 5 AND r2 IS NOT NULL GROUP BY ALL"),
    "m23_stability": with_(
        *BASE, SEEN, f"""st AS (SELECT as_of, ticker, gap, {_tail('r')} AS label, dense_rank() OVER (ORDER BY as_of) AS k FROM (SELECT as_of, ticker, valuation_gap AS gap, {avg_rank('(-valuation_gap)', 'as_of')} AS r FROM seen WHERE valuation_gap IS NOT NULL)),
two AS (SELECT a.as_of, a.gap, b.gap AS was, a.label, b.label AS wl FROM st a JOIN st b ON a.ticker = b.ticker AND a.k = b.k + 1),
rk AS (SELECT *, {avg_rank('gap', 'as_of')} AS r1, {avg_rank('was', 'as_of')} AS r2 FROM two),
per AS (SELECT as_of, count(*) AS n, corr(r1, r2) AS rank_corr, avg(CAST(label <> wl AS INT)) AS label_changed, avg(CAST(label <> wl AND label <> 'mid' AND wl <> 'mid' AS INT)) AS cheap_rich_flip FROM rk GROUP BY 1 HAVING count(*) >= 20)""",
        body=f"SELECT {SPLIT} AS split, round(avg(rank_corr), 6) AS rank_corr, round(avg(label_changed), 6) AS label_changed, round(avg(cheap_rich_flip), 6) AS cheap_rich_flip, count(*) AS n_pairs FROM per GROUP BY ALL",
    ),
    "m24_top_overlap": with_(*BASE, SEEN, f"t AS (SELECT as_of, coalesce({avg_rank('(-pe_gap)', 'as_of')} > 0.8, false) AS a, coalesce({avg_rank('(-pb_gap)', 'as_of')} > 0.8, false) AS b FROM seen), per AS (SELECT as_of, count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b) AS j FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE a OR b) > 0)", body="SELECT round(avg(j), 6) AS overlap, count(*) AS n_dates FROM per"),
    "m25_error_spread": with_(*BASE, body=f"SELECT target, {SPLIT} AS split, round(quantile_disc(exp(abs(gap)) - 1, 0.5), 6) AS error_median, round(quantile_disc(exp(abs(gap)) - 1, 0.9), 6) AS error_p90, count(*) AS n FROM fits GROUP BY ALL"),
    "h01_ic_and_spread": with_(*BASE, SEEN, DAILY, CALENDAR, SNAPS, RETURNS, body="SELECT grp, horizon, as_of, n, round(ic, 6) AS ic, round(spread, 6) AS spread FROM ics"),
    "h05_false_discovery": with_(*BASE, SEEN, DAILY, CALENDAR, SNAPS, RETURNS, "t AS (SELECT horizon, as_of, round(abs(ic), 6) AS p FROM ics WHERE grp = 'all')", "u AS (SELECT a.horizon, a.as_of, a.p, least(1.0, min(b.p * b.m / b.k)) AS q FROM t a JOIN (SELECT p, max(k) AS k, max(m) AS m FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(p) OVER () AS m FROM t WHERE p IS NOT NULL) GROUP BY p) b ON b.p >= a.p GROUP BY 1, 2, 3)", body="SELECT horizon, as_of, round(p, 9) AS p_value, round(q, 9) AS p_value_fdr, q <= 0.2 AS significant_after_fdr FROM u"),
    "a01_labels": with_(*BASE, SEEN, LABELS, body="SELECT as_of, ticker, round(cheapness_rank, 6) AS cheapness_rank, valuation_label FROM labelled"),
    "a15_size_by_label": with_(*BASE, SEEN, LABELS, body=f"SELECT size_group, count(*) FILTER (WHERE valuation_label = '{_CHEAP}') AS cheap, count(*) FILTER (WHERE valuation_label = '{_MID}') AS mid, count(*) FILTER (WHERE valuation_label = '{_RICH}') AS rich FROM labelled GROUP BY 1"),
    "u02_industry_groups": "SELECT ticker, CASE WHEN industry IS NOT NULL AND count(*) OVER (PARTITION BY industry) >= 4 THEN industry ELSE coalesce(sector, 'Unknown') || ' 기타' END AS industry FROM universe",
    "u04_size_counts": "SELECT sector, count(*) FILTER (WHERE size_group = 'large') AS large, count(*) FILTER (WHERE size_group = 'mid') AS mid, count(*) FILTER (WHERE size_group = 'small') AS small FROM universe GROUP BY 1",
    "c01_stale": with_(DAILY, body="SELECT u.ticker FROM universe u LEFT JOIN (SELECT ticker, max(date) AS d FROM daily GROUP BY 1) p USING (ticker) WHERE d IS NULL OR DATE '2024-06-28' - d > 3"),
    "c05_quality_report": with_(
        QUARTERS, """p AS (SELECT ticker, count(*) AS n, bool_or(NOT isnan(close) AND close <= 0) AS bad FROM prices WHERE ticker IS NOT NULL GROUP BY 1),
q AS (SELECT ticker, count(*) AS nq, count(trailing_pe) AS npe, median(trailing_pe) FILTER (WHERE k <= 8) AS pe, median(price_to_book) FILTER (WHERE k <= 8) AS pb FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS k FROM quarters) GROUP BY 1),
t AS (SELECT u.ticker, concat_ws(', ', CASE WHEN n IS NULL THEN 'no prices' END, CASE WHEN n < 60 THEN 'short prices' END, CASE WHEN bad THEN 'close not above 0' END, CASE WHEN nq IS NULL THEN 'no fundamentals' END, CASE WHEN npe = 0 THEN 'no P/E' END, CASE WHEN pe < 1 THEN 'low P/E' END, CASE WHEN pb < 0.1 THEN 'low P/B' END) AS issues FROM (SELECT DISTINCT ticker FROM universe) u LEFT JOIN p USING (ticker) LEFT JOIN q USING (ticker))""",
        body="SELECT ticker, issues FROM t WHERE issues <> ''",
    ),
}
