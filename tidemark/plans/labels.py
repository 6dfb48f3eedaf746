"""Labels, expectations and warning flags with their reasons, over a panel with verdicts: windows and conditions, no joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators.windows import percent_rank_max

SPIKE, VOLUME_Z, TRAP_ROWS, WEAK_GROWTH = 0.15, 3.0, 4, 40.0
MOVE_PRICE, MOVE_EPS, LAG_MOVE, YEARS_AHEAD, SIMILAR_BAND, BASE_EFFECT = 0.15, 0.15, 0.4, 10, 0.02, 1.0
# Details, types and texts of the report, which are data to those who read it.
PAST_ABOVE, REQUIRED_ABOVE, SIMILAR = "과거 성장 > 요구 성장", "요구 성장 > 과거 성장", "요구 성장 ≈ 과거 성장"
TURNAROUND, NO_GROWTH_HISTORY = "흑자 전환", "성장 이력 없음"
ONE_OFF_NOTE, BASE_EFFECT_NOTE = " (일회성 손익 가능)", " (기저 효과 가능)"
BOTH_MOVED, PRICE_UP, EPS_DOWN, PRICE_DOWN, UNCLEAR, NO_DATA = "복합형", "주가 상승형", "실적 악화형", "가격 급락형", "불분명", "데이터 부족"
MEME_TEXT = "최근 5거래일 %s (%+.1f%%) + 거래량 이상치(63일 평균 대비 %.1f표준편차) — 밸류에이션 판단 신뢰도 낮음"
TRAP_TEXT = "최근 4개 시점 연속 저평가 + 매출성장률은 섹터 하위 40% 이내 — 모델이 못 보는 이유로 계속 싼 것일 수 있음 (지속 할인·저성장 경고; 밸류트랩인지는 검증하지 않은 규칙)"
LAG_TEXT = "마지막 재무 기준일(%s) 이후 주가 %+.0f%% — 분사·인수합병·실적 충격이 아직 재무 지표에 반영되지 않았을 수 있음 (배수 괴리가 과장될 수 있으니 뉴스 먼저 확인)"
ONE_OFF_TEXT = "%s 분기 EPS가 평소와 크게 다름(%s) — 일회성 손익 의심"
ONE_OFF_RATIO, ONE_OFF_SIGN = "전년 같은 분기의 %.1f배", "전년 같은 분기와 부호가 반대(적자)"
PER_SHARE_TEXT = "%s 분기 주당매출이 전년 대비 %.1f배로 급변 — 분사·인수합병·주식 수 기준 변경·데이터 오류 의심"
BREAK_TEXT = " (최근 12개월 배수가 서로 다른 분기를 섞고 있어 괴리를 그대로 믿기 어려움)"
SINGLE_TEXT = " 한 가지 배수로만 판단 — 다른 배수는 범위 밖이거나 값이 없어 교차 확인이 안 됨 (신뢰도 낮음)"
TRANSITION_TEXTS = {
    BOTH_MOVED: "주가 %1$s 상승과 EPS %2$s 하락이 겹침 — 단순 재평가로 읽으면 안 됨",
    PRICE_UP: "주가가 %1$s 오르며 적정가를 넘어섬 (EPS %2$s)",
    EPS_DOWN: "EPS가 %2$s 줄며 배수가 기계적으로 상승 (주가 %1$s) — 재평가보다 이익 훼손에 가까움",
    PRICE_DOWN: "주가가 %1$s 떨어졌는데도 고평가로 전환 (EPS %2$s) — ROE·성장률 등 펀더멘털이 더 크게 나빠져 적정 배수가 내려갔을 가능성",
    UNCLEAR: "주가(%1$s)·EPS(%2$s) 움직임으로는 설명되지 않음 — 다른 재무 지표 변화로 적정 배수가 바뀌었거나 시장 전체의 가격 결정이 달라진 영향",
}


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _col(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def add_labels(df: DataFrame) -> DataFrame:
    """cheapness_rank (0 to 100, high is cheap, within as_of) and valuation_label; rows with a loss and no rank are held
    off, other rows without a rank have no data."""
    rank = percent_rank_max(-F.col("valuation_gap"), ["as_of"])
    r = F.col("cheapness_rank")
    label = F.when(r >= cfg.CHEAP, cfg.LABEL_CHEAP).when(r <= cfg.EXPENSIVE, cfg.LABEL_RICH).when(r.isNotNull(), cfg.LABEL_MID)
    return df.withColumn("cheapness_rank", rank).withColumn("valuation_label", label.when(_col(df, "loss", "boolean"), cfg.LABEL_LOSS).otherwise(cfg.LABEL_NONE))


def _growth(df: DataFrame) -> Column:
    """Three-year earnings growth; the EPS growth only where the panel has no such column."""
    return _col(df, "earnings_cagr_3y" if "earnings_cagr_3y" in df.columns else "eps_cagr_3y")


def add_expectations(df: DataFrame) -> DataFrame:
    """median_pe of as_of (over 1 to 100), implied_excess_growth = (pe / median)^(1/10) - 1 and earnings_cagr_3y_median, the
    median of three-year earnings growth at as_of."""
    w = Window.partitionBy("as_of")
    pe = F.when(F.col("trailing_pe") > 0, F.col("trailing_pe"))
    mid = F.percentile(F.when(pe.between(1, 100), pe), F.lit(0.5)).over(w)
    return df.withColumn("median_pe", mid).withColumns({
        "implied_excess_growth": F.when(F.col("median_pe") > 0, F.pow(pe / F.col("median_pe"), F.lit(1.0 / YEARS_AHEAD)) - 1),
        "earnings_cagr_3y_median": F.percentile(_growth(df), F.lit(0.5)).over(w),
    })


def _reason(flag: Column, text: Column) -> Column:
    return F.when(flag, text).otherwise("")


def flag_meme(df: DataFrame) -> DataFrame:
    """meme_flag and meme_reason: five-day move above 15% with a last-day volume more than three deviations above its mean."""
    move, z = _col(df, "price_spike_5d"), _col(df, "volume_zscore_63d")
    flag = _false((F.abs(move) > SPIKE) & (z > VOLUME_Z))
    text = F.format_string(MEME_TEXT, F.when(move > 0, "급등").otherwise("급락"), move * 100, z)
    return df.withColumns({"meme_flag": flag, "meme_reason": _reason(flag, text)})


def flag_value_trap(df: DataFrame) -> DataFrame:
    """value_trap_flag and _reason: cheap in four rows of the ticker in a row, and weak growth now."""
    w = Window.partitionBy("ticker").orderBy("as_of").rowsBetween(-(TRAP_ROWS - 1), 0)
    cheap = F.sum((F.col("valuation_label") == cfg.LABEL_CHEAP).cast("int")).over(w) == TRAP_ROWS
    df = df.withColumn("value_trap_flag", _false(cheap & (_col(df, "revenue_growth_yoy_pct") <= WEAK_GROWTH)))
    return df.withColumn("value_trap_reason", _reason(F.col("value_trap_flag"), F.lit(TRAP_TEXT)))


def flag_report_lag(df: DataFrame) -> DataFrame:
    """price_move_since_report, report_lag_flag and _reason: the first known of rescaled / reported P/B, P/S, P/E, P/FCF."""
    names = ("price_to_book", "price_to_sales", "trailing_pe", "price_to_fcf")
    ratio = lambda m: F.try_divide(_col(df, m), _col(df, f"{m}_reported"))
    move = F.ln(F.coalesce(*[F.when(ratio(m) > 0, ratio(m)) for m in names]))
    df = df.withColumn("__move", move).withColumns({"price_move_since_report": F.expm1("__move"), "report_lag_flag": _false(F.abs("__move") > LAG_MOVE)}).drop("__move")
    day = F.coalesce(_col(df, "fundamentals_period", "date").cast("string"), F.lit("?"))
    return df.withColumn("report_lag_reason", _reason(F.col("report_lag_flag"), F.format_string(LAG_TEXT, day, F.col("price_move_since_report") * 100)))


def flag_break(df: DataFrame) -> DataFrame:
    """fundamental_break_flag and _reason: a one-off in earnings or a per-share break within the last four quarters."""
    off, jump = _col(df, "eps_one_off_period", "date"), _col(df, "per_share_break_period", "date")
    ratio = _col(df, "eps_one_off_ratio")
    size = F.when(ratio > 0, F.format_string(ONE_OFF_RATIO, ratio)).otherwise(ONE_OFF_SIGN)
    parts = F.concat_ws(" / ", F.when(off.isNotNull(), F.format_string(ONE_OFF_TEXT, off.cast("string"), size)), F.when(jump.isNotNull(), F.format_string(PER_SHARE_TEXT, jump.cast("string"), _col(df, "per_share_break_ratio"))))
    flag = off.isNotNull() | jump.isNotNull()
    return df.withColumns({"fundamental_break_flag": flag, "fundamental_break_reason": _reason(flag, F.concat(parts, F.lit(BREAK_TEXT)))})


def flag_single_view(df: DataFrame) -> DataFrame:
    """single_view_flag and _reason: a cheap or expensive label that rests on one multiple."""
    flag = _false(F.col("valuation_label").isin(cfg.LABEL_CHEAP, cfg.LABEL_RICH) & (_col(df, "n_gaps", "int") == 1))
    return df.withColumns({"single_view_flag": flag, "single_view_reason": _reason(flag, F.concat(F.coalesce(_col(df, "valuation_basis", "string"), F.lit("")), F.lit(SINGLE_TEXT)))})


def transitions(df: DataFrame) -> DataFrame:
    """transition_flag, _type and _reason: cheap at the ticker's row before and expensive now, by what moved by more than 15% in
    the log between the two (price up and EPS down, one of them, price down, none). Type and reason are '' without a flip."""
    w = Window.partitionBy("ticker").orderBy("as_of")
    change = lambda c: F.when((F.col(c) > 0) & (F.lag(c).over(w) > 0), F.ln(F.col(c) / F.lag(c).over(w)))
    df = df.withColumns({
        "__p": change("price"), "__e": change("eps") if "eps" in df.columns else F.lit(None).cast("double"),
        "transition_flag": _false((F.lag("valuation_label").over(w) == cfg.LABEL_CHEAP) & (F.col("valuation_label") == cfg.LABEL_RICH)),
    })
    p, e = F.col("__p"), F.col("__e")
    up, down, fell = _false(p > MOVE_PRICE), _false(e < -MOVE_EPS), _false(p < -MOVE_PRICE)
    kind = F.when(up & down, BOTH_MOVED).when(up, PRICE_UP).when(down, EPS_DOWN).when(fell, PRICE_DOWN).otherwise(UNCLEAR)
    df = df.withColumn("transition_type", F.when(F.col("transition_flag"), kind).otherwise(""))
    show = lambda c: F.when(c.isNotNull(), F.format_string("%+.1f%%", c * 100)).otherwise(NO_DATA)
    text = F.lit("")
    for k, t in TRANSITION_TEXTS.items():
        text = F.when(F.col("transition_type") == k, F.format_string(t, show(p), show(e))).otherwise(text)
    return df.withColumn("transition_reason", text).drop("__p", "__e")


def growth_detail(df: DataFrame) -> DataFrame:
    """realized_excess_growth, label_detail and valuation_view of labelled rows.

    The growth delivered beyond the median one, (1 + growth) / (1 + median) - 1, against the growth that the multiple asks for
    beyond the median: similar within 0.02, else which one is higher. A turnaround has no growth and its own detail; without
    growth or multiple there is no history. Notes say that a one-off or a tiny base may be behind it, but for rows without
    history, and turnarounds have no base. Other rows have the detail ''; the view is the label, with the detail if any.
    """
    labelled = F.col("valuation_label").isin(cfg.LABEL_CHEAP, cfg.LABEL_RICH, cfg.LABEL_MID)
    past = _growth(df)
    df = df.withColumn("realized_excess_growth", F.try_divide(1 + past, 1 + F.col("earnings_cagr_3y_median")) - 1)
    d = F.col("realized_excess_growth") - F.col("implied_excess_growth")
    one_off = F.when(_false(_col(df, "fundamental_break_flag", "boolean")), ONE_OFF_NOTE).otherwise("")
    base = F.when(_false(past > BASE_EFFECT), BASE_EFFECT_NOTE).otherwise("")
    compared = F.when(F.abs(d) < SIMILAR_BAND, SIMILAR).when(d > 0, PAST_ABOVE).otherwise(REQUIRED_ABOVE)
    turned = F.concat(F.lit(TURNAROUND), one_off)
    detail = F.when(_false(_col(df, "earnings_turnaround_3y") == 1), turned).when(d.isNull(), NO_GROWTH_HISTORY).otherwise(F.concat(compared, one_off, base))
    df = df.withColumn("label_detail", F.when(labelled, detail).otherwise(""))
    return df.withColumn("valuation_view", F.when(F.col("label_detail") != "", F.concat_ws(" · ", "valuation_label", "label_detail")).otherwise(F.col("valuation_label")))


def screened(df: DataFrame) -> DataFrame:
    """All labels and flags in the order in which they build on one another."""
    for step in (add_labels, flag_meme, flag_value_trap, flag_report_lag, flag_break, flag_single_view, add_expectations, growth_detail, transitions):
        df = step(df)
    return df
