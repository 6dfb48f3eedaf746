"""The report of one snapshot: selection, order, top lists, counts, flags, and a text per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.plans.labels import BASE_EFFECT_NOTE, ONE_OFF_NOTE

MIN_EFFECT = 0.05
# The texts of the report, in the order in which they appear in it.
NEEDS_THE_SAME = "앞으로 10년간 중간 종목과 비슷하게 성장하면 현재 PER이 설명됨"
NEEDS_GROWTH, NEEDS_MORE, NEEDS_LESS, NEEDS_END = "앞으로 10년간 이익이 중간 종목보다 매년 약 ", " 더", " 덜", " 늘어야 현재 PER이 설명됨"
PAST_GROWTH, PAST_MEDIAN = "최근 3년 이익 성장률 연 ", ", 중간 종목 "
PAST_TURN, PAST_UNKNOWN = "3년 전 적자에서 흑자로 전환해 성장률로 표시할 수 없음", "최근 3년 이익 성장률 계산 불가(적자 또는 3년 미만 이력)"
EXPECTATION, EXPECTATION_END = "주가에 반영된 기대: ", "; 10년 뒤 중간 종목 수준 PER, 같은 할인율 가정)"
RAISED, LOWERED, NO_DRIVER = "높인 요인 ", "낮춘 요인 ", "평균적인 종목과 비슷"
NO_VALUE, DENOMINATOR = "(값 없음)", "(분모 효과)"
NOT_IN_VERDICT, OF_A_LOSS = " [참고용, 종합 판단 제외]", " [적자라 참고용]"
MULTIPLE, FAIR = " %.1f배 (적정 %.1f배, ", " — 적정 "
GROWTH_BEYOND = ": 중간 종목 대비 최근 3년 실제 초과 성장 %+.1f%% vs 가격에 반영된 초과 성장 %+.1f%%"
HELD_OFF = "최근 12개월 적자 — 일회성 손상인지 구조적 부진인지 재무 지표만으로 구분할 수 없어 판단을 보류함 (위 배수 괴리는 참고용)"
IS_CHEAP, IS_DEAR = "싸다", "비싸다"
VIEWS_AGREE = "종합: %d개 관점 중 %d개가 '%s' 쪽 (평균 괴리 "
ONE_VIEW, ONE_VIEW_GAP, ONE_VIEW_END = "종합: ", " 한 가지 관점으로만 판단 (괴리 ", ") — 다른 배수로 교차 확인할 수 없음"


def report_at(screened: DataFrame, columns: list[str], as_of: str | None = None) -> DataFrame:
    """Rows of one snapshot (the last one unless named), columns that exist in the order asked for (others NULL), by descending
    cheapness_rank and ticker. Gaps of single multiples are in percent (exp(gap) - 1), and valuation_gap_pct is the combined
    one; valuation_gap stays as it is. A date that is no snapshot gives no rows."""
    day = F.lit(as_of).cast("date") if as_of is not None else screened.agg(F.max("as_of")).scalar()
    rows = screened.where(F.col("as_of") == day)
    if "valuation_gap" in rows.columns:
        rows = rows.withColumn("valuation_gap_pct", F.expm1("valuation_gap"))
    gap = lambda c: c.endswith("_gap") and c != "valuation_gap"
    pick = lambda c: (F.expm1(c) if gap(c) else F.col(c)).alias(c) if c in rows.columns else F.lit(None).alias(c)
    return rows.orderBy(F.desc_nulls_last("cheapness_rank"), "ticker").select(*[pick(c) for c in columns])


def of_ticker(report: DataFrame, ticker: str) -> dict:
    """The ticker's row as a dict, or {'error': ...}; the ticker is taken in capitals."""
    row = report.where(F.col("ticker") == ticker.upper()).first()
    return row.asDict() if row else {"error": f"{ticker.upper()} is not in the report"}


def extremes(report: DataFrame, n: int = 15) -> tuple[DataFrame, DataFrame]:
    """The n cheapest and the n most expensive rows (top-k, no full sort)."""
    known = report.where("cheapness_rank is not null")
    return known.orderBy(F.desc("cheapness_rank"), "ticker").limit(n), known.orderBy("cheapness_rank", "ticker").limit(n)


def crosstab(report: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by column with the columns named in advance."""
    return report.groupBy(row).pivot(column, values).count().na.fill(0)


def drivers_text(contrib: Column, denominators: Column | None = None, missing: Column | None = None, labels: dict[str, str] | None = None) -> Column:
    """Up to two drivers that raise and two that lower the fair multiple by at least 0.05 in the log, the strongest
    first: 'name +12%'. Denominator drivers and those whose value is missing (arrays of names) are marked, names replaced by
    `labels`. Percentages are rounded half to even."""
    strong = F.filter(F.map_entries(contrib), lambda e: F.abs(e["value"]) >= MIN_EFFECT)
    names = F.create_map(*[F.lit(x) for kv in (labels or {"": ""}).items() for x in kv])
    marked = lambda some, e, text: F.when(F.array_contains(some, e["key"]), text).otherwise("") if some is not None else F.lit("")

    def show(e: Column) -> Column:
        pct = F.bround(F.expm1(e["value"]) * 100, 0).cast("int")
        size = F.concat(F.when(pct >= 0, " +").otherwise(" "), pct.cast("string"), F.lit("%"))
        return F.concat(F.coalesce(F.try_element_at(names, e["key"]), e["key"]), marked(missing, e, NO_VALUE), size, marked(denominators, e, DENOMINATOR))

    def side(sign: int, title: str) -> Column:
        one = F.filter(strong, lambda e: e["value"] * sign > 0)
        ranked = F.array_sort(F.transform(one, lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("key"), e["value"].alias("value"))))
        text = F.concat_ws(", ", F.transform(F.slice(ranked, 1, 2), show))
        return F.when(F.size(one) > 0, F.concat(F.lit(title), text))

    return F.coalesce(F.nullif(F.concat_ws(" / ", side(1, RAISED), side(-1, LOWERED)), F.lit("")), F.lit(NO_DRIVER))


def expectation_text(df: DataFrame) -> Column:
    """What the price assumes of the years ahead, next to what was delivered; '' without a multiple."""
    excess, growth, median = F.col("implied_excess_growth"), F.col("earnings_cagr_3y"), F.col("earnings_cagr_3y_median")
    pct = lambda c, form: F.format_string(form, F.bround(c * 100, 0).cast("int"))
    need = F.when(F.abs(excess) < 0.005, NEEDS_THE_SAME).otherwise(
        F.concat(F.lit(NEEDS_GROWTH), pct(F.abs(excess), "%d%%"), F.when(excess > 0, NEEDS_MORE).otherwise(NEEDS_LESS), F.lit(NEEDS_END)))
    past = F.when(growth.isNotNull() & median.isNotNull(), F.concat(F.lit(PAST_GROWTH), pct(growth, "%+d%%"), F.lit(PAST_MEDIAN), pct(median, "%+d%%")))
    past = past.when(F.col("earnings_turnaround_3y") == 1, PAST_TURN).otherwise(PAST_UNKNOWN)
    return F.when(excess.isNull(), "").otherwise(F.concat(F.lit(EXPECTATION), need, F.lit(" ("), past, F.lit(EXPECTATION_END)))


# Drivers that move a multiple through its own arithmetic.
DENOMINATORS = {
    "pe": ["return_on_equity"], "pb": ["log_book_value"], "ps": ["asset_turnover", "log_revenue"], "ev_ebitda": ["asset_turnover"],
    "pfcf": ["fcf_margin", "cash_conversion_3y", "log_revenue"], "pe_norm": ["return_on_equity"],
}


def explained(report: DataFrame, fits: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(ticker, as_of, explanation): a text per row of a screened report.

    One line per fitted multiple with actual and fair value, gap and drivers (denominator effects and missing values marked),
    the expectation in the price, the view with its two growth rates, and how many views agree; rows with a loss say that they
    are held off. A row without fits has the lines that need none.
    """
    drivers = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in DENOMINATORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("target")), F.array().cast("array<string>"))
    used = dict.fromkeys(f for t in cfg.TARGETS for f in cfg.features_of(t) if f in report.columns)
    lacking = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in used]))
    rows = report.select("ticker", "as_of", lacking.alias("lacking"))
    long = fits.select("ticker", "as_of", "target", "contrib").join(rows, ["ticker", "as_of"])
    text = long.select("ticker", "as_of", F.struct("target", drivers_text(F.col("contrib"), drivers, F.col("lacking"), labels or cfg.DRIVER_LABELS).alias("t")).alias("x"))
    texts = text.groupBy("ticker", "as_of").agg(F.map_from_entries(F.collect_list("x")).alias("texts"))  # a target each
    r = report.join(texts, ["ticker", "as_of"], "left")
    pct = lambda c: F.format_string("%+d%%", F.bround(F.expm1(c) * 100, 0).cast("int"))
    loss = F.coalesce(F.col("loss"), F.lit(False))

    def line(t: cfg.Target) -> Column:
        note = F.lit(NOT_IN_VERDICT) if not t.in_verdict else F.when(loss, OF_A_LOSS).otherwise("")
        particle = "를" if t.label.endswith(("EBITDA", "FCF")) else "을"
        head = F.format_string(t.label + MULTIPLE, F.col(t.column), F.col(f"fair_{t.key}"))
        return F.when(F.col(f"{t.key}_gap").isNotNull(), F.concat(head, pct(F.col(f"{t.key}_gap")), F.lit(")"), note, F.lit(f"{FAIR}{t.label}{particle} "), F.coalesce(F.try_element_at("texts", F.lit(t.key)), F.lit(""))))

    growth = F.format_string(GROWTH_BEYOND, F.col("realized_excess_growth") * 100, F.col("implied_excess_growth") * 100)
    view = F.when(F.col("label_detail") != "", F.concat(F.lit("→ "), F.col("valuation_view"), F.coalesce(F.when(F.col("realized_excess_growth").isNotNull() & F.col("implied_excess_growth").isNotNull(), growth), F.lit(""))))
    n, agree = F.col("n_gaps"), F.round(F.col("gap_agreement") * F.col("n_gaps"), 0).cast("int")
    side = F.when(F.col("valuation_gap") < 0, IS_CHEAP).otherwise(IS_DEAR)
    whole = F.when(loss, HELD_OFF)
    whole = whole.when(n > 1, F.concat(F.format_string(VIEWS_AGREE, n, agree, side), pct(F.col("valuation_gap")), F.lit(")")))
    whole = whole.when(n == 1, F.concat(F.lit(ONE_VIEW), F.col("valuation_basis"), F.lit(ONE_VIEW_GAP), pct(F.col("valuation_gap")), F.lit(ONE_VIEW_END)))
    lines = [line(t) for t in cfg.TARGETS if t.column in report.columns and f"{t.key}_gap" in report.columns]
    return r.select("ticker", "as_of", F.concat_ws("\n", *lines, F.nullif(expectation_text(r), F.lit("")), view, whole).alias("explanation"))


FLAGS = ["meme", "value_trap", "transition", "report_lag", "fundamental_break", "single_view"]


def flagged(report: DataFrame, most: int = 15) -> DataFrame:
    """(flag, place, n, ticker, valuation_label, reason): for each flag the `most` rows nearest to the ends of the ranking (a
    top-k of the report of one date), with the number of all of them."""
    cells = F.array(*[F.when(F.col(f"{f}_flag"), F.struct(F.lit(f).alias("flag"), F.col(f"{f}_reason").alias("reason"))) for f in FLAGS])
    far = F.coalesce(F.abs(F.col("cheapness_rank") - 50), F.lit(-1.0))
    rows = report.select("ticker", "valuation_label", far.alias("far"), F.inline(F.array_compact(cells)))
    w = Window.partitionBy("flag")
    rows = rows.withColumns({"place": F.row_number().over(w.orderBy(F.desc("far"), "ticker")), "n": F.count("*").over(w)})
    return rows.where(F.col("place") <= most).select("flag", "place", "n", "ticker", "valuation_label", "reason")


def detail_by_size(report: DataFrame) -> DataFrame:
    """Labels with their detail (without notes) by size group, and how many of them carry the notes."""
    detail = F.col("label_detail")
    for note in (ONE_OFF_NOTE, BASE_EFFECT_NOTE):
        detail = F.replace(detail, F.lit(note), F.lit(""))
    rows = report.where("label_detail <> ''").withColumn("view", F.concat_ws(" · ", "valuation_label", detail))
    has = lambda note: F.sum(F.col("label_detail").contains(note).cast("int"))
    sizes = [F.sum((F.col("size_group") == s).cast("int")).alias(s) for s in ("large", "mid", "small")]
    return rows.groupBy("view").agg(*sizes, has(ONE_OFF_NOTE).alias("one_off"), has(BASE_EFFECT_NOTE).alias("base_effect"))
