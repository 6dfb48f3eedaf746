"""Constants of the valuation model. They must be as they are for the same results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Target:
    key: str
    column: str
    least: float
    most: float
    label: str
    extra: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    in_verdict: bool = True


FIN = ("Financials",)
TARGETS = [
    Target("pe", "trailing_pe", 1.0, 100.0, "PER", ("log_book_value", "roe_avg_3y")),
    Target("pb", "price_to_book", 0.1, 20.0, "PBR", ("net_debt_to_capital", "log_book_value", "roe_avg_3y", "log_revenue", "eps_volatility_3y")),
    Target("ps", "price_to_sales", 0.05, 40.0, "PSR", ("asset_turnover", "log_revenue", "industry"), FIN),
    Target("ev_ebitda", "ev_to_ebitda", 1.0, 60.0, "EV/EBITDA", ("asset_turnover",), FIN),
    Target("pfcf", "price_to_fcf", 1.0, 100.0, "P/FCF", ("fcf_margin", "cash_conversion_3y", "log_revenue"), FIN),
    Target("pe_norm", "normalized_pe", 1.0, 100.0, "정규화 PER", ("log_book_value", "roe_avg_3y"), in_verdict=False),
]
BASE_FEATURES = ("return_on_equity", "operating_margin", "revenue_growth_yoy", "debt_to_equity", "payout_ratio_ttm", "volatility_63d", "gross_margin")
CATEGORICAL = ("industry",)
#: Features that are tried one by one and together, and what a set has to gain on train and on val to be taken.
CANDIDATES = (
    "log_revenue", "log_book_value", "op_margin_avg_3y", "roe_avg_3y", "roic", "fcf_margin", "net_debt_to_capital", "asset_turnover", "revenue_cagr_3y",
    "op_margin_volatility", "dividend_growth_3y", "dividend_years_no_cut", "eps_cagr_3y", "growth_consistency_3y", "eps_volatility_3y", "roe_volatility_3y",
    "gross_margin_volatility_3y", "loss_share_3y", "cash_conversion_3y", "roe_spike", "eps_spike", "revenue_growth_accel", "revenue_growth_ttm",
    "revenue_growth_ttm_accel", "op_margin_change_1y", "gross_margin_change_1y", "current_ratio", "sga_to_sales", "industry",
)
MIN_GAIN = 0.01
#: Names of the drivers in the report.
DRIVER_LABELS = {
    "return_on_equity": "ROE", "operating_margin": "영업이익률", "revenue_growth_yoy": "매출성장률", "debt_to_equity": "부채비율", "payout_ratio_ttm": "배당성향",
    "volatility_63d": "변동성", "roic": "ROIC", "gross_margin": "매출총이익률", "fcf_margin": "FCF이익률", "net_debt_to_capital": "순부채비율", "current_ratio": "유동비율",
    "asset_turnover": "자산회전율", "sga_to_sales": "판관비율", "revenue_cagr_3y": "3년 매출성장률", "op_margin_volatility": "이익률 변동성", "dividend_growth_3y": "3년 배당성장률",
    "dividend_years_no_cut": "배당 무삭감 연수", "op_margin_avg_3y": "3년 평균 영업이익률", "log_revenue": "매출 규모", "log_book_value": "자본 규모", "roe_avg_3y": "3년 평균 ROE",
    "eps_cagr_3y": "3년 EPS 성장률", "growth_consistency_3y": "성장 꾸준함", "eps_volatility_3y": "이익 변동성", "roe_volatility_3y": "ROE 변동성",
    "gross_margin_volatility_3y": "매출총이익률 변동성", "loss_share_3y": "적자 분기 비율", "cash_conversion_3y": "이익의 현금 전환율", "roe_spike": "ROE의 평소 대비 급등",
    "eps_spike": "이익의 평소 대비 급등", "sector": "섹터", "industry": "세부 업종",
}
PENALTIES = (0.01, 0.1, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
FOLDS, MIN_ROWS, WINSOR = 5, 50, 0.02
TRAIN_END, VAL_END = date(2019, 12, 31), date(2023, 12, 31)
HORIZONS = (1, 3, 6, 12)
CHEAP, EXPENSIVE = 80.0, 20.0
LABEL_CHEAP, LABEL_RICH, LABEL_MID, LABEL_NONE, LABEL_LOSS = "저평가", "고평가", "중립", "데이터 부족", "판단 보류(적자)"


def features_of(target: Target, drop: tuple[str, ...] = ()) -> list[str]:
    """Base features and the target's own, each once, without dropped ones."""
    return [f for f in dict.fromkeys((*BASE_FEATURES, *target.extra)) if f not in drop]
