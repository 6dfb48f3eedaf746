"""Command line: build, evaluate, compare-features, screen and verify-multiples over a directory of parquet tables."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.plans import diagnostics, fairvalue, hypothesis, labels, panel, report
from tidemark.session import session
from tidemark.sources.ingest import compare_with_reference, write_panel, write_report
from tidemark.sources.tables import cut, read, release

#: Columns of the report, in order.
REPORT = [
    "ticker", "sector", "size_group", "as_of", "valuation_label", "label_detail", "valuation_view", "cheapness_rank", "valuation_gap_pct", "valuation_basis", "n_gaps", "gap_agreement",
    *[c for t in cfg.TARGETS for c in (t.column, f"fair_{t.key}")], *[f"{t.key}_gap" for t in cfg.TARGETS], "dividend_yield", "dividend_years_no_cut",
    "implied_excess_growth", "realized_excess_growth", "earnings_cagr_3y", "earnings_cagr_3y_median", "earnings_turnaround_3y", "sector_valuation_rank", "quality_score", "momentum_score",
    "loss", *[f"{f}_flag" for f in report.FLAGS], "transition_type", "price_move_since_report", *[f"{f}_reason" for f in report.FLAGS],
]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--data", required=True, help="directory of the parquet tables")
    p.add_argument("--panel", default="panel_built", help="where the built panel lies")
    p.add_argument("--min-rows", type=int, default=cfg.MIN_ROWS)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--start", type=date.fromisoformat, default=date(2004, 1, 1))
    b.add_argument("--today", type=date.fromisoformat, default=date.today())
    sub.add_parser("evaluate")
    c = sub.add_parser("compare-features")
    c.add_argument("--drop-check", action="store_true")
    s = sub.add_parser("screen")
    s.add_argument("--as-of")
    s.add_argument("--ticker")
    s.add_argument("--csv")
    v = sub.add_parser("verify-multiples")
    v.add_argument("--reference", required=True)
    v.add_argument("--column", default="trailing_pe")
    return p


def evaluate(p: DataFrame, fits: DataFrame, seen: DataFrame, min_rows: int) -> None:
    """Prints how good the model is beside its baseline, how steady, whether its views agree, and what followed."""
    base = fairvalue.sector_baseline(fairvalue.eligible(p, min_rows=min_rows)).withColumn("gap", F.col("y") - F.col("pred"))
    coefs = fairvalue.coefficients(p, min_rows=min_rows)
    sections = cut(diagnostics.cross_sections(fits, base, coefs))
    diagnostics.summary(sections).orderBy("target", "split").show(50)
    diagnostics.error_spread(fits, sections).orderBy("target", "split").show(50)
    diagnostics.agreement(seen).show()
    diagnostics.coefficient_summary(coefs).orderBy("target", "feature").show(200)
    diagnostics.ttm_reliability(labels.flag_break(seen)).show()
    diagnostics.stability(seen.select("as_of", "ticker", F.col("valuation_gap").alias("gap"))).show()
    diagnostics.r2_by_group(fits, "size_group").orderBy("target", "split", "size_group").show(100)
    hypothesis.gap_return_test(seen.withColumn("gap", F.col("valuation_gap")), by="size_group").show(100)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "build":
        t = lambda n: read(spark, a.data, n)
        p = panel.raw_panel(t("prices"), t("fundamentals"), t("fiscal_year_ends"), t("universe"), a.start, a.today)
        write_panel(panel.scores(panel.add_percentiles(p)), a.panel)
        return 0
    p = spark.read.parquet(a.panel)
    if a.command == "verify-multiples":
        compare_with_reference(p, spark.read.parquet(a.reference), a.column).orderBy("ticker").show(50)
    elif a.command == "compare-features":
        compared = cut(diagnostics.compare_sets(diagnostics.feature_sets(p, a.min_rows, drop_check=a.drop_check), "current"))
        compared.orderBy("target", "split", "set_name").show(1000, truncate=False)
        diagnostics.adopted(compared, cfg.MIN_GAIN).orderBy("set_name", "target").show(500, truncate=False)
    else:
        fits = cut(fairvalue.fit(p, min_rows=a.min_rows))
        seen = fairvalue.verdict(p, fits)
        if a.command == "evaluate":
            evaluate(p, fits, seen, a.min_rows)
        else:
            screened = cut(labels.screened(seen))
            r = report.report_at(screened, REPORT, a.as_of)
            if a.ticker:
                print(report.of_ticker(r, a.ticker))
                one = screened.where((F.col("ticker") == a.ticker.upper()) & (F.col("as_of") == (F.lit(a.as_of).cast("date") if a.as_of else screened.agg(F.max("as_of")).scalar())))
                report.explained(one, fits).show(1, truncate=False)
            else:
                for part in report.extremes(r):
                    part.show(15, truncate=False)
                report.crosstab(r, "size_group", "valuation_label", [cfg.LABEL_CHEAP, cfg.LABEL_MID, cfg.LABEL_RICH]).show()
                report.detail_by_size(r).show(50, truncate=False)
                report.flagged(r).orderBy("flag", "place").show(100, truncate=False)
                if a.csv:
                    write_report(r, a.csv)
    release()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
