"""How good fits are and how steady: aggregates over a table of fits (as_of, target, ticker, y, pred, gap, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators.windows import percent_rank_average
from tidemark.plans import fairvalue
from tidemark.plans.fairvalue import KEYS, split_of


def _ranked(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Average ranks of the columns within the keys (the rank correlation is the correlation of these)."""
    return df.withColumns({f"__r_{c}": percent_rank_average(F.col(c), keys) for c in columns})


def cross_sections(fits: DataFrame, baseline: DataFrame | None = None, coefs: DataFrame | None = None) -> DataFrame:
    """(as_of, target, n, r2, mae, spearman): per cross-section; r2 is NULL where y does not vary.

    With `baseline`, fits of the same rows by the sector median, its r2 and mae stand beside as r2_baseline, mae_baseline; with
    `coefs` (`fairvalue.coefficients`) the penalty and the map of coefficients of the fit on all rows.
    """
    d = _ranked(fits, KEYS, "y", "pred")
    sse, e = F.sum(F.pow(F.col("y") - F.col("pred"), 2)), F.abs(F.col("y") - F.col("pred"))
    sst = F.var_pop("y") * F.count("y")
    out = d.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.when(sst > 0, 1 - sse / sst).alias("r2"), F.avg(e).alias("mae"), F.corr("__r_y", "__r_pred").alias("spearman")
    )
    if baseline is not None:
        out = out.join(cross_sections(baseline).select(*KEYS, F.col("r2").alias("r2_baseline"), F.col("mae").alias("mae_baseline")), KEYS, "left")
    if coefs is not None:
        out = out.join(coefs.select(*KEYS, "penalty", "coef"), KEYS, "left")
    return out


def summary(sections: DataFrame) -> DataFrame:
    """Means of the measures per (target, split) and the number of dates."""
    s = sections.withColumn("split", split_of(F.col("as_of")))
    measures = [c for c in ("r2", "r2_baseline", "mae", "mae_baseline", "spearman") if c in sections.columns]
    return s.groupBy("target", "split").agg(*[F.avg(c).alias(c) for c in measures], F.count("*").alias("n_dates"))


def error_spread(fits: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Per (target, split) median and 90% quantile of exp(|gap|) - 1 over all rows (percentile_approx: bounded state; exact for
    groups below its accuracy); with `sections` the median and quartiles of r2 over dates as well."""
    s = fits.withColumns({"split": split_of(F.col("as_of")), "e": F.expm1(F.abs(F.col("gap")))})
    q = lambda p: F.percentile_approx("e", p, 10_000)
    out = s.groupBy("target", "split").agg(q(0.5).alias("error_median"), q(0.9).alias("error_p90"), F.count("*").alias("n"))
    if sections is not None:
        r2 = sections.withColumn("split", split_of(F.col("as_of"))).groupBy("target", "split").agg(*[F.percentile("r2", F.lit(p)).alias(n) for n, p in (("r2_median", 0.5), ("r2_q25", 0.25), ("r2_q75", 0.75))])
        out = out.join(r2, ["target", "split"], "left")
    return out


def agreement(seen: DataFrame) -> DataFrame:
    """(n, mean_agreement, all_agree): over rows with a verdict of more than one view."""
    rows = seen.where("valuation_gap is not null and n_gaps > 1")
    return rows.agg(F.count("*").alias("n"), F.avg("gap_agreement").alias("mean_agreement"), F.avg((F.col("gap_agreement") == 1).cast("double")).alias("all_agree"))


def coefficient_summary(coefs: DataFrame) -> DataFrame:
    """Per (target, feature): mean, median, quartiles of the coefficient over dates and the share with the mean's sign."""
    c = coefs.select("target", F.explode("coef").alias("feature", "v"))
    w = Window.partitionBy("target", "feature")
    c = c.withColumn("m", F.avg("v").over(w))
    return c.groupBy("target", "feature").agg(
        F.first("m").alias("mean"), *[F.percentile("v", F.lit(p)).alias(n) for p, n in ((0.5, "median"), (0.25, "q25"), (0.75, "q75"))],
        F.avg((F.signum("v") == F.signum("m")).cast("double")).alias("same_sign_share"), F.count("*").alias("n_dates"),
    )


def r2_by_group(fits: DataFrame, group: str, least: int = 10) -> DataFrame:
    """Per (target, split, group): mean over dates of the r2 within (as_of, group), of groups with `least` rows and
    varying y; and rows per date."""
    sst = F.var_pop("y") * F.count("y")
    g = fits.groupBy(*KEYS, group).agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(F.pow(F.col("y") - F.col("pred"), 2)), F.when(sst > 0, sst))).alias("r2"))
    g = g.where((F.col("n") >= least) & F.col("r2").isNotNull()).withColumn("split", split_of(F.col("as_of")))
    return g.groupBy("target", "split", group).agg(F.avg("r2").alias("r2"), F.avg("n").alias("rows_per_date"), F.count("*").alias("n_dates"))


def tails(gap: Column, keys: list[str]) -> Column:
    """cheap above 0.8, rich up to 0.2 of the average percent rank of -gap, else mid; NULL for a missing gap."""
    r = percent_rank_average(-gap, keys)
    return F.when(r > 0.8, "cheap").when(r <= 0.2, "rich").when(r.isNotNull(), "mid")


def stability(gaps: DataFrame, least: int = 30) -> DataFrame:
    """Per split of the later date: mean rank correlation of gaps of consecutive snapshots, and the mean shares of labels
    that changed and that went from one tail to the other; of pairs with at least `least` common tickers.

    `gaps` has as_of, ticker and gap. The snapshot before is found by an equi-join on (ticker, ordinal of the date).
    """
    g = gaps.where("gap is not null").select("as_of", "ticker", "gap", tails(F.col("gap"), ["as_of"]).alias("label"))
    dates = g.select("as_of").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("as_of")))  # one row a date
    g = g.join(dates, "as_of")
    before = g.select("ticker", (F.col("k") + 1).alias("k"), F.col("gap").alias("was"), F.col("label").alias("was_label"))
    both = _ranked(g.join(before, ["ticker", "k"]), ["as_of"], "gap", "was")
    flip = (F.col("label") != F.col("was_label")) & (F.col("label") != "mid") & (F.col("was_label") != "mid")
    per = both.groupBy("as_of").agg(
        F.count("*").alias("n"), F.corr("__r_gap", "__r_was").alias("rank_corr"), F.avg((F.col("label") != F.col("was_label")).cast("double")).alias("label_changed"),
        F.avg(flip.cast("double")).alias("cheap_rich_flip"),
    ).where(F.col("n") >= least)
    return per.withColumn("split", split_of(F.col("as_of"))).groupBy("split").agg(*[F.avg(c).alias(c) for c in ("rank_corr", "label_changed", "cheap_rich_flip")], F.count("*").alias("n_pairs"))


def top_overlap(gaps: DataFrame, a: str, b: str, tail: str = "cheap") -> DataFrame:
    """(overlap, n_dates): mean over dates of the Jaccard index of two gaps' tails; dates with both empty are skipped."""
    t = gaps.select("as_of", (tails(F.col(a), ["as_of"]) == tail).alias("a"), (tails(F.col(b), ["as_of"]) == tail).alias("b"))
    t = t.select("as_of", F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    per = t.groupBy("as_of").agg(F.sum((F.col("a") & F.col("b")).cast("int")).alias("both"), F.sum((F.col("a") | F.col("b")).cast("int")).alias("any"))
    per = per.where("any > 0")
    return per.agg(F.avg(F.col("both") / F.col("any")).alias("overlap"), F.count("*").alias("n_dates"))


def ttm_reliability(seen: DataFrame) -> DataFrame:
    """(part, n, break_share, mean_abs_pe, mean_abs_pe_norm, rank_corr): can the last twelve months be trusted?

    Over rows with a verdict, marked by fundamental_break_flag: the share of breaks in the tails of the combined gap ('cheap' up
    to 0.2 of its average rank within as_of, 'expensive' above 0.8, 'middle', 'all'); the mean |gap| of the plain and the
    normalized P/E of 'flagged' and 'not flagged' rows that have both; and the mean over dates of the rank correlation of the
    two gaps ('correlation', n is the number of dates).
    """
    v = seen.where("valuation_gap is not null")
    r = percent_rank_average(F.col("valuation_gap"), ["as_of"])
    v = v.select("as_of", "fundamental_break_flag", "pe_gap", "pe_norm_gap", r.alias("r"))
    tail = F.when(F.col("r") <= 0.2, "cheap").when(F.col("r") > 0.8, "expensive").otherwise("middle")
    none = lambda *names: [F.lit(None).cast("double").alias(n) for n in names]
    share = F.avg(F.col("fundamental_break_flag").cast("double")).alias("break_share")
    one = v.select(F.explode(F.array(tail, F.lit("all"))).alias("part"), "fundamental_break_flag").groupBy("part").agg(F.count("*").alias("n"), share, *[x.alias(n) for x, n in ((F.max(F.lit(None).cast("double")), "mean_abs_pe"), (F.max(F.lit(None).cast("double")), "mean_abs_pe_norm"), (F.max(F.lit(None).cast("double")), "rank_corr"))])
    both = v.where("pe_gap is not null and pe_norm_gap is not null")
    part = F.when(F.col("fundamental_break_flag"), "flagged").otherwise("not flagged")
    two = both.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.avg(F.abs("pe_gap")).alias("mean_abs_pe"), F.avg(F.abs("pe_norm_gap")).alias("mean_abs_pe_norm"))
    two = two.select("part", "n", *none("break_share"), "mean_abs_pe", "mean_abs_pe_norm", *none("rank_corr"))
    per = _ranked(both, ["as_of"], "pe_gap", "pe_norm_gap").groupBy("as_of").agg(F.corr("__r_pe_gap", "__r_pe_norm_gap").alias("c"))
    three = per.agg(F.count("c").alias("n"), F.avg("c").alias("rank_corr")).select(F.lit("correlation").alias("part"), "n", *none("break_share", "mean_abs_pe", "mean_abs_pe_norm"), "rank_corr")
    return one.unionByName(two).unionByName(three)


def compare_sets(results: dict[str, DataFrame], baseline: str) -> DataFrame:
    """(target, split, set_name, r2, delta): mean r2 of each set's fits and its distance from the baseline set."""
    every = None
    for name, fits in results.items():
        s = summary(cross_sections(fits)).select("target", "split", F.lit(name).alias("set_name"), "r2")
        every = s if every is None else every.unionByName(s)
    base = F.max(F.when(F.col("set_name") == baseline, F.col("r2"))).over(Window.partitionBy("target", "split"))
    return every.withColumn("delta", F.col("r2") - base)


def adopted(compared: DataFrame, bar: float = 0.01) -> DataFrame:
    """(set_name, target, train, val, meets_bar): a '+' set meets the bar if it gains that much on train and on val, a '-' set
    (a feature left out) if it loses that much on both."""
    of = lambda s: F.max(F.when(F.col("split") == s, F.col("delta"))).alias(s)
    d = compared.groupBy("set_name", "target").agg(of("train"), of("val"))
    sign = F.when(F.col("set_name").startswith("-"), -1.0).otherwise(1.0)
    return d.withColumn("meets_bar", F.coalesce((F.least(F.col("train") * sign, F.col("val") * sign) >= bar) & F.col("train").isNotNull() & F.col("val").isNotNull(), F.lit(False)))


def feature_sets(panel: DataFrame, min_rows: int, candidates: Sequence[str] = cfg.CANDIDATES, drop_check: bool = False) -> dict[str, DataFrame]:
    """Fits by set name: the features in use ('current'), with each candidate that the panel has ('+name') and all of them
    ('+all'), the other transform ('winsor'), the sector median, and with `drop_check` without each feature in use ('-name')."""
    one = lambda **k: fairvalue.fit(panel, min_rows=min_rows, contributions=False, **k)
    more = lambda *names: {t.key: list(dict.fromkeys([*cfg.features_of(t), *names])) for t in cfg.TARGETS}
    here = [c for c in candidates if c in panel.columns]
    sets = {"current": one(), **{f"+{c}": one(features=more(c)) for c in here}}
    if drop_check:
        sets |= {f"-{f}": one(drop=(f,)) for f in dict.fromkeys(f for t in cfg.TARGETS for f in cfg.features_of(t) if f in panel.columns)}
    base = fairvalue.sector_baseline(fairvalue.eligible(panel, min_rows=min_rows))
    return sets | {"+all": one(features=more(*here)), "winsor": one(transform="winsor"), "sector_median": base.withColumn("gap", F.col("y") - F.col("pred"))}
