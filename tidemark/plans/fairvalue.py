"""Fair multiples: for each snapshot and target a ridge on ranked fundamentals, predicted out of fold.

The panel is made long, one row per eligible (as_of, target, ticker); each (as_of, target) is a cross-section of the
universe, which fits in a task, and is fitted by one grouped Arrow call. Everything else is joins-free SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions.columns import ensure_columns
from tidemark.functions.stats import average_ranks, ridge_loo
from tidemark.operators.windows import mean_of

KEYS = ["as_of", "target"]


def split_of(day: Column) -> Column:
    """train, val or test by the snapshot's date."""
    return F.when(day <= F.lit(cfg.TRAIN_END), "train").when(day <= F.lit(cfg.VAL_END), "val").otherwise("test")


def loss_flag(df: DataFrame) -> Column:
    """True where the P/E is missing or not above 0 and a loss shows in eps, return on equity or eps_ttm."""
    have = lambda c, cond: cond if c in df.columns else F.lit(False)
    no_pe = F.coalesce(~(F.col("trailing_pe") > 0), F.lit(True))
    loss = [have("eps", F.col("eps") <= 0), have("return_on_equity", F.col("return_on_equity") < 0), have("eps_ttm", F.col("eps_ttm") <= 0)]
    some = F.lit(False)
    for x in loss:
        some = some | F.coalesce(x, F.lit(False))
    return no_pe & some


def eligible(panel: DataFrame, targets: Sequence[cfg.Target] = cfg.TARGETS, min_rows: int = cfg.MIN_ROWS, features: Sequence[str] | None = None) -> DataFrame:
    """One row per (as_of, target, ticker) whose multiple is within the target's bounds and sector is not excluded, of
    cross-sections with at least `min_rows` of them; y is the log of the multiple. Targets whose column the panel lacks
    are skipped."""
    rows = []
    for t in targets:
        if t.column in panel.columns:
            ok = F.col(t.column).between(t.least, t.most)
            if t.without:
                ok = ok & ~F.coalesce(F.col("sector").isin(*t.without), F.lit(False))
            rows.append(F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(t.key).alias("target"), F.ln(t.column).alias("y"))))
    used = dict.fromkeys(f for f in (features if features is not None else [f for t in targets for f in cfg.features_of(t)]) if f in panel.columns)
    keep = ["as_of", "ticker", *[c for c in ("sector", "industry", "size_group") if c in panel.columns and c not in used], *used]
    long = panel.select(*keep, F.inline(F.array_compact(F.array(*rows))))
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    return long.withColumn("__n", n).where(F.col("__n") >= min_rows).drop("__n")


def fold_of(folds: int = cfg.FOLDS) -> Column:
    """Fold of each ticker in its cross-section: its place in descending order of tickers, modulo the folds."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("ticker"))
    return (F.dense_rank().over(w) - 1) % folds


def sector_baseline(long: DataFrame, folds: int = cfg.FOLDS) -> DataFrame:
    """`long` with fold and pred: the median y of the sector over the other folds, else of all rows of the other folds.

    Medians come from one aggregate per (as_of, target, sector, left-out fold): each row counts in the other folds.
    """
    f = long.withColumn("fold", fold_of(folds))
    others = f.select(*KEYS, "sector", "y", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))).alias("out"))
    by_sector = others.groupBy(*KEYS, "sector", "out").agg(F.percentile("y", F.lit(0.5)).alias("m"))
    by_all = others.groupBy(*KEYS, "out").agg(F.percentile("y", F.lit(0.5)).alias("m_all"))
    same = lambda d, *k: d.withColumnsRenamed({x: f"__{x}" for x in k})
    j = f.join(same(by_sector, *KEYS, "sector", "out"), [*(F.col(k) == F.col(f"__{k}") for k in (*KEYS, "sector")), F.col("fold") == F.col("__out")], "left").drop(*(f"__{k}" for k in (*KEYS, "sector", "out")))
    j = j.join(same(by_all, *KEYS, "out"), [*(F.col(k) == F.col(f"__{k}") for k in KEYS), F.col("fold") == F.col("__out")], "left").drop(*(f"__{k}" for k in (*KEYS, "out")))
    return j.withColumn("pred", F.coalesce("m", "m_all")).drop("m", "m_all")


def rank_transform(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each feature as its average rank / number of present values in the cross-section (the model's transform)."""
    from tidemark.operators.windows import percent_rank_average

    return long.withColumns({f: percent_rank_average(F.col(f), KEYS) for f in features})


def winsor_transform(long: DataFrame, features: Sequence[str], q: float = cfg.WINSOR) -> DataFrame:
    """Each feature clipped to its [q, 1 - q] quantiles in the cross-section, where three values are present."""
    w = Window.partitionBy(*KEYS)
    out = {}
    for f in features:
        lo, hi = F.percentile(f, F.lit(q)).over(w), F.percentile(f, F.lit(1 - q)).over(w)
        out[f] = F.when(F.count(f).over(w) >= 3, F.least(F.greatest(F.col(f), lo), hi) + 0 * F.col(f)).otherwise(F.col(f))
    return long.withColumns(out)


def design(g: pd.DataFrame, features: Sequence[str], transform: str, sectors: bool = True) -> tuple[np.ndarray, list[str], list[str]]:
    """Matrix of a cross-section, the name of each column and the driver that it belongs to.

    Numbers are ranked or clipped, then filled by the median (0 if all are missing) with a column that marks the filled;
    industry and sector become one column per level.
    """
    cols, names, drivers = [], [], []
    for f in features:
        if f not in g.columns:
            continue
        if f in cfg.CATEGORICAL:
            for level in sorted(g[f].dropna().unique()):
                cols.append((g[f] == level).to_numpy(float))
                names.append(f"{f}_{level}")
                drivers.append(f)
            continue
        x = g[f].to_numpy(float)
        ok = np.isfinite(x)
        if transform == "rank":
            x = average_ranks(x) / max(1, ok.sum())
        elif ok.sum() >= 3:
            x = np.clip(x, *np.quantile(x[ok], [cfg.WINSOR, 1 - cfg.WINSOR]))
        cols.append(np.where(ok, x, np.median(x[ok]) if ok.any() else 0.0))
        names.append(f)
        drivers.append(f)
        if not ok.all():
            cols.append((~ok).astype(float))
            names.append(f"{f}_na")
            drivers.append(f)
    for level in sorted(g["sector"].dropna().unique()) if sectors else ():
        cols.append((g["sector"] == level).to_numpy(float))
        names.append(f"sector_{level}")
        drivers.append("sector")
    return np.column_stack(cols) if cols else np.zeros((len(g), 0)), names, drivers


def _standardised(train: np.ndarray, x: np.ndarray) -> np.ndarray:
    scale = train.std(axis=0)
    return (x - train.mean(axis=0)) / np.where(scale == 0, 1.0, scale)


def fit(
    panel: DataFrame, targets: Sequence[cfg.Target] = cfg.TARGETS, *, min_rows: int = cfg.MIN_ROWS, transform: str = "rank",
    features: dict[str, Sequence[str]] | None = None, drop: tuple[str, ...] = (), contributions: bool = True,
    penalties: Sequence[float] = cfg.PENALTIES, sectors: bool = True,
) -> DataFrame:
    """(as_of, target, ticker, sector, size_group, fold, y, pred, gap, fair, contrib): out-of-fold fair multiples.

    gap = y - pred, fair = exp(pred), contrib maps each driver to its part of pred. `features` names other features per
    target key; features the panel lacks are skipped. Of `penalties` the one with the smallest leave-one-out error is taken;
    without `sectors` these have no columns of their own. Rows that are not eligible have no row here.
    """
    chosen = {t.key: list((features or {}).get(t.key) or cfg.features_of(t, drop)) for t in targets}
    used = dict.fromkeys(f for t in targets for f in chosen[t.key])
    long = ensure_columns(eligible(panel, targets, min_rows, tuple(used)), {"size_group": "string"}).withColumn("fold", fold_of())

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ticker", ignore_index=True)
        x, _, drivers = design(g, chosen[g["target"].iloc[0]], transform, sectors)
        y, fold = g["y"].to_numpy(float), g["fold"].to_numpy()
        pred = np.full(len(g), np.nan)
        parts: list[dict | None] = [None] * len(g)
        order = list(dict.fromkeys(drivers))
        member = np.array([[d == o for o in order] for d in drivers], dtype=float).reshape(len(drivers), len(order))
        for k in np.unique(fold):
            train, held = fold != k, fold == k
            coef, intercept, _ = ridge_loo(_standardised(x[train], x[train]), y[train], penalties)
            terms = _standardised(x[train], x[held]) * coef
            pred[held] = intercept + terms.sum(axis=1)
            if contributions:
                for i, row in zip(np.flatnonzero(held), terms @ member, strict=True):
                    parts[i] = dict(zip(order, row.tolist(), strict=True))
        out = g[["as_of", "target", "ticker", "sector", "size_group", "fold", "y"]].copy()
        out["pred"], out["gap"], out["fair"], out["contrib"] = pred, y - pred, np.exp(pred), parts
        return out

    schema = f"as_of {long.schema['as_of'].dataType.simpleString()}, target string, ticker string, sector string, size_group string, fold int, y double, pred double, gap double, fair double, contrib map<string,double>"
    return long.groupBy(*KEYS).applyInPandas(work, schema)


def coefficients(panel: DataFrame, targets: Sequence[cfg.Target] = cfg.TARGETS, *, min_rows: int = cfg.MIN_ROWS, transform: str = "rank") -> DataFrame:
    """(as_of, target, n, penalty, coef): the fit on all rows of a cross-section; coef maps features to standardised
    coefficients."""
    chosen = {t.key: cfg.features_of(t) for t in targets}
    long = eligible(panel, targets, min_rows)

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ticker", ignore_index=True)
        x, names, _ = design(g, chosen[g["target"].iloc[0]], transform)
        coef, _, a = ridge_loo(_standardised(x, x), g["y"].to_numpy(float), cfg.PENALTIES)
        kept = {n: float(c) for n, c in zip(names, coef, strict=True) if n in chosen[g["target"].iloc[0]]}
        return pd.DataFrame({"as_of": g["as_of"].iloc[:1], "target": g["target"].iloc[:1], "n": [len(g)], "penalty": [a], "coef": [kept]})

    kind = long.schema["as_of"].dataType.simpleString()
    return long.groupBy(*KEYS).applyInPandas(work, f"as_of {kind}, target string, n int, penalty double, coef map<string,double>")


def verdict(panel: DataFrame, fits: DataFrame, targets: Sequence[cfg.Target] = cfg.TARGETS) -> DataFrame:
    """`panel` with <target>_gap, fair_<target>, valuation_gap, n_gaps, gap_agreement and valuation_basis.

    valuation_gap is the mean of the present gaps of the targets in the verdict, none for rows with a loss; agreement is
    the share of them with its sign (a gap of 0 agrees with 0 only); the basis joins their labels by '+'.
    """
    keys = [t.key for t in targets]
    g = fits.groupBy("as_of", "ticker").pivot("target", keys).agg(F.first("gap").alias("gap"), F.first("pred").alias("pred"))
    g = g.select("as_of", "ticker", *[F.col(f"{k}_gap") for k in keys], *[F.exp(f"{k}_pred").alias(f"fair_{k}") for k in keys])
    clash = [c for c in g.columns if c in panel.columns and c not in ("as_of", "ticker")]
    p = panel.drop(*clash).join(g, ["as_of", "ticker"], "left").withColumn("loss", loss_flag(panel))
    used = [(t, F.when(~F.col("loss"), F.col(f"{t.key}_gap"))) for t in targets if t.in_verdict]
    p = p.withColumns({"valuation_gap": mean_of([x for _, x in used]), "n_gaps": sum((x.isNotNull().cast("int") for _, x in used), F.lit(0))})
    agree = sum((F.coalesce((F.signum(x) == F.signum("valuation_gap")).cast("int"), F.lit(0)) for _, x in used), F.lit(0))
    return p.withColumns({
        "gap_agreement": F.when(F.col("n_gaps") > 0, agree / F.col("n_gaps")),
        "valuation_basis": F.concat_ws("+", *[F.when(x.isNotNull(), F.lit(t.label)) for t, x in used]),
    })
