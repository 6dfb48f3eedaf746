"""Do gaps say anything about later returns: rank correlation and quintile spread per date, robust tests, and control of
the false discovery rate over the whole table."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as cfg
from tidemark.functions.stats import mean_test
from tidemark.operators.windows import percent_rank_average, quantile_bucket
from tidemark.plans.fairvalue import split_of


def long_returns(rows: DataFrame, horizons: Sequence[int] = cfg.HORIZONS, by: str | None = None) -> DataFrame:
    """(grp, as_of, ticker, horizon, signal, ret): present pairs of -gap and return; grp is 'all' and, with `by`, each
    group again."""
    r = rows.select("as_of", "ticker", (-F.col("gap")).alias("signal"), *([F.col(by).alias("g")] if by else []), F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_return_{h}m").alias("ret")) for h in horizons])))
    r = r.where("signal is not null and ret is not null")
    groups = F.array_distinct(F.array_compact(F.array(F.lit("all"), F.col("g")))) if by else F.array(F.lit("all"))
    return r.select(F.explode(groups).alias("grp"), "as_of", "ticker", "horizon", "signal", "ret")


def per_date(pairs: DataFrame, buckets: int = 5) -> DataFrame:
    """(grp, horizon, as_of, n, ic, spread): rank correlation of signal and return, and mean return of the top bucket
    less that of the bottom one; dates with fewer than 5 * buckets rows are skipped."""
    keys = ["grp", "horizon", "as_of"]
    p = pairs.withColumns({
        "rs": percent_rank_average(F.col("signal"), keys), "rr": percent_rank_average(F.col("ret"), keys),
        "q": quantile_bucket(keys, [F.col("signal"), F.col("ticker")], buckets), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
    }).where(F.col("n") >= 5 * buckets)
    top, low = F.avg(F.when(F.col("q") == buckets - 1, F.col("ret"))), F.avg(F.when(F.col("q") == 0, F.col("ret")))
    return p.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rs", "rr").alias("ic"), (top - low).alias("spread"))


def lags_of(months: int) -> int:
    """Autocovariance lags for overlapping returns at quarterly snapshots."""
    return max(0, math.ceil(months / 3) - 1)


def tests(dates: DataFrame, least: int = 4) -> DataFrame:
    """(grp, split, horizon, test, n_dates, mean, t_stat, p_value): of series with at least `least` dates. A series is
    one number per date, ordered; it is tested in one Arrow call over all series."""
    x = dates.withColumn("split", split_of(F.col("as_of"))).select("grp", "split", "horizon", "as_of", F.inline(F.array(*[F.struct(F.lit(k).alias("test"), F.col(k).alias("v")) for k in ("ic", "spread")])))
    x = x.where("v is not null").groupBy("grp", "split", "horizon", "test").agg(F.array_sort(F.collect_list(F.struct("as_of", "v"))).alias("s"))
    x = x.where(F.size("s") >= least).select("grp", "split", "horizon", "test", F.size("s").alias("n_dates"), F.col("s.v").alias("v"))

    @F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("mean", "t_stat", "p_value")]))
    def run(v: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mean_test(list(s), lags_of(int(m))) for s, m in zip(v, h, strict=True)], columns=["mean", "t_stat", "p_value"])

    return x.withColumn("r", run("v", "horizon")).select("grp", "split", "horizon", "test", "n_dates", "r.mean", "r.t_stat", "r.p_value")


def with_fdr(table: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """`table` with p_value_fdr (Benjamini-Hochberg over all its rows with a p) and significant_after_fdr.

    The table has one row per test, so one ordered window over it is small.
    """
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    t = table.withColumn("__p", F.when(ok, F.col(p)))
    w = Window.orderBy(F.col("__p").asc_nulls_last())
    m = F.count("__p").over(Window.partitionBy())
    # Equal p values share the highest rank among them: the running minimum from the largest p down sees it first.
    t = t.withColumn("__s", F.col("__p") * m / F.row_number().over(w))
    back = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("p_value_fdr", F.when(F.col("__p").isNotNull(), F.least(F.lit(1.0), F.min("__s").over(back))))
    return t.withColumn("significant_after_fdr", F.coalesce(F.col("p_value_fdr") <= alpha, F.lit(False))).drop("__p", "__s")


def gap_return_test(rows: DataFrame, by: str | None = None, horizons: Sequence[int] = cfg.HORIZONS) -> DataFrame:
    """The whole test table: per group, split, horizon and test the mean, its t and p, and the rate-controlled p."""
    out = with_fdr(tests(per_date(long_returns(rows, horizons, by))))
    place = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return out.orderBy("grp", place, "horizon", "test")
