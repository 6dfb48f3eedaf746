"""Yield, growth and reliability of dividends at a date, from the payments with an ex-date up to it.

A ticker's payments are one array (no more of them than days with one), joined once by ticker; all else is array
functions in the JVM, the clock since the last cut a fold with a struct state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import median_of

STOPPED_DAYS, RECENT_DAYS, THREE_YEARS, CAP_YEARS, CUT = 400, 730, 1095, 25.0, 0.95


def _tail(a: Column, n: Column) -> Column:
    """The last n elements, all of them if there are fewer."""
    k = F.least(n, F.size(a))
    return F.when(k > 0, F.slice(a, F.size(a) - k + 1, k)).otherwise(F.slice(a, 1, 0))


def payments(daily: DataFrame) -> DataFrame:
    """(ticker, paid): the payments above 0 by date."""
    p = daily.where("dividend > 0").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", F.col("dividend").alias("amount")))).alias("paid"))
    return p


def since_last_cut(paid: Column) -> Column:
    """Date of the last cut, else of the first payment. A cut is a payment below 95% of the median of the four before
    it, at least four payments after the cut before."""
    start = F.struct(F.get(paid["date"], F.lit(0)).alias("since"), F.lit(-4).alias("last"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        before = F.slice(paid["amount"], s["i"] - 3, 4)
        cut = (s["i"] >= 4) & (s["i"] - s["last"] >= 4)
        cut = F.when(cut, x["amount"] < CUT * median_of(before)).otherwise(F.lit(False))
        return F.struct(
            F.when(cut, x["date"]).otherwise(s["since"]).alias("since"), F.when(cut, s["i"]).otherwise(s["last"]).alias("last"), (s["i"] + 1).alias("i")
        )

    # slice() wants a start above 0: the first four payments are folded without looking back.
    def guarded(s: Column, x: Column) -> Column:
        return F.when(s["i"] < 4, F.struct(s["since"].alias("since"), s["last"].alias("last"), (s["i"] + 1).alias("i"))).otherwise(step(s, x))

    return F.aggregate(paid, start, guarded, lambda s: s["since"])


def dividend_features(snapshots: DataFrame, daily: DataFrame, price: str = "price") -> DataFrame:
    """`snapshots` (ticker, as_of, price) with dividend_yield, dividend_growth_3y and dividend_years_no_cut.

    A company without a payment in the 400 days up to as_of, or without a price above 0, is a non-payer: yield 0, growth
    NULL, years 0. The yearly number of payments comes from the median gap of the last two years (rounded half to even,
    1 to 12; 1 if there is no gap or it is 0).
    """
    s = snapshots.join(payments(daily).withColumnRenamed("ticker", "__t"), F.col("ticker") == F.col("__t"), "left").drop("__t")
    c = F.col
    s = s.withColumn("__past", F.filter("paid", lambda x: x["date"] <= c("as_of")))
    last = F.get(c("__past")["date"], F.size("__past") - 1)
    pays = F.coalesce((F.size("__past") > 0) & (F.datediff("as_of", last) <= STOPPED_DAYS) & (c(price) > 0), F.lit(False))
    recent = F.filter("__past", lambda x: x["date"] > F.date_sub(c("as_of"), RECENT_DAYS))
    s = s.withColumns({"__pays": pays, "__recent": F.transform(recent, lambda x: F.unix_date(x["date"]))})
    gaps = F.transform(F.slice("__recent", 2, F.greatest(F.size("__recent") - 1, F.lit(0))), lambda d, i: (d - F.get(c("__recent"), i)).cast("double"))
    freq = F.least(F.greatest(F.coalesce(F.bround(F.try_divide(F.lit(365.0), median_of(gaps)), 0), F.lit(1.0)), F.lit(1.0)), F.lit(12.0)).cast("int")
    then = F.filter("__past", lambda x: x["date"] <= F.date_sub(c("as_of"), THREE_YEARS))
    s = s.withColumns({"__freq": F.when(F.size("__recent") > 1, freq).otherwise(1), "__then": then})
    now_amount, then_amount = median_of(_tail(c("__past")["amount"], F.lit(4))), median_of(_tail(c("__then")["amount"], F.lit(4)))
    growth = F.when((F.size("__then") >= 4) & (now_amount > 0) & (then_amount > 0), F.pow(now_amount / then_amount, F.lit(1.0 / 3)) - 1)
    yearly = median_of(_tail(c("__past")["amount"], c("__freq"))) * c("__freq")
    years = F.least(F.lit(CAP_YEARS), F.datediff("as_of", since_last_cut(c("__past"))) / 365.25)
    new = {
        "dividend_yield": F.when(c("__pays"), yearly / c(price)).otherwise(0.0),
        "dividend_growth_3y": F.when(c("__pays"), growth),
        "dividend_years_no_cut": F.when(c("__pays"), years).otherwise(0.0),
    }
    return s.select(*[x for x in snapshots.columns if x not in new], *[v.alias(k) for k, v in new.items()])
