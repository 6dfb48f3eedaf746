"""Column profiles of loads, character-class masks of values, and the loads that depart from others of their feed.

All aggregates have bounded state and combine before the shuffle, so a load, a column or a value that holds a third of
all rows is no single task. Counts, ranges and quantiles (percentile_approx, exact for loads of fewer rows than its
accuracy) come from one aggregate of the wide rows; distinct values, decimals and masks from one row per load, column and
value, so a mask is made once for each distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import cut

ACCURACY = 10_000
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@dataclass(frozen=True)
class DriftRule:
    """When a load's masks depart from those of the feed's other loads.

    least_rows: smaller loads are not judged. divergence: Jensen-Shannon divergence (bits), beyond what a load of its size
    has by chance and beyond the feed's median, from which a load departs; sampling: added to it, divided by the rows of the
    load, as the chance part of small loads varies more; spread: the excess is also to be this many robust deviations of
    the feed's loads.

    second_*: the second signal, plain statistics. deviations: distance of a share, a level, a spread or a range from the
    feed's median in robust or sampling deviations; share: difference of the share of distinct, most frequent or zero
    values; decimals: difference of the mean number of decimals.
    """

    least_rows: int = 10
    divergence: float = 0.05
    sampling: float = 3.0
    spread: float = 3.0
    second_deviations: float = 6.0
    second_share: float = 0.2
    second_decimals: float = 0.4


def number_text(c: Column) -> Column:
    """A finite number in plain decimals, at most ten of them, without exponent and closing zeros; NULL for others and from
    10**28 on."""
    fin = F.when(F.abs(c) < float("inf"), c)
    short, exact = fin.cast("string"), fin.try_cast("decimal(38,10)").cast("string")
    plain = (F.instr(short, "E") == 0) & (F.length(short) - F.instr(short, ".") <= 10)
    text = F.when(plain, short).otherwise(exact)
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def _digits_mask(text: Column, rest: Column | None = None) -> Column:
    """Mask of a plain number: sign, point and leading zeros stay; the first significant digit becomes 1 (1), 4 (2 to 4) or 9
    (5 to 9), a third of the orders of magnitude each; the other digits become 9. `rest` is the text from that digit on."""
    t = F.ltrim(text, F.lit("-"))
    rest = F.ltrim(t, F.lit("0.")) if rest is None else rest
    head = F.left(t, F.length(t) - F.length(rest))
    first = F.translate(F.left(rest, F.lit(1)), "2345678", "4449999")
    more = F.translate(F.right(rest, F.length(rest) - 1), "012345678", "999999999")
    sign = F.when(F.left(text, F.lit(1)) == "-", "-").otherwise("")
    return F.when(rest == "", "0").otherwise(F.concat(sign, head, first, more))


def number_mask(c: Column) -> Column:
    """Character-class mask of a double, so that sign, size and precision show; NaN gives nan, infinities inf and -inf,
    numbers from 10**28 on huge."""
    odd = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(odd, _digits_mask(number_text(c)), F.when(c.isNotNull(), "huge"), F.lit("null"))


def text_mask(c: Column) -> Column:
    """Runs of capitals, other letters and digits become A, a and 9; all else stays. NULL gives null."""
    for pattern, to in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a"), (r"\p{Nd}+", "9")):
        c = F.regexp_replace(c, pattern, to)
    return F.coalesce(c, F.lit("null"))


def value_mask(c: Column, kind: T.DataType) -> Column:
    """Mask of a value by its type; of dates, times and the like every digit becomes 9."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_mask(c.cast("double"))
    if isinstance(kind, T.StringType):
        return text_mask(c)
    if isinstance(kind, T.NumericType):
        return F.coalesce(_digits_mask(c.cast("string")), F.lit("null"))
    return F.coalesce(F.translate(c.cast("string"), "012345678", "999999999"), F.lit("null"))


def _value_counts(df: DataFrame, group: str | None, columns: Sequence[str]) -> DataFrame:
    """([__g,] __c, v, s, n): how often each value of each column (by number) occurs in the group. Doubles are in v, all else
    is text in s, both NULL for NULL. Repeated values combine before the shuffle."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = []
    for i, name in enumerate(columns):
        c, none = F.col(f"`{name}`"), F.lit(None)
        v, s = (c.cast("double"), none.cast("string")) if _is_float(kinds[name]) else (none.cast("double"), c.cast("string"))
        cells.append(F.struct(F.lit(i).cast("smallint").alias("__c"), v.alias("v"), s.alias("s")))
    keys = [] if group is None else [F.col(f"`{group}`").alias("__g")]
    return df.select(*keys, F.inline(F.array(*cells))).groupBy(*([] if group is None else ["__g"]), "__c", "v", "s").agg(F.count("*").alias("n"))


def _is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _with_text(values: DataFrame) -> DataFrame:
    """`_value_counts` with text: s, or the number in v; a column of its own, so that it is made once for all that reads it."""
    return values.withColumn("text", F.coalesce("s", number_text(F.col("v"))))


def _with_mask(values: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`_value_counts` with the mask of each value by the type of its column."""
    kinds = {f.name: f.dataType for f in df.schema}
    some = lambda kind: [i for i, c in enumerate(columns) if isinstance(kinds[c], kind)]
    at, v, text = F.col("__c"), F.col("v"), F.col("text")
    values = _with_text(values).withColumn("rest", F.ltrim(F.ltrim(text, F.lit("-")), F.lit("0.")))
    mask = F.when(v.isNull() & text.isNull(), "null")
    if some(T.NumericType):
        odd = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise("huge")
        mask = mask.when(at.isin(*some(T.NumericType)), F.coalesce(_digits_mask(text, F.col("rest")), odd))
    if some(T.StringType):
        mask = mask.when(at.isin(*some(T.StringType)), text_mask(text))
    return values.withColumn("mask", mask.otherwise(F.translate(text, "012345678", "999999999"))).drop("text", "rest")


def _named(df: DataFrame, group: str | None, columns: Sequence[str]) -> DataFrame:
    """__g and __c back to the group's name and the column's name, in front."""
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("__c")).alias("column_name")
    lead = [name] if group is None else [F.col("__g").alias(group), name]
    return df.select(*lead, *[c for c in df.columns if c not in ("__g", "__c")])


def _ranges(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(__g, __c, n_rows, n_null, ...): what needs no distinct values, of all columns in one aggregate of the wide rows."""
    kinds = {f.name: f.dataType for f in df.schema}
    n = lambda c: F.sum(F.coalesce(c.cast("bigint"), F.lit(0)))
    types = {"n_null": "bigint", "n_nan": "bigint", "min_value": "double", "max_value": "double", "mean_value": "double", "q": "array<double>", "n_negative": "bigint", "n_zero": "bigint", "n_infinite": "bigint"}
    aggs, cells = [F.count("*").alias("__rows")], []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        stats = {"n_null": n(c.isNull())}
        if isinstance(kinds[name], T.NumericType):
            d = c.cast("double")
            v, fin = F.when(~F.isnan(d), d), F.when(F.abs(d) < float("inf"), d)
            stats |= {
                "n_nan": n(F.isnan(d)), "min_value": F.min(v), "max_value": F.max(v), "mean_value": F.avg(fin),
                "q": F.percentile_approx(fin, list(QUANTILES.values()), ACCURACY), "n_negative": n(v < 0), "n_zero": n(v == 0), "n_infinite": n(F.abs(v) == float("inf")),
            }
        aggs += [x.alias(f"__{k}_{i}") for k, x in stats.items()]
        rest = lambda k, t: F.lit(0).cast(t) if t == "bigint" else F.lit(None).cast(t)
        cell = [(F.col(f"__{k}_{i}") if k in stats else rest(k, t)).alias(k) for k, t in types.items()]
        cells.append(F.struct(F.lit(i).cast("smallint").alias("__c"), F.col("__rows").alias("n_rows"), *cell))
    return df.groupBy(F.col(f"`{group}`").alias("__g")).agg(*aggs).select("__g", F.inline(F.array(*cells)))


def profile(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """One row per group and column: n_rows, n_missing (NULL or NaN), n_null, n_distinct and top_count (of present
    values), min_value, max_value, p05 .. p95, mean_value, n_negative, n_zero, n_infinite, sum_decimals.

    Texts, times and booleans have only the counts. Rows without group are one group NULL; an empty table has none.
    """
    values = _value_counts(df, group, columns)
    there = (F.col("v").isNotNull() & ~F.isnan("v")) | F.col("s").isNotNull()
    text = F.when(F.col("v").isNotNull(), F.col("text"))
    decimals = F.when(F.instr(text, ".") > 0, F.length(text) - F.instr(text, ".")).otherwise(0)
    seen = _with_text(values.where(there)).groupBy(F.col("__g").alias("__h"), F.col("__c").alias("__d")).agg(
        F.count("*").alias("n_distinct"), F.max("n").alias("top_count"), F.sum(decimals * F.col("n")).alias("sum_decimals"))
    out = _ranges(df, group, columns).join(seen, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__c") == F.col("__d")), "left")
    quantiles = [F.get("q", F.lit(i)).alias(k) for i, k in enumerate(QUANTILES)]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _named(out.select(
        "__g", "__c", "n_rows", (F.col("n_null") + F.col("n_nan")).alias("n_missing"), "n_null", zero("n_distinct"), zero("top_count"),
        "min_value", "max_value", *quantiles, "mean_value", "n_negative", "n_zero", "n_infinite", zero("sum_decimals"),
    ), group, columns)


def masks(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, column_name, mask, n): how many values of the column have the mask in the group; missing ones too."""
    m = _with_mask(_value_counts(df, group, columns), df, columns).groupBy("__g", "__c", "mask").agg(F.sum("n").alias("n"))
    return _named(m, group, columns)


def patterns(df: DataFrame, columns: Sequence[str], rare: float = 0.001, dominant: float = 0.05) -> DataFrame:
    """(column_name, mask, n, share, dominant, rare): the masks of each column over the whole table.

    dominant: the mask has at least this share, or is the most frequent one (ties: the first by text); rare: its share is
    below `rare`, so its values are pattern violations.
    """
    n = _with_mask(_value_counts(df, None, columns), df, columns).groupBy("__c", "mask").agg(F.sum("n").alias("n"))
    total = n.groupBy(F.col("__c").alias("__d")).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "mask")).alias("x"))
    share = F.col("n") / F.col("total")
    return _named(n.join(total, F.col("__c") == F.col("__d")).select(
        "__c", "mask", "n", F.round(share, 9).alias("share"), ((share >= dominant) | (F.col("mask") == F.col("x.mask"))).alias("dominant"), (share < rare).alias("rare"),
    ), None, columns)


def _same(*names: str) -> Column:
    """Equal, NULL with NULL: `names` against the columns with two underscores before them."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return out


def _aside(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"__{n}" for n in names})


def _against_feed(mask: DataFrame, loads: DataFrame, load: str, feed: str) -> tuple[DataFrame, DataFrame]:
    """(load, feed, column_name, n_rows, mask, n, all_n): the masks of the loads with their number in the whole feed; and
    (feed, column_name, every, all_rows): the numbers of all masks of the feed. Loads that `loads` does not name have the feed
    NULL. Numbers have few masks (signs, sizes, precisions), which bounds the lists."""
    feeds = loads.select(F.col(load).alias("__l"), F.col(feed).alias("feed")).dropDuplicates(["__l"])
    own = mask.groupBy(load, "column_name").agg(F.collect_list(F.struct("mask", "n")).alias("x"), F.sum("n").alias("n_rows"))
    own = own.join(feeds, F.col(load) == F.col("__l"), "left").select(load, "feed", "column_name", "n_rows", F.inline("x"))
    every = own.groupBy("feed", "column_name", "mask").agg(F.sum("n").alias("all_n"))
    whole = every.groupBy("feed", "column_name").agg(F.collect_list("all_n").alias("every"), F.sum("all_n").alias("all_rows"))
    keys = ("feed", "column_name", "mask")
    return own.join(_aside(every, *keys), _same(*keys)).drop(*[f"__{k}" for k in keys]), whole


def violations(mask: DataFrame, loads: DataFrame, load: str, feed: str, rare: float = 0.001) -> DataFrame:
    """(load, feed, column_name, mask, n, n_others): the masks of a load whose share in the feed's other loads is below `rare`.

    A feed's only load has nothing to be compared with and no row here.
    """
    x, whole = _against_feed(mask, loads, load, feed)
    x = x.join(_aside(whole, "feed", "column_name"), _same("feed", "column_name")).where("all_rows > n_rows")
    others = F.col("all_n") - F.col("n")
    return x.where(others / (F.col("all_rows") - F.col("n_rows")) < rare).select(load, "feed", "column_name", "mask", "n", others.alias("n_others"))


def _divergence(mask: DataFrame, loads: DataFrame, load: str, feed: str) -> DataFrame:
    """(load, feed, column_name, divergence): Jensen-Shannon divergence (bits) of a load's masks from those of the feed's other
    loads, less what a load of its size has by chance; NULL for a feed's only load."""
    x, whole = _against_feed(mask, loads, load, feed)
    x = x.groupBy(load, "feed", "column_name", "n_rows").agg(F.collect_list(F.struct("n", "all_n")).alias("own"))
    x = x.join(_aside(whole, "feed", "column_name"), _same("feed", "column_name"))
    rows = F.col("n_rows")

    def pair(e: Column) -> tuple[Column, Column]:
        return e["n"] / rows, F.try_divide(e["all_n"] - e["n"], F.col("all_rows") - rows)

    def part(e: Column) -> Column:
        p, q = pair(e)
        h = (p + q) / 2
        # Masks that the load lacks add half of their share each: 1/2 in all, less half the share of those it has.
        return p * F.log2(p / h) / 2 + F.when(q > 0, q * F.log2(q / h) / 2).otherwise(0.0) - q / 2

    def by_chance(k: Column) -> Column:
        # Of a mask expected n * q times: q if that is far below 1, (1 - q) / (8 n ln 2) if it is far above.
        q = k / F.col("all_rows")
        return F.coalesce(F.try_divide(q * (1 - q), (1 - q) + 5.545 * rows * q), F.lit(0.0))

    js = F.aggregate("own", F.lit(0.5), lambda t, e: t + part(e)) - F.aggregate("every", F.lit(0.0), lambda t, k: t + by_chance(k))
    return x.select(load, "feed", "column_name", F.when(F.col("all_rows") > rows, js).alias("divergence"))


def departures(prof: DataFrame, mask: DataFrame, loads: DataFrame, load: str, feed: str, rule: DriftRule = DriftRule()) -> DataFrame:
    """One row per load and column: how far its masks and its statistics are from the feed's other loads; by_masks,
    by_statistics, and departs, if one of them.

    The masks decide: divergence (`_divergence`) less the feed's median of it, against `rule`. The statistics are a second
    signal for what masks do not show: missing and negative share, level (median), spread (inter-quartile range), range (p05
    to p95), distinct share, top share, zeros, decimals. Loads under rule.least_rows are reported and never depart. A feed's
    only load departs from nothing; loads that `loads` does not name are compared with one another. One row per load and
    column is stored, as the medians of the feeds are taken from it in two steps.
    """
    x = prof.join(_aside(_divergence(mask, loads, load, feed), load, "column_name"), _same(load, "column_name"))
    n = F.col("n_rows") - F.col("n_missing")
    share = lambda c: F.try_divide(F.col(c), n)
    x = x.select(
        load, "feed", "column_name", "n_rows", n.alias("n"), (F.col("n_missing") / F.col("n_rows")).alias("missing"), F.col("p50").alias("level"),
        (F.col("p75") - F.col("p25")).alias("spread"), (F.col("p95") - F.col("p05")).alias("range"), share("n_negative").alias("negative"), share("n_zero").alias("zero"),
        share("n_distinct").alias("distinct"), share("top_count").alias("top"), share("sum_decimals").alias("decimals"),
        "divergence",
    )
    x = cut(x)
    stats = ["missing", "level", "spread", "range", "negative", "zero", "distinct", "top", "decimals", "divergence"]
    judged = F.col("n_rows") >= rule.least_rows
    of_feed = lambda d, *a: d.where(judged).groupBy(F.col("feed").alias("__f"), F.col("column_name").alias("__c")).agg(*a)
    joined = lambda d, s: d.join(s, F.col("feed").eqNullSafe(F.col("__f")) & (F.col("column_name") == F.col("__c")), "left").drop("__f", "__c")
    x = joined(x, of_feed(x, *[F.percentile_approx(s, 0.5, ACCURACY).alias(f"mid_{s}") for s in stats], F.count("*").alias("n_loads")))
    mid_of = lambda s: F.col(f"mid_{s}")
    root = F.sqrt(F.greatest(F.col("n").cast("double"), F.lit(1.0)))
    of_share = lambda s, k: (F.col(s) - mid_of(s)) / F.sqrt(mid_of(s) * (1 - mid_of(s)) / F.greatest(F.col(k).cast("double"), F.lit(1.0)) + 1e-4)
    of_ratio = lambda s: F.when(mid_of(s) > 0, F.log((F.col(s) + mid_of(s) * 1e-6) / mid_of(s)) * root / 1.2)
    x = x.withColumns({
        "d_missing": of_share("missing", "n_rows"), "d_negative": of_share("negative", "n"),
        "d_level": F.when(mid_of("spread") > 0, (F.col("level") - mid_of("level")) / (0.93 * mid_of("spread") / root)),
        "d_spread": of_ratio("spread"), "d_range": of_ratio("range"),
        **{f"d_{s}": F.col(s) - mid_of(s) for s in ("zero", "distinct", "top", "decimals", "divergence")},
    })
    x = joined(x, of_feed(x, (1.4826 * F.percentile_approx(F.abs("d_divergence"), 0.5, ACCURACY)).alias("noise")))
    by_masks = F.col("d_divergence") > F.greatest(rule.divergence + rule.sampling / F.col("n_rows"), rule.spread * F.col("noise"))
    far = [F.abs(f"d_{s}") > rule.second_deviations for s in ("missing", "negative", "level", "spread", "range")]
    far += [F.abs(f"d_{s}") > rule.second_share for s in ("zero", "distinct", "top")] + [F.abs("d_decimals") > rule.second_decimals]
    yes = lambda c: judged & (F.coalesce(F.col("n_loads"), F.lit(0)) > 1) & F.coalesce(c, F.lit(False))
    x = x.withColumns({"by_masks": yes(by_masks), "by_statistics": yes(F.greatest(*[F.coalesce(f, F.lit(False)) for f in far]))})
    distances = [F.round(F.col(f"d_{s}"), 6).alias(f"d_{s}") for s in stats]
    return x.select(load, "feed", "column_name", "n_rows", *distances, "by_masks", "by_statistics", (F.col("by_masks") | F.col("by_statistics")).alias("departs"))
