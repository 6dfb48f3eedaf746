"""Attributes as they were known at a time: one change history per attribute, separate last-known matches, pivoted back.

Plan. A row of the history stays one wide row with one order for all of its attributes; a missing value is no entry of its
attribute's history. History and events of a key meet in one exchange, each row with its own side only, and running maxima,
one for each attribute, answer the events where they are. Everything stays in the JVM; no range join is made, and the
answers are not joined back.

Keys with very many rows are many tasks: their history is cut into spans of time, and their events, if those are many, are
dealt to parts that each get the history of the span. A second running maximum over one row per span carries what earlier
spans knew. Such keys are found by counting; their table has MOST_HOT rows at most, so that it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import MICROS_PER_DAY, micros

#: Name of the attribute that every row has; its source id says which row was the last known.
ROW = "row"
#: A key is split from this many rows or events on, and how many keys (the largest) are split.
SPAN_ROWS, MOST_HOT = 1_000_000, 100_000


def change_history(rows: DataFrame, key: str, known_at: str, latest_by: Sequence[str], tie: str, attributes: Sequence[str]) -> DataFrame:
    """(key, t, h): a wide row per row with key, known_at, tie and all of `latest_by`; h has the order o0.., k and the values v0...

    t is known_at in microseconds; the order is by `latest_by` (dates or times, in turn), then the smallest `tie`; a column of
    `latest_by` that is known_at itself has no place of its own. A missing value (NULL or NaN) of an attribute makes no entry
    of its history, so attributes that are updated at different times keep apart.
    """
    order = [micros(c).alias(f"o{i}") for i, c in enumerate(latest_by) if c != known_at]
    value = [(F.lit(1.0) if a == ROW else F.col(f"`{a}`").cast("double")).alias(f"v{i}") for i, a in enumerate(attributes)]
    r = rows.select(F.col(key).alias("key"), micros(known_at).alias("t"), *order, (-F.col(tie)).alias("k"), *value)
    for c in r.columns:
        if not c.startswith("v"):
            r = r.where(F.col(c).isNotNull())
    values = [F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")).alias(f"v{i}") for i in range(len(value))]
    r = r.select("key", "t", F.struct(*[c for c in r.columns if c[0] in "ok" and c != "key"], *values).alias("h"))
    # Of several attributes a row without any is harmless, and a filter on all of them makes Catalyst infer 2**n constraints.
    return r.where(F.col("h.v0").isNotNull()) if len(values) == 1 else r


def _hot(history: DataFrame, events: DataFrame, span_rows: int) -> DataFrame:
    """(hk, first, width, spans, parts): the MOST_HOT largest of the keys with more than `span_rows` rows or events. A key
    beyond them has less than 1 / MOST_HOT of all rows and stays whole."""
    t = F.when(F.col("kind") == 0, F.col("t"))
    both = history.select("key", "t", F.lit(0).alias("kind")).unionByName(events.select("key", "t", F.lit(1).alias("kind")))
    n = both.groupBy(F.col("key").alias("hk")).agg(F.count(t).alias("rows"), F.count("*").alias("all"), F.min(t).alias("first"), F.max(t).alias("last"))
    n = n.withColumn("most", F.greatest("rows", F.col("all") - F.col("rows"))).where(F.col("most") > span_rows).orderBy(F.desc("most"), "hk").limit(MOST_HOT)
    spans = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(span_rows))).cast("bigint")
    parts = F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("rows")) / (spans * span_rows))).cast("int")
    return n.select("hk", "first", (F.floor((F.col("last") - F.col("first")) / spans) + 1).cast("bigint").alias("width"), spans.alias("spans"), parts.alias("parts"))


def last_known(history: DataFrame, events: DataFrame, latest_by: Sequence[str], known_at: str, attributes: Sequence[str], span_rows: int = SPAN_ROWS) -> DataFrame:
    """The columns of `events`.e and for each attribute a struct (value, known_us, k) of the last entry, by the order of
    `change_history`, among those known at or before the event; NULL where there is none.

    `events` has key, t (microseconds) and e, a struct of whatever is to come out again; those without key or t are answered
    by NULLs (t sorts before all times, and events without key are dealt to parts like those of a large one).
    """
    hot = F.broadcast(_hot(history, events.where("key is not null and t is not null"), span_rows))
    placed = lambda d: d.join(hot, F.col("key") == F.col("hk"), "left")
    parts = F.coalesce("parts", F.when(F.col("key").isNull(), 4096).otherwise(1))
    one = placed(history).select("key", "t", "h", F.lit(0).alias("kind"), "first", "width", "spans", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    two = placed(events).select("key", "t", "e", F.lit(1).alias("kind"), "first", "width", "spans", F.pmod(F.monotonically_increasing_id(), parts).cast("int").alias("part"))
    both = one.unionByName(two, allowMissingColumns=True)
    at = F.floor((F.col("t") - F.col("first")) / F.col("width"))
    span = F.coalesce(F.greatest(F.lit(0), F.least(at, F.col("spans") - 1)), F.lit(0)).cast("int").alias("span")
    rank = [F.col("t") if c == known_at else F.col(f"h.o{i}") for i, c in enumerate(latest_by)]

    def entry(i: int) -> Column:
        return F.when(F.col(f"h.v{i}").isNotNull(), F.struct(*[x.alias(f"r{j}") for j, x in enumerate(rank)], F.col("h.k").alias("k"), F.col(f"h.v{i}").alias("value"), F.col("t").alias("known_us")))

    names = [f"x{i}" for i in range(len(attributes))]
    so_far = Window.partitionBy("key", "span", "part").orderBy(F.asc_nulls_first("t"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("key", span, "part", "t", "kind", "h", "e")
    seen = both.select("key", "span", "kind", "e", *[F.max(entry(i)).over(so_far).alias(n) for i, n in enumerate(names)]).where("kind = 1")
    # What the spans before knew, of the keys that have several: of most tables none.
    cut = history.join(hot, (F.col("key") == F.col("hk")) & (F.col("spans") > 1)).select("key", span, "t", "h")
    ends = cut.groupBy("key", "span").agg(*[F.max(entry(i)).alias(n) for i, n in enumerate(names)])
    every = hot.where("spans > 1").select(F.col("hk").alias("key"), F.explode(F.sequence(F.lit(0), F.col("spans").cast("int") - 1)).alias("span"))
    ends = every.join(ends, ["key", "span"], "left")
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "span", *[F.max(n).over(before).alias(f"was_{n}") for n in names])
    got = seen.join(carried, ["key", "span"], "left")
    return got.select("e.*", *[F.greatest(n, f"was_{n}").alias(a) for n, a in zip(names, attributes, strict=True)])


def attributes_as_of(
    events: DataFrame, rows: DataFrame, *, event_key: str, event_time: str, row_key: str, known_at: str,
    latest_by: Sequence[str], tie: str, attributes: Sequence[str], max_age_days: int | None = None,
    sources: bool = False, how: str = "left", span_rows: int = SPAN_ROWS,
) -> DataFrame:
    """`events` with each of `attributes` of `rows` as last known at the event's time, never a later one.

    Per attribute the entry with known_at <= event_time counts that is latest by `latest_by`; of equals the one with the
    smallest `tie`. An attribute's own last present value is taken, so two attributes can come from different rows;
    with `sources`, <attribute>_from names the row (its `tie`). The attribute "row" stands for the row itself and only
    has row_from. With `max_age_days`, entries known longer ago count as none (inclusive bound).

    Defined cases: events without key or time get NULLs (with how="inner" events without any attribute are left out);
    empty tables give no rows or NULLs; repeated events have a row each; columns of `events` that have the name of a
    result column are replaced by it.
    """
    history = change_history(rows, row_key, known_at, latest_by, tie, attributes)
    e = events.select(F.col(event_key).alias("key"), micros(event_time).alias("t"), F.struct(*[F.col(f"`{c}`").alias(f"e{i}") for i, c in enumerate(events.columns)], micros(event_time).alias("us")).alias("e"))
    known = last_known(history, e, latest_by, known_at, [f"a{i}" for i in range(len(attributes))], span_rows)
    new = {}
    for i, a in enumerate(attributes):
        x = F.col(f"a{i}")
        if max_age_days is not None:
            x = F.when(F.col("us") - x["known_us"] <= max_age_days * MICROS_PER_DAY, x)
        if a != ROW:
            new[a] = x["value"]
        if sources or a == ROW:
            new[f"{a}_from"] = -x["k"]
    keep = [(i, c) for i, c in enumerate(events.columns) if c not in new]
    out = known.select(*[F.col(f"e{i}").alias(c) for i, c in keep], *[c.alias(k) for k, c in new.items()])
    return out.where(" or ".join(f"`{k}` is not null" for k in new)) if how == "inner" else out
