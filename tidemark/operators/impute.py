"""Filling missing cells from the finest group of similar records with enough support, with marks for each cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that stand for no sector, compared in lower case without outer blanks.
NO_NAME = ["", "-", "--", "?", "n/a", "na", "#n/a", "none", "null", "nan", "tbd", "unknown", "not available", "other", "misc"]


def usable_name(c: Column, known: Column) -> Column:
    """The name if it is one of those known to be one (`known` true), is not blank and no word for 'no name'."""
    return F.when(known & ~F.lower(F.trim(c)).isin(NO_NAME), c)


def with_known_names(df: DataFrame, name: str, names: DataFrame, flag: str) -> DataFrame:
    """Adds `flag`: whether the trimmed lower-case `name` is among the one-column table `names`.

    The names are reduced to distinct ones; the join is broadcast only if Spark finds that side below its limit.
    """
    fold = lambda c: F.lower(F.trim(c))
    good = names.select(fold(F.col(names.columns[0])).alias("__name")).where("__name is not null").distinct()
    good = good.where(~F.col("__name").isin(NO_NAME))
    # Rows without a name match nothing; they get keys of their own, so a shuffle does not send all of them to one task.
    alone = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    out = df.withColumn("__name", F.coalesce(fold(F.col(name)), alone))
    return out.join(good.withColumn(flag, F.lit(True)), "__name", "left").drop("__name").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unusable_cells(filled: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, field): one row per cell without a usable value, by the marks <field>_missing of `fill`."""
    cells = F.array(*[F.when(F.col(f"{k}_missing"), F.lit(k)) for k in fields])
    return filled.select(id_col, F.explode(F.array_compact(cells)).alias("field"))


def _by_level(rows: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep` and, for each level whose keys the row has, __level and its keys as __k0, ...; other keys are NULL there."""
    kinds = {f.name: f.dataType for f in rows.schema}

    def one(i: int, used: Sequence[str]) -> Column:
        has = F.lit(True)
        for k in used:
            has = has & F.col(k).isNotNull()
        cells = [(F.col(k) if k in used else F.lit(None).cast(kinds[k])).alias(f"__k{j}") for j, k in enumerate(keys)]
        return F.when(has, F.struct(F.lit(i).alias("__level"), *cells))

    every = F.array_compact(F.array(*[one(i, used) for i, (_, used) in enumerate(levels)]))
    return rows.select(*keep, F.inline(every))


def group_statistics(
    rows: DataFrame, values: Sequence[str], levels: Sequence[tuple[str, Sequence[str]]], keys: Sequence[str], categorical: bool
) -> DataFrame:
    """(__level, __k0.., __x0, __n0, ...): typical value and number of present values of each of `values`, for the groups of
    all levels in one aggregate.

    Numbers: percentile_approx, the lower median (exact for groups below its accuracy), which has bounded state and combines
    before the shuffle. Categories: the most frequent value, of equals the smallest; counted by value first, so a hot
    group is combined before it meets in one task.
    """
    names = ["__level", *[f"__k{j}" for j in range(len(keys))]]
    if not categorical:
        long = _by_level(rows, levels, keys, values)
        stats = [x for i, v in enumerate(values) for x in (F.percentile_approx(v, 0.5, 10_000).alias(f"__x{i}"), F.count(v).alias(f"__n{i}"))]
        return long.groupBy(*names).agg(*stats)
    (value,) = values
    counts = _by_level(rows.where(F.col(value).isNotNull()), levels, keys, [value]).groupBy(*names, value).agg(F.count("*").alias("__c"))
    top = F.min(F.struct((-F.col("__c")).alias("c"), F.col(value).alias("v")))
    return counts.groupBy(*names).agg(top.alias("__t"), F.sum("__c").alias("__n0")).select(*names, F.col("__t.v").alias("__x0"), "__n0")


def fill(
    df: DataFrame, values: dict[str, str], levels: Sequence[tuple[str, Sequence[str]]], *, support: int = 5, categorical: bool = False,
) -> DataFrame:
    """`df` with each of `values` filled, and <value>_missing, <value>_filled (booleans) and <value>_level (what filled it).

    `values` maps a column to the column with its usable value (itself, if it is the same one). Where that is NULL the
    value is taken from the first of `levels` (name, key columns; finest first) whose group has at least `support` usable
    values: their median or, if `categorical` (one value at a time), their mode. A level with no keys stands for all rows.
    Rows with a NULL in a level's keys skip that level; a cell that no level can fill is missing, not filled, and its
    value is NULL. An empty table stays empty; repeated rows are filled alike.

    Plan. Rows that miss nothing are passed on as they are. The statistics of all levels and values are one aggregate. What
    fills a cell depends on the row's keys alone, so the distinct keys of incomplete rows are looked up, once for all
    levels, and only incomplete rows are joined.
    """
    names, usable = list(values), list(values.values())
    keys = list(dict.fromkeys(k for _, used in levels for k in used))
    lacks = F.lit(False)
    for u in usable:
        lacks = lacks | F.col(u).isNull()
    some = df.where(lacks)
    level_keys = ["__level", *[f"__k{j}" for j in range(len(keys))]]
    same = lambda d, cols, to: d.withColumnsRenamed({c: to + c for c in cols})
    equal = lambda cols, to: [F.col(c).eqNullSafe(F.col(to + c)) for c in cols]
    stats = same(group_statistics(df, usable, levels, keys, categorical), level_keys, "s")
    asked = _by_level(some.select(*keys).distinct() if keys else some.select(F.lit(0).alias("__one")).distinct(), levels, keys, keys or ["__one"])
    found = asked.join(stats, equal(level_keys, "s"))
    first = [F.min(F.when((F.col(f"__n{i}") >= support) & F.col(f"__x{i}").isNotNull(), F.struct("__level", F.col(f"__x{i}").alias("v")))).alias(f"__f{i}") for i in range(len(names))]
    fills = same(found.groupBy(*(keys or ["__one"])).agg(*first), keys or ["__one"], "__f_")
    done = some.join(fills, equal(keys, "__f_") if keys else F.lit(True), "left")
    label = F.array(*[F.lit(n) for n, _ in levels])

    def marks(got: Sequence[tuple[Column, Column]]) -> list[Column]:
        out = []
        for (n, u), (x, at) in zip(values.items(), got, strict=True):
            none = F.col(u).isNull()
            out += [F.coalesce(F.col(u), x).alias(n), none.alias(f"{n}_missing"), (none & x.isNotNull()).alias(f"{n}_filled"), F.when(none & x.isNotNull(), at).alias(f"{n}_level")]
        return out

    keep = [c for c in df.columns if c not in {x for n in names for x in (n, f"{n}_missing", f"{n}_filled", f"{n}_level")}]
    kinds = {f.name: f.dataType for f in df.schema}
    whole = df.where(~lacks).select(*keep, *marks([(F.lit(None).cast(kinds[u]), F.lit(None).cast("string")) for u in usable]))
    mended = done.select(*keep, *marks([(F.col(f"__f{i}.v"), F.get(label, F.col(f"__f{i}.__level"))) for i in range(len(names))]))
    return whole.unionByName(mended)
