"""Mixing sources to target weights with balanced (cube-method) sampling of documents.

Every document of a source is used the same whole number of times and once more with the source's fractional inclusion
probability. Which documents get that extra use is drawn by the cube method: the vector of probabilities moves through
the null space of the balancing constraints (number of documents, number of tokens) until only a small landing problem
is left.

Plan. The documents of a source are spread over cells by a hash of their id, so that a source with a third of all rows is
many tasks and the draw is the same however the rows lie. In a cell, groups of documents of like size fly at once, as
columns of a matrix; the two that stay open of each group follow, the largest first, each balanced by many smaller ones, so
that what stays open at last is small. Two documents of each cell are left; they fly once more together for each source, and the
landing gives up the number before the tokens (as it does where a document is far larger than the others): a source misses its tokens by less than one of its smallest open documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import whole_keys
from tidemark.sources.tables import cut

#: Rows that a target table may have at most; it is read to the driver.
MOST_TARGETS = 10_000
#: Documents of a cell, of a group that flies as a column, of the smaller ones that balance one at the end, and how many of the
#: smallest of a cell fly in no group, so that what is open at last is balanced by many of them.
CELL, GROUP, BALANCE, SMALLEST = 50_000, 64, 2_000, 512
#: A document of so many times the median's tokens is decided before the flight.
GIANT = 8.0
_EPS = 1e-9


@dataclass
class Plan:
    """Of one source: whole uses of each document, chance of one more, and the tokens it is to give."""

    source: str
    weight: float
    max_repeats: int
    share: float
    tokens: int
    target: float
    whole: int
    chance: float
    docs: int = 0


def plan_mix(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: float | None = None) -> list[Plan]:
    """Uses per source. `targets`: (source, weight, max_repeats); `tokens`: size of each source.

    Sources without tokens, weight or repeats can give nothing; the shares of the others keep their proportions.
    Without `total` the mix is as large as exact shares allow: the source that is scarcest for its share is used
    max_repeats times. With a larger `total`, sources at their cap give what they can and the others still get their
    share of `total`, so the actual shares show what is missing.
    """
    can = [(s, w, r) for s, w, r in targets if tokens.get(s, 0) > 0 and w is not None and w > 0 and r is not None and r > 0]
    weights = sum(w for _, w, _ in can)
    if total is None:
        total = min((r * tokens[s] / (w / weights) for s, w, r in can), default=0.0)
    plans = []
    for s, w, r in targets:
        have = tokens.get(s, 0)
        usable = any(s == x for x, _, _ in can)
        share = w / weights if usable else 0.0
        uses = min(share * total / have, float(r)) if usable else 0.0
        whole = int(uses + _EPS)
        plans.append(Plan(s, w, r, share, have, share * total, whole, max(0.0, uses - whole) if uses - whole > _EPS else 0.0))
    return plans


def _steps(p: np.ndarray, u: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Rows of chances moved along rows of directions until one is 0 or 1: up or down, so that the expected chances stay."""
    with np.errstate(all="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf)).min(-1, keepdims=True)
        down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf)).min(-1, keepdims=True)
    q = p + np.where(draw[..., None] * (up + down) < down, up, -down) * u
    return np.where(q <= _EPS, 0.0, np.where(q >= 1 - _EPS, 1.0, q))


def _open(p: np.ndarray) -> np.ndarray:
    return (p > 0) & (p < 1)


def fly_groups(t: np.ndarray, p: np.ndarray, rng: np.random.Generator, group: int = GROUP) -> None:
    """One flight for every `group` consecutive units (sizes t, chances p, which are moved in place), all at once: each takes
    its units in turn and moves three open ones so that neither their number nor their size changes. Two stay open at most."""
    n = len(t)
    rows = -(-n // group)
    slot = np.full((rows, 2), -1)
    for j in range(group):
        new = np.arange(rows) * group + j
        there = new < n
        full = np.flatnonzero(there & (slot >= 0).all(1))
        if len(full):
            three = np.c_[slot[full], new[full]]
            a, b, c = t[three].T
            u = np.where(((a == b) & (b == c))[:, None], [1.0, -1.0, 0.0], np.c_[b - c, c - a, a - b])
            p[three] = _steps(p[three], u / np.abs(u).max(1, keepdims=True), rng.random(len(full)))
            left = np.sort(np.where(_open(p[three]), three, n), axis=1)[:, :2]
            slot[full] = np.where(left < n, left, -1)
        some = there.copy()
        some[full] = False
        empty = np.flatnonzero(some)
        slot[empty, (slot[empty, 0] >= 0).astype(int)] = new[empty]


def settle(t: np.ndarray, p: np.ndarray, rng: np.random.Generator, above: float = 0.0, most: int | None = None) -> None:
    """Decides the open units larger than `above` (sizes t in falling order, chances p in place), the largest first, each
    balanced by all smaller open ones (the next `most`), which share its change: so that number and size are kept or, where
    that would move one of them more than the large one itself, the size only. Two units stay open at least."""
    left = np.flatnonzero(_open(p))
    while len(left) > 2 and t[left[0]] > above:
        at = left if most is None else left[: most + 1]
        s = t[at] / t[at[0]]
        u = np.r_[1.0, np.full(len(at) - 1, -1.0 / s[1:].sum())]
        m = np.stack([np.ones(len(at) - 1), s[1:]])
        g = m @ m.T
        if g[0, 0] * g[1, 1] - g[0, 1] ** 2 > 1e-9 * g[0, 0] * g[1, 1]:
            both = -m.T @ np.linalg.solve(g, np.array([1.0, 1.0]))  # the smallest change that keeps both sums
            u = np.r_[1.0, both] if np.abs(both).max() <= 1 else u
        elif s[-1] > 1 - 1e-9:  # all of one size
            u = np.r_[1.0, -1.0, np.zeros(len(at) - 2)]
        p[at] = _steps(p[at][None], u[None] / np.abs(u).max(), rng.random(1))[0]
        left = left[_open(p[left])]


def land(t: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> None:
    """Decides the open units that are left, two at most (sizes t in falling order): the number is given up for the size between
    two, and the one that is left is drawn by its chance."""
    left = np.flatnonzero(_open(p))
    if len(left) == 2:
        u = np.array([t[left[1]], -t[left[0]]]) / t[left].max()
        p[left] = _steps(p[left][None], u[None], rng.random(1))[0]
        left = left[_open(p[left])]
    p[left] = (rng.random(len(left)) < p[left]).astype(float)


def fly(t: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> None:
    """The flight of a cell (sizes t in falling order, chances p in place); two units stay open at most.

    Units far larger than the median are decided first, against all others, whose chances hardly change by it; then groups of
    like size fly at once, but for the smallest ones; then what is open, the largest first.
    """
    if len(t):
        settle(t, p, rng, above=GIANT * float(np.median(t)))
        usual = np.flatnonzero(_open(p))
        usual = usual[: max(0, len(usual) - SMALLEST)]
        moved = p[usual]
        fly_groups(t[usual], moved, rng)
        p[usual] = moved
        settle(t, p, rng, most=BALANCE)


def _flight(seed: int, last: bool):  # noqa: ANN202
    """Frames of (id, source, cell, tokens, chance) by source and cell, the largest first -> the same with the chance 0, 1 or,
    if it is open still, in between."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_keys(frames, ["source", "cell"], rows=CELL):
            for (source, cell), f in frame.groupby(["source", "cell"], sort=False):
                rng = np.random.default_rng([seed, zlib.crc32(source.encode()), int(cell) + 1])
                t, p = f["tokens"].to_numpy(float), f["chance"].to_numpy(float).copy()
                fly(t, p, rng)
                if last:
                    land(t, p, rng)
                yield f.assign(chance=p)

    return work


def read_targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, weight, max_repeats) of a target table, which must be a small one with one row per source."""
    rows = targets.where("source is not null").select("source", "weight", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"a target table may have {MOST_TARGETS} rows")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a target table has one row per source")
    return [(r[0], r[1], r[2]) for r in rows]


def plans_for(sized: DataFrame, targets: DataFrame, total: float | None = None) -> list[Plan]:
    """The plan of each target; only the totals of the sources with a target reach the driver."""
    want = read_targets(targets)
    names = [s for s, _, _ in want]
    sums = sized.where(F.col("source").isin(names) & (F.col("tokens") > 0)).groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect()
    plans = plan_mix(want, {r["source"]: int(r["n"] or 0) for r in sums}, total)
    docs = {r["source"]: r["docs"] for r in sums}
    return [replace(p, docs=docs.get(p.source, 0)) for p in plans]


def mixed(sized: DataFrame, plans: list[Plan], id_col: str, seed: int = 0) -> DataFrame:
    """(id, source, tokens, uses): how often each document is used; one row per document of `sized` (id, source, tokens).

    Documents without source, of a source without target, and of no tokens have 0 uses. No document is used more than its
    source's max_repeats. The draw depends on ids, sizes and seed only, not on how the rows lie or are split. The tokens of a
    source miss their target by less than one of its smaller documents; rows that share an id are drawn one by one, and
    which of them is used is not defined.
    """
    of = lambda d, kind: F.try_element_at(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))]), F.col("source")) if d else F.lit(None).cast(kind)
    usable = F.col("source").isNotNull() & (F.col("tokens") > 0)
    base = F.coalesce(F.when(usable, of({p.source: p.whole for p in plans if p.whole}, "int")), F.lit(0)).cast("int")
    chance = F.when(usable, of({p.source: p.chance for p in plans if p.chance > 0}, "double"))
    cells = F.coalesce(of({p.source: -(-p.docs // CELL) for p in plans if p.docs > CELL}, "int"), F.lit(1))
    kind = sized.schema[id_col].dataType.simpleString()
    rows = sized.select(F.col(id_col).alias("id"), "source", F.pmod(F.xxhash64(id_col), cells).cast("bigint").alias("cell"), F.col("tokens").cast("bigint").alias("tokens"), chance.alias("chance"), base.alias("base"))
    schema = f"id {kind}, source string, cell bigint, tokens bigint, chance double, base int"
    ordered = lambda d, *by: d.repartition(*by).sortWithinPartitions("source", "cell", F.desc("tokens"), "id")
    flown = cut(ordered(rows.where("chance is not null"), "source", "cell").mapInPandas(_flight(seed, last=False), schema))
    still = "chance > 0 and chance < 1"
    landed = ordered(flown.where(still).withColumn("cell", F.lit(-1).cast("bigint")), "source").mapInPandas(_flight(seed, last=True), schema)
    drawn = flown.where(f"not ({still})").unionByName(landed)
    uses = (F.col("base") + F.coalesce("chance", F.lit(0.0)).cast("int")).alias("uses")
    return rows.where("chance is null").unionByName(drawn).select(F.col("id").alias(id_col), "source", "tokens", uses)


def shares(mix: DataFrame, plans: list[Plan]) -> DataFrame:
    """Per source of the targets or the documents: weight, target and actual share of the mixed tokens, sizes and uses.

    A source without target has the target share 0, a target without documents the actual share 0; documents without
    source are the source NULL.
    """
    spark = mix.sparkSession
    rows = [(p.source, float(p.weight) if p.weight is not None else None, p.max_repeats, float(p.share)) for p in plans]
    want = spark.createDataFrame(rows, "source string, weight double, max_repeats int, target_share double")
    used = mix.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"), F.sum("uses").alias("n_uses"),
        F.max("uses").alias("most_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"),
    )
    whole = used.agg(F.sum("mixed_tokens").alias("all_tokens"), F.lit(1).alias("one"))  # a single row
    out = used.withColumnRenamed("source", "s").join(want, F.col("s").eqNullSafe(F.col("source")), "full").withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        F.coalesce("source", "s").alias("source"), "weight", "max_repeats", F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce(F.try_divide(F.col("mixed_tokens"), F.col("all_tokens")), F.lit(0.0)).alias("actual_share"),
        n("n_docs"), n("tokens"), n("n_uses"), n("most_uses"), n("mixed_tokens"),
    )
