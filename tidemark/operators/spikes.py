"""Implausible readings of numeric series: impossible values, spikes that return, and stuck values.

Peaks over threshold: the residual of a reading from the levels before and after it, without the season, is compared with
the level that the generalised Pareto tail of its source reaches at a fixed risk. No other bound decides.

The readings of a source (a company's field) are reduced to distinct (time, value) pairs before they are shuffled, so
copies of a reading cost nothing and a source has no more readings than the calendar has report dates times versions.
Frames of many sources are then worked on at once as matrices (sources x times).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import starts, whole_keys


@dataclass(frozen=True)
class SpikeRule:
    """Parameters of the detector.

    reach: readings on each side that give the level before and after; back: how many of them must be there.
    linear: readings within this many noise deviations of 0 are compared by differences, larger ones by ratios.
    tail: share of a source's residuals treated as exceedances; risk: chance per reading that the fitted tail reaches the
    cutoff; prior_mean, prior_shape, prior_size: mean excess (in robust deviations) and shape of the tail before any
    reading of the source is seen, and how many exceedances that counts for (a source has a handful of its own; the values
    are those of noise with a little more tail than a normal one). longest: readings in a row that a spike may last.
    stuck: successive equal readings that make a value stuck; chance: a run is stuck if as many runs of its length as this,
    or fewer, are expected by chance in the source; steps: a source whose usual change is fewer reporting steps than this
    is a coarse one, whose runs say nothing.
    """

    reach: int = 5
    back: int = 1
    linear: float = 3.0
    tail: float = 0.15
    risk: float = 1e-4
    prior_mean: float = 0.6
    prior_shape: float = 0.1
    prior_size: float = 10.0
    longest: int = 2
    stuck: int = 4
    chance: float = 0.1
    steps: float = 3.0


def _masked_median(m: np.ndarray) -> np.ndarray:
    """Median over the last axis without NaN; NaN where all are."""
    n = np.isfinite(m).sum(-1)
    s = np.sort(m, axis=-1)
    lo = np.take_along_axis(s, np.maximum((n - 1) // 2, 0)[..., None], -1)[..., 0]
    hi = np.take_along_axis(s, np.maximum(n // 2, 0)[..., None].clip(max=m.shape[-1] - 1), -1)[..., 0]
    return np.where(n > 0, (lo + hi) / 2, np.nan)


def _side(y: np.ndarray, k: int, sign: int) -> np.ndarray:
    """For each cell the k nearest present cells before (sign -1) or after it; y has no gaps but at its end."""
    c, t = y.shape
    out = np.full((c, t, k), np.nan)
    for j in range(1, k + 1):
        if j < t:
            if sign < 0:
                out[:, j:, j - 1] = y[:, :-j]
            else:
                out[:, :-j, j - 1] = y[:, j:]
    return out


def gpd_cutoff(e: np.ndarray, ok: np.ndarray, scale: np.ndarray, rule: SpikeRule) -> np.ndarray:
    """Per row of `e` (absolute residuals) the level that a generalised Pareto tail exceeds with chance rule.risk.

    The threshold is the (1 - tail) quantile. Mean and shape of the excesses (by probability-weighted moments) are averaged
    with the prior's, each by its number of exceedances. Residuals beyond the cutoff of the prior alone are what is looked
    for and take no part in the fit. A source without residuals has the prior's cutoff.
    """

    def level(u: np.ndarray, mean: np.ndarray, xi: np.ndarray) -> np.ndarray:
        """Level of a tail with this mean excess and shape over u."""
        far = np.log(rule.tail / rule.risk)
        flat = np.abs(xi) < 1e-6
        return u + mean * (1 - xi) * np.where(flat, far, np.expm1(np.where(flat, 1.0, xi) * far) / np.where(flat, 1.0, xi))

    def threshold(a: np.ndarray) -> np.ndarray:
        n = np.isfinite(a).sum(1)
        at = np.clip(np.ceil((1 - rule.tail) * n).astype(int) - 1, 0, a.shape[1] - 1)
        return np.nan_to_num(np.take_along_axis(np.sort(a, axis=1), at[:, None], 1)[:, 0])

    a = np.where(ok, e, np.nan)
    mean, shape = rule.prior_mean * scale, np.full(len(scale), rule.prior_shape)
    a = np.where(a <= level(threshold(a), mean, shape)[:, None], a, np.nan)
    u = threshold(a)
    x = np.sort(np.where(a > u[:, None], a - u[:, None], np.nan), axis=1)
    m = np.isfinite(x).sum(1)
    b0 = np.nansum(x, axis=1) / np.maximum(m, 1)
    weight = (m[:, None] - 1 - np.arange(x.shape[1])) / np.maximum(m[:, None] - 1, 1)
    b1 = np.nansum(x * weight, axis=1) / np.maximum(m, 1)
    d = b0 - 2 * b1
    own = np.where((m > 2) & (d > 0), 2 - b0 / np.where(d > 0, d, 1.0), rule.prior_shape)
    k = rule.prior_size
    return level(u, (k * mean + m * b0) / (k + m), (k * shape + m * np.clip(own, -1.0, 0.9)) / (k + m))


#: Cells of the matrices that are worked on at once (a longer source is worked on alone).
_CELLS = 100_000
#: Units in which readings are reported, from fine to coarse.
_UNITS = sorted(m * 10.0**k for k in range(-6, 6) for m in (1, 2, 2.5, 5))


def reporting_step(y: np.ndarray) -> np.ndarray:
    """Per row the coarsest unit of which nine in ten present readings are multiples; 0 where none is."""
    n, step = np.isfinite(y).sum(1), np.zeros(len(y))
    for unit in _UNITS:
        q = y / unit
        with np.errstate(invalid="ignore"):
            whole = (np.abs(q - np.round(q)) < 1e-4) & ((np.round(q) != 0) | (y == 0))
        step = np.where((whole.sum(1) >= 0.9 * n) & (n > 0), unit, step)
    return step


def _runs(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the run of each item and its place in it (from 0); items in `order`, `new` marks where runs begin."""
    head = np.flatnonzero(new)
    length = np.diff(np.r_[head, len(order)])
    whole, place = np.empty(len(order), dtype=int), np.empty(len(order), dtype=int)
    whole[order] = np.repeat(length, length)
    place[order] = np.arange(len(order)) - np.repeat(head, length)
    return whole, place


def _scan(f: pd.DataFrame, keys: list[str], rule: SpikeRule) -> pd.DataFrame:
    """Flagged readings of whole sources; f has one row per (key, t, value). Sources of like length are worked on together,
    so one long source does not widen the matrices of all others."""
    f = f.sort_values([*keys, "t", "v"], kind="stable", ignore_index=True)
    src = np.cumsum(starts(f, keys)) - 1
    size = np.ceil(np.log2(np.bincount(src))).astype(int)
    out = np.zeros(len(f), dtype=bool)
    for k in np.unique(size[size > 0]):  # one reading alone is never flagged
        alike = np.flatnonzero(size == k)
        for some in np.array_split(alike, -(-(len(alike) << int(k)) // _CELLS)):
            if len(some):
                at = np.flatnonzero(np.isin(src, some))
                out[at] = _flag(np.searchsorted(some, src[at]), *(f[c].to_numpy()[at] for c in ("t", "v", "season")), rule)
    return f.loc[out, [*keys, "t", "v"]]


def _flag(src: np.ndarray, t: np.ndarray, v: np.ndarray, q: np.ndarray, rule: SpikeRule) -> np.ndarray:
    """Which readings are flagged; rows are sorted by source (0, 1, ...), time and value."""
    newt = np.r_[True, (src[1:] != src[:-1]) | (t[1:] != t[:-1])]
    cell = np.cumsum(newt) - 1  # index of (source, time)
    cell_src = src[newt]
    pos = np.arange(len(cell_src)) - np.flatnonzero(np.r_[True, cell_src[1:] != cell_src[:-1]])[cell_src]
    n_src, width = int(src[-1]) + 1, max(2, int(pos.max()) + 1)

    # One reading for each time: the version nearest to the source's median.
    med = pd.Series(v).groupby(src).transform("median").to_numpy()
    order = np.lexsort((np.abs(v - med), cell))
    lead = order[np.r_[True, cell[order][1:] != cell[order][:-1]]]
    y0 = np.full((n_src, width), np.nan)
    y0[cell_src, pos] = v[lead]
    season = np.full((n_src, width), -1)
    season[cell_src, pos] = q[lead]

    # The form in which noise is even: linear near 0, logarithmic far from it, by the source's own noise.
    around = lambda x, k: np.concatenate([_side(x, k, -1), _side(x, k, 1)], axis=2)
    step, level = reporting_step(y0), _masked_median(np.abs(y0))
    noise = 1.4826 * np.nan_to_num(_masked_median(np.abs(y0 - _masked_median(around(y0, rule.reach)))))
    # Where the noise is 0, the step or a hundredth of the level stands for it.
    noise = np.maximum(np.maximum(noise, step), 0.01 * level) + 1e-300
    bend = 2 * rule.linear * noise
    y = np.arcsinh(y0 / bend[:, None])

    # Seasonal part: the median over the years of what a season is above its running level, where it repeats.
    above = y - _masked_median(np.concatenate([around(y, 4), y[:, :, None]], axis=2))
    part = np.zeros_like(y)
    spread = 1.4826 * _masked_median(np.abs(above))
    for s in range(4):
        m = np.where(season == s, above, np.nan)
        typical = _masked_median(m)
        known = (np.isfinite(m).sum(1) >= 3) & (np.abs(typical) > 0.5 * spread)
        part += np.where((season == s) & known[:, None], np.nan_to_num(typical)[:, None], 0)
    r = y - part
    before, after = _side(r, rule.reach, -1), _side(r, rule.reach, 1)
    mb, ma = _masked_median(before), _masked_median(after)
    both = (np.isfinite(before).sum(2) >= rule.back) & (np.isfinite(after).sum(2) >= rule.back)

    def leave(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
        """How far x is from the levels on both sides, 0 where it lies between them."""
        p, n = x - b, x - a
        return np.where(p * n > 0, np.minimum(np.abs(p), np.abs(n)), 0.0)

    e = np.where(both, leave(r, mb, ma), np.nan)
    scale = 1.4826 * np.nan_to_num(_masked_median(np.abs(r - _masked_median(np.concatenate([before, after], axis=2)))))
    # A reading is known to a step only, and a scale of 0 is none: the smallest noise that the form above assumes.
    scale = np.maximum(scale, np.maximum(step, 1e-3 * level) / np.hypot(level, bend) + 1e-12)
    cut = gpd_cutoff(np.nan_to_num(e), np.isfinite(e), scale, rule)

    # Every version is judged by its own value; runs longer than `longest` are a change, not a spike.
    i, j = src, pos[cell]
    far = both[i, j] & (leave(np.arcsinh(v / bend[i]) - part[i, j], mb[i, j], ma[i, j]) > cut[i])
    hit = np.zeros(len(cell_src), dtype=bool)
    hit[cell[far]] = True
    new = np.r_[True, (cell_src[1:] != cell_src[:-1]) | (hit[1:] != hit[:-1])]
    out = far & (_runs(np.arange(len(hit)), new)[0][cell] <= rule.longest)

    # Stuck values: runs of the same value at successive times, unless steps or frequent repeats make them likely.
    order = np.lexsort((j, v, i))
    new = np.r_[True, (i[order][1:] != i[order][:-1]) | (v[order][1:] != v[order][:-1]) | (j[order][1:] != j[order][:-1] + 1)]
    length, place = _runs(order, new)
    count = lambda mask: np.bincount(i[mask], minlength=n_src)
    pairs, free = count(j > 0), count((length < rule.stuck) & (j > 0))
    equal = count((length < rule.stuck) & (place > 0))
    change = np.abs(np.diff(y0, axis=1))
    usual = np.nan_to_num(_masked_median(np.where(change > 0, change, np.nan)))
    with np.errstate(all="ignore"):
        # Neighbours that share a step: of normal changes of this median, one in 3.7 steps.
        share = np.maximum(equal / np.maximum(free, 1), 0.27 * step / usual)
    share = np.where((usual > 0) & (usual >= rule.steps * step), np.clip(share, 0, 1), 1.0)
    likely = pairs[i] * share[i] ** (length - 1)
    return out | ((length >= rule.stuck) & (place > 0) & (likely <= rule.chance))


def unusual_readings(readings: DataFrame, source: Sequence[str], rule: SpikeRule = SpikeRule()) -> DataFrame:
    """(source..., t, v): distinct readings that leave the source's range and return, or are stuck.

    `readings` has the source columns, t (long, orders the readings), season (int 0..3) and v (double). Rows with NULL
    or non-finite v, or NULL source or t, are left out; repeated readings count once; sources with too few readings
    (fewer than 2 * back + 1 times) have no spikes. One reading at a time can have several versions (values); each is
    judged by itself against the other times.
    """
    keys = list(source)
    kept = readings.where(F.abs("v") < float("inf"))
    for k in [*keys, "t"]:
        kept = kept.where(F.col(k).isNotNull())
    kept = kept.groupBy(*keys, "t", "v").agg(F.min("season").alias("season"))
    kinds = {x.name: x.dataType.simpleString() for x in readings.schema}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_keys(batches, keys, rows=20_000):
            yield _scan(frame, keys, rule)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "t", "v"])
    return kept.repartition(*keys).sortWithinPartitions(*keys, "t").mapInPandas(work, schema)
