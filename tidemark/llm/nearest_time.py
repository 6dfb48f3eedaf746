"""Pairing records with the record nearest in time of the same entity, by x-fast tries over timestamp bits.

Plan. An entity's time line is cut into blocks of 2**bits microseconds, at least as wide as the tolerance; a question is
sent to the at most three blocks its tolerance reaches. A block of more than SPAN_ROWS instants is cut into parts of about that
many at quantiles of its instants, so that what a task holds is bounded however an entity's instants lie; a question goes
to its part and the next one. Candidates are reduced to one per entity and time before they are shuffled, and those that no
question can reach are dropped at the scan. A partition is read in frames of whole parts; a frame gets one hash table
per prefix length, with the keys (part, prefix) and the smallest and largest leaf below. A question finds its
longest present prefix by binary search over the lengths: log2(bits) probes, all questions of a frame at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import MICROS_PER_DAY, micros
from tidemark.operators.lastknown import MOST_HOT, SPAN_ROWS
from tidemark.operators.segments import starts, whole_keys

#: Bits of the days used to drop candidates at the scan: 2**37 us is 1.6 days. The years 1 to 9999 have 2.3 million of
#: them at most, 19 MB, which bounds what is broadcast whatever the tables hold; a century has 23,000.
_SIEVE_BITS = 37
_EMPTY = np.int64(-1)
#: Parts that a block can have at most: the quantiles that are taken of it.
MOST_PARTS = 1024
PART = ["key", "block", "part"]


class HashTable:
    """Open addressing from int64 keys (not negative, distinct) to their positions, built and probed in bulk."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(3, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.place = np.zeros(1 << self.bits, dtype=np.int64)
        mask = (1 << self.bits) - 1
        left, slot = np.arange(len(keys)), self._hash(keys)
        while len(left):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[left[free]]
            won = free & (self.keys[slot] == keys[left])
            self.place[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 for those that are not in the table."""
        mask = (1 << self.bits) - 1
        out = np.full(len(keys), -1, dtype=np.int64)
        left, slot = np.arange(len(keys)), self._hash(keys)
        while len(left):
            at = self.keys[slot]
            same = at == keys[left]
            out[left[same]] = self.place[slot[same]]
            on = ~same & (at != _EMPTY)
            left, slot = left[on], (slot[on] + 1) & mask
        return out


class XFastTrie:
    """Tries of many groups over `bits`-bit offsets. Leaves are sorted by group and offset and are distinct."""

    def __init__(self, group: np.ndarray, offset: np.ndarray, bits: int) -> None:
        self.group, self.offset, self.bits = group, offset, bits
        self.levels: dict[int, tuple[HashTable, np.ndarray, np.ndarray]] = {}

    def _level(self, length: int) -> tuple[HashTable, np.ndarray, np.ndarray]:
        """The table of prefixes of a length with the first and last leaf under each; made when first needed."""
        if length not in self.levels:
            key = (self.group << length) | (self.offset >> (self.bits - length))
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
            self.levels[length] = HashTable(key[head]), head, np.r_[head[1:], len(key)] - 1
        return self.levels[length]

    def neighbours(self, group: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of the largest offset <= and of the smallest offset >= each asked one in its group; -1 where none."""
        n = len(group)
        before, after = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        if not len(self.group) or not n:
            return before, after
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.bits, dtype=np.int64)
        table, _, _ = self._level(0)
        live = table.find(group) >= 0
        for _ in range(self.bits.bit_length()):
            mid = (low + high + 1) // 2
            for length in np.unique(mid[live & (low < high)]):
                ask = np.flatnonzero(live & (low < high) & (mid == length))
                there = self._level(int(length))[0].find((group[ask] << length) | (offset[ask] >> (self.bits - length))) >= 0
                low[ask[there]], high[ask[~there]] = length, length - 1
        for length in np.unique(low[live]):
            ask = np.flatnonzero(live & (low == length))
            table, first, last = self._level(int(length))
            node = table.find((group[ask] << length) | (offset[ask] >> (self.bits - length)))
            if length == self.bits:
                before[ask] = after[ask] = first[node]
                continue
            right = ((offset[ask] >> (self.bits - length - 1)) & 1).astype(bool)
            # The asked bit's branch is empty: all leaves of the node lie on the other side of the asked offset.
            before[ask] = np.where(right, last[node], first[node] - 1)
            after[ask] = before[ask] + 1
        inside = lambda leaf: np.where((leaf >= 0) & (leaf < len(self.group)) & live, leaf, -1)
        before, after = inside(before), inside(after)
        before[(before >= 0) & (self.group[before] != group)] = -1
        after[(after >= 0) & (self.group[after] != group)] = -1
        return before, after


def _match(frame: pd.DataFrame, bits: int, tolerance: int) -> pd.DataFrame:
    """Per asked (key, t) the nearest candidate of the frame's blocks within the tolerance."""
    gid = np.cumsum(starts(frame, PART)) - 1
    t, ask = frame["t"].to_numpy(np.int64), frame["ask"].to_numpy(bool)
    at = frame["at"].to_numpy(np.int64)
    offset = t - (frame["block"].to_numpy(np.int64) << bits)
    g, o, ids = gid[~ask], offset[~ask], frame["id"].to_numpy(np.int64)[~ask]
    trie = XFastTrie(g, o, bits)
    # A question outside of its block (its tolerance reaches in from a neighbour) asks at the block's edge.
    edge = np.clip(offset[ask], 0, (1 << bits) - 1)
    before, after = trie.neighbours(gid[ask], edge)
    asked, tc = at[ask], t[~ask]
    big = np.iinfo(np.int64).max
    gap = lambda leaf: np.where(leaf >= 0, np.abs(tc[leaf] - asked), big) if len(tc) else np.full(len(leaf), big)
    b, a = gap(before), gap(after)
    leaf = np.where(b <= a, before, after)  # of two equally near ones the earlier
    d = np.minimum(a, b)
    ok = d <= tolerance
    key = frame["key"].to_numpy()[ask][ok]
    return pd.DataFrame({"key": key, "at": asked[ok], "gap": d[ok], "t": tc[leaf[ok]], "id": ids[leaf[ok]]})


def _crowded(candidates: DataFrame, span_rows: int) -> DataFrame:
    """(key, block, bounds) of the blocks that are cut: sorted instants, each the first of a part.

    Those are the MOST_HOT largest of the blocks with more than `span_rows` candidates, in MOST_PARTS parts at most, which bounds
    what is broadcast; a block beyond them has less than 1 / MOST_HOT of all candidates and stays whole.
    """
    hot = candidates.groupBy("key", "block").agg(F.count("*").alias("n")).where(F.col("n") > span_rows).orderBy(F.desc("n"), "key", "block").limit(MOST_HOT)
    hot = hot.select(F.col("key").alias("hk"), F.col("block").alias("hb"), F.greatest(F.lit(1), F.floor(F.lit(MOST_PARTS * span_rows) / F.col("n"))).alias("step"))
    c = candidates.join(F.broadcast(hot), (F.col("key") == F.col("hk")) & (F.col("block") == F.col("hb")))
    cuts = F.percentile_approx("t", [i / MOST_PARTS for i in range(1, MOST_PARTS)], 10 * MOST_PARTS)
    c = c.groupBy("hk", "hb").agg(cuts.alias("q"), F.max("step").alias("step"))
    return c.select("hk", "hb", F.array_distinct(F.filter("q", lambda x, i: (i + 1) % F.col("step") == 0)).alias("bounds"))


def nearest_in_time(
    asked: DataFrame, candidates: DataFrame, *, key: str, asked_time: str, time: str, candidate_id: str,
    tolerance_days: float, candidate_key: str | None = None, span_rows: int = SPAN_ROWS,
) -> DataFrame:
    """`asked` with <candidate_id> of the candidate of the same key that is nearest in time, before or after it.

    Only candidates at most `tolerance_days` away count (inclusive). Of two equally near ones the earlier is taken, of
    several at the same time the smallest id. Asked rows without key or time, or without a candidate in reach, are left
    out; repeated asked rows have a row each; candidates without key, time or id never match. A column of `asked` that
    is called like the id is replaced. Ids are bigint; times are dates or naive timestamps, compared in microseconds.
    """
    tolerance = math.floor(tolerance_days * MICROS_PER_DAY)
    bits = max(1, tolerance.bit_length())
    e = asked.drop(candidate_id) if candidate_id in asked.columns else asked
    e = e.withColumns({"__key": F.col(key), "__at": micros(asked_time)}).where("__key is not null and __at is not null")
    ask = e.groupBy(F.col("__key").alias("key"), F.col("__at").alias("at")).agg(F.lit(True).alias("ask"))
    reach = lambda b: F.sequence(F.shiftright(F.col("at") - tolerance, b), F.shiftright(F.col("at") + tolerance, b))
    near = e.select(F.col("__at").alias("at")).distinct().select(F.explode(reach(_SIEVE_BITS)).alias("sieve")).distinct()
    c = candidates.select(F.col(candidate_key or key).alias("key"), micros(time).alias("t"), F.col(candidate_id).cast("bigint").alias("id"))
    c = c.where("key is not null and t is not null and id is not null").withColumn("sieve", F.shiftright("t", _SIEVE_BITS))
    c = c.join(F.broadcast(near), "sieve", "left_semi")
    # Counted before copies are merged: that needs no shuffle of candidates, and copies only make a part smaller.
    crowded = F.broadcast(_crowded(c.select("key", F.shiftright("t", bits).alias("block"), "t"), span_rows))
    c = c.groupBy("key", "t").agg(F.min("id").alias("id"))
    c = c.select("key", F.shiftright("t", bits).alias("block"), "t", F.lit(False).alias("ask"), "id", F.col("t").alias("at"))
    placed = lambda d: d.join(crowded, (F.col("key") == F.col("hk")) & (F.col("block") == F.col("hb")), "left").drop("hk", "hb")
    # The part of an instant is the number of bounds up to it. A bound is an instant itself, so each part but the first has one
    # and a question finds what comes before it in its own part, what comes after it there or in the next.
    part = F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col("t"))), F.lit(0))
    here = placed(c).withColumn("part", part).drop("bounds")
    there = placed(ask.select("key", F.explode(reach(bits)).alias("block"), F.col("at").alias("t"), "ask", F.lit(0).cast("bigint").alias("id"), "at"))
    there = there.withColumn("part", F.explode(F.array_distinct(F.array(part, F.least(part + 1, F.coalesce(F.size("bounds"), F.lit(0))))))).drop("bounds")
    rows = here.unionByName(there).repartition(*PART).sortWithinPartitions(*PART, "ask", "t")
    kind = c.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_keys(batches, PART, rows=200_000):
            yield _match(frame, bits, tolerance)

    found = rows.mapInPandas(work, f"key {kind}, at bigint, gap bigint, t bigint, id bigint")
    best = found.groupBy("key", "at").agg(F.min(F.struct("gap", "t", "id")).alias("x"))
    best = best.select(F.col("key").alias("__key"), F.col("at").alias("__at"), F.col("x.id").alias(candidate_id))
    return e.join(best, ["__key", "__at"]).drop("__key", "__at")
