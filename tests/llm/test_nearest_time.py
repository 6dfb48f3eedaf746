import bisect
import datetime as dt
import random

import numpy as np

from tidemark.llm.nearest_time import HashTable, XFastTrie, nearest_in_time

T = dt.datetime
Q, C = "row long, k string, at timestamp_ntz, cid string", "cid long, k string, t timestamp_ntz"


def match(spark, ask, cand, days=10):
    out = nearest_in_time(spark.createDataFrame(ask, Q), spark.createDataFrame(cand, C), key="k", asked_time="at", time="t", candidate_id="cid", tolerance_days=days)
    assert out.columns == ["row", "k", "at", "cid"]
    return sorted((r["row"], r["cid"]) for r in out.collect())


def test_hash_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**60, 5000))
    t = HashTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys[1:] - 1)[np.diff(keys) > 1] == -1).all()
    assert (HashTable(np.zeros(0, dtype=np.int64)).find(np.array([3])) == -1).all()


def test_trie_against_bisect():
    rng = random.Random(1)
    for bits in (1, 3, 9, 40):
        groups = {g: sorted({rng.randrange(1 << bits) for _ in range(rng.randint(0, 30))}) for g in range(6)}
        g = np.array([k for k, v in groups.items() for _ in v], dtype=np.int64)
        o = np.array([x for v in groups.values() for x in v], dtype=np.int64)
        ask = [(rng.randrange(7), rng.choice([rng.randrange(1 << bits), *(groups[0] or [0])])) for _ in range(300)]
        before, after = XFastTrie(g, o, bits).neighbours(np.array([a for a, _ in ask]), np.array([b for _, b in ask]))
        for (a, b), x, y in zip(ask, before, after, strict=True):
            v = groups.get(a, [])
            i = bisect.bisect_right(v, b)
            assert (o[x] if x >= 0 else None) == (v[i - 1] if i else None)
            j = bisect.bisect_left(v, b)
            assert (o[y] if y >= 0 else None) == (v[j] if j < len(v) else None)


def test_bounds_ties_and_repeats(spark):
    at = T(2020, 6, 1)
    d = dt.timedelta
    cand = [(1, "a", at - d(days=10)), (2, "b", at + d(days=10, microseconds=1)), (3, "c", at - d(hours=1)), (4, "c", at + d(hours=1)), (9, "d", at + d(1)), (8, "d", at + d(1)), (8, "d", at + d(1)), (5, "e", at)]
    ask = [(i, k, at, "x") for i, k in enumerate("abcdef")] + [(10, "c", at, "x"), (10, "c", at, "x")]
    assert match(spark, ask, cand) == [(0, 1), (2, 3), (3, 8), (4, 5), (10, 3), (10, 3)]


def test_nulls_and_empty(spark):
    at = T(2020, 6, 1)
    assert match(spark, [], [(1, "a", at)]) == [] and match(spark, [(1, "a", at, None)], []) == []
    cand = [(1, None, at), (2, "a", None), (None, "a", at), (3, "a", at + dt.timedelta(days=2))]
    assert match(spark, [(1, "a", at, None), (2, None, at, None), (3, "a", None, None)], cand) == [(1, 3)]


def test_against_brute_force_with_a_hot_entity(spark):
    rng = random.Random(4)
    base = T(1999, 12, 20)
    when = lambda: base + dt.timedelta(microseconds=rng.randrange(400 * 86_400_000_000))
    cand = [(i, "hot" if i % 3 else rng.choice("xyz"), when()) for i in range(900)]
    ask = [(i, rng.choice(["hot", "x", "y"]), when().replace(hour=0, minute=0, second=0, microsecond=0), None) for i in range(300)]
    want = []
    for row, k, at, _ in ask:
        near = [(abs(t - at), t, c) for c, kk, t in cand if kk == k and abs(t - at) <= dt.timedelta(days=3)]
        if near:
            want.append((row, min(near)[2]))
    assert match(spark, ask, cand, 3) == sorted(want)


def test_a_crowded_block_is_split_over_tasks(spark):
    """A million instants of one entity within one block (two days), most of them in its first hour."""
    from tidemark.llm import nearest_time as nt

    base, day = 1_592_000_000_000_000 >> 40 << 40, 86_400_000_000
    us = f"{base} + case when id < 900000 then id * 4000 else 3600000000 + (id - 900000) * 1692000 end"
    cand = spark.range(1_000_000).selectExpr("id cid", "'hot' k", f"timestampadd(microsecond, {us}, timestamp_ntz'1970-01-01') t")
    ask = spark.range(500).selectExpr("id row", "'hot' k", f"timestampadd(microsecond, {base} - 1000000 + id * {2 * day // 499}, timestamp_ntz'1970-01-01') at")
    c = cand.selectExpr("k key", f"shiftright({us.replace('id', 'cid')}, 40) block", f"{us.replace('id', 'cid')} t")
    (hot,) = nt._crowded(c, 100_000).collect()
    assert 9 <= len(hot["bounds"]) <= 20 and hot["bounds"] == sorted(set(hot["bounds"]))
    got = {r["row"]: r["cid"] for r in nearest_in_time(ask, cand, key="k", asked_time="at", time="t", candidate_id="cid", tolerance_days=10, span_rows=100_000).collect()}
    times = np.r_[np.arange(900_000) * 4000, 3_600_000_000 + np.arange(100_000) * 1_692_000]
    for row in range(500):
        d = np.abs(times - (row * (2 * day // 499) - 1_000_000))
        assert got[row] == int(np.argmin(d))


def test_cut_blocks_give_the_same_as_whole_ones(spark):
    rng = random.Random(12)
    base = T(2020, 1, 1)
    when = lambda days: base + dt.timedelta(microseconds=rng.randrange(days * 86_400_000_000))
    cand = [(i, rng.choice("hhhhx"), when(30) if i % 2 else base + dt.timedelta(microseconds=rng.randrange(10**7))) for i in range(1500)]
    ask = [(i, rng.choice("hxq"), when(40), None) for i in range(200)]
    q, c = spark.createDataFrame(ask, Q), spark.createDataFrame(cand, C)
    run = lambda n: sorted((r["row"], r["cid"]) for r in nearest_in_time(q, c, key="k", asked_time="at", time="t", candidate_id="cid", tolerance_days=4, span_rows=n).collect())
    assert run(20) == run(10**6)


def test_p1_against_sql(spark):
    from tests.oracle import connect, difference
    from tidemark.llm.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    assert not difference(QUERIES["p1_found"](spark, sf).toPandas(), connect(sf).execute(ORACLE["p1_found"]).df())
