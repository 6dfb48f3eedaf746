import collections
from random import Random

import numpy as np
import pytest

from tidemark.llm import mix


def test_plan_shares_caps_and_missing_sources():
    plans = {p.source: p for p in mix.plan_mix([("a", 30.0, 1), ("b", 60.0, 4), ("gone", 10.0, 3), ("off", 0.0, 3)], {"a": 1000, "b": 300, "c": 5})}
    # b can give 1200 tokens at most for two thirds: the mix has 1800.
    assert plans["a"].share == pytest.approx(1 / 3) and plans["a"].target == pytest.approx(600)
    assert (plans["a"].whole, plans["a"].chance) == (0, pytest.approx(0.6)) and (plans["b"].whole, plans["b"].chance) == (4, 0.0)
    assert plans["gone"].share == 0 and plans["off"].whole == 0
    big = {p.source: p for p in mix.plan_mix([("a", 1.0, 1), ("b", 1.0, 4)], {"a": 1000, "b": 300}, total=4000)}
    assert (big["a"].whole, big["b"].whole) == (1, 4)
    assert mix.plan_mix([], {}) == []


def fly(units, seed):
    """Chances after the whole flight and landing of units (size, chance), and how many were open before the landing."""
    order = sorted(range(len(units)), key=lambda i: -units[i][0])
    t, p = np.array([units[i][0] for i in order], dtype=float), np.array([units[i][1] for i in order])
    rng = np.random.default_rng(seed)
    mix.fly(t, p, rng)
    before = ((p > 0) & (p < 1)).sum()
    mix.land(t, p, rng)
    return dict(zip(order, p, strict=True)), before


def test_cube_keeps_number_tokens_and_chances():
    rng = Random(1)
    units = [(rng.randint(1, 400), 0.3) for _ in range(200)]
    want_n, want_t = 60, 0.3 * sum(t for t, _ in units)
    hits = collections.Counter()
    for seed in range(1500):
        got, before = fly(units, seed)
        assert before <= 2 and set(got.values()) <= {0.0, 1.0}
        assert abs(sum(got.values()) - want_n) <= 8  # the last units give up the number for the tokens
        assert abs(sum(units[i][0] for i, x in got.items() if x) - want_t) <= 30
        hits.update(i for i, x in got.items() if x)
    assert all(abs(hits[i] / 1500 - 0.3) < 0.07 for i in range(200))


def test_very_uneven_sizes_leave_a_small_rest():
    """Sizes from 1 to 40,000: the tokens that miss are fewer than the median document has."""
    rng = Random(3)
    units = [(max(1, int(rng.lognormvariate(5.5, 1.6))), 0.37) for _ in range(5000)]
    median = sorted(t for t, _ in units)[2500]
    assert max(t for t, _ in units) > 100 * median
    want = 0.37 * sum(t for t, _ in units)
    for seed in range(40):
        got, _ = fly(units, seed)
        assert abs(sum(units[i][0] for i, x in got.items() if x) - want) < median


def test_equal_sizes_and_few_units():
    for n in range(5):
        for s in range(50):
            got, before = fly([(7, 0.5) for _ in range(n)], s)
            assert len(got) == n and before <= 2 and set(got.values()) <= {0.0, 1.0}
    assert all(sum(fly([(7, 0.25) for _ in range(40)], s)[0].values()) == 10 for s in range(20))
    # One large unit among units of one size: they make up for its tokens.
    for s in range(20):
        got, _ = fly([(300, 0.5)] + [(7, 0.5)] * 99, s)
        assert abs(300 * got[0] + 7 * (sum(got.values()) - got[0]) - 496.5) <= 7


def test_groups_fly_at_once_and_keep_both_sums():
    rng = np.random.default_rng(0)
    t = np.sort(rng.integers(100, 140, 1000))[::-1].astype(float)
    p = np.full(1000, 0.4)
    mix.fly_groups(t, p, rng, 50)
    assert ((p > 0) & (p < 1)).reshape(20, 50).sum(1).max() <= 2
    assert np.allclose(p.reshape(20, 50).sum(1), 20) and np.allclose((p * t).reshape(20, 50).sum(1), 0.4 * t.reshape(20, 50).sum(1))


def docs(spark, rows):
    from tidemark.sources.tables import cut

    return cut(spark.createDataFrame(rows, "doc_id long, source string, tokens long"))


def test_mixed_shares_and_repeats(spark):
    rng = Random(2)
    rows = [(i, "big", rng.randint(1, 900)) for i in range(3000)] + [(10_000 + i, "small", rng.randint(1, 900)) for i in range(60)]
    rows += [(20_000, None, 50), (20_001, "untargeted", 50), (20_002, "big", 0), (20_003, "small", 0)]
    targets = spark.createDataFrame([("big", 3.0, 2), ("small", 1.0, 5), ("absent", 1.0, 2)], "source string, weight double, max_repeats int")
    d = docs(spark, rows).repartition(5)
    from tidemark.sources.tables import cut

    d = cut(d)
    plans = mix.plans_for(d, targets)
    m = mix.mixed(d, plans, "doc_id", seed=3)
    got = {r["doc_id"]: r for r in m.collect()}
    assert len(got) == len(rows)
    assert all(got[i]["uses"] == 0 for i in (20_000, 20_001, 20_002, 20_003))
    assert all(r["uses"] <= {"big": 2, "small": 5}.get(r["source"], 0) for r in got.values())
    s = {r["source"]: r for r in mix.shares(m, plans).collect()}
    assert s["big"]["actual_share"] == pytest.approx(0.75, abs=0.004) and s["small"]["actual_share"] == pytest.approx(0.25, abs=0.004)
    assert s["absent"]["actual_share"] == 0 and s["absent"]["n_docs"] == 0 and s[None]["n_docs"] == 1 and s["untargeted"]["target_share"] == 0
    # The same uses come out however the rows lie.
    again = {r["doc_id"]: r["uses"] for r in mix.mixed(d.repartition(3, "tokens").orderBy("tokens"), plans, "doc_id", seed=3).collect()}
    assert again == {k: r["uses"] for k, r in got.items()}
    other = {r["doc_id"]: r["uses"] for r in mix.mixed(d, plans, "doc_id", seed=4).collect()}
    assert other != again


def test_a_large_source_is_many_cells(spark, monkeypatch):
    monkeypatch.setattr(mix, "CELL", 500)
    rng = Random(8)
    d = docs(spark, [(i, "hot", rng.randint(1, 2000)) for i in range(6000)] + [(10_000 + i, "other", 900) for i in range(3000)])
    plans = mix.plans_for(d, spark.createDataFrame([("hot", 1.0, 1), ("other", 2.0, 1)], "source string, weight double, max_repeats int"))
    rows = mix.mixed(d, plans, "doc_id", seed=1).collect()
    hot = sum(r["tokens"] * r["uses"] for r in rows if r["source"] == "hot")
    assert abs(hot - plans[0].target) < 50 and len(rows) == 9000


def test_empty_tables_and_bad_targets(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    none = docs(spark, [])
    plans = mix.plans_for(none, targets)
    assert mix.mixed(none, plans, "doc_id").count() == 0 and mix.shares(mix.mixed(none, plans, "doc_id"), plans).count() == 1
    d = docs(spark, [(1, "a", 5)])
    assert mix.mixed(d, mix.plans_for(d, targets.limit(0)), "doc_id").first()["uses"] == 0
    with pytest.raises(ValueError):
        mix.read_targets(targets.union(targets))


def test_every_source_misses_its_tokens_by_less_than_its_median_document(spark):
    from tidemark.llm import queries
    from tidemark.sources.tables import read

    sf = "/root/testdata/sf0.1"
    sized = queries._sized(spark, sf)
    plans = mix.plans_for(sized, read(spark, sf, "mix_targets"))
    rows = mix.mixed(sized, plans, "doc_id").toPandas()
    assert len(rows) == 10_000
    for p in plans:
        mine = rows[(rows["source"] == p.source) & (rows["tokens"] > 0)]
        if p.chance > 0:
            assert abs((mine["tokens"] * mine["uses"]).sum() - p.target) < mine["tokens"].median()


def test_p7_over_the_tables(spark):
    from tidemark.llm.queries import p7_shares

    rows = {r["source"]: r for r in p7_shares(spark, "/root/testdata/sf0.01").collect()}
    total = sum(r["target_share"] for r in rows.values())
    assert total == pytest.approx(1)
    for r in rows.values():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01
        assert r["most_uses"] <= (r["max_repeats"] or 0)
