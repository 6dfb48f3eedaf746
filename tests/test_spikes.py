import math
import random

import numpy as np
import pandas as pd

from tidemark.functions.columns import filler_code, real_number
from tidemark.operators import spikes
from tidemark.operators.spikes import SpikeRule, gpd_cutoff, unusual_readings

S = "source string, t bigint, season int, v double"


def found(spark, rows):
    df = spark.createDataFrame(rows, S)
    return {(r["source"], r["t"], r["v"]) for r in unusual_readings(df, ["source"]).collect()}


def series(name, values):
    return [(name, i, i % 4, v) for i, v in enumerate(values)]


def level(rng, n, base=5.0, noise=0.05):
    return [base * math.exp(rng.gauss(0, noise)) for _ in range(n)]


def test_spikes_of_one_or_two_readings_are_found_and_changes_of_level_are_not(spark):
    rng = random.Random(3)
    a = level(rng, 40)
    a[12], a[25], a[26] = 500.0, 0.4, 0.41
    b = level(rng, 20) + level(rng, 20, base=25.0)
    seasonal = [x * (6 if i % 4 == 3 else 1) for i, x in enumerate(level(rng, 40))]
    noisy = level(rng, 40, noise=0.6)
    three = level(rng, 40)
    three[20:23] = [50.0, 51.0, 50.5]
    got = found(spark, series("a", a) + series("b", b) + series("s", seasonal) + series("n", noisy) + series("three", three))
    assert {(s, t) for s, t, _ in got} == {("a", 12), ("a", 25), ("a", 26)}


def test_losses_and_signs(spark):
    rng = random.Random(5)
    loss = [rng.gauss(0.2, 0.4) for _ in range(40)]
    plain = [rng.gauss(2.0, 0.1) for _ in range(40)]
    plain[10] = -60.0
    got = found(spark, series("loss", loss) + series("plain", plain))
    assert {(s, t) for s, t, _ in got} == {("plain", 10)}


def test_each_version_of_a_time_counts_by_its_own_value(spark):
    rng = random.Random(7)
    a = series("a", level(rng, 30))
    got = found(spark, [*a, ("a", 15, 3, 700.0), ("a", 15, 3, 700.0), ("a", 15, 3, 5.01)])
    assert got == {("a", 15, 700.0)}


def test_stuck_values(spark):
    rng = random.Random(9)
    a = [round(x, 4) for x in level(rng, 30)]
    a[10:15] = [a[10]] * 5
    a[20:23] = [a[20]] * 3
    coarse = [rng.choice([0.1, 0.2]) for _ in range(40)]
    got = found(spark, series("a", a) + series("c", coarse) + series("const", [3.0] * 20))
    assert {(s, t) for s, t, _ in got} == {("a", t) for t in (11, 12, 13, 14)}
    # A missing reading in between is skipped.
    gap = series("a", a)
    gap[12] = ("a", 12, 0, None)
    assert {t for _, t, _ in found(spark, gap)} == {11, 13, 14}


def test_nulls_empty_and_short(spark):
    assert found(spark, []) == set()
    rows = [(None, 1, 0, 1.0), ("a", None, 0, 1.0), ("a", 1, 0, None), ("a", 2, 0, float("nan")), ("a", 3, 0, float("inf")), ("b", 1, 0, 1.0), ("c", 1, 0, 1.0), ("c", 2, 0, 900.0)]
    assert found(spark, rows) == set()


def test_filler_codes(spark):
    rows = [(x,) for x in (999.99, -9999.0, 99999.0, 1e9, 9999999.0, -999.0, 1e20, 99.0, 9.99, 5.0, 1000.0, 998.0, 1234567.0, None, float("nan"))]
    df = spark.createDataFrame(rows, "v double")
    got = [r[0] for r in df.select(filler_code(df["v"])).collect()]
    assert got == [True, True, True, True, True, True, True] + [False] * 8
    kept = [r[0] for r in spark.createDataFrame([(9012.78,), (73873.07,), (-120.0,), (9999.0,), (float("-inf"),), (float("nan"),), (None,)], "v double").select(real_number("v")).collect()]
    assert kept == [9012.78, 73873.07, -120.0, None, None, None, None]


def test_tail_cutoff_keeps_its_risk():
    rng = np.random.default_rng(0)
    e = np.abs(rng.normal(size=(200, 400)))
    cut = gpd_cutoff(e, np.ones_like(e, dtype=bool), np.ones(200), SpikeRule(risk=1e-3))
    share = (np.abs(rng.normal(size=(200, 5000))) > cut[:, None]).mean()
    assert 1e-4 < share < 4e-3


def test_the_fitted_tail_alone_decides():
    """The same deviation is a spike at a source of thin tail and none at a source whose own readings reach as far."""
    rng = np.random.default_rng(4)
    thin, heavy = rng.normal(10, 0.2, 48), rng.normal(10, 0.2, 48)
    heavy[::8] += rng.choice([-1.5, 1.5], 6)
    thin[21] = heavy[21] = 11.9
    f = pd.concat([pd.DataFrame({"source": s, "t": range(48), "season": np.arange(48) % 4, "v": v}) for s, v in (("thin", thin), ("heavy", heavy))])
    assert set(map(tuple, spikes._scan(f, ["source"], SpikeRule())[["source", "t"]].to_numpy().tolist())) == {("thin", 21)}
    e = np.abs(np.stack([thin, heavy]) - 10)
    cut = gpd_cutoff(e, np.ones_like(e, dtype=bool), np.full(2, 0.2), SpikeRule())
    assert cut[0] < 1.9 < cut[1]


def test_coarse_steps_are_not_stuck_even_if_the_level_hardly_moves():
    rng = np.random.default_rng(8)
    quiet = np.round(rng.normal(0.85, 0.03, 60), 1)  # long runs of 0.9 and 0.8
    fine = np.round(rng.normal(5, 0.5, 60), 3)
    fine[30:36] = fine[30]
    v = np.r_[quiet, fine]
    f = pd.DataFrame({"source": ["q"] * 60 + ["f"] * 60, "t": [*range(60)] * 2, "season": 0, "v": v})
    assert set(map(tuple, spikes._scan(f, ["source"], SpikeRule())[["source", "t"]].to_numpy().tolist())) == {("f", t) for t in range(31, 36)}
    assert spikes.reporting_step(np.array([[0.25, 0.5, 1.0, np.nan], [0.1, 0.3, 0.2, 0.7], [3.0, 3.0, 3.0, 3.0]])).tolist() == [0.25, 0.1, 1.0]


def test_long_sources_and_short_ones_in_one_frame():
    """A source of 20,000 readings with one spike among many short ones; repeated runs give the same."""
    rng = np.random.default_rng(2)
    long = rng.normal(50, 1, 20_000)
    long[7777] = 500
    parts = [pd.DataFrame({"source": "long", "t": range(20_000), "season": 0, "v": long})]
    parts += [pd.DataFrame({"source": f"s{i}", "t": range(12), "season": 0, "v": rng.normal(5, 0.1, 12)}) for i in range(300)]
    got = spikes._scan(pd.concat(parts), ["source"], SpikeRule())
    assert ("long", 7777) in set(map(tuple, got[["source", "t"]].to_numpy().tolist())) and (got["source"] == "long").sum() < 10


def test_p2_finds_planted_readings_in_the_tables(spark, tmp_path):
    """Spikes planted into clean copies of the tables come out through the query, nothing else of the company does."""
    from tidemark.queries.quality import p2_found

    rng = random.Random(11)
    base = "timestamp_ntz'2015-03-31 00:00:00'"
    v = level(rng, 32)
    f = spark.createDataFrame([(i, "x", i, v[i] if i != 9 else 4000.0, 9.0 + rng.random()) for i in range(32)], "fund_id long, ticker string, k int, eps double, sales_per_share double")
    f = f.selectExpr("fund_id", "ticker", f"cast(add_months({base}, 3 * k) as date) period", "eps", "case when fund_id = 4 then -1.0 else sales_per_share end sales_per_share")
    f.write.parquet(str(tmp_path / "fundamentals.parquet"))
    p = spark.createDataFrame([(100 + i, "x", i, 2.0 + rng.random() / 10, 5.0) for i in range(12)] + [(200, None, 3, 0.0, 5.0), (201, "x", None, 99999.0, None)], "panel_id long, ticker string, k int, price_to_book double, book_value double")
    p.selectExpr("panel_id", "ticker", f"cast(add_months({base}, 3 * k) as timestamp_ntz) as_of", "price_to_book", "book_value").write.parquet(str(tmp_path / "panel.parquet"))
    got = {tuple(r) for r in p2_found(spark, str(tmp_path)).collect()}
    assert got == {("fundamentals", 9, "eps"), ("fundamentals", 4, "sales_per_share"), ("panel", 200, "price_to_book"), ("panel", 201, "price_to_book")}
