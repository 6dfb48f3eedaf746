import random

import pytest

from tidemark.operators.profile import DriftRule, departures, masks, patterns, profile, value_mask, violations

S = "load long, x double, name string"


def table(spark, rows):
    return spark.createDataFrame(rows, S)


def test_profile_counts(spark):
    df = table(spark, [(1, 1.5, "a"), (1, 1.5, None), (1, None, "b"), (1, float("nan"), "b"), (1, float("inf"), "b"), (1, -2.0, "c"), (2, 0.0, "z")])
    got = {(r["load"], r["column_name"]): r.asDict() for r in profile(df, "load", ["x", "name"]).collect()}
    x = got[1, "x"]
    assert (x["n_rows"], x["n_missing"], x["n_null"], x["n_distinct"], x["top_count"]) == (6, 2, 1, 3, 2)
    assert (x["min_value"], x["max_value"], x["n_negative"], x["n_infinite"], x["sum_decimals"]) == (-2.0, float("inf"), 1, 1, 2)
    assert (got[1, "name"]["n_missing"], got[1, "name"]["n_distinct"], got[1, "name"]["top_count"]) == (1, 3, 3)
    assert (got[2, "x"]["n_zero"], got[2, "x"]["p50"]) == (1, 0.0)


def test_masks(spark):
    df = table(spark, [(1, v, n) for v, n in ((12.5, "Abc 12"), (-0.25, "ÄB-c"), (0.0, ""), (None, None), (float("nan"), "x"), (float("-inf"), "日本"), (100.0, "a1b"))])
    got = {(r["column_name"], r["mask"]) for r in masks(df, "load", ["x", "name"]).collect()}
    assert {m for c, m in got if c == "x"} == {"19.9", "-0.49", "0", "null", "nan", "-inf", "199"}
    assert {m for c, m in got if c == "name"} == {"Aa 9", "A-a", "", "null", "a", "a9a"}


def test_number_masks_show_sign_size_and_precision(spark):
    want = {1.0: "1", 20.5: "49.9", 0.05: "0.09", -0.00012: "-0.00019", 1e20: "1" + "9" * 20, 123456789.125: "199999999.999", 2.5e-9: "0.0000000049", 1e-12: "0", 1e30: "huge", 7.000000000001: "9"}
    df = spark.createDataFrame([(k,) for k in want], "x double")
    assert {r[0]: r[1] for r in df.select("x", value_mask(df["x"], df.schema["x"].dataType)).collect()} == want
    ints = spark.createDataFrame([(-1050,), (None,)], "x long")
    assert [r[0] for r in ints.select(value_mask(ints["x"], ints.schema["x"].dataType)).collect()] == ["-1999", "null"]


def test_rare_masks(spark):
    df = table(spark, [(1, 1.25, "ab")] * 2000 + [(1, 1.2, "A-9")])
    got = {(r["column_name"], r["mask"]): (r["dominant"], r["rare"], r["n"]) for r in patterns(df, ["x", "name"]).collect()}
    assert got["name", "a"] == (True, False, 2000) and got["name", "A-9"] == (False, True, 1)


def drift(spark, loads, column="departs", rule=DriftRule()):
    rows = [(k, v, None) for k, (_, vs) in loads.items() for v in vs]
    df = table(spark, rows)
    feeds = spark.createDataFrame([(k, f) for k, (f, _) in loads.items()], "load long, feed string")
    out = departures(profile(df, "load", ["x"]), masks(df, "load", ["x"]), feeds, "load", "feed", rule)
    return {r["load"] for r in out.collect() if r[column]}


@pytest.mark.parametrize("change", ["scale", "half missing", "zeros", "sign", "precision", "spread", "one value", "shift"])
def test_a_load_that_departs_is_found(spark, change):
    rng = random.Random(2)
    loads = {k: ("f", [round(rng.gauss(0.5, 0.1), 4) for _ in range(90)]) for k in range(12)}
    loads |= {k + 100: ("g", [round(rng.gauss(80, 10), 4) for _ in range(90)]) for k in range(12)}
    v = loads[5][1]
    new = {
        "scale": [x * 100 for x in v], "half missing": [x if i % 2 else None for i, x in enumerate(v)], "zeros": [x if i % 3 else 0.0 for i, x in enumerate(v)],
        "sign": [-x for x in v], "precision": [round(x, 1) for x in v], "spread": [0.5 + (x - 0.5) * 4 for x in v], "one value": [v[0]] * 90, "shift": [x + 0.3 for x in v],
    }[change]
    assert drift(spark, loads) == set()
    loads[5] = ("f", new)
    assert drift(spark, loads) == {5}
    if change != "shift":  # 0.5 and 0.8 have the same mask, so only the level shows it
        assert drift(spark, loads, "by_masks") == {5}


def test_masks_alone_find_every_load_of_the_tables(spark):
    """With the second signal off the same loads come out, and with the masks off too: they agree."""
    from tidemark.queries import quality

    x = [r for r in quality.p4_drift(spark, "/root/testdata/sf0.1").collect() if r["departs"]]
    assert len(x) == 50 and all(r["by_masks"] for r in x)


def test_violations_are_masks_that_other_loads_lack(spark):
    df = table(spark, [(k, 0.5 + i / 1000, None) for k in range(3) for i in range(50)] + [(1, 123.0, None), (1, None, None)])
    feeds = spark.createDataFrame([(k, "f") for k in range(3)], "load long, feed string")
    got = {(r["load"], r["mask"], r["n"], r["n_others"]) for r in violations(masks(df, "load", ["x"]), feeds, "load", "feed").collect()}
    assert got == {(1, "199", 1, 0), (1, "null", 1, 0)}


def test_small_loads_vary_more_by_chance(spark):
    rng = random.Random(6)
    loads = {k: ("f", [round(rng.lognormvariate(3, 0.6), 2) for _ in range(90 if k % 2 else 14)]) for k in range(30)}
    assert drift(spark, loads, "by_masks") == set()

def test_small_single_and_unnamed_loads(spark):
    rng = random.Random(4)
    loads = {k: ("f", [round(rng.gauss(0.5, 0.1), 4) for _ in range(60)]) for k in range(8)}
    loads[9] = ("f", [900.0] * 9)  # fewer than ten rows
    loads[10] = ("alone", [900.0] * 50)
    assert drift(spark, loads) == set()
    df = table(spark, [(None, 1.0, None), (3, None, None)])
    feeds = spark.createDataFrame([], "load long, feed string")
    assert departures(profile(df, "load", ["x"]), masks(df, "load", ["x"]), feeds, "load", "feed").count() >= 1
    empty = table(spark, [])
    assert departures(profile(empty, "load", ["x"]), masks(empty, "load", ["x"]), feeds, "load", "feed").count() == 0
