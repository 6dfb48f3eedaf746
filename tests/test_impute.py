from pyspark.sql import functions as F

from tidemark.functions.columns import real_number
from tidemark.operators import impute

S = "id long, ticker string, snap string, sector string, v double"


def test_fill_takes_the_finest_group_with_support(spark):
    rows = [(i, "x", "s1", "A", float(i)) for i in range(6)] + [(10, "x", "s1", "A", None), (11, "y", "s1", "A", None), (12, "z", "s2", "B", float("nan")), (13, None, "s1", None, -9999.0), (14, "y", "s1", "A", 999.99), (15, "y", "s3", "A", 120.0)]
    df = spark.createDataFrame(rows, S).withColumn("ok", real_number("v"))
    out = impute.fill(df, {"v": "ok"}, [("ticker", ["ticker"]), ("sector", ["snap", "sector"]), ("snapshot", ["snap"]), ("all", [])], support=5)
    got = {r["id"]: (r["v"], r["v_filled"], r["v_level"]) for r in out.collect()}
    assert got[10] == (2.0, True, "ticker") and got[11] == (2.0, True, "sector")
    assert got[12] == (3.0, True, "all") and got[13] == (2.0, True, "snapshot")
    assert got[3] == (3.0, False, None) and got[14] == (2.0, True, "sector")
    assert got[15] == (120.0, False, None)  # size alone makes no code: a ratio of 120 stays as it is
    assert len(got) == len(rows) and set(out.columns) == {*df.columns, "v_missing", "v_filled", "v_level"}
    assert {r["id"] for r in out.where("v_missing").collect()} == {10, 11, 12, 13, 14}


def test_mode_ties_and_nothing_to_fill_from(spark):
    df = spark.createDataFrame([(1, "x", "s", "B", 0.0), (2, "x", "s", "A", 0.0), (3, "x", "s", None, 0.0), (4, "q", "t", None, 0.0)], S)
    got = {r["id"]: (r["sector"], r["sector_filled"], r["sector_level"]) for r in impute.fill(df, {"sector": "sector"}, [("ticker", ["ticker"])], categorical=True, support=2).collect()}
    assert got[3] == ("A", True, "ticker") and got[4] == (None, False, None) and got[1] == ("B", False, None)
    empty = spark.createDataFrame([], S)
    assert impute.fill(empty, {"v": "v"}, [("all", [])]).count() == 0
    # Two numbers at once, repeated rows, and columns whose names clash with the marks.
    two = spark.createDataFrame([(1, "x", 1.0, None, "?"), (1, "x", 1.0, None, "?"), (2, "x", None, 5.0, "?"), (3, None, None, None, "?")], "id long, g string, a double, b double, a_level string")
    rows = impute.fill(two, {"a": "a", "b": "b"}, [("g", ["g"])], support=1).collect()
    assert sorted((r["id"], r["a"], r["b"], r["a_level"], r["b_level"]) for r in rows[:0] + [r for r in rows if r["id"] < 3]) == [(1, 1.0, 5.0, None, "g"), (1, 1.0, 5.0, None, "g"), (2, 1.0, 5.0, "g", None)]
    assert [(r["a"], r["a_missing"], r["a_filled"]) for r in rows if r["id"] == 3] == [(None, True, False)]


def test_unusable_cells(spark):
    words = ["Energy", " energy ", "", "  ", "n/a", "UNKNOWN", "?", None, "Bogus", "#N/A"]
    df = spark.createDataFrame([(i, w, v) for i, (w, v) in enumerate(zip(words, [1.0, 0.0, -4.0, float("nan"), None, float("inf"), 999.99, -999.0, 1e20, 2.0], strict=True))], "id long, sector string, v double")
    names = spark.createDataFrame([("Energy",), (None,), ("unknown",)], "sector string")
    p = impute.with_known_names(df, "sector", names, "named")
    p = p.withColumns({"ok": real_number("v"), "ok_s": impute.usable_name(F.col("sector"), F.col("named"))})
    p = impute.fill(p, {"v": "ok"}, [("all", [])])
    out = impute.unusable_cells(impute.fill(p, {"sector": "ok_s"}, [("all", [])], categorical=True), "id", ["v", "sector"])
    got = {tuple(r) for r in out.collect()}
    assert {i for i, f in got if f == "v"} == {3, 4, 5, 6, 7, 8}
    assert {i for i, f in got if f == "sector"} == set(range(2, 10))


def test_filled_panel_marks_every_cell_that_was_found(spark):
    from tidemark.queries.quality import p5_filled, p5_found

    sf = "/root/testdata/sf0.001"
    found = {tuple(r) for r in p5_found(spark, sf).collect()}
    rows = p5_filled(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/panel.parquet").count()
    for r in rows:
        for f in ("return_on_equity", "operating_margin", "sector", "as_of"):
            assert r[f"{f}_filled"] == ((r["panel_id"], f) in found and r[f] is not None)
            assert (r[f"{f}_level"] is not None) == r[f"{f}_filled"]
