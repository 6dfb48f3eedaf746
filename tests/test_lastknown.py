import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.lastknown import ROW, _hot, attributes_as_of, change_history

ROWS = "ticker string, period date, known timestamp_ntz, id bigint, a double, b double"
EV = "e bigint, ticker string, at timestamp_ntz, a string"
D, T = dt.date, dt.datetime


def match(spark, rows, events, attributes=("a", "b"), **kw):
    r, e = spark.createDataFrame(rows, ROWS), spark.createDataFrame(events, EV)
    out = attributes_as_of(e, r, event_key="ticker", event_time="at", row_key="ticker", known_at="known", latest_by=["period", "known"], tie="id", attributes=list(attributes), **kw)
    return {x["e"]: x.asDict() for x in out.collect()}


def test_attributes_are_matched_one_by_one_and_never_from_the_future(spark):
    rows = [
        ("x", D(2020, 3, 31), T(2020, 5, 1), 1, 1.0, 10.0),
        ("x", D(2020, 6, 30), T(2020, 8, 1), 2, 2.0, None),
        ("x", D(2020, 6, 30), T(2020, 9, 1), 3, float("nan"), 30.0),
        ("x", D(2020, 3, 31), T(2020, 10, 1), 4, 9.0, 90.0),
    ]
    ask = [(1, "x", T(2020, 4, 30, 23), "c"), (2, "x", T(2020, 5, 1), "c"), (3, "x", T(2020, 8, 15), "c"), (4, "x", T(2021, 1, 1), "c")]
    got = match(spark, rows, ask, sources=True)
    assert (got[1]["a"], got[1]["b"]) == (None, None)
    assert (got[2]["a"], got[2]["b"]) == (1.0, 10.0)
    assert (got[3]["a"], got[3]["a_from"], got[3]["b"], got[3]["b_from"]) == (2.0, 2, 10.0, 1)
    # The restated old quarter of October is known but describes an earlier period.
    assert (got[4]["a"], got[4]["b"], got[4]["b_from"]) == (2.0, 30.0, 3)


def test_ties_repeats_nulls_and_clashing_names(spark):
    rows = [("x", D(2020, 3, 31), T(2020, 5, 1), i, float(i), None) for i in (7, 5, 5, 6)]
    rows += [(None, D(2020, 3, 31), T(2020, 5, 1), 1, 1.0, 1.0), ("x", None, T(2020, 5, 1), 1, 1.0, 1.0), ("x", D(2020, 6, 30), None, 1, 1.0, 1.0)]
    ask = [(1, "x", T(2020, 6, 1), "c"), (2, "x", T(2020, 6, 1), "c"), (3, None, T(2020, 6, 1), "c"), (4, "x", None, "c"), (5, "y", T(2020, 6, 1), "c")]
    got = match(spark, rows, ask, attributes=[ROW, "a"])
    assert [got[i]["row_from"] for i in (1, 2, 3, 4, 5)] == [5, 5, None, None, None]
    assert got[1]["a"] == 5.0 and got[4]["a"] is None
    assert set(match(spark, rows, ask, attributes=[ROW], how="inner")) == {1, 2}


def test_age_bound_and_empty_tables(spark):
    rows = [("x", D(2010, 3, 31), T(2010, 5, 1), 1, 1.0, None)]
    ask = [(1, "x", T(2010, 5, 11), "c"), (2, "x", T(2010, 5, 11, 0, 0, 1), "c"), (3, "x", T(2024, 1, 1), "c")]
    got = match(spark, rows, ask, attributes=["a"], max_age_days=10)
    assert [got[i]["a"] for i in (1, 2, 3)] == [1.0, None, None]
    assert match(spark, rows, ask, attributes=["a"])[3]["a"] == 1.0
    assert match(spark, [], ask, attributes=["a"])[1]["a"] is None
    assert match(spark, rows, [], attributes=["a"]) == {}


def test_against_brute_force(spark):
    import random

    rng = random.Random(1)
    day = lambda a: T(2020, 1, 1) + dt.timedelta(days=rng.randint(0, a), hours=rng.randint(0, 23))
    rows = [(rng.choice("xxxxy"), D(2020, 1, 1) + dt.timedelta(days=91 * rng.randint(0, 9)), day(900), i, rng.choice([None, float(i)]), None) for i in range(300)]
    ask = [(i, rng.choice("xxyz"), day(1000), None) for i in range(200)]
    for span_rows in (1_000_000, 20):  # x has some 240 rows: with 20 it is cut into a dozen spans
        got = match(spark, rows, ask, attributes=["a"], span_rows=span_rows)
        for i, k, at, _ in ask:
            ok = [r for r in rows if r[0] == k and r[2] <= at and r[4] is not None]
            want = max(ok, key=lambda r: (r[1], r[2], -r[3]))[4] if ok else None
            assert got[i]["a"] == want


def test_a_key_with_most_rows_is_many_tasks(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, concat('k', id), 'hot') ticker", "id", "cast(id as double) a", "timestampadd(second, id, timestamp_ntz'2020-01-01') at")
    history = change_history(rows, "ticker", "at", ["at"], "id", ["a"])
    events = history.selectExpr("key", "t", "struct(t) e")
    (hot,) = _hot(history, events, 500).collect()
    assert hot["hk"] == "hot" and hot["spans"] > 20 and hot["parts"] == 1
    got = attributes_as_of(rows.selectExpr("ticker", "at", "id e"), rows, event_key="ticker", event_time="at", row_key="ticker", known_at="at", latest_by=["at"], tie="id", attributes=["a"], span_rows=500)
    assert got.where("a <> e or a is null").count() == 0 and got.count() == 20_000


def test_spans_without_rows_carry_what_was_known(spark):
    rows = [("x", D(2020, 1, 1), T(2020, 1, 1) + dt.timedelta(minutes=i), i, float(i), None) for i in range(40)] + [("x", D(2020, 1, 1), T(2021, 1, 1), 99, 99.0, None)]
    ask = [(i, "x", T(2020, 2 + i, 1), "c") for i in range(10)] + [(10, "x", T(2022, 1, 1), "c"), (11, "x", T(2019, 1, 1), "c")]
    got = match(spark, rows, ask, attributes=["a"], span_rows=5)  # nine spans, seven of them empty
    assert [got[i]["a"] for i in range(12)] == [39.0] * 10 + [99.0, None]


def test_many_events_at_one_instant_are_dealt_to_parts(spark):
    rows = spark.createDataFrame([("x", D(2020, 3, 31), T(2020, 5, 1), i, float(i), None) for i in range(3)], ROWS)
    events = spark.range(9000).selectExpr("id e", "'x' ticker", "timestamp_ntz'2020-06-01' at")
    history = change_history(rows, "ticker", "known", ["period"], "id", ["a"])
    (hot,) = _hot(history, events.selectExpr("ticker key", "1 t", "struct(e) e"), 1000).collect()
    assert (hot["spans"], hot["parts"]) == (1, 9)
    out = attributes_as_of(events, rows, event_key="ticker", event_time="at", row_key="ticker", known_at="known", latest_by=["period"], tie="id", attributes=["a"], span_rows=1000)
    assert out.where("a = 0.0").select("e").distinct().count() == 9000 == out.count()


def test_only_the_bounded_table_of_cut_keys_is_broadcast_by_hint(spark):
    df = spark.createDataFrame([("x", D(2020, 3, 31), T(2020, 5, 1), 1, 1.0, 1.0)], ROWS)
    e = spark.createDataFrame([(1, "x", T(2020, 5, 1), "c")], EV)
    out = attributes_as_of(e, df, event_key="ticker", event_time="at", row_key="ticker", known_at="known", latest_by=["period"], tie="id", attributes=["a"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan
    # Hints are on the table of split keys only (MOST_HOT rows at most), wherever it is joined.
    hinted = [line for line in plan.splitlines() if "strategy=broadcast" in line]
    assert hinted and all("hk#" in line or "#" in line and "key" in line for line in hinted)
    assert out.select(F.max("a")).first()[0] == 1.0
