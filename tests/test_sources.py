import datetime as dt
import json

import pytest

from tidemark.sources import ingest
from tidemark.streaming import snapshots

D, T = dt.date, dt.datetime


def test_series_from_json(spark):
    doc = {"series": {"quarterly": {"eps": [{"period": "2020-03-31", "v": 1.0}, {"period": "2020-06-30", "v": None}, {"period": "2020-03-31", "v": 9.0}], "other": [{"period": "2020-03-31", "v": 5}]}, "annual": {"eps": [{"period": "2019-12-31", "v": 1}], "pe": [{"period": "2019-12-31", "v": 2}]}}}
    raw = spark.createDataFrame([("x", json.dumps(doc)), ("y", "no json"), ("z", None)], "ticker string, payload string")
    got = ingest.quarterly_series(raw, {"eps": "eps", "peTTM": "trailing_pe"})
    assert got.columns == ["ticker", "period", "eps", "trailing_pe"]
    assert {(r["period"], r["eps"], r["trailing_pe"]) for r in got.collect()} == {(D(2020, 3, 31), 1.0, None), (D(2020, 6, 30), None, None)}
    assert [tuple(r) for r in ingest.year_ends(raw).collect()] == [("x", D(2019, 12, 31))]


def history(spark, **first):
    rows = [(t, d + dt.timedelta(days=i), 1.0) for t, d in first.items() for i in range(3)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def test_cache_rules(spark):
    tickers = spark.createDataFrame([("a",), ("b",), ("c",)], "ticker string")
    cached = history(spark, a=D(2024, 1, 1), b=D(2023, 1, 1))
    assert {r[0] for r in ingest.stale_tickers(cached, tickers, "2024-01-06", ["close"]).collect()} == {"b", "c"}
    assert ingest.stale_tickers(cached, tickers, "2024-01-06", ["close_raw"]).count() == 3
    cached = history(spark, a=D(2010, 1, 1), b=D(2010, 1, 1), c=D(2010, 1, 1))
    new = history(spark, a=D(2010, 6, 1), b=D(2020, 1, 1), d=D(2020, 1, 1))
    got = {r["ticker"]: r["d"] for r in ingest.merged_history(cached, new).groupBy("ticker").agg({"date": "min"}).withColumnRenamed("min(date)", "d").collect()}
    assert got == {"a": D(2010, 6, 1), "b": D(2010, 1, 1), "c": D(2010, 1, 1), "d": D(2020, 1, 1)}


def test_retry():
    waits, calls = [], []

    def call(n):
        calls.append(1)
        if len(calls) < n:
            raise OSError("again")
        return "ok"

    assert ingest.with_retry(lambda: call(3), lambda e: True, (1, 2, 3), waits.append) == "ok" and waits == [1, 2]
    calls.clear()
    with pytest.raises(OSError):
        ingest.with_retry(lambda: call(9), lambda e: True, (1, 2, 3), waits.append)
    assert len(calls) == 4
    calls.clear()
    with pytest.raises(OSError):
        ingest.with_retry(lambda: call(9), lambda e: False, (1, 2, 3), waits.append)
    assert len(calls) == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("가", D(2020, 1, 1), 1.0), ("b", D(2021, 1, 1), 2.0)], "ticker string, as_of date, x double")
    assert ingest.write_report(df, str(tmp_path / "r.csv")) == 2 and (tmp_path / "r.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    ingest.write_panel(df, str(tmp_path / "p"))
    one = spark.read.parquet(str(tmp_path / "p")).where("as_of = date'2021-01-01'")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(as_of" in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        ingest.write_report(df, str(tmp_path / "r.csv"), 1)
    ingest.write_prices(history(spark, a=D(2010, 1, 1)), str(tmp_path / "q"), 4)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 3
    ref = spark.createDataFrame([("b", 2.1)], "ticker string, x double")
    assert ingest.compare_with_reference(df, ref, "x").first()["close"]


def quotes(spark, path, rows):
    spark.createDataFrame(rows, snapshots.QUOTE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_of_quotes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    q = lambda i, t, d, c: (i, t, d, c, c, 1.0, 0.0)
    quotes(spark, src, [q(1, "a", T(2024, 1, 1, 10), 5.0), q(2, "a", T(2024, 1, 1, 12), 6.0), q(2, "a", T(2024, 1, 1, 12), 6.0), q(3, None, T(2024, 1, 1), 1.0), q(4, "b", T(2024, 1, 1), float("nan"))])
    stream = lambda: spark.readStream.schema(snapshots.QUOTE_SCHEMA).parquet(src)
    snapshots.run_latest(stream(), out, ck).awaitTermination()
    quotes(spark, src, [q(5, "a", T(2024, 1, 1, 11), 9.0), q(6, "c", T(2024, 1, 2), 7.0), q(2, "a", T(2024, 1, 1, 12), 6.0)])
    snapshots.run_latest(stream(), out, ck).awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[2:]))
    assert {(r["ticker"], r["close"]) for r in spark.read.parquet(str(last)).collect()} == {("a", 6.0), ("c", 7.0)}
    batch = snapshots.daily_bars(spark.read.schema(snapshots.QUOTE_SCHEMA).parquet(src).where("close > 0 and not isnan(close) and ticker is not null").dropDuplicates(["price_id"]))
    assert {(r["ticker"], r["day"], r["close"], r["n"]) for r in batch.collect()} == {("a", D(2024, 1, 1), 6.0, 3), ("c", D(2024, 1, 2), 7.0, 1)}


def test_collection_is_cache_first(spark):
    S = "ticker string, date date, close double"
    day = lambda m, d: dt.date(2024, m, d)
    cached = spark.createDataFrame([("fresh", day(6, 27), 1.0), ("old", day(1, 2), 2.0), ("lost", day(1, 3), 3.0)], S)
    tickers = spark.createDataFrame([("fresh",), ("old",), ("lost",), ("new",), ("gone",)], "ticker string")
    asked = []

    def fetch(ask):
        asked.extend(r["ticker"] for r in ask.collect())
        return spark.createDataFrame([("old", day(6, 28), 20.0), ("old", day(1, 2), 19.0), ("new", day(6, 28), 5.0)], S)

    history, failed = ingest.collect(cached, tickers, fetch, "2024-06-28", ["close"])
    assert sorted(asked) == ["gone", "lost", "new", "old"]
    got = {(r["ticker"], r["date"]): r["close"] for r in history.collect()}
    assert got == {("fresh", day(6, 27)): 1.0, ("old", day(6, 28)): 20.0, ("old", day(1, 2)): 19.0, ("lost", day(1, 3)): 3.0, ("new", day(6, 28)): 5.0}
    assert [r["ticker"] for r in failed.collect()] == ["gone"]


def test_fetched_prices_have_one_schema(spark):
    rows = spark.createDataFrame([("A.B", "2024-01-02", 5.0, 7)], "ticker string, date string, close double, volume long")
    r = ingest.raw_prices(rows).first()
    assert (r["date"], r["close_raw"], r["volume"], r["dividend"]) == (dt.date(2024, 1, 2), 5.0, 7.0, 0.0)
    assert ingest.raw_prices(rows.limit(0)).dtypes == ingest.raw_prices(rows).dtypes
    assert ingest.price_symbols(rows).first()["symbol"] == "A-B"


def test_report_file_is_named_by_its_date(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2024, 4, 1))], "ticker string, as_of date")
    ingest.write_report(df, str(tmp_path / "r_{date}.csv"))
    assert (tmp_path / "r_2024-04-01.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_stored_tables_are_deleted(spark):
    import os

    from tidemark.sources import tables

    before = list(tables._stored)
    tables._stored.clear()
    assert tables.cut(spark.range(5)).count() == 5
    (name,) = tables._stored
    assert os.path.exists(name.removeprefix("file:")) and tables.release() == 1 and not os.path.exists(name.removeprefix("file:"))
    tables._stored.extend(before)


def test_frozen_members_and_pages(spark, tmp_path):
    from tidemark.operators import universe

    (tmp_path / "m.csv").write_text("ticker,name,sector\nA,Alpha,Energy\n")
    assert universe.read_members(spark, str(tmp_path / "m.csv")).first().asDict() == {"ticker": "A", "name": "Alpha", "sector": "Energy"}
    page = "<table><tr><th>Symbol</th><th>GICS Sub-Industry</th></tr><tr><td>a</td><td>{}</td></tr></table>"
    one, two = (universe.sub_industries(spark, page.format(x)) for x in ("Oil", "Gas"))
    assert universe.first_page_wins([one, two]).first()["sub_industry"] == "Oil" and universe.sub_industries(spark, "<p>").count() == 0
