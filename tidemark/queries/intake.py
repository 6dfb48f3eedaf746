"""Queries of ingestion and of the universe: payloads, caches and pages are made of the tables, and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import finite
from tidemark.operators import universe
from tidemark.queries.sql import DAILY, QUARTERS, with_
from tidemark.sources import ingest
from tidemark.sources.tables import by_day, by_quarter, read

SERIES = {"pe": "trailing_pe", "roe": "return_on_equity", "eps": "eps", "never": "not_reported"}
PAGE = """<table><tr><th>Year</th></tr></table><table><tr><th>Ticker symbol</th><th>Company</th><th>GICS Sector</th><th>GICS Sub-Industry</th></tr>
<tr><td> aaa </td><td>Alpha &amp; Co</td><td>Information Technology</td><td>Software</td></tr><tr><td>AAA</td><td>again</td><td>Energy</td><td>Oil</td></tr>
<tr><td>brk.b</td><td>Beta</td><td>Health Care</td><td>Devices</td></tr><tr><td>9x</td><td>none</td><td>Energy</td><td>Oil</td></tr><tr><td>C-D</td><td>Gamma</td><td>Energy</td><td>Gas</td></tr></table>"""
LATER_PAGE = """<table><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>GICS Sub-Industry</th></tr>
<tr><td>AAA</td><td>Alpha</td><td>Energy</td><td>Coal</td></tr><tr><td>E</td><td>Epsilon</td><td>Utilities</td><td>Water</td></tr></table>"""


def s01_price_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched rows without dividends or quoted prices, typed (S1), and the symbols they are fetched by."""
    rows = ingest.raw_prices(read(spark, sf, "prices").select("ticker", "date", "close", "volume").where("ticker is not null"))
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.max("dividend").alias("most_paid"), F.count_if(F.col("close").eqNullSafe(F.col("close_raw"))).alias("same")).join(ingest.price_symbols(read(spark, sf, "universe")), "ticker")


def s02_payload_quarters(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly series written as JSON payloads, one per ticker, and read again."""
    q = by_quarter(read(spark, sf, "fundamentals"))
    lists = [F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("period").cast("string").alias("period"), F.col(c).alias("v")))).alias(k) for k, c in SERIES.items() if c in q.columns]
    raw = q.groupBy("ticker").agg(*lists)
    raw = raw.select("ticker", F.to_json(F.struct(F.struct(F.struct(*[k for k in SERIES if k in raw.columns]).alias("quarterly")).alias("series"))).alias("payload"))
    return ingest.quarterly_series(raw, SERIES).withColumn("not_reported", F.col("not_reported").cast("double"))


def s03_year_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Closing dates from the annual series of JSON payloads (S3)."""
    y = read(spark, sf, "fiscal_year_ends").where("ticker is not null and period is not null")
    points = F.collect_list(F.struct(F.col("period").cast("string").alias("period"), F.lit(1.0).alias("v")))
    raw = y.groupBy("ticker").agg(points.alias("sales")).select("ticker", F.to_json(F.struct(F.struct(F.struct("sales").alias("annual")).alias("series"))).alias("payload"))
    return ingest.year_ends(raw)


def s09_constituents(spark: SparkSession, sf: str) -> DataFrame:
    """Members from the first table of a page that has symbols and sectors."""
    return universe.constituents(spark, PAGE)


def s11_sub_industries(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-industries of two pages; the first one wins."""
    return universe.first_page_wins([universe.sub_industries(spark, p) for p in (PAGE, LATER_PAGE)])


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A cache and a new fetch out of the daily rows: some tickers are not fetched, some come truncated."""
    daily = by_day(read(spark, sf, "prices"))
    kind = F.pmod(F.length("ticker") + F.ascii("ticker"), F.lit(3))
    cached = daily.where(F.col("date") < "2023-01-01").withColumn("close", F.col("close") + 1)
    fetched = daily.where((kind == 0) | ((kind == 1) & (F.col("date") >= "2022-06-01")))
    return cached, fetched


def c02_required_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A cache that lacks a required column is fetched anew for all tickers."""
    return ingest.stale_tickers(by_day(read(spark, sf, "prices")).drop("dividend"), read(spark, sf, "universe", "ticker"), "2024-06-28", ["dividend"])


def c03_merged_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache and fetch merged: what was not fetched or comes truncated keeps the cache."""
    out = ingest.merged_history(*_halves(spark, sf))
    return out.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.sum("close"), 4).alias("total"))


def u01_merged_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Core and two index lists in one universe, with sector overrides."""
    u = read(spark, sf, "universe")
    part = lambda r, size: u.where(F.pmod(F.ascii("ticker"), F.lit(4)).isin(*r)).select("ticker", F.concat("name", F.lit(f" {size}")).alias("name"), F.lit("Index").alias("sector"), F.lit(size).alias("size_group"))
    core = u.where(F.pmod(F.ascii("ticker"), F.lit(4)) < 2).select("ticker", "name", "sector", F.lit("large").alias("size_group"))
    return universe.merged(core, [part((1, 2), "mid"), part((2, 3), "small")], {"ABCDEF": "Energy"})


def u03_sector_tickers(spark: SparkSession, sf: str) -> DataFrame:
    """(sector, ticker): the tickers of each of two sectors."""
    u = read(spark, sf, "universe")
    return reduce(DataFrame.unionByName, [universe.of_sector(u, s).select(F.lit(s).alias("sector"), "ticker") for s in ("Energy", "Utilities")])


def m28_compared_multiples(spark: SparkSession, sf: str) -> DataFrame:
    """Latest P/E per ticker of the given panel against the latest reported one."""
    p = read(spark, sf, "panel").where("ticker is not null and as_of is not null").groupBy("ticker", "as_of").agg(F.min_by("trailing_pe", "panel_id").alias("pe")).select("ticker", "as_of", finite("pe").alias("trailing_pe"))
    theirs = by_quarter(read(spark, sf, "fundamentals")).groupBy("ticker").agg(F.max_by("trailing_pe", "period").alias("trailing_pe"))
    out = ingest.compare_with_reference(p, theirs, "trailing_pe")
    return out.withColumns({c: F.round(c, 9) for c in ("ours", "theirs", "ratio")})


QUERIES = {f.__name__: f for f in (s01_price_rows, s02_payload_quarters, s03_year_ends, s09_constituents, s11_sub_industries, c02_required_columns, c03_merged_cache, u01_merged_universe, u03_sector_tickers, m28_compared_multiples)}

_KIND = "(length(ticker) + ascii(ticker)) % 3"
ORACLE = {
    "s01_price_rows": "SELECT ticker, count(*) AS n, 0.0 AS most_paid, count(*) AS same, any_value(replace(u.ticker, '.', '-')) AS symbol FROM prices p JOIN universe u USING (ticker) GROUP BY 1",
    "s02_payload_quarters": with_(
        QUARTERS, "raw AS (SELECT q.ticker, q.period, q.trailing_pe, q.return_on_equity, CASE WHEN NOT isnan(f.eps) AND NOT isinf(f.eps) THEN f.eps END AS eps FROM quarters q JOIN fundamentals f ON f.fund_id = q.fund_id)",
        body="SELECT *, CAST(NULL AS DOUBLE) AS not_reported FROM raw WHERE trailing_pe IS NOT NULL OR return_on_equity IS NOT NULL OR eps IS NOT NULL",
    ),
    "s03_year_ends": "SELECT DISTINCT ticker, period FROM fiscal_year_ends WHERE ticker IS NOT NULL AND period IS NOT NULL",
    "s09_constituents": "SELECT * FROM (VALUES ('AAA', 'Alpha & Co', 'Technology', 'Software'), ('BRK.B', 'Beta', 'Healthcare', 'Devices'), ('C-D', 'Gamma', 'Energy', 'Gas')) t(ticker, name, sector, sub_industry)",
    "c02_required_columns": "SELECT ticker FROM universe",
    "c03_merged_cache": with_(
        DAILY, f"cached AS (SELECT * REPLACE (close + 1 AS close) FROM daily WHERE date < DATE '2023-01-01'), fetched AS (SELECT * FROM daily WHERE {_KIND} = 0 OR ({_KIND} = 1 AND date >= DATE '2022-06-01'))",
        "a AS (SELECT ticker, min(date) AS a FROM cached GROUP BY 1), b AS (SELECT ticker, min(date) AS b FROM fetched GROUP BY 1), kept AS (SELECT coalesce(a.ticker, b.ticker) AS ticker FROM a FULL JOIN b USING (ticker) WHERE b IS NULL OR b - a > 365)",
        "m AS (SELECT * FROM fetched WHERE ticker NOT IN (SELECT ticker FROM kept) UNION ALL SELECT * FROM cached WHERE ticker IN (SELECT ticker FROM kept))",
        body="SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last, round(sum(close), 4) AS total FROM m GROUP BY 1",
    ),
    "u01_merged_universe": """WITH k AS (SELECT *, ascii(ticker) % 4 AS k FROM universe)
SELECT ticker, CASE WHEN k < 2 THEN name WHEN k = 2 THEN name || ' small' ELSE name || ' small' END AS name, CASE WHEN ticker = 'ABCDEF' THEN 'Energy' WHEN k < 2 THEN sector ELSE 'Index' END AS sector, CASE k WHEN 0 THEN 'large' WHEN 1 THEN 'mid' ELSE 'small' END AS size_group FROM k""",
    "u03_sector_tickers": "SELECT DISTINCT sector, ticker FROM universe WHERE sector IN ('Energy', 'Utilities')",
    "m28_compared_multiples": with_(
        QUARTERS, "one AS (SELECT ticker, as_of, CASE WHEN NOT isnan(trailing_pe) AND NOT isinf(trailing_pe) THEN trailing_pe END AS v FROM (SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY panel_id) AS r FROM panel WHERE ticker IS NOT NULL AND as_of IS NOT NULL) WHERE r = 1)",
        "p AS (SELECT ticker, v AS ours FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) AS r FROM one) WHERE r = 1), f AS (SELECT ticker, trailing_pe AS theirs FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS r FROM quarters) WHERE r = 1)",
        body="SELECT ticker, round(ours, 9) AS ours, round(theirs, 9) AS theirs, round(CASE WHEN theirs <> 0 THEN ours / theirs END, 9) AS ratio, coalesce(abs(ours / nullif(theirs, 0) - 1) <= 0.15, false) AS close FROM p JOIN f USING (ticker)",
    ),
    "s11_sub_industries": "SELECT * FROM (VALUES ('AAA', 'Oil'), ('BRK.B', 'Devices'), ('9X', 'Oil'), ('C-D', 'Gas'), ('E', 'Water')) t(ticker, sub_industry)",
}
