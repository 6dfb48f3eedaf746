"""Queries of this subpackage over a directory of tables, and what SQL can say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mix, nearest_time, skeleton, tokenize
from tidemark.sources.tables import cut, read


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """(panel_id, price_id): the usable quote nearest to as_of within 10 days; see `nearest_time.nearest_in_time`."""
    quotes = read(spark, sf, "prices", "price_id", "ticker", "date", "close_raw").where(f"close_raw > 0 and close_raw < double('Infinity')")
    panel = read(spark, sf, "panel", "panel_id", "ticker", "as_of")
    out = nearest_time.nearest_in_time(panel, quotes, key="ticker", asked_time="as_of", time="date", candidate_id="price_id", tolerance_days=10)
    return out.select("panel_id", "price_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, ids): token ids of every text by byte_bpe_50k."""
    return tokenize.token_ids(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    # Tokens are counted once and kept in storage: the totals and the draw both read them.
    return cut(tokenize.token_counts(read(spark, sf, "documents", "doc_id", "source", "text"), "text"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each document is used for the target shares of tokens."""
    sized = _sized(spark, sf)
    return mix.mixed(sized, mix.plans_for(sized, read(spark, sf, "mix_targets")), "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source in the mix of `p7_mix`."""
    sized = _sized(spark, sf)
    plans = mix.plans_for(sized, read(spark, sf, "mix_targets"))
    return mix.shares(mix.mixed(sized, plans, "doc_id"), plans)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_a, doc_b): pairs of documents that look the same and are not the same string."""
    return skeleton.look_alike_pairs(cut(skeleton.looks(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")), "doc_id")


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, class_id, class_size, n_forms): documents whose look also occurs in other characters."""
    return skeleton.look_alike_classes(cut(skeleton.looks(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")), "doc_id")


def p8_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, skeleton): every text in its consistent form."""
    return skeleton.with_skeleton(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p6_ids, p7_mix, p7_shares, p8_found, p8_classes, p8_skeleton)}

P1_SQL = """
WITH q AS (
  SELECT ticker, date, min(price_id) AS price_id FROM prices
  WHERE ticker IS NOT NULL AND date IS NOT NULL AND close_raw > 0 AND NOT isnan(close_raw) AND NOT isinf(close_raw)
  GROUP BY ticker, date
), d AS (
  SELECT DISTINCT ticker, as_of FROM panel WHERE ticker IS NOT NULL AND as_of IS NOT NULL
), b AS (
  SELECT d.ticker, d.as_of, q.date, q.price_id FROM d ASOF JOIN q ON d.ticker = q.ticker AND d.as_of >= q.date
), a AS (
  SELECT d.ticker, d.as_of, q.date, q.price_id FROM d ASOF JOIN q ON d.ticker = q.ticker AND d.as_of <= q.date
), u AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY abs(date_diff('microsecond', date, as_of)), date) AS r
  FROM (SELECT * FROM b UNION ALL SELECT * FROM a)
  WHERE abs(date_diff('microsecond', date, as_of)) <= 864000000000
)
SELECT p.panel_id, u.price_id FROM panel p JOIN u ON p.ticker = u.ticker AND p.as_of = u.as_of AND u.r = 1
"""

#: Only what SQL can express: merges, draws and skeletons are tested against brute force instead.
ORACLE = {"p1_found": P1_SQL}
