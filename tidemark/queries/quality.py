"""Queries of the data-quality operators on the panel and fundamentals: unusual readings, attributes, profile, filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import filler_code, micros, present, real_number
from tidemark.operators import impute, lastknown, profile, spikes
from tidemark.sources.tables import FUNDAMENTAL_FIELDS, cut, read

FIELDS = ("eps", "sales_per_share", "price_to_book")


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    """(table_name, row_id, ticker, at, field, v, impossible): the present readings of the three fields, long."""
    f = read(spark, sf, "fundamentals", "fund_id", "ticker", "period", "eps", "sales_per_share")
    p = read(spark, sf, "panel", "panel_id", "ticker", "as_of", "price_to_book", "book_value")
    code = filler_code
    inf = lambda c: F.abs(c) == float("inf")
    eps, sps, pb = F.col("eps"), F.col("sales_per_share"), F.col("price_to_book")
    no = F.lit(False)
    cells = lambda *x: F.inline(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("v"), F.coalesce(bad, no).alias("impossible")) for n, c, bad in x]))
    f = f.select(F.lit("fundamentals").alias("table_name"), F.col("fund_id").alias("row_id"), "ticker", F.col("period").cast("timestamp_ntz").alias("at"), cells(
        ("eps", eps, inf(eps) | code(eps)), ("sales_per_share", sps, inf(sps) | code(sps) | (sps < 0)),
    ))
    # A price to book of 0 or of -1 to the last digit is a code where no negative book value explains it.
    p = p.select(F.lit("panel").alias("table_name"), F.col("panel_id").alias("row_id"), "ticker", F.col("as_of").cast("timestamp_ntz").alias("at"), cells(
        ("price_to_book", pb, inf(pb) | code(pb) | ((pb <= 0) & (present("book_value") > 0)) | (pb.isin(0.0, -1.0) & present("book_value").isNull())),
    ))
    return f.unionByName(p).where("v is not null and not isnan(v)")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """(table_name, row_id, field): readings that cannot be, that leave the company's range and return, or are stuck.

    Impossible readings are found row by row, also without ticker or time; the others go through
    `spikes.unusual_readings` per company and field, and every row that holds a flagged reading comes out.
    """
    r = _readings(spark, sf).withColumn("t", micros("at"))
    impossible = r.where("impossible").select("table_name", "row_id", "field")
    possible = r.where("not impossible and ticker is not null and at is not null")
    season = ((F.month("at") - 1) / 3).cast("int").alias("season")
    flagged = spikes.unusual_readings(possible.select("field", "ticker", "t", season, "v"), ["field", "ticker"])
    odd = possible.join(flagged, ["field", "ticker", "t", "v"], "left_semi").select("table_name", "row_id", "field")
    return impossible.unionByName(odd)


def _known(spark: SparkSession, sf: str, attributes: list[str], how: str, *columns: str) -> DataFrame:
    f = read(spark, sf, "fundamentals", "ticker", "period", "available_date", "fund_id", *[a for a in attributes if a != lastknown.ROW])
    f = f.where(F.col("available_date") >= F.col("period").cast("timestamp_ntz"))
    return lastknown.attributes_as_of(
        read(spark, sf, "panel", "panel_id", "ticker", "as_of").where("as_of is not null"), f,
        event_key="ticker", event_time="as_of", row_key="ticker", known_at="available_date",
        latest_by=["period", "available_date"], tie="fund_id", attributes=attributes, how=how,
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """(panel_id, fund_id): the fundamentals row known at each panel row's as_of; see `lastknown.attributes_as_of`."""
    return _known(spark, sf, [lastknown.ROW], "inner").select("panel_id", F.col("row_from").alias("fund_id"))


def p3_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Each panel row with as_of and the last known present value of every attribute of the fundamentals."""
    known = _known(spark, sf, FUNDAMENTAL_FIELDS, "left")
    return known.select("panel_id", "ticker", "as_of", *FUNDAMENTAL_FIELDS)


PROFILED = ["price", "trailing_pe", "price_to_book", "price_to_sales", "ev_to_ebitda", "price_to_fcf", "return_on_equity", "roic", "gross_margin", "operating_margin", "debt_to_equity", "payout_ratio_ttm", "book_value", "volatility_63d", "dividend_yield"]
WATCHED = ["payout_ratio_ttm", "trailing_pe", "roic"]


def _loads_profiled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, str, str]:
    panel, loads = read(spark, sf, "panel", "load_id", *WATCHED), read(spark, sf, "loads", "load_id", "feed")
    return profile.profile(panel, "load_id", WATCHED), profile.masks(panel, "load_id", WATCHED), loads, "load_id", "feed"


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """(load_id, column_name): loads of at least 10 rows whose masks, or else statistics, depart from the other loads of the
    feed."""
    return profile.departures(*_loads_profiled(spark, sf)).where("departs").select("load_id", "column_name")


def _profiled(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    panel = read(spark, sf, "panel")
    return panel, [c for c in panel.columns if c not in ("load_id", "panel_id")]


def p4_profile(spark: SparkSession, sf: str) -> DataFrame:
    """One row per load and column of the whole panel: nulls, distinct values, ranges, signs, precision."""
    panel, columns = _profiled(spark, sf)
    return profile.profile(panel, "load_id", columns).withColumn("mean_value", F.round("mean_value", 6))


def p4_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Per column of the panel the value masks with their share, and whether a mask is dominant or rare (a violation)."""
    panel, columns = _profiled(spark, sf)
    return profile.patterns(panel, columns)


def p4_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Per load and watched column the masks that hardly occur in the feed's other loads."""
    return profile.violations(*_loads_profiled(spark, sf)[1:])


def p4_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Per load and watched column the divergence of its masks from the feed's, and its distances from the feed."""
    return profile.departures(*_loads_profiled(spark, sf))


FILLED = ["return_on_equity", "operating_margin", "sector", "as_of"]


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with the four fields checked, filled and marked by `impute.fill`.

    as_of comes from its load (a load is of one snapshot); sector from its ticker, its industry, its load; the two numbers
    from the ticker, the snapshot's sector and size, the snapshot's sector, the snapshot, and all rows.
    """
    panel = impute.with_known_names(read(spark, sf, "panel", "panel_id", "ticker", "load_id", "industry", "size_group", *FILLED), "sector", read(spark, sf, "universe", "sector"), "__named")
    ok = panel.withColumns({"ok_sector": impute.usable_name(F.col("sector"), F.col("__named")), **{f"ok_{k}": real_number(k) for k in FILLED[:2]}}).drop("__named")
    ok = impute.fill(ok, {"as_of": "as_of"}, [("load", ["load_id"])], categorical=True, support=1)
    ok = impute.fill(ok, {"sector": "ok_sector"}, [("ticker", ["ticker"]), ("industry", ["industry"]), ("load", ["load_id"])], categorical=True, support=2)
    levels = [("ticker", ["ticker"]), ("snapshot, sector and size", ["as_of", "sector", "size_group"]), ("snapshot and sector", ["as_of", "sector"]), ("snapshot", ["as_of"]), ("all", [])]
    # Stored between the steps: the numbers' fill reads the panel three times.
    return impute.fill(cut(ok), {k: f"ok_{k}" for k in FILLED[:2]}, levels, support=5)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """(panel_id, field): cells of return_on_equity, operating_margin, sector and as_of without a usable value, as the
    filling marks them."""
    return impute.unusable_cells(_filled(spark, sf), "panel_id", FILLED)


def p5_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Every panel row with the four fields filled, and for each field whether and by which level it was filled."""
    return _filled(spark, sf).select("panel_id", *[c for k in FILLED for c in (k, f"{k}_filled", f"{k}_level")])


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_attributes, p4_found, p4_profile, p4_masks, p4_violations, p4_drift, p5_found, p5_filled)}
