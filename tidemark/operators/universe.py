"""The universe of tickers: merging lists, industry groups, constituents from HTML tables."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_INDUSTRY = 20
#: Sector names that the index pages spell differently. Fixed values.
RENAMED = {"Information Technology": "Technology", "Health Care": "Healthcare", "Communication Services": "Communication"}


def merged(core: DataFrame, members: list[DataFrame], overrides: dict[str, str] | None = None) -> DataFrame:
    """(ticker, name, sector, size_group): core and index members; a ticker in both keeps the core's name and sector and
    takes the index's size group; a later index overrides an earlier one; sector overrides come last."""
    cols = ["ticker", "name", "sector", "size_group"]
    every = None
    for i, m in enumerate(members):
        m = m.select(*cols, F.lit(i).alias("__i"))
        every = m if every is None else every.unionByName(m)
    if every is None:
        out = core.select(*cols)
    else:
        index = every.groupBy("ticker").agg(F.max_by(F.struct("name", "sector", "size_group"), "__i").alias("x"))
        c = core.select("ticker", F.struct("name", "sector", "size_group").alias("c"))
        out = c.join(index, "ticker", "full").select("ticker", F.coalesce("c.name", "x.name").alias("name"), F.coalesce("c.sector", "x.sector").alias("sector"), F.coalesce("x.size_group", "c.size_group").alias("size_group"))
    if overrides:
        pairs = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        out = out.withColumn("sector", F.coalesce(F.element_at(pairs, F.col("ticker")), F.col("sector")))
    return out


def industry_groups(universe: DataFrame, sub: str = "sub_industry", least: int = MIN_INDUSTRY) -> DataFrame:
    """`universe` with industry: the sub-industry if `least` members share it, else '<sector> 기타' (a missing sector
    counts as Unknown). Counts are aggregated and joined back, so a common sub-industry is no single task."""
    n = universe.where(F.col(sub).isNotNull()).groupBy(F.col(sub).alias("__s")).agg(F.count("*").alias("__n"))
    u = universe.join(n, F.col(sub) == F.col("__s"), "left")
    other = F.concat(F.coalesce("sector", F.lit("Unknown")), F.lit(" 기타"))
    return u.withColumn("industry", F.when(F.col("__n") >= least, F.col(sub)).otherwise(other)).drop("__s", "__n")


def size_counts(universe: DataFrame) -> DataFrame:
    """Tickers per sector and size group, a column per size."""
    return universe.groupBy("sector").pivot("size_group", ["large", "mid", "small"]).count().na.fill(0)


def duplicates(universe: DataFrame) -> DataFrame:
    """(ticker, n) of the tickers that occur more than once."""
    return universe.groupBy("ticker").agg(F.count("*").alias("n")).where("n > 1")


def of_sector(universe: DataFrame, sector: str) -> DataFrame:
    """(ticker) of a sector."""
    return universe.where(F.col("sector") == sector).select("ticker").distinct()


def first_page_wins(pages: list[DataFrame]) -> DataFrame:
    """(ticker, sub_industry) of several pages (ticker, sub_industry); of a ticker on several the first page counts."""
    every = None
    for i, page in enumerate(pages):
        page = page.where("ticker is not null and sub_industry is not null").select("ticker", "sub_industry", F.lit(i).alias("page"))
        every = page if every is None else every.unionByName(page)
    return every.groupBy("ticker").agg(F.min_by("sub_industry", "page").alias("sub_industry"))


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Index members frozen as CSV with a header: ticker, name, sector and whatever else is there, all text."""
    return spark.read.csv(path, header=True)


class _Tables(HTMLParser):
    """Rows of the cells' texts of every table of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(re.sub(r"\s+", " ", html.unescape("".join(self.cell))).strip())
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def sub_industries(spark: SparkSession, page: str) -> DataFrame:
    """(ticker, sub_industry) of the first table of a page that has a symbol and a sub-industry column; no rows without one."""
    parser = _Tables()
    parser.feed(page)
    for table in parser.tables:
        head = [h.lower() for h in (table[0] if table else [])]
        symbol = next((i for i, h in enumerate(head) if h in ("symbol", "ticker", "ticker symbol")), None)
        sub = next((i for i, h in enumerate(head) if "sub-industry" in h or "sub industry" in h), None)
        if symbol is not None and sub is not None:
            rows = {r[symbol].strip().upper(): r[sub].strip() for r in table[1:] if max(symbol, sub) < len(r)}  # the last row of a ticker
            return spark.createDataFrame(list(rows.items()), "ticker string, sub_industry string")
    return spark.createDataFrame([], "ticker string, sub_industry string")


def constituents(spark: SparkSession, page: str) -> DataFrame:
    """(ticker, name, sector, sub_industry) of the first table of a page that has a symbol and a sector column.

    Tickers are trimmed and in capitals; rows whose ticker is none are left out; of a repeated ticker the first row
    stays; renamed sectors get their usual name. A page without such a table gives no rows.
    """
    parser = _Tables()
    parser.feed(page)
    rows: list[tuple] = []
    for table in parser.tables:
        head = [h.lower() for h in (table[0] if table else [])]
        find = lambda *names: next((i for n in names for i, h in enumerate(head) if n in h), None)  # noqa: E731,B023
        symbol, sector, name, sub = find("symbol", "ticker"), find("gics sector", "sector"), find("security", "company"), find("sub-industry", "sub industry")
        if symbol is None or sector is None:
            continue
        at = lambda r, i: r[i] if i is not None and i < len(r) else None
        rows = [(k, at(r, symbol), at(r, name), at(r, sector), at(r, sub)) for k, r in enumerate(table[1:])]
        break
    df = spark.createDataFrame(rows, "k int, ticker string, name string, sector string, sub_industry string")
    df = df.withColumn("ticker", F.upper(F.trim("ticker"))).where(F.col("ticker").rlike(r"^[A-Z][A-Z0-9.\-]*$"))
    df = df.withColumn("__r", F.row_number().over(Window.partitionBy("ticker").orderBy("k"))).where("__r = 1").drop("__r", "k")
    return df.replace(RENAMED, subset=["sector"])
