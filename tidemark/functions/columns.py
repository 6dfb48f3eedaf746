"""Column helpers shared by all operators: missing values, times and schema tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def present(c: Column | str) -> Column:
    """The number without NaN: NaN and NULL both mean missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """The number if it is finite, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def filler_code(c: Column | str) -> Column:
    """True for numbers that stand for 'no value' by their form: nothing but nines from 999 on (also 999.99, -9999), or a
    power of ten from a million on. Size alone makes no code."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.format_string("%.2f", F.abs(c))
    return F.coalesce((F.abs(c) >= 999) & digits.rlike(r"^(9{3,}\.(00|90|99)|10{6,}\.00)$"), F.lit(False))


def real_number(c: Column | str) -> Column:
    """The number if it is finite and no filler code, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when((F.abs(c) < F.lit(float("inf"))) & ~filler_code(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every double and float column without NaN; one projection, no shuffle."""
    kinds = (T.DoubleType, T.FloatType)
    return df.withColumns({f.name: present(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, kinds)})


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a naive time or a date, whatever the session's time zone is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c.cast("timestamp_ntz"))


def ensure_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Adds typed NULL columns for those of `wanted` (name -> type) that the table lacks."""
    have = set(df.columns)
    new = {k: F.lit(None).cast(v) for k, v in wanted.items() if k not in have}
    return df.withColumns(new) if new else df


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not use."""
    while name in df.columns:
        name = "_" + name
    return name
