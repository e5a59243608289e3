"""Numbers in texts: exact formatting, lenient parsing and coercion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number; a guard in front of casts, which accept more (`5d`, `0x1p3`).
NUMERIC = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def fixed1(value: Column) -> Column:
    """One decimal, rounded from the exact binary value, so 34.25 gives 34.2 and 0.15 gives 0.1; null stays null."""
    return F.pandas_udf(lambda s: pd.Series([None if pd.isna(x) else f"{x:.1f}" for x in s]), "string")(value)


def fixed1_all(values: Column) -> Column:
    """fixed1 of each element of an array."""
    return F.pandas_udf(lambda s: pd.Series([None if x is None else [None if pd.isna(v) else f"{v:.1f}" for v in x] for x in s]), "array<string>")(values)


def shortest(value: Column) -> Column:
    """The shortest decimal that reads back the same, without exponent, with `.0` on whole numbers: the lexical form of facts."""

    def text(x: float) -> str | None:
        if pd.isna(x):
            return None
        s = format(x, "f") if "e" in repr(float(x)) else repr(float(x))
        if "e" in repr(float(x)):
            from decimal import Decimal

            s = format(Decimal(repr(float(x))), "f")
        return s if "." in s else s + ".0"

    return F.pandas_udf(lambda s: pd.Series([text(x) for x in s]), "string")(value)


def lenient(text: Column, kelvin: bool = False) -> Column:
    """A double or null: blank is null, and with kelvin one trailing `K` and then one `k` is dropped first."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    if kelvin:
        t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"K$", ""), r"k$", ""), r"^\s+|\s+$", "")
    return F.when(t.rlike(NUMERIC), t.try_cast("double"))


def finite(value: Column) -> Column:
    """value, or null where it is NaN or infinite."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def confidence(value: Column) -> Column:
    """A confidence in [0, 1]; anything else counts 0."""
    return F.when(value.between(0.0, 1.0) & ~F.isnan(value), value).otherwise(F.lit(0.0))


def all_or_none(values: Column) -> Column:
    """The array if every element is a finite number, else null."""
    return F.when(F.forall(values, lambda x: finite(x).isNotNull()), values)
