"""Scalar numeric helpers: age bins (H6/H7), clip (H9), half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Right-closed decade bins (0,10], (10,20], ..., (90,100];
# ages of 0, above 100 or unknown fall outside every bin.
AGE_BIN_WIDTH = 10
AGE_BIN_COUNT = 10


def age(birth_year: str | Column, base_year: int) -> Column:
    """Age in ``base_year`` (H6)."""
    col = F.col(birth_year) if isinstance(birth_year, str) else birth_year
    return F.lit(int(base_year)) - col


def age_bin(age_col: Column) -> Column:
    """1-based bin number of a right-closed decade bin, or null."""
    top = AGE_BIN_WIDTH * AGE_BIN_COUNT
    return F.when((age_col > 0) & (age_col <= top),
                  F.ceil(age_col / F.lit(AGE_BIN_WIDTH)).cast("int"))


def clip_round(x: Column) -> Column:
    """Low-rank forecasts: clip negatives to 0, then round half to even."""
    return F.bround(F.greatest(x, F.lit(0.0)), 0)


def round_even(x: Column) -> Column:
    """Total forecast: round half to even, no clip."""
    return F.bround(x, 0)
