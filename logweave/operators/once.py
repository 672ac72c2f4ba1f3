"""Computed columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, cols: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``cols``, fenced against duplication.

    The optimizer copies the definition of a column into every filter on it
    that it moves towards the scan, and filters come from joins as well. For a
    long chain of text expressions that means parsing each line several times.
    Filters do not move below a generator that makes the column, so the values
    come out of a one-row ``inline``; other columns still let filters through.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    base = keep if keep is not None else df.columns
    return df.select(*base, made)
