"""Joins of a large side with a table that is usually, but not surely, small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
SALTS = 16


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a table: is it within both bounds?

    One aggregate, combined map-side. (A limit would not make it cheaper: it
    moves rows of every partition into a single task.)
    """
    size = F.octet_length(F.to_json(F.struct("*")))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def lookup_join(big: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner",
                spread: Sequence[str] = (), max_rows: int = BROADCAST_ROWS,
                max_bytes: int = BROADCAST_BYTES, salts: int = SALTS,
                where: Column | None = None) -> DataFrame:
    """``big`` joined with ``dim`` on equal columns, ``how`` inner or left.

    ``dim`` is broadcast when it was measured to be within the bounds. Beyond
    them both sides are shuffled with a salt in the key: rows of ``big`` get a
    salt from a hash of the columns in ``spread`` and ``dim`` is repeated once
    per salt, so that one key holding much of ``big`` is still split.
    ``where`` is a further join condition over columns of both sides.
    """
    on = list(on)
    if fits_broadcast(dim, max_rows, max_bytes):
        right = F.broadcast(dim)
        left = big
        keys = on
    else:
        cols = [F.col(c) for c in (spread or big.columns)]
        left = big.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
        right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = on + ["_salt"]
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        c = left[k] == right[f"_r_{k}"]
        cond = c if cond is None else cond & c
    if where is not None:
        cond = cond & where
    return left.join(right, cond, how).drop("_salt", *[f"_r_{k}" for k in keys])
