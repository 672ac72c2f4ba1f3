"""SimHash near-duplicates: fingerprints, multi-index search, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import free_name, stable, text_slices
from logweave.llm.components import components
from logweave.session import freeze

RADIUS = 3
#: Fingerprints with the same half beyond which the half's group is linked through its balls.
GROUP_LIMIT = 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text: 1 where over half the shingle hashes have the bit."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(tokens) - shingle + 1].tolist()
    stops = ends[shingle - 1:].tolist()
    n = len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 100_000):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in
                         zip(starts[at:at + 100_000], stops[at:at + 100_000], strict=True)),
                        np.uint64, min(100_000, n - at))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(_row, doc_id, fp) from (_row, doc_id, text): the SimHash of each text as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()],
                           np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("doc_id"), pa.array(fps)],
                                             names=["_row", "doc_id", "fp"])

    return docs.select(F.col("_row").cast("long").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
                       "text").mapInArrow(run, "_row long, doc_id long, fp long")


def _half(fp: str, k: int) -> Column:
    """Half ``k`` of a fingerprint, as a number below 2^32."""
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))


def _halves(fps: DataFrame) -> DataFrame:
    """(k, part, rest, fp): one table row for each half of each fingerprint."""
    return fps.select("fp", F.inline(F.array(*[
        F.struct(F.lit(k).alias("k"), _half("fp", k).alias("part"), _half("fp", 1 - k).alias("rest"))
        for k in (0, 1)])))


def _ball(value: Column, bits: int, zero_only: bool) -> Column:
    """``value`` and the numbers that differ from it in one of ``bits`` bits (or one zero bit)."""
    masks = [1 << i for i in range(bits)]
    flips = F.array(*[F.lit(m).cast("long") for m in masks])
    if zero_only:
        flips = F.filter(flips, lambda m: value.bitwiseAND(m) == 0)
    return F.concat(F.array(value), F.transform(flips, lambda m: value.bitwiseXOR(m)))


def links(fps: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): links that connect all fingerprints (column ``fp``, distinct) at 3 or fewer bits.

    Of two fingerprints at distance 3 or less, one half differs in at most one
    bit. Each half is a table; every fingerprint asks both tables for the ball
    of radius 1 around its half, flipping zero bits only, since of two halves
    that differ in one bit exactly one has the zero there. Matches are kept if
    the complete distance is at most 3.

    Halves that more than ``group_limit`` fingerprints share would give a
    number of matches with the square of the group. They are linked exactly
    but without pairs: two numbers are at distance 3 or less if and only if the ball
    of radius 1 around one meets the ball of radius 2 around the other. So
    each member of such a group names all points of both balls of its other half, and at
    every point that some member is within 1 of, all members within 2 of it
    link to the smallest of them. Groups one bit apart meet in the same way.
    """
    table = _halves(fps)
    big = freeze(table.groupBy("k", "part").agg(F.count("*").alias("n"))
                 .filter(F.col("n") > group_limit).select("k", "part"))
    some_big = not big.isEmpty()
    found = table.join(big, ["k", "part"], "left_anti") if some_big else table
    asks = table.select(F.col("fp").alias("a"), "k", "part",
                        F.explode(_ball(F.col("part"), 32, True)).alias("at"))
    near = (asks.join(found.select("k", F.col("part").alias("at"), F.col("fp").alias("b")), ["k", "at"])
            .filter((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
                    & ((F.col("at") != F.col("part")) | (F.col("a") < F.col("b"))))
            .select("a", "b"))
    return (near.union(_big_links(table, big)) if some_big else near).distinct()


def _big_links(table: DataFrame, big: DataFrame) -> DataFrame:
    """Links inside big groups, and from fingerprints one bit away from a big group's half."""
    own = table.join(big, ["k", "part"]).select("k", F.col("part").alias("at"), "rest", "fp")
    by = (table.select("k", "rest", "fp", "part",
                       F.explode(_ball(F.col("part"), 32, True)).alias("at"))
          .filter(F.col("at") != F.col("part"))
          .join(big.withColumnRenamed("part", "at"), ["k", "at"])
          .select("k", "at", "rest", "fp"))
    pairs = [(1 << i) ^ (1 << j) for i in range(32) for j in range(i)]
    ones = [1 << i for i in range(32)]
    small = F.array(F.lit(0).cast("long"), *[F.lit(m).cast("long") for m in ones])
    wide = F.array(F.lit(0).cast("long"), *[F.lit(m).cast("long") for m in ones + pairs])

    def points(df: DataFrame, masks: Column, role: int) -> DataFrame:
        return df.select("k", "at", "fp", F.lit(role).alias("role"),
                         F.explode(F.transform(masks, lambda m: F.col("rest").bitwiseXOR(m))).alias("x"))

    # members: within 1 (role 0) and within 2 (role 1) of a point; two of them meet at distance 3
    met = points(own, small, 0).union(points(own, wide, 1))
    heads = (met.groupBy("k", "at", "x").agg(F.min("fp").alias("head"),
                                             F.min("role").alias("least"), F.count("*").alias("n"))
             .filter("least = 0 AND n > 1").select("k", "at", "x", "head"))
    inside = met.join(heads, ["k", "at", "x"]).select(F.col("head").alias("a"), F.col("fp").alias("b"))
    # guests: one bit off in the half, so 2 bits may differ in the rest: both within 1 of a point
    guests = points(own, small, 0).union(points(by, small, 1))
    stars = (guests.groupBy("k", "at", "x").agg(F.min(F.when(F.col("role") == 0, F.col("fp"))).alias("head"))
             .filter("head IS NOT NULL"))
    outside = (points(by, small, 1).join(stars, ["k", "at", "x"])
               .select(F.col("head").alias("a"), F.col("fp").alias("b")))
    return inside.union(outside).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3,
                    group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: near-duplicate classes.

    ``component_id`` is the smallest doc_id reachable over links of 3 or fewer
    differing bits, the row's own included. Rows with equal texts have one
    fingerprint and are one node of the search, however many they are. Null
    and empty texts have fingerprint zero and link like any other; a null
    doc_id is kept as a row and is never a component's id (null only where the whole
    component has no id); repeated doc_ids give a row each; other columns are
    ignored; an empty table gives no rows. Texts of any length are read whole.
    """
    found = _classes(docs.select(F.lit(0).alias("_row"), "doc_id", F.col(text).alias("text")), shingle, group_limit)
    return found.select("doc_id", "fp", F.col("least").alias("component_id"))


def _classes(docs: DataFrame, shingle: int, group_limit: int) -> DataFrame:
    """(_row, doc_id, fp, class, least): the class of each row and its smallest doc_id."""
    fps = freeze(fingerprints(docs, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = components(links(nodes.select("fp"), group_limit))
    # classes of more than one fingerprint; all other fingerprints are classes of their own
    placed = nodes.join(member, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("class"))
    ids = placed.groupBy("class").agg(F.min("least").alias("least"))
    by_fp = placed.select("fp", "class").join(ids, "class").withColumnRenamed("fp", "_fp")
    return fps.join(by_fp, F.col("fp") == F.col("_fp"), "left").select("_row", "doc_id", "fp", "class", "least")


def deduplicate(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each near-duplicate class of ``docs``, that of the smallest doc_id, all columns.

    Of rows that share that doc_id the first one read is kept. Rows without a
    doc_id go if their class has a row with one; else one of them is kept.
    """
    docs = stable(docs)
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    found = freeze(_classes(keyed.select(F.col(row).alias("_row"), "doc_id", F.col(text).alias("text")), shingle, GROUP_LIMIT))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("_row"))).alias("head")
    heads = found.groupBy("class").agg(first).select(F.col("head._row").alias(row))
    return keyed.join(heads, row, "left_semi").select(docs.columns)
