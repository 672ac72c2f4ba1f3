"""Kernel addresses in messages, translated to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.joins import lookup_join

_ADDRESS = r"\[<([0-9A-Fa-f]+)>\]"


def translate_symbols(df: DataFrame, symbols: DataFrame, column: str = "line",
                      max_rows: int = 1_000_000) -> DataFrame:
    """Replace ``[<hex>]`` by `` [<hex> module.symbol ]`` in ``column``.

    Addresses are looked up without regard to case, from left to right; the
    first unknown one ends the translation of that line. Rows are told apart by
    a number of their own, so no column need identify them. Lines without an
    address take no part in the join or the shuffle.
    """
    found = F.regexp_extract_all(column, F.lit(_ADDRESS), F.lit(1))
    plain = df.filter(~F.col(column).rlike(_ADDRESS))
    texts = df.filter(F.col(column).rlike(_ADDRESS))
    others = [c for c in df.columns if c != column]
    # text before each address, and the rest after the last
    gaps = F.split(column, _ADDRESS, -1)
    pieces = (texts.withColumn("_gaps", gaps).withColumn("_line", F.monotonically_increasing_id())
              .select("*", F.posexplode(found).alias("_pos", "_hex"))
              .withColumn("_addr", F.lower("_hex")))
    # the reference table may list an address twice: the first name counts
    table = (symbols.select(F.lower("addr").alias("_addr"), F.struct(
        F.col("addr"), F.col("module"), F.col("name")).alias("_sym"))
        .groupBy("_addr").agg(F.min("_sym").alias("_sym")))
    hit = lookup_join(pieces, table, ["_addr"], "left", ["_line", "_pos"], max_rows)
    whole = hit.groupBy("_line").agg(
        F.any_value(F.struct(column, *others)).alias("_row"),
        F.any_value("_gaps").alias("_gaps"),
        F.min(F.when(F.col("_sym").isNull(), F.col("_pos"))).alias("_stop"),
        F.sort_array(F.collect_list(F.struct("_pos", "_hex", "_sym"))).alias("_hits"))
    known = F.filter("_hits", lambda h: F.col("_stop").isNull() | (h["_pos"] < F.col("_stop")))
    shown = F.array_join(F.transform(known, lambda h: F.concat(
        F.get(F.col("_gaps"), h["_pos"]), F.lit(" [<"), h["_sym"]["addr"], F.lit("> "),
        h["_sym"]["module"], F.lit("."), h["_sym"]["name"], F.lit(" ]"))), "")
    rest = F.array_join(F.transform(
        F.filter("_hits", lambda h: h["_pos"] >= F.col("_stop")),
        lambda h: F.concat(F.get(F.col("_gaps"), h["_pos"]), F.lit("[<"), h["_hex"],
                           F.lit(">]"))), "")
    text = F.concat(shown, F.coalesce(rest, F.lit("")), F.element_at("_gaps", -1))
    done = whole.select(text.alias(column),
                        *[F.col(f"_row.{c}").alias(c) for c in others])
    return plain.unionByName(done.select(*df.columns))
