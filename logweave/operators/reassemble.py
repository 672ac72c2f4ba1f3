"""Lines from byte chunks of connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.ordering import running_total


def numbered_pieces(chunks: DataFrame, conn: str = "conn_id", seq: str = "seq",
                    chunk: str = "chunk", block: int = 100_000) -> DataFrame:
    """Pieces between newlines, each with the number of the line it belongs to.

    That number is the count of newlines before it, summed in blocks, so that
    one busy connection is spread out.
    """
    pieces = F.split(F.col(chunk), "\n", -1)
    counted = running_total(chunks.select(conn, seq, chunk), [conn],
                            F.size(pieces) - 1, "_start", seq, block)
    return (counted.select(conn, seq, "_start", F.posexplode(pieces).alias("_i", "_piece"))
            .withColumn("line_no", (F.col("_start") + F.col("_i")).cast("bigint")).drop("_start"))


def join_pieces(pieces: DataFrame, conn: str = "conn_id", seq: str = "seq") -> DataFrame:
    """``(conn, line_no, line)``; only the pieces of a single line come together."""
    return (pieces.groupBy(conn, "line_no")
            .agg(F.sort_array(F.collect_list(F.struct(seq, "_i", "_piece"))).alias("_p"))
            .select(conn, "line_no",
                    F.array_join(F.transform("_p", lambda p: p["_piece"]), "").alias("line")))


def reassemble_lines(chunks: DataFrame, conn: str = "conn_id", seq: str = "seq",
                     chunk: str = "chunk", block: int = 100_000) -> DataFrame:
    """``(conn, line_no, line)`` from ``(conn, seq, chunk)``.

    Lines end at a newline, wherever the chunks were cut; a carriage return
    before it is dropped and empty lines are skipped (their number is not
    reused). The last piece of a connection counts as a line.
    """
    lines = join_pieces(numbered_pieces(chunks, conn, seq, chunk, block), conn, seq)
    return lines.withColumn("line", F.regexp_replace("line", "\\r$", "")).filter("line <> ''")
