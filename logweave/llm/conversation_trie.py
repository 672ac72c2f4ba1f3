"""Prefix trie of conversations: containers of suffixes under trie heads, burst while too large, then swept."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import written
from logweave.operators.joins import lookup_join
from logweave.session import freeze

#: Turns of a container with more than one sequence beyond which it bursts.
LIMIT = 1024
#: Characters of a turn id: 128 bits of a SHA-256 in hex.
ID = 32
#: Ids that are joined into one piece of a list of members.
PIECE = 50_000
_HEADS = "array<struct<depth: int, conv: long>>"


def sequences(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv_id, turns) with the turns (id, chars) of each conversation in order.

    Turns are ordered by ``turn``, null first; of equal ones the smaller id is
    first. A turn's id is a digest of its role and text, where null counts as
    empty, so texts do not move. Rows without a conversation belong to none
    and are left out. A conversation is one row.
    """
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    ident = F.left(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256), F.lit(ID))
    turns = df.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), ident.alias("id"), F.length(what).cast("long").alias("chars")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars"))).alias("turns"))


def rebuild(found: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first turns are those of another one, from ``sequences``.

    Conversation c starts with the first h turns of conversation c - c % ``span`` (all
    if it has fewer, none if it is not there), h = crc32(c) % ``most``, and goes on
    with its own turns after its first h.
    """
    found = written(found, "turns")
    first = found.filter(F.col("conv_id") % span == 0).select(
        F.col("conv_id").alias("start"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    size = F.size("turns")
    rest = F.when(size > h, F.slice("turns", h + 1, F.greatest(size - h, F.lit(0)))).otherwise(
        F.slice("turns", 1, 0))
    head = F.when(F.col("head").isNotNull(), F.slice("head", 1, h)).otherwise(F.slice("turns", 1, 0))
    return (found.withColumn("start", F.col("conv_id") - F.col("conv_id") % span).join(first, "start", "left")
            .select("conv_id", F.concat(head, rest).alias("turns")))


def trie(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the prefix trie of (conv_id, turns), the root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` (digest of the
    comma-joined, ascending ids of the members that end in the node). conv_ids
    are unique. Conversations without turns end in the root. No conversations, no rows.

    Equal sequences are counted first, one of them stands for all. All
    sequences start in one container; a container with more than ``limit`` turns
    becomes a trie head that spans the turns all its sequences share, and bursts into containers by the next
    turn. Rounds follow nested heads only, so their number is small, and no
    container holds more than ``limit`` turns, or it holds one sequence. Remaining containers are sorted and swept:
    a task keeps the open path and the children of its nodes. Totals of
    containers are added up along their heads.
    """
    every = written(found.select(
        "conv_id", F.array_join(F.col("turns.id"), "").alias("ids"), F.size("turns").alias("n"),
        F.col("turns.chars").alias("chars")).withColumn("key", F.sha2("ids", 256)), "sequences")
    same = freeze(every.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")))
    alone = every.drop("key").join(same.drop("key"), "conv_id")
    done, heads, ends = _burst(alone, limit)
    swept = written(_sweep(done), "nodes")
    nodes = swept.drop("heads")
    if heads is not None:
        nodes = nodes.unionByName(_head_nodes(swept, heads, ends))
    digests = _digests(every.select("conv_id", "key"), same.filter("copies > 1"))
    many = nodes.filter("end_copies > 1").join(digests, F.col("end_conv") == F.col("rep"), "left").drop("rep")
    few = nodes.filter("end_copies IS NULL OR end_copies <= 1").withColumn(
        "ends_sha256", F.sha2(F.coalesce(F.col("end_conv").cast("string"), F.lit("")), 256))
    return many.unionByName(few).select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
                                        "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@F.pandas_udf(T.IntegerType())
def _shared(low: pd.Series, high: pd.Series) -> pd.Series:
    """Turns with which two sequences start alike."""
    return pd.Series([len(os.path.commonprefix([a, b])) // ID for a, b in zip(low, high, strict=True)], dtype="int32")


def _prefix(depth: Column) -> Column:
    return F.substring("ids", 1, depth * ID)


def _burst(alone: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Sequences in their final containers, the heads above them, and sequences that end in heads."""
    none = F.array().cast(_HEADS)
    active = written(alone.withColumn("depth", F.lit(0)).withColumn("box", F.lit("")).withColumn("heads", none), "box")
    done, heads, ends = [], [], []
    while True:
        large = freeze(active.groupBy("box").agg(
            F.sum(F.col("n") - F.col("depth") + 1).alias("weight"), F.count("*").alias("m"),
            F.min("conv_id").alias("head"), F.sum("copies").alias("n_convs"))
            .filter(f"weight > {limit} AND m > 1").select("box", "head", "n_convs"))
        if large.isEmpty():
            done.append(active)
            break
        inside = lookup_join(active, large, ["box"], "left", spread=["conv_id"])
        done.append(inside.filter("head IS NULL").drop("head", "n_convs"))
        inside = inside.filter("head IS NOT NULL")
        upto = freeze(inside.groupBy("box").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
                      .select("box", _shared("low", "high").alias("upto")))
        inside = written(lookup_join(inside, upto, ["box"], spread=["conv_id"]), "burst")
        path = F.slice("chars", F.greatest("depth", F.lit(1)), F.col("upto") - F.greatest("depth", F.lit(1)) + 1)
        heads.append(inside.filter("conv_id = head").select(
            "head", "depth", "upto", "n_convs", "heads",
            F.when(F.col("depth") == 0, F.concat(F.array(F.lit(0).cast("long")), path)).otherwise(path).alias("chars")))
        ends.append(inside.filter("n = upto").select("head", "upto", F.col("conv_id").alias("end_conv"),
                                                     F.col("copies").alias("end_copies")))
        active = inside.filter("n > upto").select(
            "conv_id", "ids", "n", "chars", "copies", (F.col("upto") + 1).alias("depth"),
            _prefix(F.col("upto") + 1).alias("box"),
            F.concat("heads", F.array(F.struct(F.col("upto").alias("depth"), F.col("head").alias("conv")))).alias("heads"))
    return _union(done), _union(heads), _union(ends)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


_NODE = ("conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         f"saved_tokens long, end_conv long, end_copies long, heads {_HEADS}")


class _Open:
    """An open node of a sweep."""

    __slots__ = ("chars", "copies", "conv", "end", "kids", "leaves", "saved", "n")

    def __init__(self, chars: int):
        self.chars, self.n, self.conv, self.leaves, self.saved = chars, 0, None, 0, 0
        self.kids: list[list] = []
        self.end = self.copies = None


def _sweep(done: DataFrame) -> DataFrame:
    """Nodes of sorted containers; the node on top of each keeps the container's heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        path: list[_Open] = []
        box, last, top, heads = None, "", 0, None

        def close(least: int) -> None:
            """Close all open nodes of a depth of ``least`` and more."""
            while path and top + len(path) - 1 >= least:
                node = path.pop()
                depth = top + len(path)
                node.leaves = node.leaves or 1
                node.saved += (node.n - 1) * node.chars
                for kid in node.kids:
                    kid[2] = node.conv
                out.extend(node.kids)
                row = [node.conv, depth, None, node.n, len(node.kids), node.leaves, node.saved, node.end,
                       node.copies, None]
                if path:
                    above = path[-1]
                    above.kids.append(row)
                    above.n += node.n
                    above.leaves += node.leaves
                    above.saved += node.saved
                    above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
                else:
                    row[2], row[9] = heads[-1]["conv"] if heads else None, heads
                    out.append(row)

        for batch in batches:
            for r in batch.to_pylist():
                ids, n = r["ids"], r["n"]
                if r["box"] != box:
                    close(0)
                    box, top, heads = r["box"], r["depth"], r["heads"]
                    path.append(_Open(r["chars"][top - 1] if top else 0))
                    same = top
                else:
                    same = top
                    while ids[same * ID:same * ID + ID] == last[same * ID:same * ID + ID] and same < n:
                        same += 1
                    close(same + 1)
                for depth in range(same + 1, n + 1):
                    path.append(_Open(r["chars"][depth - 1]))
                node = path[-1]
                node.end, node.copies = r["conv_id"], r["copies"]
                node.n += r["copies"]
                node.conv = r["conv_id"] if node.conv is None else min(node.conv, r["conv_id"])
                last = ids
                if len(out) > 20_000:
                    yield _table(out)
                    out.clear()
        close(0)
        yield _table(out)

    def _table(rows: list[list]) -> pa.RecordBatch:
        names = [f.split()[0] for f in _NODE.split(f", heads {_HEADS}")[0].split(", ")] + ["heads"]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 7,
                 pa.list_(pa.struct([("depth", pa.int32()), ("conv", pa.int64())]))]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    dealt = done.select("box", "depth", "ids", "n", "chars", "conv_id", "copies", "heads").repartition("box")
    return dealt.sortWithinPartitions("ids").mapInArrow(run, _NODE)


def _head_nodes(swept: DataFrame, heads: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes of the heads, with totals of all containers and heads below them."""
    own = F.transform("chars", lambda c: (F.col("n_convs") - 1) * c)
    heads = heads.withColumn("own", own)
    total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x)
    below = swept.filter("heads IS NOT NULL").select("heads", "n_leaves", "saved_tokens").union(
        heads.select("heads", F.lit(0).cast("long"), total))
    each = below.select(F.size("heads").alias("size"), "n_leaves", "saved_tokens", F.posexplode("heads").alias("at", "h"))
    sums = each.groupBy(F.col("h.conv").alias("t_head"), F.col("h.depth").alias("t_upto")).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"),
        F.sum((F.col("at") == F.col("size") - 1).cast("long")).alias("kids"))
    ends = ends.select(F.col("head").alias("e_head"), F.col("upto").alias("e_upto"), "end_conv", "end_copies")
    full = (heads.join(sums, (F.col("head") == F.col("t_head")) & (F.col("upto") == F.col("t_upto")))
            .join(ends, (F.col("head") == F.col("e_head")) & (F.col("upto") == F.col("e_upto")), "left"))
    above = F.when(F.size("heads") > 0, F.element_at("heads", F.when(F.size("heads") > 0, -1).otherwise(1))["conv"])
    node = full.select("head", "depth", "upto", "n_convs", "n_leaves", "below", "kids", "end_conv", "end_copies", "own",
                       above.alias("above"), F.posexplode("own").alias("at", "mine"))
    last = F.col("depth") + F.col("at") == F.col("upto")
    down = F.aggregate(F.slice("own", F.col("at") + 1, F.size("own")), F.lit(0).cast("long"), lambda a, x: a + x)
    return node.select(
        F.col("head").alias("conv_id"), (F.col("depth") + F.col("at")).cast("int").alias("depth"),
        F.when(F.col("at") > 0, F.col("head")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("below") + down).alias("saved_tokens"), F.when(last, F.col("end_conv")).alias("end_conv"),
        F.when(last, F.col("end_copies")).alias("end_copies"))


def _digests(every: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of groups of equal sequences, whose ids may be a large part of all.

    Ids are dealt by ranges and joined into pieces of a list; one task of a group reads pieces only.
    """
    members = lookup_join(every, groups.select("key", F.col("conv_id").alias("rep")), ["key"], spread=["conv_id"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, kept = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([rep], pa.int64()), pa.array([kept[0]], pa.int64()),
                 pa.array([",".join(map(str, kept))], pa.string())], names=["rep", "first", "ids"])

        for batch in batches:
            for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if kept and (r != rep or len(kept) == PIECE):
                    yield row()
                    kept = []
                rep = r
                kept.append(c)
        if kept:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([rep], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "ends_sha256"])

        for batch in batches:
            for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if state is not None and r == rep:
                    state.update(b",")
                else:
                    if state is not None:
                        yield row()
                    rep, state = r, hashlib.sha256()
                state.update(ids.encode())
        if state is not None:
            yield row()

    lists = (members.select("rep", "conv_id").repartitionByRange("rep", "conv_id")
             .sortWithinPartitions("rep", "conv_id").mapInArrow(pieces, "rep long, first long, ids string"))
    return (lists.repartition("rep").sortWithinPartitions("rep", "first")
            .mapInArrow(digest, "rep long, ends_sha256 string"))
