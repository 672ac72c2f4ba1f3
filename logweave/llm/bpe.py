"""Byte-level BPE by prefix dynamic programming, and its inverse."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.chunks import Chunks
from logweave.llm.common import text_slices, worker_cache

#: Entries that a Python worker keeps of tables of first bytes and of tested token pairs.
CACHE_HEADS = 50_000
CACHE_PAIRS = 100_000
_HEAD = 6
_NEVER = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixEncoder:
    """Encodes byte strings by the ranks of a vocabulary.

    For each prefix of a byte string exactly one token can be the last of the
    prefix's encoding: the one that ends there and stays apart from the last
    token of what precedes it. A table of these tokens is filled from left to
    right; it never depends on later bytes, so appended bytes continue it, and
    after an edit only the part behind the edit is filled again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.children: dict[int, tuple[int, int]] = {}
        self._pairs: dict[int, bool] = {}
        self._spines: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        #: tables of the first bytes of pieces met so far
        self._heads: dict[bytes, list[int]] = {}
        self.usable = dict(ranks)
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) == 2:
                    self.children[rank] = (ranks[parts[0]], ranks[parts[1]])
                else:  # no merges build it: it only stands for a whole piece
                    del self.usable[token]

    def _merge(self, data: bytes, below: int) -> list[bytes]:
        """The parts of ``data`` after all merges of a lower rank than ``below``."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i)
                          for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one edge of ``token`` while it is built, and the rank that ends it."""
        found = self._spines.get((token, side))
        if found is None:
            found, until, part = [], _NEVER, token
            while True:
                found.append((self.bytes_of[part], until))
                if part not in self.children:
                    break
                until, part = part, self.children[part][side]
            self._spines[token, side] = found
        return found

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` next to each other are an encoding of their bytes.

        They are not if, at some time of the merging, the part at the right
        edge of ``a`` and that at the left edge of ``b`` merge first.
        """
        key = a << 20 | b
        found = self._pairs.get(key)
        if found is None:
            found = True
            for x, x_until in self._spine(a, 1):
                for y, y_until in self._spine(b, 0):
                    rank = self.ranks.get(x + y, _NEVER)
                    # of two merges of one rank the left one comes first
                    if rank < x_until and rank <= y_until and rank != _NEVER:
                        found = False
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            self._pairs[key] = found
        return found

    def fill(self, data: bytes, last: list[int]) -> None:
        """Continue a prefix table to the end of ``data``.

        ``last[i]`` is the token that ends with byte ``i``; the list has the
        bytes that are known already.
        """
        get, pairs = self.usable.get, self._pairs
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                token = get(data[start:end])
                if token is None:
                    continue
                if not start:
                    break
                apart = pairs.get(last[start - 1] << 20 | token)
                if apart or apart is None and self.stay_apart(last[start - 1], token):
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
            last.append(token)

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding that a prefix table stands for."""
        out, at = [], len(last) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one piece; pieces share the tables of their first bytes."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        head = data[:_HEAD]
        known = self._heads.get(head)
        if known is None:
            known = []
            self.fill(head, known)
            if len(self._heads) >= CACHE_HEADS:
                self._heads.clear()
            self._heads[head] = known
        last = known.copy()
        self.fill(data, last)
        return self.read_back(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EncodedText:
    """A text with its pieces and their prefix tables, for appends and edits."""

    def __init__(self, encoder: PrefixEncoder, pattern: str, text: str = ""):
        self.encoder, self.split, self.text = encoder, regex.compile(pattern), ""
        self.starts: list[int] = []
        self.tables: list[tuple[bytes, list[int]]] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters ``start`` to ``stop``; far pieces and prefixes before the edit stay."""
        text = self.text[:start] + new + self.text[stop:]
        # how a piece ends depends on the character behind it, so one more is split again
        keep = max(0, int(np.searchsorted(self.starts, start, side="left")) - 2)
        at = self.starts[keep] if keep < len(self.starts) else 0
        shift = len(text) - len(self.text)
        later = {s + shift: k for k, s in enumerate(self.starts) if s > stop}
        old = self.tables[keep:]
        starts, tables = self.starts[:keep], self.tables[:keep]
        for n, found in enumerate(self.split.finditer(text, at)):
            known = later.get(found.start())
            data = found.group().encode()
            if known is not None and found.start() > start + len(new) and self.tables[known][0] == data:
                starts += [s + shift for s in self.starts[known:]]
                tables += self.tables[known:]
                break
            starts.append(found.start())
            before = old[n] if n < len(old) else (b"", [])
            same = 0
            while same < min(len(data), len(before[0])) and data[same] == before[0][same]:
                same += 1
            last = before[1][:same]
            self.encoder.fill(data, last)
            tables.append((data, last))
        self.text, self.starts, self.tables = text, starts, tables

    def ids(self) -> list[int]:
        out: list[int] = []
        for data, last in self.tables:
            whole = self.encoder.ranks.get(data)
            out += [whole] if whole is not None else self.encoder.read_back(last)
        return out


def codec(path: str, pattern: str) -> tuple[PrefixEncoder, Chunks]:
    """The encoder of a rank file and its remembered chunks, made once in each Python worker."""
    kept = worker_cache()
    if ("bpe", path, pattern) not in kept:
        encoder, split = PrefixEncoder(load_ranks(path)), regex.compile(pattern).findall
        packed = {rank: rank.to_bytes(4, "little") for rank in encoder.bytes_of}.__getitem__

        def piece(text: str) -> bytes:
            return b"".join(map(packed, encoder.encode(text.encode("utf-8", "replace"))))

        kept["bpe", path, pattern] = encoder, Chunks(lambda t: b"".join(map(piece, split(t))), piece)
    return kept["bpe", path, pattern]


def _unpack(packed: list[bytes | None], path: str) -> list[bytes | None]:
    """The bytes that packed ids stand for."""
    kept = worker_cache()
    if ("bytes", path) not in kept:
        kept["bytes", path] = {r: b for b, r in load_ranks(path).items()}
    of = kept["bytes", path].__getitem__
    return [None if ids is None else b"".join(map(of, np.frombuffer(ids, "<u4").tolist())) for ids in packed]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text as packed little-endian 32-bit token ids.

    Null and empty texts give empty ids, null or repeated doc_ids a row each;
    other columns are ignored, an empty table gives no rows. Rows are encoded
    where they are read: no shuffle. A text is worked on piece by piece, and a
    worker keeps a limited number of encoded pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunks = codec(path, pattern)
        for part in text_slices(batches, "text"):
            packed = list(map(chunks.text, part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())],
                                             names=["doc_id", "ids"])

    return _texts(docs, text).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that packed ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"),
                     pa.array(_unpack(part.column("ids").to_pylist(), path), pa.binary())],
                    names=["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids") \
        .mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` in one pass, with one Python worker a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunks = codec(path, pattern)
        for part in text_slices(batches, "text"):
            packed = list(map(chunks.text, part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(packed, pa.binary()), pa.array(_unpack(packed, path), pa.binary())],
                names=["doc_id", "ids", "decoded"])

    return _texts(docs, text).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Per row of ``docs``: number of tokens, SHA-256 of the ids and of the decoded bytes."""
    return round_trip(docs, path, pattern, text).select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
