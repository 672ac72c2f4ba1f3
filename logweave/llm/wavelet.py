"""Token ids of a corpus in shards, each a wavelet matrix in one compressed file."""

from __future__ import annotations

import json
import math
import os
import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave.llm.common import text_buffers, text_slices, with_row_key, worker_cache
from logweave.llm.files import new_folder, read_whole, write_once
from logweave.session import freeze

_MAGIC = b"WMATRIX1"
_BLOCK = 1 << 16
#: Tokens of a shard (the document that passes it still belongs to it), bytes of text of a sort partition.
SHARD_TOKENS = 4_000_000
PARTITION_BYTES = 24 << 20
#: Words that a worker remembers the ids of, twice; the library takes longest for new ones.
KEPT_WORDS = 350_000
#: Bytes of text that are encoded at a time.
SLICE_TEXT = 1 << 22
#: Signs that one piece has behind letters; an apostrophe may begin a piece of its own.
_SIGNS = string.punctuation.replace("'", "").encode()
#: Kinds of bytes: white space to cut before, printed ASCII signs, ASCII letters, bytes of other signs.
_BLANK, _PRINTED, _LETTER, _HIGH = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _BLANK
_KIND[0x21:0x7F] = _PRINTED
_KIND[list(string.ascii_letters.encode())] |= _LETTER
_KIND[0x80:] = _HIGH
_POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)


def build(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """The file of a shard: bit planes of ``ids`` with ranks, and its documents.

    Plane k has the k-th highest bit of every id. Ids with bit 0 go before
    those with bit 1 in the next plane, both in their order. Planes are cut into blocks,
    compressed one by one; the header has the ones before each block.
    """
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1).compress
    body, planes, at = [], [], 0

    def add(raw: bytes) -> list[int]:
        nonlocal at
        body.append(pack(raw))
        at += len(body[-1])
        return [at - len(body[-1]), at]

    for k in range(bits - 1, -1, -1):
        bit = (seq & seq.dtype.type(1 << k)) != 0
        raw = np.packbits(bit, bitorder="little")
        blocks, ones = [], 0
        for b in range(0, len(raw), _BLOCK):
            part = raw[b:b + _BLOCK]
            blocks.append([*add(part.tobytes()), ones])
            ones += int(np.bitwise_count(part).sum())
        planes.append({"zeros": len(seq) - ones, "blocks": blocks})
        seq = np.concatenate([seq.take(np.flatnonzero(~bit)), seq.take(np.flatnonzero(bit))])
    head = {"n": len(ids), "planes": planes, "docs": len(doc_ids),
            "lengths": add(np.asarray(lengths, "<i8").tobytes()), "ids": add(json.dumps(doc_ids).encode())}
    text = json.dumps(head).encode()
    return b"".join([_MAGIC, struct.pack("<I", len(text)), text, *body])


class WaveletMatrix:
    """Access, counting and occurrences of tokens from a shard's file; blocks are opened as needed."""

    def __init__(self, content: bytes):
        if content[:8] != _MAGIC:
            raise ValueError("not a shard of token ids")
        n, = struct.unpack_from("<I", content, 8)
        self._body = memoryview(content)[12 + n:]
        self._head = json.loads(content[12:12 + n])
        self._open: dict[tuple[int, int], np.ndarray] = {}
        self.n, self.bits = self._head["n"], len(self._head["planes"])

    def _read(self, a: int, b: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._body[a:b])

    def documents(self) -> tuple[list, np.ndarray]:
        """Document ids and numbers of tokens, in the order of the file."""
        return (json.loads(self._read(*self._head["ids"])),
                np.frombuffer(self._read(*self._head["lengths"]), "<i8"))

    def _block(self, plane: int, b: int) -> np.ndarray:
        if (plane, b) not in self._open:
            start, stop, _ = self._head["planes"][plane]["blocks"][b]
            self._open[plane, b] = np.frombuffer(self._read(start, stop), np.uint8)
        return self._open[plane, b]

    def _bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // 8 // _BLOCK)[i // 8 % _BLOCK]) >> (i % 8) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place ``i``."""
        blocks = self._head["planes"][plane]["blocks"]
        b = i // 8 // _BLOCK
        if b == len(blocks):
            return self.n - self._head["planes"][plane]["zeros"]
        raw, at = self._block(plane, b), i // 8 % _BLOCK
        part = int(np.bitwise_count(raw[:at]).sum())
        return blocks[b][2] + part + (int(raw[at] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def _down(self, plane: int, bit: int, i: int) -> int:
        ones = self._ones(plane, i)
        return self._head["planes"][plane]["zeros"] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        value = 0
        for plane in range(self.bits):
            bit = self._bit(plane, i)
            value = value << 1 | bit
            i = self._down(plane, bit, i)
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for plane in range(self.bits):
            bit = token >> (self.bits - 1 - plane) & 1
            start, stop = self._down(plane, bit, start), self._down(plane, bit, stop)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often ``token`` stands in places ``start`` to ``stop``."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def occurrence(self, token: int, k: int) -> int | None:
        """The place of the ``k``-th ``token`` (from 0), None if there are fewer."""
        if token >> self.bits:
            return None
        a, b = self._range(token, 0, self.n)
        if k >= b - a:
            return None
        at = a + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            rank = at - (self._head["planes"][plane]["zeros"] if bit else 0)
            at = self._select(plane, bit, rank)
        return at

    def _select(self, plane: int, bit: int, rank: int) -> int:
        """The place of the ``rank``-th ``bit`` of a plane."""
        blocks = self._head["planes"][plane]["blocks"]
        before = [o if bit else b * _BLOCK * 8 - o for b, (_, _, o) in enumerate(blocks)]
        b = int(np.searchsorted(before, rank, side="right")) - 1
        raw = self._block(plane, b)
        counts = np.cumsum(_POPCOUNT[raw] if bit else 8 - _POPCOUNT[raw])
        rank -= before[b]
        at = int(np.searchsorted(counts, rank, side="right"))
        rank -= int(counts[at - 1]) if at else 0
        for j in range(8):
            if int(raw[at]) >> j & 1 == bit:
                if not rank:
                    return (b * _BLOCK + at) * 8 + j
                rank -= 1
        raise IndexError(rank)

    def tokens(self) -> np.ndarray:
        """All tokens, in order: the planes are undone from the last to the first."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self._head["planes"])):
            raw = b"".join(self._read(a, b) for a, b, _ in plane["blocks"])
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            before = np.empty_like(out)
            before[np.flatnonzero(~bit)] = out[:plane["zeros"]]
            before[np.flatnonzero(bit)] = out[plane["zeros"]:] | out.dtype.type(1 << k)
            out = before
        return out


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stay, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts fall apart into chunks that the vocabulary's pattern encodes one by one.

    No piece has white space behind another sign, nor another sign behind a letter, and what the pattern
    finds does not depend on what stands before. So texts are cut before white space, between an ASCII
    letter and an ASCII sign, and behind a single line feed. Signs that may be white space of Unicode, and
    control characters, are not cut from the white space behind them.
    """
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    before, own = kind[:-1], kind[1:]
    high = (before & _HIGH) != 0
    if high.any():
        at = np.flatnonzero(high)
        # the byte before, and the one before that, of the last byte of a sign
        one, two = data[at - 1], data[at - 2]
        odd = (at < 2) | (one == 0xC2) | ((two >= 0xE1) & (two <= 0xE3) & np.isin(one, (0x80, 0x81, 0x9A, 0xA0)))
        high[at[odd]] = False
    cut[1:-1] = (((own & _BLANK) != 0) & (high | ((before & _PRINTED) != 0))
                 | ((before & _LETTER) != 0) & ((own & (_PRINTED | _LETTER)) == _PRINTED))
    cut[offsets] = True
    line = np.flatnonzero((data[:-1] == 10) & cut[:-2] & ((own & _PRINTED) != 0))
    cut[line + 1] = True
    return np.flatnonzero(cut[:-1])


class _Encoder:
    """Ids of whole columns of texts; a chunk goes to the library once while it is remembered."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.names, self.kept = self.tokenizer.model, _byte_letters(), kept
        self.now: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.letters: dict[str, bool] = {}

    def _piece(self, chunk: bytes) -> bytes:
        """Ids of a text that the pattern does not split."""
        return b"".join([t.id.to_bytes(4, "little")
                         for t in self.model.tokenize(chunk.decode("latin-1").translate(self.names))])

    def _letter(self, sign: str) -> bool:
        if sign not in self.letters:
            self.letters[sign] = len(self.tokenizer.pre_tokenizer.pre_tokenize_str("a" + sign)) == 1
        return self.letters[sign]

    def _new(self, chunk: bytes) -> bytes:
        """Ids of a chunk not remembered: letters and signs behind them are pieces, all else takes the library's steps."""
        word = chunk[1:] if chunk[:1] == b" " else chunk
        if word.isalpha():
            return self._piece(chunk)
        stem = word.rstrip(_SIGNS)
        if not stem:
            return self._piece(chunk) if word else self._whole(chunk)
        text = stem.decode()
        if text.isalpha() and all(map(self._letter, text)):
            tail = len(chunk) - len(word) + len(stem)
            return (self._remember(chunk[:tail]) + self._remember(chunk[tail:])
                    if tail < len(chunk) else self._piece(chunk))
        return self._whole(chunk)

    def _whole(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _remember(self, chunk: bytes) -> bytes:
        packed = self.now.get(chunk) or self.older.get(chunk) or self._new(chunk)
        if len(chunk) <= 48:
            if len(self.now) >= self.kept:
                self.older, self.now = self.now, {}
            self.now[chunk] = packed
        return packed

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a line, and how many each text has."""
        data, offsets = text_buffers(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = _cuts(data, offsets)
        edges = pa.py_buffer(np.append(starts, len(data)))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, edges, pa.py_buffer(data)])
        chunks = chunks.dictionary_encode()
        of, distinct = chunks.indices.to_numpy(), chunks.dictionary.to_pylist()
        packed = [self._remember(c) if ids is None else ids
                  for c, ids in zip(distinct, list(map(self.now.get, distinct)), strict=True)]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        n = size[of]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[of] - ends + n, n)
        at += np.arange(len(at))
        before = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return np.frombuffer(b"".join(packed), "<u4")[at], np.diff(before)


def _encoder(path: str) -> _Encoder:
    kept = worker_cache()
    if ("tokenizer", path) not in kept:
        kept["tokenizer", path] = _Encoder(path)
    return kept["tokenizer", path]


def write_shards(docs: DataFrame, path: str, end: int = 0, text: str = "text",
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(part, seq, uri, n_tokens): the files written, in order of ``part`` and ``seq``.

    Texts are encoded by the tokenizers file ``path``, each followed by the id
    ``end``, in ascending order of doc_id (rows without one first; rows of one id in an order of their
    texts). Rows are dealt out by ranges of doc_id; a task streams its range and starts a new file after
    ``shard_tokens``, so no range needs more memory than a file. Null and empty texts are the end
    id alone; an empty table gives no files. A repeated task writes new
    files; only those listed here count.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                     F.coalesce(F.col(text), F.lit("")).alias("text")))
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / PARTITION_BYTES))
    order = ["doc_id", F.xxhash64("text"), "_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        packed, ids, lengths, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            uri = write_once(folder, f"shard-{part:06d}-{seq:06d}",
                             build(np.concatenate(packed), ids, np.array(lengths)))
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([seq]), pa.array([uri]), pa.array([n])],
                names=["part", "seq", "uri", "n_tokens"])

        for batch in text_slices(batches, "text", SLICE_TEXT):
            found, size = encoder.column(batch.column("text"))
            found, size = np.insert(found, np.cumsum(size), end), size + 1
            doc_ids, begin, first = batch.column("doc_id").to_pylist(), 0, 0
            ends = np.cumsum(size)
            while first < len(doc_ids):
                # up to the document that fills the file
                last = min(int(np.searchsorted(ends, begin + shard_tokens - n)) + 1, len(doc_ids))
                stop = int(ends[last - 1])
                packed.append(found[begin:stop])
                ids += doc_ids[first:last]
                lengths += size[first:last].tolist()
                n, begin, first = n + stop - begin, stop, last
                if n >= shard_tokens:
                    yield flush()
                    packed, ids, lengths, n, seq = [], [], [], 0, seq + 1
        if ids:
            yield flush()

    return freeze(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                  .select("doc_id", "text")
                  .mapInArrow(run, "part long, seq long, uri string, n_tokens long"))


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): all documents of the files, from the files.

    ``start`` counts the ids of all documents before, ``ids`` are packed
    little-endian 32-bit numbers. One task reads some files, one file at a time.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file: the running sum is over the list of files only
    placed = shards.select("uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                matrix = WaveletMatrix(read_whole(uri))
                doc_ids, lengths = matrix.documents()
                tokens, ends = matrix.tokens(), np.cumsum(lengths)
                for a in range(0, len(doc_ids), 500):
                    at = slice(a, a + 500)
                    ids = [tokens[e - n:e].astype("<u4").tobytes()
                           for e, n in zip(ends[at].tolist(), lengths[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[at], pa.int64()), pa.array(base + ends[at] - lengths[at]),
                         pa.array(lengths[at]), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    files = max(1, shards.count())
    return placed.repartition(files, "uri").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def checks(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read back."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
