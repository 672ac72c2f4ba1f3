"""WARC archives: written by tasks, read back over byte ranges with verified record chains."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import stable, text_slices, with_row_key
from logweave.llm.files import new_folder, open_store, write_once
from logweave.operators.joins import lookup_join
from logweave.session import freeze

#: Bytes of an archive before a task starts the next one, and of a range that is read by one step.
FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
_PEEK = 1 << 14
_NO_ID = (1 << 63) - 1
#: Fixed values of the format.
_MAGIC = b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, url: str | None, date: str, digest: str, size: int,
            refers_to: str | None, block: bytes) -> bytes:
    """One record with its header and the two line ends behind it."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", _PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size)),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode("ascii", "replace") + b"\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None, row: int) -> str:
    return f"urn:x-row:{row}" if page_id is None else f"urn:x-page:{page_id}"


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """(uri, length): archives with one record per row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``least_bytes`` the one with the
    smallest page_id (of equal ids the first read; rows without id count as
    last) is a response, the others are revisits that refer to it and
    have no payload. A null html is an empty payload. Repeated ids give a record each;
    other columns are ignored; an empty table gives no archives. Digests of repeated
    payloads meet the rows by broadcast while measured small, else by a salted join.
    """
    folder = new_folder(pages.sparkSession, "warc")
    keyed = with_row_key(stable(pages).select(F.col("page_id").cast("long").alias("page_id"), "url",
                                      F.coalesce("html", F.lit("")).alias("html"))) \
        .withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1("html")))
    order = F.struct(F.coalesce("page_id", F.lit(_NO_ID)).alias("id"), F.col("_row").alias("row"))
    firsts = freeze(keyed.filter("digest IS NOT NULL").groupBy("digest")
                    .agg(F.min(order).alias("head"), F.count("*").alias("n")).filter("n > 1")
                    .select("digest", F.col("head.id").alias("head_id"), F.col("head.row").alias("head_row")))
    rows = lookup_join(keyed, firsts, ["digest"], "left", spread=["_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, records, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            uri = write_once(folder, f"part-{part:06d}-{seq:06d}.warc", b"".join(records))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size])], names=["uri", "length"])

        for batch in text_slices(batches, "html"):
            for r in batch.to_pylist():
                payload = r["html"].encode("utf-8", "replace")
                again = r["head_row"] is not None and r["head_row"] != r["_row"]
                head = None if not again else \
                    _urn(None if r["head_id"] == _NO_ID else r["head_id"], r["head_row"])
                records.append(_record(
                    "revisit" if again else "response", _urn(r["page_id"], r["_row"]), r["url"], date,
                    base32_sha1(payload), len(payload), head, _HTTP if again else _HTTP + payload))
                size += len(records[-1])
                if size >= file_bytes:
                    yield flush()
                    records, size, seq = [], 0, seq + 1
        if records:
            yield flush()

    return freeze(rows.select("_row", "page_id", "url", "html", "head_id", "head_row")
                  .mapInArrow(run, "uri string, length long"))


class _Source:
    """Bytes of a file by place; nothing is kept but one piece."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        self.length = self.file.size()

    def read(self, start: int, size: int) -> bytes:
        return self.file.read_at(max(0, min(size, self.length - start)), start) if start < self.length else b""


def _may_be_header(data: bytes) -> bool:
    """Whether the whole lines of ``data`` can begin a record header, of any length."""
    first, *fields = data.split(b"\r\n")[:-1] or [b"WARC/1.1"]
    return bool(re.fullmatch(rb"WARC/1\.[0-9]+", first)) and all(b":" in f for f in fields)


def _header(source: _Source, at: int, known: bytes = b"") -> tuple[dict[str, str], int] | None:
    """Fields of the record header at ``at`` and where its block starts; None if there is none."""
    size = _PEEK
    data = known if len(known) >= 64 else source.read(at, size)
    while True:
        end = data.find(b"\r\n\r\n")
        if end >= 0:
            break
        # what no header can begin with is not read on
        if at + len(data) >= source.length or not _may_be_header(data):
            return None
        size *= 4
        data = source.read(at, size)
    lines = data[:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[0-9]+", lines[0]):
        return None
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]+", fields.get("content-length", "")):
        return None
    return fields, at + end + 4


def _successor(source: _Source, at: int, known: bytes = b"") -> int | None:
    """Where the record after the one at ``at`` starts, if a whole record is there."""
    found = _header(source, at, known)
    if found is None:
        return None
    end = found[1] + int(found[0]["content-length"])
    return end + 4 if end + 4 <= source.length and source.read(end, 4) == b"\r\n\r\n" else None


def boundaries(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(uri, start, stop, entry): for each byte range of each file, the first record that starts in it.

    Every range is searched for the magic of a record; each candidate, true
    or inside a payload, has a successor by its own length. Within a range a task
    follows successors to the first place behind the range. Between ranges
    pointers are doubled from the file's start, and what is not
    reached from there is no record. Ranges in which no record starts, and files that start with
    none, have no row; behind a broken record nothing is reached any more.
    """
    links, reached = _reached(files, range_bytes)
    return links.join(reached, ["uri", "place"]).select("uri", "start", "stop", F.col("place").alias("entry"))


def _reached(files: DataFrame, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Candidates of all ranges, and the places (uri, place) that are reached from the starts of files."""
    ranges = files.filter("length > 0").select("uri", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")) \
        .withColumn("stop", F.col("start") + range_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, stop in zip(*(batch.column(c).to_pylist() for c in ("uri", "start", "stop")), strict=True):
                source = _Source(uri)
                data = source.read(start, stop - start + _PEEK)
                after: dict[int, int] = {}
                at = data.find(_MAGIC)
                while 0 <= at < stop - start:
                    behind = _successor(source, start + at, data[at:at + _PEEK])
                    if behind is not None:
                        after[start + at] = behind
                    at = data.find(_MAGIC, at + 1)
                leave: dict[int, int] = {}
                for place in sorted(after, reverse=True):
                    behind = after[place]
                    # None: the chain breaks inside the range
                    leave[place] = behind if behind >= stop else leave.get(behind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(leave), pa.string()), pa.array([start] * len(leave), pa.int64()),
                     pa.array([stop] * len(leave), pa.int64()), pa.array(list(leave), pa.int64()),
                     pa.array(list(leave.values()), pa.int64())],
                    names=["uri", "start", "stop", "place", "leave"])

    n = max(1, min(ranges.count(), 10 * files.sparkSession.sparkContext.defaultParallelism))
    links = freeze(ranges.repartition(n, "uri", "start").mapInArrow(
        scan, "uri string, start long, stop long, place long, leave long"))
    # only places that some chain enters a range at can be reached between ranges
    entered = links.select("uri", F.col("leave").alias("place")).filter("place IS NOT NULL").distinct()
    jump = freeze(links.select("uri", "place", "leave").filter("leave IS NOT NULL")
                  .join(entered.union(files.select("uri", F.lit(0).cast("long"))).distinct(), ["uri", "place"]))
    reached = files.select("uri", F.lit(0).cast("long").alias("place"))
    longest = files.agg(F.max("length")).first()[0] or 0
    for _ in range(math.ceil(math.log2(max(1, math.ceil(longest / range_bytes)))) + 1):
        further = reached.join(jump, ["uri", "place"]).select("uri", F.col("leave").alias("place"))
        reached = freeze(reached.union(further).distinct())
        ahead = jump.select("uri", F.col("place").alias("leave"), F.col("leave").alias("next"))
        jump = freeze(jump.join(ahead, ["uri", "leave"]).select("uri", "place", F.col("next").alias("leave")))
    return links, reached


def read_archives(files: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each verified record of ``files`` (uri, length).

    Columns: uri, offset, record_type, record_id, target_uri, refers_to (id of a record),
    payload_bytes and payload_digest (bare base32 SHA-1) of the full payload, and payload (null unless
    asked for, and in revisits). What a record holds is digested again; a digest other than its header's
    raises, and so does a file whose chain of records does not reach its length.
    """
    schema = ("uri string, offset long, record_type string, record_id string, target_uri string, "
              "refers_to string, payload_bytes long, payload_digest string, payload binary")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(),
             pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, stop, at in zip(*(batch.column(c).to_pylist() for c in ("uri", "stop", "entry")), strict=True):
                source, rows, size = _Source(uri), [], 0
                while at < min(stop, source.length):
                    found = _header(source, at)
                    behind = _successor(source, at)
                    if found is None or behind is None:
                        raise ValueError(f"{uri}: no whole record at {at}")
                    fields, begin = found
                    block = source.read(begin, behind - 4 - begin)
                    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                    again = fields.get("warc-type") == "revisit"
                    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    digest = said if again else base32_sha1(payload)
                    if said and digest != said:
                        raise ValueError(f"{uri}: the payload of the record at {at} has another digest")
                    rows.append((uri, at, fields.get("warc-type"), fields.get("warc-record-id", "").strip("<>"),
                                 fields.get("warc-target-uri"),
                                 fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                                 int(fields.get("x-payload-length", 0)) if again else len(payload), digest,
                                 payload if payloads and not again else None))
                    size += len(block)
                    at = behind
                    if size > 1 << 22 or at >= min(stop, source.length):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    links, reached = _reached(files, range_bytes)
    found = freeze(links.join(reached, ["uri", "place"]).select("uri", "start", "stop", F.col("place").alias("entry")))
    # places that a chain comes to and no record is at: the start of a file, or behind a range
    lost = (reached.join(files.select("uri", "length"), "uri").filter("place < length")
            .join(links, ["uri", "place"], "left_anti").select("uri", "place").first())
    if lost is not None:
        raise ValueError(f"{lost.uri}: no whole record at {lost.place}")
    n = max(1, min(found.count(), 10 * files.sparkSession.sparkContext.defaultParallelism))
    return found.repartition(n, "uri", "start").mapInArrow(run, schema)


def page_digests(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that pages were written as."""
    def page(urn: str) -> Column:
        return F.regexp_extract(urn, "^urn:x-page:(-?[0-9]+)$", 1).try_cast("long")

    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          page("refers_to").alias("refers_to"))
