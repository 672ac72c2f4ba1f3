"""Archives written and read back, records hidden in payloads, broken files, odd rows."""

import random

import pytest

from logweave.llm import warc
from logweave.llm.files import new_folder, write_once


def fake(n):
    return warc._record("response", f"urn:x-page:{n}", "http://fake", "2024-01-01T00:00:00Z", "X", 3, None,
                        b"abc").decode()


@pytest.mark.parametrize("range_bytes", [300, 4000, 1 << 20])
def test_round_trip(spark, range_bytes):
    r = random.Random(range_bytes)
    rows = []
    for i in range(120):
        html = r.choice(["", None, "same page", "é" * r.randrange(2000), fake(900 + i), "\r\n\r\n" + fake(5) * 3,
                         "WARC/1.1\r\n", "WARC/1.0\r\nContent-Length: 999999\r\n\r\n", f"<p>{i}"])
        rows.append((i, r.choice([None, "http://a/WARC/1.1\r\nContent-Length: 1", "http://ü/ x"]), html, "clash"))
    rows += [(None, "u", "same page", "c"), (7, "u", "again seven", "c"), (7, "u", "again seven", "c")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    files = warc.write_archives(df, file_bytes=20_000)
    assert files.count() > 3
    records = warc.read_archives(files, range_bytes=range_bytes)
    got = sorted(map(tuple, warc.page_digests(records).collect()), key=repr)
    first = {}
    for p, _, h, _ in rows:
        h = h or ""
        first[h] = min(first.get(h, 1 << 62), 1 << 62 if p is None else p)
    seen, want = set(), []
    for p, _, h, _ in sorted(rows, key=lambda x: (1 << 62 if x[0] is None else x[0])):
        h = h or ""
        data = h.encode()
        again = h in seen
        seen.add(h)
        want.append((p, len(data), warc.base32_sha1(data), "revisit" if again else "response",
                     first[h] if again else None))
    assert got == sorted(want, key=repr)
    texts = {r.payload for r in records.filter("record_type = 'response'").collect()}
    assert texts == {(h or "").encode() for _, _, h, _ in rows}


def test_broken_file_stops_at_the_break(spark):
    folder = new_folder(spark, "broken")
    good = b"".join(fake(i).encode() for i in range(5))
    uris = [(write_once(folder, "a", good + b"junk" + good), 2 * len(good) + 4), (write_once(folder, "b", b"junk" + good), len(good) + 4),
            (write_once(folder, "c", good[:-2]), len(good) - 2), (write_once(folder, "d", b""), 0)]
    files = spark.createDataFrame(uris, "uri string, length long")
    for r in (100, 1 << 20):
        found = warc.boundaries(files, r).groupBy("uri").count().collect()
        assert {x.uri for x in found} == {uris[0][0], uris[2][0]}
    found = warc.boundaries(files, 100).collect()
    assert all(x.entry < len(good) for x in found)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_archives(df)
    assert files.count() == 0 and warc.read_archives(files).count() == 0


def test_broken_files_raise_and_long_headers_are_read(spark):
    good = b"".join(warc._record("response", f"urn:x-page:{i}", "http://a", "d", warc.base32_sha1(b"abc"), 3, None, b"abc")
                    for i in range(5))
    for k, data in enumerate((good[:-2], good + b"junk" + good, b"junk" + good)):
        uri = write_once(new_folder(spark, "torn"), f"t{k}", data)
        for r in (100, len(good), 1 << 20):
            with pytest.raises(Exception, match="no whole record"):
                warc.read_archives(spark.createDataFrame([(uri, len(data))], "uri string, length long"), range_bytes=r).count()
    data = warc._record("response", "urn:x-page:1", "http://a/" + "u" * (70 << 20), "d", "X", 3, None, b"abc")
    source = warc._Source(write_once(new_folder(spark, "long"), "l", data))
    assert warc._successor(source, 0) == len(data)
