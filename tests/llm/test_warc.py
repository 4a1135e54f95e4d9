"""WARC archives: what is written is read back, wherever the ranges cut; misleading and damaged bytes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow.fs
import pytest

from carefold.llm import warc
from carefold.llm._common import shared_dir
from tests.oracle import assert_same, connect

SCHEMA = "page_id long, url string, html string, digest string, first int"


def expected(rows: list[tuple]) -> list[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) by loops."""
    last = lambda x: (x is None, x)
    by: dict[bytes, list[tuple]] = {}
    for page_id, url, html in rows:
        by.setdefault((html or "").encode(), []).append((page_id, url))
    out = []
    for body, pages in by.items():
        pages.sort(key=lambda p: (last(p[0])[0], p[0] or 0, last(p[1])[0], p[1] or ""))
        for i, (page_id, _) in enumerate(pages):
            new = i == 0 or len(body) < 100
            out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if new else "revisit", None if new else pages[0][0]))
    return sorted(out, key=repr)


def made(n: int) -> list[tuple]:
    rnd = random.Random(n)
    noise = lambda size: "".join(chr(rnd.randrange(0x20, 0x2FF)) for _ in range(size))
    rows = [(i, f"http://a/{i}?é x", noise(rnd.randrange(0, 400))) for i in range(n)]
    rows += [(n + i, "http://hot", "h" * 150) for i in range(n)]  # one payload for half of the pages
    rows += [(7, "http://again", "r" * 120)] * 4 + [(7, "http://other", "r" * 120), (8, None, "r" * 120), (None, "http://n", "r" * 120)]
    rows += [(None, None, "m" * 130)] * 2 + [(9, "x", None), (10, "x", ""), (11, "a\r\nWARC-Type: b", "s" * 99), (12, "x", "s" * 99), (13, "x", "é" * 50), (14, "x", "é" * 50)]
    return rows + [(5000, "http://long", noise(20_000))]


@pytest.mark.parametrize("size", [511, 4096, warc.RANGE])
def test_written_and_read(spark, size):
    rows = made(60)
    to = shared_dir(spark, "test-warc")
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(3)
    files = warc.write(pages, to)
    assert sum(r.records for r in files.collect()) == len(rows)
    got = warc.read(spark, f"{to}/warc", size).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)
    texts = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    assert all(bytes(r.payload) == texts[r.payload_digest] for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id in (0, 11)} == {"http://a/0?%C3%A9%20x", "http://a/11?%C3%A9%20x", "a%0D%0AWARC-Type:%20b"}
    # The records of a file follow each other without a gap.
    for f in files.collect():
        places = sorted((r.start, r.end) for r in got if r.file == f.file)
        assert places[0][0] == 0 and places[-1][1] == f.size and all(a[1] == b[0] for a, b in zip(places, places[1:], strict=False))


def test_query(spark, tmp_path):
    rows = made(40)
    spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, warc.query(spark, str(tmp_path)).collect()), key=repr) == expected(rows)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.query(spark, str(tmp_path)).collect() == []


def stored(data: bytes) -> bytes:
    """A gzip member that holds the data as it is."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def archive(spark, *parts: bytes) -> str:
    to = shared_dir(spark, "test-warc")
    files, folder = pyarrow.fs.FileSystem.from_uri(to)
    files.create_dir(folder)
    with files.open_output_stream(f"{folder}/one.warc.gz", compression=None) as out:
        out.write(b"".join(parts))
    return to


def response(page_id: int, body: bytes) -> bytes:
    return warc.record(page_id, None, body, len(body), hashlib.sha256(body).hexdigest(), None)


@pytest.mark.parametrize("size", [64, 300, 1000, 1 << 20])
def test_archives_in_payloads(spark, size):
    """Whole archives that lie uncompressed in records' payloads are no records."""
    inner = b"".join(warc.member(response(100 + i, b"inner %d" % i * 20)) for i in range(8))
    middle = stored(response(50, inner)) + stored(response(51, b"x" * 500))
    parts = [warc.member(response(0, b"first")), stored(response(1, inner * 3)), stored(response(2, middle)), warc.member(response(3, b"")), stored(response(4, inner))]
    got = warc.read(spark, archive(spark, *parts), size).orderBy("start").collect()
    assert [(r.page_id, r.record_type) for r in got] == [(i, "response") for i in range(5)]
    assert [r.end - r.start for r in got] == [len(p) for p in parts]


@pytest.mark.parametrize("size", [50, 700, 1 << 20])
def test_damage(spark, size):
    good = [warc.member(response(i, b"body %d " % i * 60)) for i in range(7)]
    broken = bytearray(good[2])
    broken[len(broken) // 2] ^= 0xFF
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = other.compress(b"no record at all" * 9) + other.flush()
    parts = [b"junk", good[0], good[1], bytes(broken), good[3], b"between", other, good[4], good[5], good[6][:-3]]
    got = warc.read(spark, archive(spark, *parts), size).orderBy("start").collect()
    assert [r.page_id for r in got if r.record_type == "response"] == [0, 1, 3, 4, 5]
    places = [(r.start, r.end) for r in got]
    assert places[0][0] == 0 and places[-1][1] == sum(map(len, parts)) and all(a[1] == b[0] for a, b in zip(places, places[1:], strict=False))


def test_query_matches_sql(spark):
    assert_same(warc.query(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), warc.ORACLE)
