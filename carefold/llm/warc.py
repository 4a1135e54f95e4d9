"""WARC (operator 12): web pages as WARC records, a gzip member each, and a splittable reader of such archives.

Writing: payloads are named by their SHA-256. Of equal payloads of MIN_REVISIT bytes or more the one of the least page
is a response record, the others are revisit records, which have the HTTP header only; smaller ones are all responses.
First pages are found by an aggregation over narrow rows that is combined before it is shuffled; only digests that
repeat go on to the join with the pages, in which hot digests are broadcast. A task writes one archive under a name of
its own attempt and renames it when it is whole.

Reading: archives are cut into byte ranges wherever the records lie. A task looks for the gzip magic from the beginning
of its range, takes a candidate for a member if it decodes to a WARC header, follows the members from there, and owns
those that start inside the range; the last one may end beyond it. Bytes that look like a member within another one (an
archive in a payload that did not compress) can mislead the first candidate of a range, so each range says where its
first record starts and where its last one ends; a range that does not begin where the one before it ends is read
again from there, until all ranges of a file join up.

Defined results: a null html is an empty payload; of equal payloads the least (page_id, url) is first, nulls last, and
of rows that repeat all three one is a response; null page_ids and urls have no such header and are null when
read; a url's characters outside printable ASCII are percent-encoded; an empty table gives no archive and an empty
result; extra columns are not written. A damaged member is given as a row with ``record_type`` 'damaged' that covers the bytes up to the
next valid member.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carefold.llm._common import join_with_hot_keys, materialize, shared_dir, table

MIN_REVISIT = 100
RANGE = 8 << 20
#: Bytes that are read at a time, and of a candidate's content to tell that it is a WARC header.
READ = 1 << 20
HEAD = 16

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the profile of revisit records whose payload is the same.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "file string, part long, start long, end long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary, next long"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


# Records.


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: tuple[int | None, str | None] | None, copy: int = 0) -> bytes:
    """A WARC record: a response with its ``payload``, or a revisit of ``refers_to``, (page_id, url) of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_name(page_id, url, digest, copy)}>", f"WARC-Date: {DATE}"]
    lines += _optional("WARC-Target-URI", _one_line(url)) + _optional("X-Page-ID", page_id)
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_name(*refers_to, digest, 0)}>", *_optional("WARC-Refers-To-Target-URI", _one_line(refers_to[1])), *_optional("X-Refers-To-Page-ID", refers_to[0])]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {copy} {digest} {_one_line(url)}").urn


def _one_line(url: str | None) -> str | None:
    return url if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def _optional(name: str, value: object) -> list[str]:
    return [] if value is None else [f"{name}: {value}"]


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> dict:
    """The fields of RECORD that a record says; raises ValueError if it is none. A response's digest is of its bytes."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    if not cut or not head.startswith(VERSION):
        raise ValueError("no WARC header")
    fields = _fields(head)
    size = int(fields["content-length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the record's length is not what its header says")
    http, _, body = rest[:size].partition(b"\r\n\r\n")
    kind, said = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    number = lambda name: int(fields[name]) if name in fields else None
    out = {"record_type": kind, "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "refers_to": number("x-refers-to-page-id"), "payload": None}
    if kind == "revisit":
        return out | {"payload_bytes": int(_fields(http)["content-length"]), "payload_digest": said}
    if kind == "response":
        digest = hashlib.sha256(body).hexdigest()
        if said and said != digest:
            raise ValueError("the payload is not what its digest says")
        return out | {"payload_bytes": len(body), "payload_digest": digest, "payload": body}
    return out | {"payload_bytes": size, "payload_digest": None}


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.decode().strip().lower(): value.decode().strip() for name, _, value in lines}


# Writing.


def write(pages: DataFrame, to: str) -> DataFrame:
    """Write archives to ``to``/warc and the list of them, (file, records, size), to ``to``/files; returns the list."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    named = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    named = named.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")})
    one = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "copies")
    groups = named.filter(F.col("size") >= MIN_REVISIT).groupBy("digest", "page_id", "url").agg(F.count("*").alias("copies"))
    firsts = groups.groupBy("digest").agg(F.min(one).alias("first"), F.sum("copies").alias("n")).filter("n > 1")
    firsts = materialize(firsts, "warc-firsts")
    met = join_with_hot_keys(named, firsts, "digest", "n", named.count())
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    revisits = F.when(F.col("first").isNotNull() & ~is_first, F.col("first"))
    repeated = F.coalesce(is_first & (F.col("first.copies") > 1), F.lit(False))
    rows = met.filter(~repeated).select("page_id", "url", "digest", "size", F.when(revisits.isNull(), F.col("payload")).alias("payload"), revisits.alias("first"), F.lit(0).cast("long").alias("copy"))
    if not firsts.filter("first.copies > 1").isEmpty():
        # Rows that repeat a first page in all meet as one row with their number, as one of them alone is a response.
        same = met.filter(repeated).groupBy("digest", "page_id", "url", "size").agg(F.first("payload").alias("payload"), F.first("first").alias("first"))
        same = same.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("first.copies") - 1)))
        again = F.col("copy") > 0
        same = same.select("page_id", "url", "digest", "size", F.when(~again, F.col("payload")).alias("payload"), F.when(again, F.col("first")).alias("first"), "copy")
        rows = rows.unionByName(same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(f"{to}/warc")
        part = TaskContext.get().partitionId()
        name, attempt = f"part-{part:06d}.warc.gz", f"{folder}/.part-{part:06d}-{uuid.uuid4().hex}"
        out, n, size = None, 0, 0
        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "size", "digest", "first", "copy")), strict=True):
                page_id, url, body, length, digest, first, copy = (x.as_py() for x in r)
                data = member(record(page_id, url, body, length, digest, first and (first["page_id"], first["url"]), copy))
                if out is None:
                    files.create_dir(folder)
                    out = files.open_output_stream(attempt, compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            files.move(attempt, f"{folder}/{name}")
            yield pa.record_batch([pa.array([name]), pa.array([n]), pa.array([size])], ["file", "records", "size"])

    kinds = "file string, records long, size long"
    rows.mapInArrow(run, kinds).write.parquet(f"{to}/files")
    return pages.sparkSession.read.schema(kinds).parquet(f"{to}/files")


# Reading.


class _Source:
    """A file that is read from a place on, a piece at a time."""

    def __init__(self, file: pyarrow.NativeFile, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def bytes_at(self, place: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``place`` on; pieces of READ bytes are kept for the next call."""
        n = min(n, self.size - place)
        if not self.at <= place <= place + n <= self.at + len(self.held):
            self.at, self.held = place, self.file.read_at(min(max(n, READ), self.size - place), place)
        return self.held[place - self.at : place - self.at + n]

    def decode(self, place: int, head_only: bool = False) -> tuple[bytes, int]:
        """(content, end) of the member that starts at ``place``; raises ValueError if none does."""
        unpacker, out, at = zlib.decompressobj(31), [], place
        try:
            while not unpacker.eof:
                data = self.bytes_at(at, 1 << 16)
                if not data:
                    raise ValueError("the member is cut off")
                out.append(unpacker.decompress(data, HEAD if head_only else 0))
                at += len(data)
                if head_only:
                    break
        except zlib.error as e:
            raise ValueError(str(e)) from e
        content = b"".join(out)
        if not content.startswith(VERSION):
            raise ValueError("no WARC header")
        return content, at - len(unpacker.unused_data)

    def next_member(self, place: int, end: int) -> int | None:
        """Where the first candidate from ``place`` on, before ``end``, that decodes to a WARC header starts."""
        while place < end:
            data = self.bytes_at(place, min(READ, end - place) + len(MAGIC) - 1)
            at = data.find(MAGIC)
            while at >= 0 and place + at < end:
                try:
                    self.decode(place + at, head_only=True)
                    return place + at
                except ValueError:
                    at = data.find(MAGIC, at + 1)
            place += READ
        return None


def members(source: _Source, begin: int, end: int, known: bool) -> Iterator[tuple[int, int, dict]]:
    """(start, end, fields) of the records that start from ``begin`` on and before ``end``, and of the damage behind them.

    ``begin`` is a record's place if that is ``known``; else the first record is looked for."""
    place = begin if known else source.next_member(begin, end)
    while place is not None and place < end:
        try:
            content, after = source.decode(place)
            fields = parse(content)
        except (ValueError, KeyError):
            after = source.next_member(place + 1, source.size)
            after = source.size if after is None else after
            fields = {"record_type": "damaged"}
        yield place, after, fields
        if after < source.size and source.bytes_at(after, len(MAGIC)) != MAGIC:
            found = source.next_member(after, source.size)
            found = source.size if found is None else found
            yield after, found, {"record_type": "damaged"}
            after = found
        place = after


def _ranges(spark: SparkSession, at: str, size: int) -> DataFrame:
    """(file, length, part, upto, begin, starts): the byte ranges of the archives in ``at``, each up to the next one;
    ``begin`` is known of the first one only."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(at).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length").filter("length > 0")
    parts = listed.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("part"))
    return parts.select("*", (F.col("part") + 1).alias("upto"), F.when(F.col("part") == 0, F.lit(0).cast("long")).alias("begin"), F.lit(None).cast("array<struct<part: long, start: long>>").alias("starts"))


def _read(ranges: DataFrame, at: str, size: int, payloads: bool) -> DataFrame:
    """RECORD for the records of each range, and one row without a type that says where its first record starts (null
    if it has none), where the range ends and, as ``next``, where the last record does.

    A task reads the ranges from ``part`` to before ``upto``, but not on from a record that is the first one of a later
    range by ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(at)
        for batch in batches:
            for r in batch.to_pylist():
                starts = {x["part"]: x["start"] for x in r["starts"] or ()}
                first, after, rows, held, upto = {}, {}, [], 0, r["upto"]
                with files.open_input_file(f"{folder}/{r['file']}") as opened:
                    source = _Source(opened, r["length"])
                    begin = r["part"] * size if r["begin"] is None else r["begin"]
                    for start, end, fields in members(source, begin, min(upto * size, r["length"]), r["begin"] is not None):
                        part = min(start // size, upto - 1)  # damage behind the last record may start beyond
                        if part > r["part"] and starts.get(part) == start:
                            upto = part
                            break
                        first.setdefault(part, start)
                        after[part] = end
                        row = {"file": r["file"], "part": part, "start": start, "end": end} | fields
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row.get("payload") or b"")
                        if held > READ or len(rows) >= 1000:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch([*rows, *({"file": r["file"], "part": p, "start": first.get(p), "end": min((p + 1) * size, r["length"]), "next": after.get(p)} for p in range(r["part"], upto))])

    return ranges.repartition("file", "part").mapInArrow(run, RECORD)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(c) for r in rows], kind) for c, kind in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def read(spark: SparkSession, at: str, size: int = RANGE, payloads: bool = True) -> DataFrame:
    """(file, start, end, record_type, page_id, url, refers_to, payload_bytes, payload_digest, payload): every record of
    the archives in ``at``, read in ranges of ``size`` bytes; a stored table. Without ``payloads`` these are null."""
    ranges = materialize(_ranges(spark, at, size), "warc-ranges")
    found = materialize(_read(ranges, at, size, payloads), "warc-records")
    while True:
        # One row for each range. The ranges of a file join up if each begins where the last one before it ended.
        told = found.filter("record_type IS NULL").select("file", "part", "start", "end", "next")
        before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        due = F.coalesce(F.last("next", ignorenulls=True).over(before), F.lit(0))
        inside = F.col("due") < F.col("end")  # else a record from before covers the whole range
        right = F.when(inside, F.coalesce(F.col("start") == F.col("due"), F.lit(False))).otherwise(F.col("start").isNull())
        wrong = told.withColumn("due", due).filter(~right).groupBy("file").agg(F.min("part").alias("part"), F.min_by("due", "part").alias("begin"))
        # From there on up to the first record that is known to begin a range.
        of = ranges.groupBy("file").agg(F.first("length").alias("length"), F.max("upto").alias("upto"))
        starts = told.filter("start IS NOT NULL").groupBy("file").agg(F.collect_list(F.struct("part", "start")).alias("starts"))
        again = wrong.join(of, "file").join(starts, "file", "left").select(*ranges.columns)
        again = materialize(again, "warc-again")
        if again.isEmpty():
            return found.filter("record_type IS NOT NULL").drop("part", "next")
        better = materialize(_read(again, at, size, payloads), "warc-records")
        rest = found.join(better.filter("record_type IS NULL").select("file", "part"), ["file", "part"], "left_anti")
        found = materialize(rest.unionByName(better), "warc-records")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_dir(spark, "warc")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if write(table(spark, sf_dir, "pages"), to).isEmpty():
        return spark.createDataFrame([], schema)
    return read(spark, f"{to}/warc", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, size >= 100 AND row_number() OVER same > 1 AS again, first_value(page_id) OVER same AS first
      FROM (SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size, sha256(coalesce(html, '')) AS digest FROM pages)
      WINDOW same AS (PARTITION BY digest ORDER BY page_id NULLS LAST, url NULLS LAST))
"""
