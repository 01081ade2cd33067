"""WARC archives: a native writer, and a reader that salvages what damage leaves.

The writer renders each record as one string and lets Spark's text sink put
the two line ends that close a record behind it, so the files are plain
WARC/1.1, written through Spark's commit protocol to any store.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
RECORD_END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes inflated at once.
INFLATE = 1 << 16
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of one archive, which is read whole by one task, and of a payload that is small.
ARCHIVE_BYTES, SMALL = 256 << 20, 128 << 10


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: ten hexadecimal digits are eight base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _clean(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(value, r"[\x00-\x1f\x7f]", "%20")


#: Bits of the filter of duplicated digests, and places that each digest sets. It fixes what is broadcast: 8 MB.
FILTER_BITS, FILTER_PLACES = 26, 4
#: Slices in which the filter travels.
FILTER_SLICES = 64


def _places(digests: pa.Array) -> np.ndarray:
    """The filter's bits for each digest, a row each: digits of the SHA-1 itself."""
    text = np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, 32).astype(np.uint64)
    digit = np.where(text >= 65, text - 65, text - 24)  # base 32: A to Z, then 2 to 7
    out = np.zeros((len(text), FILTER_PLACES), np.uint64)
    for k in range(FILTER_PLACES):
        for d in range(8 * k, 8 * k + 6):
            out[:, k] = out[:, k] * 32 + digit[:, d]
    return (out & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filters(batches):
    """The filter of a task's digests, in slices."""
    seen, any_row = np.zeros(1 << FILTER_BITS, bool), False
    for b in batches:
        if b.num_rows:
            seen[_places(b.column("digest")).ravel()], any_row = True, True
    if any_row:
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(np.packbits(seen), FILTER_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(FILTER_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "data"])


def _either(batches):
    """One slice over the tasks that set it; a slice's rows stream through."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for n, data in zip(b.column("slice").to_pylist(), b.column("data").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(data), np.uint8)
            held[n] = held[n] | part if n in held else part
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], names=["slice", "data"])


def digest_filter(digests: DataFrame) -> bytes:
    """A Bloom filter of fixed size over the column ``digest``; empty without rows.

    Tasks set bits; groups of tasks merge first, then each slice, so no task
    holds more than a group's slices. Only the filter reaches the driver.
    """
    kind = "slice int, data binary"
    some = digests.select("digest").mapInArrow(_filters, kind).repartition(8 * FILTER_SLICES, "slice", F.spark_partition_id() % 8).mapInArrow(_either, kind)
    rows = {r["slice"]: r["data"] for r in some.repartition(FILTER_SLICES, "slice").mapInArrow(_either, kind).collect()}
    return b"".join(zlib.decompress(rows[k]) for k in range(FILTER_SLICES)) if rows else b""


def _maybe(shared):
    @F.arrow_udf("boolean")
    def maybe(digests: pa.Array) -> pa.Array:
        bits = np.frombuffer(shared.value, np.uint8)
        at = _places(digests)
        return pa.array(((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)) if len(digests) else pa.array([], pa.bool_())

    return maybe


def records(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """A record string per page: page_id, record, size (bytes of the payload).

    Needs page_id, url, html. A null html is the empty payload. Of records
    with equal payloads of ``min_payload`` bytes or more the largest page_id
    is the response and all others revisit it; of rows with an equal largest
    page_id each is a response. A null page_id counts as the smallest. A null
    url gives a record without a target. Smaller payloads are all responses.

    Equal payloads are found as (digest, length, largest id) alone, whose
    maxima combine before their shuffle. Only pages that a Bloom filter takes
    for duplicated move, in a join that adaptive execution splits where one
    payload is very common; all others, whatever their size, become records
    where they are read. A page taken so by error joins with nothing and stays
    a response, so the filter's size is no limit on the result.
    """
    html = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    page = html.withColumn("digest", payload_digest(F.col("html"))).withColumn("size", F.octet_length("html").cast("bigint"))
    first = page.select("page_id", "digest", "size").where(F.col("size") >= min_payload)
    several = first.groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    largest = written(several, "payloads")
    bits = digest_filter(largest)
    if not bits:
        return _rendered(page.withColumn("response", F.lit(None).cast("bigint")))
    marked = page.withColumn("maybe", _maybe(pages.sparkSession.sparkContext.broadcast(bits))(F.col("digest")))
    alone = marked.where(~F.col("maybe")).drop("maybe").withColumn("response", F.lit(None).cast("bigint"))
    named = marked.where(F.col("maybe")).drop("maybe").join(largest, ["digest", "size"], "left")
    return _rendered(alone).unionByName(_rendered(named))


def _rendered(named: DataFrame) -> DataFrame:
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    target = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url")), F.lit("\r\n"))).otherwise("")
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri(F.col("response")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise("")
    http = F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit(RECORD_END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), uri(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}\r\n"), target, refers,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END),
    )
    return named.select("page_id", F.concat(head, block).alias("record"), "size")


def write(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """Write archives into the folder ``path``.

    No archive holds more than about ``ARCHIVE_BYTES``, unless one record
    alone does: payloads up to ``SMALL`` bytes go ``ARCHIVE_BYTES / SMALL`` to
    a file, larger ones as many as fit if all were as long as the longest.
    """
    made = records(pages, min_payload)
    sink = lambda d, most: d.select("record").write.mode("append").option("lineSep", RECORD_END).option("maxRecordsPerFile", max(1, most)).text(path)
    sink(made.where(F.col("size") <= SMALL), ARCHIVE_BYTES // SMALL)
    longest = pages.select(F.max(F.octet_length("html"))).first()[0] or 0
    if longest > SMALL:
        sink(made.where(F.col("size") > SMALL), ARCHIVE_BYTES // longest)


READ = "path string, offset bigint, length bigint, kind string, record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, reason string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archives under ``path``, plain or with gzip members.

    ``kind`` is ``record`` or ``gap``. A gap has the bytes that no valid record
    covers and the ``reason`` of the first failed check there. A revisit has
    the digest and size of the full payload but no payload. An empty file
    gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_salvage_batches, READ)


def _salvage_batches(batches):
    kinds = dict(path=pa.string(), offset=pa.int64(), length=pa.int64(), kind=pa.string(), record_type=pa.string(), record_id=pa.string(), target=pa.string(), refers_to=pa.string(), payload_digest=pa.string(), payload_bytes=pa.int64(), payload=pa.binary(), reason=pa.string())
    for b in batches:
        for at in range(b.num_rows):
            path, data = b.column("path")[at].as_py(), b.column("content")[at].as_buffer()
            lot, held = [], 0
            for row in salvage(memoryview(data)):
                lot.append({"path": path, **row})
                held += len(row.get("payload") or b"")
                if held >= 4_000_000 or len(lot) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in lot], t) for k, t in kinds.items()], names=list(kinds))
                    lot, held = [], 0
            if lot:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in lot], t) for k, t in kinds.items()], names=list(kinds))


class Bad(ValueError):
    """A failed check."""


class Archive:
    """The bytes of one archive, and what a search found ahead, so that no stretch is searched or read as a header twice.

    Places asked for must not fall.
    """

    def __init__(self, data) -> None:
        self.data, self.end = memoryview(data), len(data)
        self.ahead: dict[re.Pattern, int] = {}
        self.header_end, self.lines, self.sound_from, self.last = -1, [], 0, {}
        self.refused: tuple | None = None

    def find(self, what: re.Pattern, at: int) -> int:
        """The first place of ``what`` from ``at`` on, or the end."""
        if self.ahead.get(what, -1) < at:
            m = what.search(self.data, at)
            self.ahead[what] = m.start() if m else self.end
        return self.ahead[what]

    def header(self, at: int) -> tuple[dict[str, str], int]:
        """The fields of the header whose version line begins at ``at``, and where its block begins.

        Candidates with the same blank line behind them share one reading of
        the lines before it.
        """
        if self.data[at : at + 10] not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
            raise Bad("no version line")
        stop = self.find(BLANK, at)
        if stop == self.end or stop - at > HEADER_BYTES:
            raise Bad("no end of the header")
        if stop != self.header_end:
            self._read(at, stop)
        first = bisect.bisect_left(self.lines, at + 10)
        if first == len(self.lines) or first < self.sound_from:
            raise Bad("a header line has no colon")
        return {k: v for k, (n, v) in self.last.items() if n >= first}, stop + 4

    def _read(self, at: int, stop: int) -> None:
        self.header_end, self.lines, self.sound_from, self.last = stop, [], 0, {}
        place = at
        for n, line in enumerate(bytes(self.data[at:stop]).split(b"\r\n")):
            self.lines.append(place)
            place += len(line) + 2
            name, colon, value = line.partition(b":")
            if not colon or b"\n" in line or b"\r" in line:
                self.sound_from = n + 1
            else:
                self.last[name.decode("utf-8", "replace").strip().lower()] = (n, value.decode("utf-8", "replace").strip())


VERSION_AT, GZIP_AT, BLANK = (re.compile(re.escape(x)) for x in (VERSION, GZIP, b"\r\n\r\n"))
#: A header longer than this is a failed check.
HEADER_BYTES = 1 << 16
#: So is a longer field of a gzip header.
GZIP_FIELD = 1 << 10


def salvage(data):
    """Rows for the records and the gaps of one archive, in order; together they cover every byte.

    After a failed check the search goes on behind the place where the bad
    record began, for the next version line or gzip member that passes all
    checks. Searches and headers are read once, so the work grows with the
    archive and the records in it, not with the number of failed places.
    """
    archive = Archive(data)
    data, at, gap, reason, end = archive.data, 0, None, "", archive.end
    while at < end:
        try:
            row, after = member(data, at) if data[at : at + 3] == GZIP else plain(archive, at)
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            at = min(archive.find(VERSION_AT, at + 1), archive.find(GZIP_AT, at + 1))
            continue
        if gap is not None:
            yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": reason}
            gap = None
        yield row | {"kind": "record", "offset": at, "length": after - at}
        at = after
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": end - gap, "reason": reason}


def member(data: memoryview, at: int) -> tuple[dict, int]:
    """One gzip member that holds one record."""
    _gzip_header(data, at)
    stream, parts, after, step = zlib.decompressobj(31), [], at, 4 * GZIP_FIELD
    try:
        while after < len(data) and not stream.eof:
            parts.append(stream.decompress(data[after : after + step]))
            after, step = after + step, min(INFLATE, 2 * step)
    except zlib.error as e:
        raise Bad("gzip member doesn't inflate") from e
    if not stream.eof:
        raise Bad("gzip member is cut off")
    inner = Archive(b"".join(parts))
    row, used = plain(inner, 0)
    if used != inner.end:
        raise Bad("gzip member holds more than a record")
    return row, min(after, len(data)) - len(stream.unused_data)


def _gzip_header(data: memoryview, at: int) -> None:
    """Check a member's flags and that its extra field, name and comment are within ``GZIP_FIELD`` bytes each."""
    if len(data) - at < 18 or data[at + 3] & 0xE0:
        raise Bad("no gzip header")
    flags, place = data[at + 3], at + 10
    if flags & 4:
        size = int.from_bytes(data[place : place + 2], "little")
        if size > GZIP_FIELD:
            raise Bad("the extra field of a gzip header is too long")
        place += 2 + size
    for flag in (8, 16):
        if flags & flag:
            size = bytes(data[place : place + GZIP_FIELD]).find(b"\0")
            if size < 0:
                raise Bad("a name in a gzip header has no end")
            place += size + 1


def plain(archive: Archive, at: int) -> tuple[dict, int]:
    """One record from its version line to the two line ends behind its block."""
    data = archive.data
    head, start = archive.header(at)
    size = head.get("content-length", "")
    if not size.isascii() or not size.isdigit() or len(size) > 18:
        raise Bad("no content length")
    after = start + int(size)
    if after + 4 > len(data):
        raise Bad("the block is cut off")
    if data[after : after + 4] != b"\r\n\r\n":
        raise Bad("no record end behind the block")
    if not {"warc-type", "warc-record-id"} <= head.keys():
        raise Bad("a mandatory header is missing")
    row = {"record_type": head["warc-type"], "record_id": head["warc-record-id"], "target": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to")}
    if row["record_type"] in ("response", "revisit") and head.get("content-type", "").startswith("application/http"):
        told = head.get("warc-payload-digest", "").removeprefix("sha1:")
        block = (start, after, row["record_type"], told)
        if archive.refused and archive.refused[0] == block:  # another candidate's header led here
            raise Bad(archive.refused[1])
        try:
            row |= _http(data, *block)
        except Bad as e:
            archive.refused = (block, str(e))
            raise
    return row, after + 4


def _http(data: memoryview, start: int, after: int, record_type: str, told: str) -> dict:
    m = BLANK.search(data[start:after])
    if not m:
        raise Bad("no end of the HTTP header")
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", data[start : start + m.start()])
    if record_type == "revisit":
        return {"payload_digest": told or None, "payload_bytes": int(length[1]) if length else None}
    payload = data[start + m.end() : after]
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if told and told != found:
        raise Bad("the payload digest differs")
    if length and int(length[1]) != len(payload):
        raise Bad("the payload length differs")
    return {"payload": bytes(payload), "payload_digest": found, "payload_bytes": len(payload)}


def gzip_members(raw: bytes) -> bytes:
    """A plain archive as one gzip member per record; what isn't a record is left out."""
    out = []
    for row in salvage(raw):
        if row["kind"] == "record":
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(c.compress(raw[row["offset"] : row["offset"] + row["length"]]) + c.flush())
    return b"".join(out)
