"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a skippable frame
that holds the seek table (the published seekable format), so a reader fetches any frame by
its range. The index maps each record to (bundle, frame, offset within the frame's content).
Of equal payloads from ``MIN_REVISIT_BYTES`` on only one is stored, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.llm.storage import Workspace, join_sized

MIN_REVISIT_BYTES = 1000
#: Content of a frame, and compressed size of a bundle, from which the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Frames that are read one after another are a run of about so many bytes of content.
READ_BYTES = 32 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, sha1_hex: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given (then ``payload`` is not stored)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes, at: int = 0):
    """(offset, headers, HTTP headers, payload) of each record in ``data`` from the offset ``at`` on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        cut = block.index(b"\r\n\r\n")
        http = dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])
        yield at, headers, http, block[cut + 4 :]
        at = end + 4 + size + 4


class BundleWriter:
    """Writes records to one bundle; ``close`` appends the seek table."""

    def __init__(self, sink):
        self.sink, self.table, self.frame, self.size = sink, [], bytearray(), 0
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """Append a record; where it is: (frame, offset)."""
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self.end_frame()
        at = len(self.table), len(self.frame)
        self.frame += record
        return at

    def end_frame(self) -> None:
        if self.frame:
            packed = self._compressor.compress(bytes(self.frame))
            self.sink.write(packed)
            self.table.append((len(packed), len(self.frame)))
            self.size += len(packed)
            self.frame.clear()

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.sink.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed size, content size) of each frame of an opened bundle."""
    size = source.size()
    source.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(size - 9 - 8 * frames)
    raw, at, out = source.read(8 * frames), 0, []
    for packed, content in struct.iter_unpack("<II", raw):
        out.append((at, packed, content))
        at += packed
    return out


def _open(uri: str):
    return FileSystem.from_uri(uri)


def _writer(folder: str):
    def write(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        writer, name, number = None, "", 0
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to"))):
                if writer is None:
                    # The task attempt is in the name: only files of attempts that succeed are in the index.
                    name = f"bundle-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.zst"
                    writer, number = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None)), number + 1
                record = record_bytes(*r)
                frame, offset = writer.add(record)
                rows.append((r[0], f"{folder}/{name}", frame, offset, len(record)))
                if writer.size >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)], names=_INDEX_NAMES)
                rows = []
        if writer is not None:
            writer.close()

    return write


_INDEX_NAMES = ["page_id", "bundle", "frame", "offset", "length"]
_INDEX_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def _reader(batches):
    for batch in batches:
        for uri, low, high in zip(*(batch.column(c).to_pylist() for c in ("bundle", "first", "last"))):
            fs, path = _open(uri)
            rows = []
            with fs.open_input_file(path) as source:
                for at, packed, content in seek_table(source)[low : high + 1]:
                    source.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=content)
                    for _, headers, http, payload in parse_records(data):
                        page = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                        kind = headers["WARC-Type"]
                        stored = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if kind == "response":
                            if hashlib.sha1(payload).hexdigest() != stored or len(payload) != int(http["Content-Length"]):
                                raise ValueError(f"record {page} of {uri} is damaged")
                        refers = headers.get("WARC-Refers-To")
                        rows.append((None if page == "null" else int(page), int(http["Content-Length"]), stored, kind, int(refers[len("<urn:page:") : -1]) if refers else None))
            if rows:
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=names)


def write_bundles(pages: DataFrame, work: Workspace) -> DataFrame:
    """Write a record per row of ``pages``; the index: page_id, bundle, frame, offset, length.

    Payloads are the UTF-8 bytes of ``html`` (null: empty). Rows whose page_id is null are
    responses, and rows that repeat the largest page_id of a payload are all responses.
    Which payloads are there more than once is found from their digests alone; payloads are
    written by the tasks that read them, unless the digests that repeat are too many to broadcast.
    Further columns, whatever their names, are ignored; no rows give an empty index.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.unhex(F.sha1("payload")))
    large = rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least"))
    kept = work.write(large.where("least < keeper").select("digest", "keeper"), "kept")
    joined = join_sized(rows, kept, ["digest"], 80, "left")
    revisit = F.when(F.col("page_id") < F.col("keeper"), F.col("keeper"))
    records = joined.select("page_id", "url", F.when(revisit.isNull(), F.col("payload")).alias("payload"), "payload_bytes", F.lower(F.hex("digest")).alias("digest"), revisit.alias("refers_to"))
    index = work.write(records.mapInArrow(_writer(work.new_path("bundles")), "page_id long, bundle string, frame long, offset long, length long"), "index")
    work.drop(kept)
    return index


def read_bundles(index: DataFrame) -> DataFrame:
    """Read all records of the bundles of an index (a written table) back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Runs of frames are dealt over tasks of their own; their number follows the bytes of content.
    """
    frames = index.groupBy("bundle", "frame").agg(F.sum("length").alias("bytes"))
    frames = frames.withColumn("run", F.floor(F.col("frame") * FRAME_BYTES / READ_BYTES))
    runs = frames.groupBy("bundle", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    total = index.agg(F.sum("length")).first()[0] or 0
    # A key that the runs are not already dealt by: else the exchange would be left out, and the few small rows put into one task.
    each = min(8 * READ_BYTES, max(READ_BYTES // 4, total // 2000))  # tasks for small inputs too, and not too many for large ones
    dealt = runs.repartition(max(1, -(-total // each)), F.xxhash64("bundle", "run"))
    return dealt.mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_at(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record (headers, HTTP headers, payload) at ``offset`` of a frame's content: only the seek table and that frame are read."""
    fs, path = _open(bundle)
    with fs.open_input_file(path) as source:
        at, packed, content = seek_table(source)[frame]
        source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=content)
    _, headers, http, payload = next(parse_records(data, offset))
    return headers, http, payload


def read_record(index: DataFrame, page_id: int | None) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of a page (more than one if rows repeat it), by way of the index; a revisit has the payload of the record it refers to."""
    out = []
    for r in index.where(F.col("page_id").eqNullSafe(F.lit(page_id).cast("long"))).orderBy("bundle", "frame", "offset").collect():
        headers, http, payload = read_at(r["bundle"], r["frame"], r["offset"])
        if headers["WARC-Type"] == "revisit":
            kept = index.where(F.col("page_id") == int(headers["WARC-Refers-To"][len("<urn:page:") : -1])).first()
            payload = read_at(kept["bundle"], kept["frame"], kept["offset"])[2]
        out.append((headers, http, payload))
    return out


def op6(pages: DataFrame) -> DataFrame:
    """One row per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_bundles(write_bundles(pages, Workspace(pages.sparkSession, "warc")))


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id < k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < k.keeper THEN k.keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
