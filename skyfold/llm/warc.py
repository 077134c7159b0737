"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding whole records, and a last skippable frame with the
seek table (compressed and plain size of every frame). The index maps each record to bundle, frame and the place in
the frame's plain bytes, so one record costs one small read.

Payloads are compared by digest with partial aggregation; the join that marks revisits is an ordinary shuffle join,
whose large keys adaptive execution splits. Bundles go to the shared folder under names that no two attempts share, and
only those of committed attempts are in the index: a lost executor leaves at most files that nobody lists.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.session import scratch_path, stored

# The seekable format's skippable frame and footer, the profile of revisits.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, BUNDLE_BYTES, READ_BYTES = 256 << 10, 64 << 20, 8 << 20
LEAST_PAYLOAD = 1000
INDEX = "page_id {}, record_id string, bundle string, frame int, offset long, length long"
FRAMES = "bundle string, frame int, at long, size long, plain long"
RECORDS = "page_id {0}, record_id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to {0}, payload binary"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> tuple[str, bytes]:
    """(record id, bytes) of one record; a revisit carries no payload but its size and digest."""
    name = record_id(page_id, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else f'urn:page:{page_id}'}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class Bundle:
    """Writes one bundle; ``add`` returns (frame, offset)."""

    def __init__(self, folder: str):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.part, self.path = f"{path}/.{self.name}", f"{path}/{self.name}"
        self.out, self.zstd = self.fs.open_output_stream(self.part, compression=None), zstandard.ZstdCompressor(3)
        self.frame, self.sizes, self.written = bytearray(), [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self._flush()
        at = len(self.sizes), len(self.frame)
        self.frame += data
        return at

    def _flush(self):
        packed = self.zstd.compress(bytes(self.frame))
        self.out.write(packed)
        self.sizes.append((len(packed), len(self.frame)))
        self.written += len(packed)
        self.frame = bytearray()

    def close(self):
        if self.frame:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.part, self.path)


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of every frame, from the end of an open bundle."""
    end = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    table, at, found = file.read_at(8 * n, end - 9 - 8 * n), 0, []
    for size, plain in struct.iter_unpack("<II", table):
        found.append((at, size, plain))
        at += size
    return found


def fetch(folder: str, bundle: str, frame: int, offset: int, length: int) -> bytes:
    """The bytes of one record, by its index row."""
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{bundle}") as file:
        at, size, _ = seek_table(file)[frame]
        return zstandard.decompress(file.read_at(size, at))[offset:offset + length]


def parse(data: bytes):
    """(headers, block) of the records in a frame's plain bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"unknown version {version}")
        head = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("record without its end")
        yield head, data[start:stop]
        at = stop + 4


def marked(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the page that holds the payload, null for holders."""
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
                        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.length("payload") >= LEAST_PAYLOAD)
    holders = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(holders, "digest", "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("holder"), F.col("holder")).alias("refers_to"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into bundles in ``folder`` and return the stored index.

    Of equal payloads of at least 1000 bytes the page with the largest id is the response and the others are revisits;
    smaller payloads are all responses. A null html is an empty payload; a null url is named by the page; a page without
    id is a response. Rows equal in id and payload are all holders or all revisits, under one record id.
    """
    rows = marked(pages, page_id, url, html)
    kind = rows.schema["page_id"].dataType.simpleString()

    def archive(batches):
        bundle = None
        for batch in batches:
            ids, names, places = batch.column(0), [], []
            for page, link, payload, digest, holder in zip(*(c.to_pylist() for c in batch.columns)):
                bundle = bundle or Bundle(folder)
                name, data = record(page, link, payload, digest, holder, date)
                names.append(name), places.append((bundle.name, *bundle.add(data), len(data)))
                if bundle.written > BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(names, pa.string()), *(pa.array([p[i] for p in places], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64())))],
                names=["page_id", "record_id", "bundle", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    return stored(rows.mapInArrow(archive, INDEX.format(kind)), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """All records of the bundles that ``index`` lists, each frame on its own; digests of stored payloads are checked.

    Frames are dealt over one task for each ``READ_BYTES`` of records that the index lists. Null ids, urls and payloads
    come back as ``write`` stored them; an empty index gives no rows.
    """
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    kind = index.schema["page_id"].dataType.simpleString()
    number = kind in ("bigint", "int", "smallint", "tinyint")

    def tables(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for bundle in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/{bundle}") as file:
                    rows += [(bundle, i, *frame) for i, frame in enumerate(seek_table(file))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["bundle", "frame", "at", "size", "plain"])

    def records(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        typed = lambda x: x if x is None or not number else int(x)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{path}/{row['bundle']}") as file:
                    plain = zstandard.decompress(file.read_at(row["size"], row["at"]))
                rows = []
                for head, block in parse(plain):
                    payload = block[block.index(b"\r\n\r\n") + 4:]
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["Payload-Length"])
                    if head["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    rows.append((typed(head.get("Page-ID")), head["WARC-Record-ID"], head["WARC-Type"], head["WARC-Target-URI"], size, digest,
                                 typed(head.get("Refers-To-Page-ID")), payload if payloads and head["WARC-Type"] == "response" else None))
                ids = pa.int64() if number else pa.string()
                kinds = (ids, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), ids, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                                 names=["page_id", "record_id", "record_type", "target", "payload_bytes", "payload_digest", "refers_to", "payload"])

    frames = index.select("bundle").distinct().mapInArrow(tables, FRAMES).repartition(1 + size // READ_BYTES, "bundle", "frame")
    return frames.mapInArrow(records, RECORDS.format("bigint" if number else "string"))


def archive_folder(spark) -> str:
    """A new folder for bundles in the shared scratch folder."""
    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
