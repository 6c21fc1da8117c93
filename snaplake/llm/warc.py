"""Dictionary-compressed WARC archives: writer and reader.

Layout of an archive (.warc.zst): a skippable frame (magic number 0x184D2A5D) that holds a Zstandard dictionary, then one
Zstandard frame for each record, compressed with it, so a record can be read alone by its offset.  The dictionary is built from the archive's
own records: the writer holds the records of one archive (ARCHIVE_BYTES of blocks, or one larger record), trains on a sample of them at even
distances and writes.  Where training finds nothing (few records, or all alike) the dictionary is plain content: the ends of the sample.

Records: a warcinfo record first; then, for each page, a response with an HTTP header and the html in UTF-8, or a revisit
(identical-payload-digest) that refers to the response with the same payload.  Of pages with equal payloads of at least `least` bytes the
one with the smallest page_id is the response (null ids last; of rows that are equal in page_id too, one), the others revisit it.
Fields of our own: Snaplake-Page-ID, Snaplake-Payload-Length, Snaplake-Refers-To-Page-ID.  A record's id follows from the write and the row's
place in it, so a revisit names its response's id without reading it.

Archives lie in the shared folder.  Pages are numbered and written once, and all else reads that table; html is joined with its marks by number, so
a payload that is there often is spread like any other.  A task writes under a name of its own and reports it in a manifest; files of lost attempts are
named by no manifest.  Null html is an empty payload; a null page_id or url gives a record without that field.  Payloads may be of any
length; repeated rows give a record each.  An empty table gives no archive.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, materialize, text_chunks

ARCHIVE_BYTES, TRAIN_SAMPLES, DICTIONARY_BYTES, LEVEL = 16 << 20, 256, 65_536, 3
SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in str(value))


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *((k, v) for k, v in fields if v is not None), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def record_id(write: uuid.UUID, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(write, str(place))}>"


class Page(NamedTuple):
    """A page with its mark: `response` is (place, page_id, url) of the response it revisits, or None if it is one itself."""

    place: int
    page_id: int | None
    url: str | None
    html: str | None
    response: tuple[int, int | None, str | None] | None = None


def page_record(page: Page, write: uuid.UUID, date: str) -> bytes:
    payload = (page.html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields: list[tuple[str, object]] = [
        ("WARC-Record-ID", record_id(write, page.place)),
        ("WARC-Date", date),
        ("WARC-Target-URI", page.url),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Snaplake-Page-ID", page.page_id),
        ("Snaplake-Payload-Length", len(payload)),
    ]
    if page.response is None:
        return record("response", fields, http + payload)
    place, page_id, url = page.response
    refers = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(write, place)), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("Snaplake-Refers-To-Page-ID", page_id)]
    return record("revisit", [*fields, *refers], http)


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    sample = records[:: max(1, len(records) // TRAIN_SAMPLES)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 8)), sample)
    except zstandard.ZstdError:  # too few records, or too alike to learn from
        ends = b"".join(r[: max(256, DICTIONARY_BYTES // len(sample))] for r in sample)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(ends, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> bytes:
    """One archive."""
    dictionary = build_dictionary(records)
    body = dictionary.as_bytes()
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(body)), body, *map(squeeze.compress, records)])


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends."""
    checked = data[at + 4] & 4
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * bool(checked)


def unpack(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive's records, from its bytes alone."""
    data = memoryview(archive)
    magic, size = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with its dictionary")
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])))
    at = 8 + size
    while at < len(data):
        end = _frame_end(data, at)
        yield at, expand.decompress(data[at:end])
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of an address and the path in it; Hadoop's names of S3 are Arrow's s3."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return pyarrow.fs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:", uri) else "file://" + uri)


def _marked(pages: DataFrame, least: int) -> DataFrame:
    """place, page_id, url, html and response (place, page_id, url; null for responses) of each page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("place"), "*", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("size")), "pages")
    narrow = rows.where(F.col("size") >= least).select("place", "page_id", "digest", "url")
    best = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "place", "url")
    firsts = narrow.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("n")).where("n > 1").select("digest", "best")
    revisits = narrow.join(firsts, "digest").where(F.col("place") != F.col("best.place"))
    marks = revisits.select("place", F.struct("best.place", "best.page_id", "best.url").alias("response"))
    return rows.select("place", "page_id", "url", "html").join(marks, "place", "left")


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives of pages (page_id, url, html) into folder; returns the manifest (path, records, bytes)."""
    write = uuid.uuid4()
    bounded_batches(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)

        def info() -> bytes:
            return record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

        def flush(have: list[bytes]) -> pa.RecordBatch:
            name, body = f"{uuid.uuid4().hex}.warc.zst", pack(have)
            # by default Arrow would compress a file of this name once more
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(body)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(have) - 1], "bytes": [len(body)]})

        have, size = [info()], 0
        for rows, htmls in text_chunks(batches, "html"):
            others = [rows.column(c).to_pylist() for c in ("place", "page_id", "url", "response")]
            for place, page_id, url, response, html in zip(*others, htmls, strict=True):
                have.append(page_record(Page(place, page_id, url, html, response and tuple(response.values())), write, date))
                size += len(have[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush(have)
                    have, size = [info()], 0
        if len(have) > 1:
            yield flush(have)

    return materialize(_marked(pages, least).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for each page record of the archives that manifest (path) names; digests of responses are checked against their payloads.

    A row has page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits), path and offset of the record's frame.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _open(path)
                with store.open_input_stream(at, compression=None) as source:
                    archive = source.read()
                rows: list[tuple] = []
                for offset, raw in unpack(archive):
                    fields, block = parse(raw)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                    payload = block.partition(b"\r\n\r\n")[2]
                    if not revisit and (payload_digest(payload) != digest or len(payload) != int(fields["Snaplake-Payload-Length"])):
                        raise ValueError(f"{path}: a payload doesn't match its digest")
                    ids = [None if (x := fields.get(k)) is None else int(x) for k in ("Snaplake-Page-ID", "Snaplake-Refers-To-Page-ID")]
                    rows.append((ids[0], int(fields["Snaplake-Payload-Length"]), digest, fields["WARC-Type"], ids[1], None if revisit else payload, path, offset))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "path", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    paths = manifest.select("path")
    return paths.repartition(max(1, min(paths.count(), 20_000)), "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, path string, offset long")


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as read back from the archives written for it."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
