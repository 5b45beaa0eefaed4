"""WARC: archives compressed with Zstandard, a dictionary in a leading skippable frame and one frame for each record.

The writer packs records into archives of bounded size; the reader takes the dictionary from the skippable frame, decodes
frame after frame, and checks the version line, the header fields and all lengths. Of records with equal payloads the one
with the largest page_id holds the payload; the others are revisit records, which name it and its digest.

Defined cases: null html is an empty payload; null page_ids are least in the order, and rows that tie on the largest page_id
of a payload are all responses; where all page_ids of a payload are null, all are responses; a null address is written as
about:blank and read back so; an empty table gives no archives; a damaged archive raises BadArchive. Executors write archives as binary rows of a table in the shared folder, which is also how
read_files() hands over files: no task touches a local disk.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import text_of, written

#: Fixed by the formats: a skippable frame that holds a dictionary, a frame, a dictionary, profile of revisit records.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_ROWS, FILTER_BITS = 8 << 20, 64 << 10, 256, 24
NAMESPACE = "urn:marketlens:page:"


class BadArchive(ValueError):
    pass


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record: named fields, a blank line, an HTTP head that gives the payload's length, the payload unless revisited."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = "".join(c for c in url or "" if c >= " ") or "about:blank"
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<{NAMESPACE}{'null' if page_id is None else page_id}>"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if is_revisit:
        fields += [("WARC-Refers-To", f"<{NAMESPACE}{'null' if refers_to is None else refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadArchive(f"header line {line[:80]!r}")
        try:
            out[name.decode("ascii").lower()] = value.strip().decode("utf-8", "surrogatepass")
        except UnicodeDecodeError as e:
            raise BadArchive(f"header line {line[:80]!r}") from e
    return out


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise BadArchive(f"content length {value[:40]!r}")
    return int(value)


def parse(raw: bytes) -> dict:
    """A decoded record as a dict; headers and lengths are validated."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive("version line")
    f = _fields(lines[1:])
    if missing := {"warc-type", "warc-record-id", "content-length"} - f.keys():
        raise BadArchive(f"missing {missing}")
    n = _length(f)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive("length of the block")
    http, blank, payload = rest[:n].partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/1."):
        raise BadArchive("HTTP head")
    length = _length(_fields(http.split(b"\r\n")[1:]))
    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
    if f["warc-type"] == "response" and (len(payload) != length or digest != digest32(payload)):
        raise BadArchive("payload's length or digest")
    if f["warc-type"] == "revisit" and (payload or "warc-refers-to" not in f):
        raise BadArchive("revisit record")

    def page(name: str) -> int | None:
        value = f.get(name, "").strip("<>").removeprefix(NAMESPACE)
        return int(value) if value.lstrip("-").isdigit() else None

    return {"page_id": page("warc-record-id"), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "refers_to": page("warc-refers-to"), "payload_bytes": length, "payload_digest": digest, "payload": payload}


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from a bounded sample (SAMPLE_ROWS payloads); without enough data, the samples' start."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    """A skippable frame with the (compressed) dictionary, then one frame for each record."""
    packed = zstandard.ZstdCompressor().compress(dictionary)
    c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed + b"".join(map(c.compress, records))


def _frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of an archive."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        raise BadArchive("no leading dictionary frame")
    n = struct.unpack_from("<I", data, 4)[0]
    held = data[8 : 8 + n]
    if len(held) != n:
        raise BadArchive("dictionary cut off")
    if held[:4] == struct.pack("<I", FRAME):
        held = zstandard.ZstdDecompressor().decompress(held)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    at, view = 8 + n, memoryview(data)
    while at < len(data):
        frame = d.decompressobj()
        try:
            parts = [frame.decompress(view[at : at + (1 << 16)])]
            end = at + (1 << 16)
            while not frame.eof and end < len(data):
                parts.append(frame.decompress(view[end : end + (1 << 20)]))
                end += 1 << 20
        except zstandard.ZstdError as e:
            raise BadArchive(str(e)) from e
        if not frame.eof:
            raise BadArchive("frame cut off")
        at = min(end, len(data)) - len(frame.unused_data)
        yield b"".join(parts)


def read_archive(data: bytes) -> Iterator[dict]:
    return map(parse, _frames(data))


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages -> page_id, url, html, digest, target (page_id of the response), is_revisit.

    Narrow rows give the digests that occur twice, with their largest page_id. Pages whose digest a filter of 2^24 places
    rules out are responses and stay where they are; only the others' payloads go to the join by digest, where Spark splits
    hot digests. A corpus with more repeated digests than the filter tells apart moves more payloads, with the same result.
    """
    rows = pages.select("page_id", "url", "html", F.sha1(text_of("html").cast("binary")).alias("digest"))
    long_enough = rows.where(F.octet_length(text_of("html")) >= least_bytes)
    best = long_enough.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
    best = written(best.where("n > 1").select("digest", "target"), "repeated")
    place = F.xxhash64("digest").bitwiseAND((1 << FILTER_BITS) - 1)
    words = best.withColumn("place", place).selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, CAST(place & 63 AS INT)) AS mask")
    words = F.broadcast(words.groupBy("word").agg(F.bit_or("mask").alias("mask")))  # 2^18 rows of 16 bytes at most
    rows = rows.withColumn("place", place).withColumn("word", F.shiftright("place", 6)).join(words, "word", "left")
    maybe = F.coalesce(F.expr("shiftright(mask, CAST(place & 63 AS INT)) & 1L"), F.lit(0)) == 1
    rows = rows.withColumn("maybe", maybe).select("page_id", "url", "html", "digest", "maybe")
    alone = rows.where("NOT maybe").select("page_id", "url", "html", "digest", F.lit(None).cast(pages.schema["page_id"].dataType).alias("target"), F.lit(False).alias("is_revisit"))
    again = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    shared = rows.where("maybe").join(best, "digest", "left").select("page_id", "url", "html", "digest", "target", again.alias("is_revisit"))
    return alone.union(shared)


def write_archives(planned: DataFrame, dictionary: bytes) -> DataFrame:
    """archive (binary) rows of about ARCHIVE_BYTES; a larger record has an archive of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, html, digest, target, again in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode("utf-8", "surrogatepass")
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                held.append(record(page_id, url, payload, name, target, again))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.record_batch([pa.array([archive(held, dictionary)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([archive(held, dictionary)], pa.binary())], names=["archive"])

    return planned.mapInArrow(run, "archive binary")


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of a column `archive` of binary archives, one row each."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payload]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                got, size = [], 0
                for r in read_archive(data.as_buffer().to_pybytes()):
                    got.append(r)
                    size += len(r["payload"])
                    if size >= ARCHIVE_BYTES:
                        yield pa.record_batch([pa.array([r[n] for r in got], t) for n, t in zip(names, kinds)], names=names)
                        got, size = [], 0
                yield pa.record_batch([pa.array([r[n] for r in got], t) for n, t in zip(names, kinds)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    return archives.select("archive").mapInArrow(run, schema + ", payload binary" * payload)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files (up to 2 GB each) from any store that Spark reads."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive")))


def archived(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    sample = [(r[0] or "").encode("utf-8", "surrogatepass") for r in pages.select(F.substring("html", 1, 4096)).limit(SAMPLE_ROWS).collect()]
    stored = written(write_archives(plan(pages), train_dictionary(sample)), "warc")
    return read_archives(stored, payload=False)
