"""Media columns: PNG images in binary columns, read through zlib chunks with checksum tests, and low-frequency cosine hashes.

A payload of bytes is stored as an 8-bit greyscale image 576 samples wide. The reader checks the signature, the checksum of
every chunk, the header and the lengths, inflates the data and undoes the five row filters with numpy. The feature is the
sign pattern of the 8 by 8 lowest frequencies of a cosine transform of the image, shrunk to 32 by 32.

Defined cases: null is the empty text, one row of padding; damaged images raise BadImage (or give null features with
errors="null"); equal payloads give equal images and hashes; long texts make long images, without a cap.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, PAD = 576, 255
#: Bytes at the end of a payload that have a checksum of their own (fixed by the contract).
TAIL = 32
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format
GREY, SIDE, LOW = 0, 32, 8


class BadImage(ValueError):
    pass


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled up with 255 to a positive multiple of 576, and how many there were."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // WIDTH))
    return raw + bytes([PAD]) * (rows * WIDTH - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 1, piece: int = 1 << 20) -> bytes:
    """An 8-bit greyscale PNG of a two-dimensional array. Each row takes the filter of none, left and up with the least sum
    of differences; data go into chunks of at most `piece` bytes."""
    rows, width = samples.shape
    up = np.vstack((np.zeros((1, width), np.uint8), samples[:-1]))
    left = np.hstack((np.zeros((rows, 1), np.uint8), samples[:, :-1]))
    options = np.stack((samples, samples - left, samples - up))
    cost = np.abs(options[1:].view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    plain = np.minimum(samples, 256 - samples.astype(np.int16)).sum(1, dtype=np.int64)
    pick = np.vstack((plain[None], cost)).argmin(0).astype(np.uint8)
    body = np.hstack((pick[:, None], options[pick, np.arange(rows)])).tobytes()
    packed = zlib.compress(body, level)
    head = struct.pack(">IIBBBBB", width, rows, 8, GREY, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + piece]) for i in range(0, len(packed), piece))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, data) of each chunk up to IEND; every checksum is tested."""
    if png[:8] != SIGNATURE:
        raise BadImage("signature")
    at = 8
    while True:
        if at + 12 > len(png):
            raise BadImage("cut off")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data, end = png[at + 8 : at + 8 + n], at + 12 + n
        if end > len(png) or struct.unpack_from(">I", png, end - 4)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise BadImage(f"checksum of {kind!r}")
        yield kind, data
        if kind == b"IEND":
            if end != len(png):
                raise BadImage("data after the end")
            return
        at = end


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters of 8-bit greyscale: runs of plain, left and up rows as arrays, the others sample by sample."""
    out = rows.copy()
    i, n = 0, len(rows)
    while i < n:
        j = i + 1
        while j < n and kinds[j] == kinds[i]:
            j += 1
        above = out[i - 1] if i else np.zeros(rows.shape[1], np.uint8)
        if kinds[i] == 1:
            out[i:j] = np.cumsum(rows[i:j], 1, dtype=np.uint8)
        elif kinds[i] == 2:
            out[i:j] = np.cumsum(np.vstack((above[None], rows[i:j])), 0, dtype=np.uint8)[1:]
        elif kinds[i] in (3, 4):
            for r in range(i, j):
                above = _mean_or_paeth(int(kinds[i]), rows[r].tolist(), (out[r - 1] if r else np.zeros_like(rows[r])).tolist())
                out[r] = above
        elif kinds[i]:
            raise BadImage(f"filter {kinds[i]}")
        i = j
    return out


def _mean_or_paeth(kind: int, row: list[int], above: list[int]) -> list[int]:
    a = c = 0
    got = []
    for x, b in zip(row, above):
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        a, c = (x + guess) & 255, b
        got.append(a)
    return got


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale, not interlaced PNG."""
    head, inflate, body = None, zlib.decompressobj(), []
    for kind, data in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif head is None:
            raise BadImage("no header")
        elif kind == b"IDAT":
            body.append(inflate.decompress(data))
    if head is None or head[2:] != (8, GREY, 0, 0, 0):
        raise BadImage("only 8-bit greyscale is read")
    raw = np.frombuffer(b"".join(body) + inflate.flush(), np.uint8)
    if not inflate.eof or len(raw) != head[1] * (head[0] + 1):
        raise BadImage("length of the data")
    raw = raw.reshape(head[1], head[0] + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE)) * np.where(k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


_COSINES = _cosines()


def _shrunk(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n equal parts of the first axis, by exact areas (rows repeat where there are fewer than n)."""
    sums = np.vstack((np.zeros((1, a.shape[1])), np.cumsum(a, 0, dtype=np.float64)))
    at = np.arange(n + 1) * len(a) / n
    low = np.minimum(at.astype(int), len(a) - 1)
    edges = sums[low] + (at - low)[:, None] * a[low]
    return np.diff(edges, axis=0) * (n / len(a))


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 by 8 lowest frequencies lie above their median (the mean level set aside)."""
    small = _shrunk(_shrunk(samples, SIDE).T, SIDE).T
    f = np.round(_COSINES @ small @ _COSINES.T, 6)
    f[0, 0] = 0
    return np.packbits(f > np.median(f)).tobytes()


def with_images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, png: each text stored as an image in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                made = [payload_of(x) for x in rows.column(1).to_pylist()]
                png = [encode_png(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for p, _ in made]
                yield pa.record_batch([rows.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(png, pa.binary())], names=["key", "n_bytes", "png"])

    return docs.select(key, text).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, png binary")


def image_figures(images: DataFrame, errors: str = "raise") -> DataFrame:
    """images (key, n_bytes, png) read back -> digests of the payload and of the image, and the hash in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for png in batch.column(2).to_pylist():
                try:
                    samples = decode_png(png)
                except BadImage:
                    if errors == "raise":
                        raise
                    got.append((None,) * 3 + (len(png), hashlib.sha256(png).hexdigest(), None))
                    continue
                data = samples.tobytes()
                got.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-TAIL:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array([x[i] for x in got], t) for i, t in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), batch.column(1), *cols], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])

    kind = images.schema["key"].dataType.simpleString()
    return images.mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")
