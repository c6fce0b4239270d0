"""Texts as PNG images in a binary column, and low-frequency cosine hashes of what is read back.

The codec is plain: chunks with CRC tests, one zlib stream, and row filters that numpy
undoes.  Media are written to the shared folder and every figure of the result comes from
the bytes that are read again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table, text_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Pixels in a row, samples in a pixel (8-bit RGB); a row is 192 bytes.
WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
#: Side of the grey thumbnail, and of its block of low frequencies.
THUMB, LOW = 32, 8
#: Rows of an Arrow batch that are decoded at once.
BATCH = 256


class CorruptImage(ValueError):
    pass


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _up(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[1:] -= rows[:-1]
    return out


def encode_png(payload: bytes) -> bytes:
    """An RGB image of ``payload``, whose length is a positive multiple of 192.

    A row that differs from the row above in less than a quarter of its bytes is stored as
    that difference, all others as they are.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    up = _up(rows)
    use = np.count_nonzero(up, axis=1) * 4 < ROW
    use[0] = False
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = np.where(use, 2, 0)
    lines[:, 1:] = np.where(use[:, None], up, rows)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise CorruptImage("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise CorruptImage("a chunk is cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise CorruptImage(f"chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + n
    if kind != b"IEND":
        raise CorruptImage("no IEND")


def _paeth_row(row: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    out = row.astype(np.int64)
    for i in range(0, len(row), bpp):
        a = out[i - bpp : i] if i else np.zeros(bpp, np.int64)
        b = above[i : i + bpp].astype(np.int64)
        c = above[i - bpp : i].astype(np.int64) if i else np.zeros(bpp, np.int64)
        pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        out[i : i + bpp] = (out[i : i + bpp] + np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))) & 255
    return out.astype(np.uint8)


def _average_row(row: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    out = row.astype(np.int64)
    for i in range(0, len(row), bpp):
        left = out[i - bpp : i] if i else 0
        out[i : i + bpp] = (out[i : i + bpp] + (left + above[i : i + bpp]) // 2) & 255
    return out.astype(np.uint8)


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the filters of ``lines``, whose first column holds the filter types."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise CorruptImage("unknown row filter")
    for i in np.flatnonzero(kinds):
        above = rows[i - 1] if i else np.zeros(rows.shape[1], np.uint8)
        if kinds[i] == 1:
            rows[i] = np.cumsum(rows[i].reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kinds[i] == 2:
            rows[i] += above
        elif kinds[i] == 3:
            rows[i] = _average_row(rows[i], above, bpp)
        else:
            rows[i] = _paeth_row(rows[i], above, bpp)
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit, non-interlaced grey, RGB or RGBA image: height x width x samples."""
    parts, head = [], None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
    if head is None:
        raise CorruptImage("no IHDR")
    width, height, depth, colour, *rest = head
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or bpp is None or any(rest):
        raise CorruptImage("only 8-bit images that are not interlaced")
    raw = zlib.decompress(b"".join(parts))
    if len(raw) != height * (width * bpp + 1):
        raise CorruptImage("wrong number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * bpp + 1)
    return unfilter(lines, bpp).reshape(height, width, bpp)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(THUMB)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * THUMB))


def _pool(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n even bands of rows; bands share rows where there are fewer than n."""
    edge = np.arange(n) * len(a) // n
    counts = np.maximum(1, np.diff(np.append(edge, len(a))))
    return np.add.reduceat(a, edge, axis=0) / counts[:, None]


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: which low-frequency cosine coefficients of the grey thumbnail exceed their median."""
    grey = image.sum(axis=2, dtype=np.int64)
    thumb = _pool(_pool(grey, THUMB).T, THUMB).T
    basis = _cosines()
    low = np.rint((basis @ thumb @ basis.T) * 1024)
    bits = (low > np.median(low.reshape(-1)[1:])).reshape(-1)
    return np.packbits(bits).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, BATCH):
            batch = whole.slice(i, BATCH)
            sizes, media = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                sizes.append(len(text))
                media.append(encode_png(text.ljust(max(1, -(-len(text) // ROW)) * ROW)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, BATCH):
            batch = whole.slice(i, BATCH)
            rows = []
            for doc_id, n, media in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                image = decode_png(media)
                payload = image.tobytes()
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FEATURES, strict=True)], schema=_FEATURES)


def media_column(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8, filled with blanks to whole rows, as PNG.

    A null text is empty; it and the empty text fill one row.  Null ids and repeated rows
    are kept.  Other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Sizes, digests and cosine hash of ``media(doc_id, n_bytes, media)``; damaged media raise ``CorruptImage``."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _FEATURES))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "media")
    return media_features(ws.save(media_column(table(spark, sf_dir, "documents")), "media"))
