"""Media columns: texts as PNG images in binary columns, read back by chunks, and hashed.

``write_png`` and ``read_png`` know 8-bit grey and colour images without interlace; the reader
tests every chunk's checksum and undoes all five row filters in numpy. The hash is the signs of
the low frequencies of a cosine transform of the image shrunk to 32 x 32.
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

from . import _common

WIDTH = 192  #: bytes of a row: 64 pixels of three samples
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, width: int = WIDTH, samples: int = 3, level: int = 3, chunk: int = 1 << 20) -> bytes:
    """payload (a multiple of width bytes) as rows of an image, each filtered by its left neighbours or not at all."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    colour = {1: 0, 3: 2}[samples]
    data = np.zeros((len(rows), width + 1), np.uint8)
    data[:, 1:] = rows
    # Text has no slopes to follow; rows of long runs have.
    flat = (rows[:, samples:] == rows[:, :-samples]).mean(axis=1) > 0.5
    data[flat, 0] = 1
    data[flat, 1 + samples :] -= rows[flat, :-samples]
    packed = zlib.compress(data.tobytes(), level)
    head = struct.pack(">IIBBBBB", width // samples, len(rows), 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", packed[i : i + chunk]) for i in range(0, len(packed), chunk)) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> np.ndarray:
    """The samples of an image as rows; ValueError if it is damaged or of another kind."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2] != 8 or head[3] not in _SAMPLES or head[6]:
        raise ValueError("not a whole 8-bit image without interlace")
    samples = _SAMPLES[head[3]]
    width = head[0] * samples
    raw = zlib.decompress(b"".join(data))
    if len(raw) != head[1] * (width + 1):
        raise ValueError("rows are missing")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], width + 1), samples)


def unfilter(rows: np.ndarray, samples: int) -> np.ndarray:
    """Undo the row filters: runs of unfiltered and left-filtered rows at once, others row by row."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    left = kinds == 1
    if left.any():
        own = out[left].reshape(int(left.sum()), -1, samples)
        out[left] = np.cumsum(own, axis=1, dtype=np.uint8).reshape(len(own), -1)
    for r in np.flatnonzero(kinds > 1):
        above = out[r - 1] if r else np.zeros(out.shape[1], np.uint8)
        if kinds[r] == 2:
            out[r] += above
        elif kinds[r] in (3, 4):
            line, up = out[r].astype(np.int64), above.astype(np.int64)
            for i in range(len(line)):
                a = line[i - samples] if i >= samples else 0
                c = up[i - samples] if i >= samples else 0
                if kinds[r] == 3:
                    guess = (a + up[i]) // 2
                else:
                    p = a + up[i] - c
                    guess = min((abs(p - a), 0, a), (abs(p - up[i]), 1, up[i]), (abs(p - c), 2, c))[2]
                line[i] = (line[i] + guess) & 255
            out[r] = line
        else:
            raise ValueError("unknown filter")
    return out


_COSINES = np.cos(np.pi * (2 * np.arange(32)[None, :] + 1) * np.arange(9)[:, None] / 64)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest mixed frequencies exceed their median."""
    cuts = _cuts(len(samples))
    blocks = samples.reshape(len(samples), 32, -1).sum(axis=2, dtype=np.int64)
    grey = np.add.reduceat(blocks, cuts, axis=0) / np.diff(np.append(cuts, len(samples)))[:, None]
    small = grey[np.arange(32) * len(grey) // 32]
    waves = (_COSINES @ small @ _COSINES.T)[1:, 1:]
    bits = (waves > np.median(waves)).ravel()
    return np.packbits(bits).tobytes().hex()


def _cuts(rows: int) -> np.ndarray:
    """Where the (at most 32) bands of rows begin."""
    n = min(rows, 32)
    return np.arange(n) * rows // n


def pad(text: str | None, multiple: int = WIDTH) -> tuple[bytes, int]:
    data = (text or "").encode()
    want = max(multiple, -(-len(data) // multiple) * multiple)
    return data.ljust(want), len(data)


def store_media(docs: DataFrame, path: str, width: int = WIDTH) -> None:
    """Write doc_id, n_bytes, media of each row of ``docs`` (doc_id, text): its text as an image.

    Null and empty texts make an image of one row of spaces. Rows with equal doc_id stay apart, an
    empty table makes an empty one, further columns are ignored, a null doc_id is kept.
    """
    _common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            padded = [pad(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([n for _, n in padded], pa.int64()), pa.array([write_png(p, width) for p, _ in padded], pa.binary())], ["doc_id", "n_bytes", "media"])

    docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary").write.option("compression", "none").parquet(path)


def media_features(spark: SparkSession, path: str) -> DataFrame:
    """Digests and the cosine hash of each stored image, from its bytes."""
    _common.ship(spark)
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n, media in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist()):
                samples = read_png(media)
                payload = samples.tobytes()
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f.endswith("string") else pa.int64()) for c, f in zip(cols, names.split(", "))], [f.split()[0] for f in names.split(", ")])

    return spark.read.parquet(path).select(F.col("doc_id"), "n_bytes", "media").mapInArrow(run, names)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _common.work_dir(spark, "media")
    store_media(_common.documents(spark, sf_dir), path)
    return media_features(spark, path)


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the operator's rows: sizes and digests of what was read back."""
    return op9_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES = {"op9_media": op9_media, "media_payloads": media_payloads}

ORACLES = {
    "media_payloads": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT *, greatest(192, (n + 191) // 192 * 192) AS size FROM d)
 SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(text || repeat(' ', size - n)) AS payload_sha256 FROM p"""
}
