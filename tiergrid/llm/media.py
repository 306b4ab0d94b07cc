"""Media columns: bytes stored as lossless WebP pixels, read back, and features of the pixels."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import as_bytes, arrow_map, small_batches

#: A payload is padded with bytes 255 to a positive multiple of this; a row of pixels holds as much.
UNIT = 576
#: Rows of pixels in an image, as many as the format holds; only a longer payload is stored as several images, one after another.
MAX_ROWS = 1 << 14


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def store(payload: bytes) -> bytes:
    """The payload as lossless WebP files, one after another; every 8-bit sample is a byte of it."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT // 4, 4)
    return b"".join(webp.encode(rows[i : i + MAX_ROWS]) for i in range(0, len(rows), MAX_ROWS))


def load(stored: bytes) -> list[np.ndarray]:
    """Pixel arrays of the files in ``stored``."""
    out, at = [], 0
    while at < len(stored):
        end = at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        out.append(webp.decode(stored[at:end]))
        at = end
    return out


def features(images: list[np.ndarray]) -> str:
    """Size, mean and spread of each channel, and a difference hash of an 8 x 8 grid of means."""
    whole = images[0] if len(images) == 1 else np.concatenate(images)
    rows, width, _ = whole.shape
    flat = whole.reshape(-1, 4)
    counts = np.bincount((flat + np.arange(4, dtype=np.uint16) * 256).ravel(), minlength=1024).reshape(4, 256)
    mean = counts @ np.arange(256) / len(flat)
    spread = np.sqrt(np.maximum(counts @ np.arange(256) ** 2 / len(flat) - mean**2, 0))
    profile = whole.sum(axis=2, dtype=np.int64)
    edges = np.linspace(0, rows, min(8, rows) + 1).astype(int)[:-1]
    grid = np.add.reduceat(np.add.reduceat(profile, edges, axis=0), np.arange(0, width, width // 9)[:9], axis=1)
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    mark = int("".join("1" if b else "0" for b in bits), 2)
    return f"{width}x{rows};mean={','.join(f'{x:.3f}' for x in mean)};sd={','.join(f'{x:.3f}' for x in spread)};dhash={mark:016x}"


def media_columns(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store whole texts as lossless WebP, decode the stored bytes, and describe the pixels.

    Returns one row for each input row: ``doc_id``, ``n_bytes`` (of the UTF-8 text), ``media`` (the stored form),
    ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the last 32 bytes) and ``feature``, the last four from the
    decoded pixels.  A null text is empty, and an empty text is one row of white pixels.  Equal
    texts give equal values.  Ids pass through unread, null or repeated; other columns are ignored.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in as_bytes(batch.column("text")):
            stored = store(pad(text))
            images = load(stored)
            read = images[0].tobytes() if len(images) == 1 else b"".join(i.tobytes() for i in images)
            rows.append((len(text), stored, len(read), sha256(read).hexdigest(), zlib.crc32(read[-32:]), features(images)))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        names = ["n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, run, f"doc_id {kind}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
