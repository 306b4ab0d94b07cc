"""Line dedup: a line found in several documents stays only in the smallest document id holding it.

Two Bloom filters (once-seen, twice-seen) pick the suspected repeats.  Only suspects shuffle, as
SHA-256 digests with the document id: the least and greatest id of a digest confirm the repeat
and name the document that keeps it.  Both are partial aggregates, and the keeper of a line that stands in a third of
all documents is sent to several tasks.  Of the texts only those that lose a line shuffle, picked by a filter of their ids.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import arrow_map, as_bytes, fields, materialise, release, small_batches, spread_join

SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """The stripped, A-Z lower-cased line, or None below ``least`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def document_keys(text: bytes, least: int) -> set[bytes]:
    return {k for k in (line_key(x, least) for x in text.split(b"\n")) if k is not None}


def drop_lines(text: bytes, digests: list[bytes] | None, least: int) -> tuple[int, int, bytes]:
    """(lines, dropped lines, kept text) of a document that loses the lines with these digests."""
    lines = text.split(b"\n")
    if not digests:
        return len(lines), 0, text
    lost = set(digests)
    kept = [x for x in lines if (k := line_key(x, least)) is None or sha256(k).digest() not in lost]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, max_bits: int = bloom.MAX_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines that a document with a smaller id also holds.

    Returns one row for each input row: ``doc_id``, ``n_lines``, ``n_dropped``, ``text`` (the kept lines joined
    by a line feed).  A null or empty text is one empty line.  Repeats inside one document, or in rows
    that share an id, count as one document and stay.  Rows with a null id take no part: their
    lines aren't counted and all stay.  Lines under ``min_chars`` code points always stay.  Other columns
    are ignored, whatever their names, save those that ``carry`` names, which come back with their row.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry)

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [xxhash.xxh3_64_intdigest(k) for t in as_bytes(batch.column("text")) for k in document_keys(t, min_chars)]
        return bloom.packed_rows(np.array(found, np.uint64))

    known = docs.where(F.col("doc_id").isNotNull())
    twice = spark.sparkContext.broadcast(bloom.twice_filter(arrow_map(known.select("text"), hashes, bloom.PACKED), "lines", max_bits))

    def suspects(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            own = list(document_keys(text, min_chars))
            hit = twice.value.contains(np.array([xxhash.xxh3_64_intdigest(k) for k in own], np.uint64))
            for k in np.flatnonzero(hit):
                ids.append(doc)
                keys.append(sha256(own[k]).digest())
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = materialise(arrow_map(known.select("doc_id", "text"), suspects, f"doc_id {kind}, key binary"), "lines-suspects")
    repeated = seen.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").select("key", "keeper")
    lost = spread_join(seen, repeated, "key").where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
    lost = materialise(lost, "lines-lost")
    release(seen)
    losers = spark.sparkContext.broadcast(bloom.member_filter(lost.select(F.xxhash64("doc_id").alias("h")), "h", "lines-losers", max_bits))

    def may_lose(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(losers.value.contains(bloom.hash_ids(batch.column("h").to_numpy())), pa.bool_())

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone = batch.column("lost").to_pylist() if "lost" in batch.schema.names else [None] * len(batch)
        rows = [drop_lines(t, g, min_chars) for t, g in zip(as_bytes(batch.column("text")), gone, strict=True)]
        total, dropped, kept = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *(batch.column(c) for c in carry)],
            names=["doc_id", "n_lines", "n_dropped", "text", *carry],
        )

    schema = f"doc_id {kind}, n_lines long, n_dropped long, text string{fields(docs, carry)}"
    marked = docs.withColumn("h", F.xxhash64("doc_id"))
    whole = arrow_map(marked, lambda batch: rebuild(batch.filter(pc.invert(may_lose(batch)))), schema)
    cut = arrow_map(marked, lambda batch: batch.filter(may_lose(batch)), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema)).drop("h")
    return whole.unionByName(arrow_map(cut.join(lost, "doc_id", "left"), rebuild, schema))
