"""Substring dedup by collinear chaining: passages that stand, perhaps edited, in an earlier document too.

Seeds are minimizers of word k-mers: any stretch of K + W - 1 words that two documents share holds a common seed.
Two Bloom filters drop the seeds that occur once before they shuffle, and another keeps copies of an earlier text out.  Each other occurrence of
a seed meets only its first one (least document, least place), so a passage that stands in a third of all
documents costs a row for each occurrence, never a pair of them.  For each document the meetings with
an earlier document are chained in order with gap costs, best predecessors coming from a tree of maxima over those in reach;
chains are aligned on word fingerprints kept around the seeds, and aligned pieces that touch become passages.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import as_bytes, arrow_map, materialise, pack, release, small_batches, spread_join
from .mixing import word_counts
from .shingles import mix, runs, word_hashes

K, W = 6, 10
#: Words of a passage; the share of its words that must align; words between seeds that a chain may bridge.
MIN_WORDS, MIN_ALIGNED, MAX_GAP = 45, 0.8, 24
GAP_COST = 0.25
MISMATCH = 2


def minimizers(kmers: np.ndarray) -> np.ndarray:
    """Places of the least k-mer of every window of W; the last place among equals."""
    if not len(kmers):
        return np.zeros(0, np.int64)
    w = min(W, len(kmers))
    windows = np.lib.stride_tricks.sliding_window_view(kmers[::-1], w)
    last = w - 1 - windows.argmin(axis=1)[::-1]
    return np.unique(np.arange(len(last)) + last)


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, word fingerprints padded by W on either side with 0) from a text's word hashes."""
    kmers = runs(words, K)
    places = minimizers(mix(kmers ^ np.uint64(0x5BD1E995)))
    prints = np.concatenate([np.zeros(W, np.uint8), (words >> np.uint64(56)).astype(np.uint8) | 1, np.zeros(W, np.uint8)])
    return kmers[places], places, prints


class WindowTree:
    """Greatest values over ranges of places 0 to n - 1, with the item that holds each; the oldest items can be taken out again."""

    def __init__(self, n: int) -> None:
        self.n, self.best = n, [(float("-inf"), -1)] * (2 * n)
        self.queues: list[deque[tuple[float, int]]] = [deque() for _ in range(n)]

    def _set(self, place: int) -> None:
        queue, i = self.queues[place], place + self.n
        top = queue[0] if queue else (float("-inf"), -1)
        while i and self.best[i] != top:
            self.best[i] = top
            i >>= 1
            if i:
                top = max(self.best[2 * i], self.best[2 * i + 1])

    def put(self, place: int, value: float, item: int) -> None:
        """Items come in the order in which they go; an item under a later one of its place never counts again."""
        queue = self.queues[place]
        while queue and queue[-1][0] <= value:
            queue.pop()
        queue.append((value, item))
        self._set(place)

    def drop(self, place: int, item: int) -> None:
        queue = self.queues[place]
        if queue and queue[0][1] == item:
            queue.popleft()
            self._set(place)

    def most(self, low: int, high: int) -> tuple[float, int]:
        """The greatest value at places from ``low`` to under ``high``."""
        found, low, high = (float("-inf"), -1), low + self.n, high + self.n
        while low < high:
            if low & 1:
                found = max(found, self.best[low])
                low += 1
            if high & 1:
                high -= 1
                found = max(found, self.best[high])
            low, high = low >> 1, high >> 1
        return found


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Disjoint chains of matches (x, y) that rise in both, best first.

    A match scores K, less GAP_COST for each word that x and y move on from its predecessor's, which is
    the best of those that lie at most MAX_GAP words before it in both; they alone are in the tree's reach.
    """
    n, reach = len(x), MAX_GAP + K
    order = sorted(range(n), key=lambda i: (x[i], -y[i]))
    places = sorted(set(y))
    ranks = {v: r for r, v in enumerate(places)}
    tree = WindowTree(len(ranks))
    score, before = [float(K)] * n, [-1] * n
    old = 0
    for i in order:
        while x[i] - x[order[old]] > reach:
            tree.drop(ranks[y[order[old]]], order[old])
            old += 1
        far = GAP_COST * (x[i] + y[i])
        value, j = tree.most(bisect_left(places, y[i] - reach), ranks[y[i]])
        if j >= 0 and value - far > 0:
            score[i], before[i] = K + value - far, j
        tree.put(ranks[y[i]], score[i] + far, i)
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda i: (-score[i], x[i])):
        chain, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of fingerprints."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = [0] * (len(b) + 1)
    for v in a.tolist():
        last = 0
        for k, w in enumerate(b.tolist(), 1):
            last, row[k] = row[k], last + 1 if v == w else max(row[k], row[k - 1])
    return row[-1]


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, agreeing ones) by which an end is extended: as far as a run pays, a word that differs costing MISMATCH agreeing ones."""
    ends = np.flatnonzero((a == 0) | (b == 0))
    n = int(ends[0]) if len(ends) else len(a)
    same = a[:n] == b[:n]
    gain = np.cumsum(np.where(same, 1, -MISMATCH))
    if not n or gain.max() <= 0:
        return 0, 0
    best = int(gain.argmax()) + 1
    return best, int(same[:best].sum())


def align(chain: list[int], x: list[int], y: list[int], own: list[bytes], other: list[bytes]) -> tuple[int, int, int, int]:
    """(start, end, start in the other document, aligned words) of a chain.

    ``own`` and ``other`` hold the fingerprints from W words before each seed to W after it.  Ends are
    extended word by word as ``extend`` does.
    """
    a = [np.frombuffer(own[i], np.uint8) for i in chain]
    b = [np.frombuffer(other[i], np.uint8) for i in chain]
    aligned = K
    for k in range(1, len(chain)):
        i, j = chain[k - 1], chain[k]
        dx, dy = x[j] - x[i], y[j] - y[i]
        if dx == dy and dx <= K + W:
            aligned += int((a[k - 1][W + K : W + dx] == b[k - 1][W + K : W + dx]).sum()) + min(dx, K)
            continue
        gx, gy = max(0, dx - K), max(0, dy - K)
        half = [common(p[k - 1][W + K :][: min(W, g)], q[k - 1][W + K :][: min(W, h)]) for p, q, g, h in ((a, b, gx, gy),)][0]
        tail = common(a[k][max(0, W - max(0, gx - W)) : W], b[k][max(0, W - max(0, gy - W)) : W])
        aligned += half + tail + min(dx, dy, K)
    left, same_left = extend(a[0][W - 1 :: -1], b[0][W - 1 :: -1])
    right, same_right = extend(a[-1][W + K :], b[-1][W + K :])
    return x[chain[0]] - left, x[chain[-1]] + K + right, y[chain[0]] - left, aligned + same_left + same_right


def passages(x: list[int], first: list[int], y: list[int], own: list[bytes], other: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """(start, end, earlier document, start there) of a document's passages, from all its meetings.

    Pieces that touch or lie within MAX_GAP / 4 words of each other, perhaps in different earlier documents, are one
    passage, named after the document of its longest piece.
    """
    by_doc: dict[int, list[int]] = {}
    for i, d in enumerate(first):
        by_doc.setdefault(d, []).append(i)
    pieces = []
    for d, members in by_doc.items():
        xs, ys = [x[i] for i in members], [y[i] for i in members]
        for chain in chains(xs, ys):
            start, end, there, aligned = align(chain, xs, ys, [own[i] for i in members], [other[i] for i in members])
            if aligned >= MIN_ALIGNED * (end - start):
                pieces.append((start, end, d, there))
    out: list[list[int]] = []
    for start, end, d, there in sorted(pieces):
        if out and start <= out[-1][1] + MAX_GAP // 4:
            if end - start > out[-1][4]:
                out[-1][2], out[-1][3], out[-1][4] = d, max(0, there - (start - out[-1][0])), end - start
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, d, there, end - start])
    return [tuple(p[:4]) for p in out if p[1] - p[0] >= min_words]


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """Passages of at least ``min_words`` words that an earlier document (of smaller id) also holds.

    Returns one row for each input row: ``doc_id``, ``n_words``, ``copy_of`` (the least id with the same text, else null),
    ``n_repeated`` (words in passages), ``first_doc`` (least earlier document, else null) and ``passages``, an array of
    (start, end, earlier, earlier_start) in words, ends exclusive.  A copy of an earlier text is one passage, whatever its
    length.  A seed meets its first occurrence alone: a passage is named after the documents that first hold its seeds, perhaps
    several, and pieces of it that lie further apart than they may are separate passages.  Words are compared by prints of seven bits.  Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased.  Texts without words, null texts and rows with a null id have no
    passages; rows that share an id are one document.  Ids are whole numbers.  Extra columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id is not null")

    classes = known.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("copy_of"))
    classes = materialise(classes, "passages-classes")
    firsts = classes.select(F.col("copy_of").alias("doc_id")).distinct()
    first = spark.sparkContext.broadcast(bloom.member_filter(firsts, "doc_id", "passages-firsts", max_bits))

    def own_words(batch: pa.RecordBatch) -> list[np.ndarray]:
        """Word hashes; none for copies of an earlier text, save a few that the filter lets through."""
        ids = batch.column("doc_id").fill_null(0).to_numpy()
        keep = first.value.contains(bloom.hash_ids(ids))
        return word_hashes([t if k else b"" for t, k in zip(as_bytes(batch.column("text")), keep, strict=True)])

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        return bloom.packed_rows(np.concatenate([np.zeros(0, np.uint64), *(np.unique(seeds(w)[0]) for w in own_words(batch))]))

    twice = spark.sparkContext.broadcast(bloom.twice_filter(arrow_map(known, hashes, bloom.PACKED), "passages", max_bits))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits, places, prints = [], [], []
        for words in own_words(batch):
            h, p, marks = seeds(words)
            hit = twice.value.contains(h)
            hits.append(h[hit])
            places.append(p[hit].astype(np.int32))
            prints.append(marks[p[hit][:, None] + np.arange(2 * W + K)] if hit.any() else np.zeros(0, np.uint8))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pack(hits), pack(places), pack(prints)], names=["doc_id", "hashes", "places", "prints"])

    measured = arrow_map(known, measure, "doc_id long, hashes binary, places binary, prints binary").where("length(hashes) > 0")
    reps = measured.join(firsts, "doc_id", "left_semi")

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = 2 * W + K
        h = [np.frombuffer(b, np.int64) for b in batch.column("hashes").to_pylist()]
        p = [np.frombuffer(b, np.int32) for b in batch.column("places").to_pylist()]
        around = b"".join(batch.column("prints").to_pylist())
        n = sum(map(len, h))
        marks = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(around)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.repeat(batch.column("doc_id").to_numpy(), [len(a) for a in h])), pa.array(np.concatenate(p)), marks], names=["h", "doc_id", "place", "around"])

    hits = arrow_map(reps.select("doc_id", "hashes", "places", "prints"), explode, "h long, doc_id long, place int, around binary")
    hits = materialise(hits, "passages-hits")
    ends = hits.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")
    shared = spark.sparkContext.broadcast(bloom.member_filter(ends, "h", "passages-shared", max_bits))
    every = hits
    hits = arrow_map(every, lambda batch: batch.filter(pa.array(shared.value.contains(bloom.hash_ids(batch.column("h").to_numpy())), pa.bool_())), "h long, doc_id long, place int, around binary")
    anchors = hits.groupBy("h").agg(F.min(F.struct("doc_id", "place", "around")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").select("h", "first")
    anchors, hits = materialise(anchors, "passages-anchors"), materialise(hits, "passages-shared-hits")
    release(every)
    met = spread_join(hits, anchors, "h").where("doc_id <> first.doc_id")
    met = met.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("place").alias("x"), F.col("first.doc_id").alias("d"), F.col("first.place").alias("y"), F.col("around").alias("own"), F.col("first.around").alias("other"))).alias("m"))
    met = met.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in ("x", "d", "y", "own", "other")))

    def chain(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for doc, *rest in zip(batch.column("doc_id").to_pylist(), *(batch.column(c).to_pylist() for c in ("x", "d", "y", "own", "other")), strict=True):
            spans = passages(*rest, min_words=min_words)
            if spans:
                ids.append(doc)
                found.append([{"start": a, "end": b, "earlier": d, "earlier_start": y} for a, b, d, y in spans])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("earlier", pa.int64()), ("earlier_start", pa.int64())])))], names=["doc_id", "spans"])

    shape = "array<struct<start:long,end:long,earlier:long,earlier_start:long>>"
    spans = arrow_map(met, chain, f"doc_id long, spans {shape}")
    counted = arrow_map(docs.withColumn("digest", F.sha2("text", 256)), lambda batch: pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(word_counts(batch.column("text")))], names=["doc_id", "digest", "n_words"]), "doc_id long, digest string, n_words long")
    all_docs = counted.join(classes, "digest", "left").join(spans, "doc_id", "left")
    copied = F.col("copy_of") < F.col("doc_id")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.col("copy_of").alias("earlier"), F.lit(0).cast("long").alias("earlier_start")))
    listed = F.when(copied, whole).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {shape})")))
    return all_docs.select("doc_id", "n_words", F.when(copied, F.col("copy_of")).alias("copy_of"), listed.alias("passages")).select(
        "doc_id",
        "n_words",
        "copy_of",
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"]).alias("n_repeated"),
        F.array_min(F.transform("passages", lambda p: p["earlier"])).alias("first_doc"),
        "passages",
    )
