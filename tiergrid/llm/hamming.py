"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its components, of any number.  The bits are cut into segments of about log2(n) bits, n being the
number of distinct codes.  The index holds each code once for each segment, dealt by the segment's number and its first
bits.  In round r a query goes to those parts of the index that hold values r bits away from its own segments, and
looks them up there; so entries and queries meet only where a probe falls.  After round r every
code within m * (r + 1) - 1 bits has been seen in m segments.  The distances verified so far, from all
parts together, bound the search of the next round, and a query whose k-th is covered takes no part in it.

Equal codes are one entry with its count and its least ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise

#: Bits of a segment; codes in a part of the index and queries that visit it together, in the mean.
LEAST_BITS, MOST_BITS = 8, 22
PART, QUERIES_AT_ONCE = 1 << 13, 1 << 16


@lru_cache(maxsize=64)
def ring(bits: int, r: int) -> np.ndarray:
    """All numbers of ``bits`` bits with ``r`` of them set."""
    return np.array([sum(1 << b for b in which) for which in combinations(range(bits), r)], np.int64)


def pack_codes(vectors: list[list | None], size: int) -> np.ndarray:
    """The signs of the components, eight to a byte, the first lowest; null, NaN and missing ones count as not positive."""
    bits = np.zeros((len(vectors), size * 8), bool)
    for row, v in zip(bits, vectors, strict=True):
        if v:
            row[: len(v)] = np.array([x is not None and x > 0 for x in v], bool)
    return np.packbits(bits, axis=1, bitorder="little")


def cut(bits: int, entries: int) -> list[tuple[int, int]]:
    """(start, width) of the segments, as equal as can be."""
    wide = min(MOST_BITS, max(LEAST_BITS, entries.bit_length() - 1))
    m = max(1, -(-bits // wide))
    edges = [i * bits // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def segment(codes: np.ndarray, start: int, width: int) -> np.ndarray:
    """The segment's value in each packed code."""
    bits = np.unpackbits(codes, axis=1, count=start + width, bitorder="little")[:, start:]
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1) if values else np.zeros((0, 1), np.uint8)


def look_up(entries: np.ndarray, query: np.ndarray, order: np.ndarray, sorted_low: np.ndarray, probes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, distances) of those under the probed values that lie within ``bound`` bits of the query."""
    a, b = np.searchsorted(sorted_low, probes), np.searchsorted(sorted_low, probes, side="right")
    size = b - a
    a, size = a[size > 0], size[size > 0]
    at = order[np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(a) else np.zeros(0, np.int64)
    far = np.bitwise_count(entries[at] ^ query).sum(axis=1, dtype=np.int64)
    return at[far <= bound], far[far <= bound]


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 50) -> DataFrame:
    """The ``k`` rows nearest to every query row in Hamming distance; queries are the ids divisible by ``every``.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``distance``: ties go to the smaller id; the query itself isn't among its
    neighbours, rows that share another id with the same code are.  With fewer than ``k`` other rows all are returned.  All components
    count; null vectors, components that are null or NaN and those that a shorter vector lacks count as not positive.  Rows with a
    null id are left out, repeated ids count once for each code.  Extra columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    bits = max(1, rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).first()["n"])

    def to_codes(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = pack_codes(batch.column("v").to_pylist(), -(-bits // 8))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "code"])

    coded = materialise(arrow_map(rows, to_codes, "vec_id long, code binary").distinct(), "codes")
    queries = materialise(coded.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), "codes-queries")
    own = queries.groupBy("query_id").agg((F.count(F.lit(1)) + k).cast("int").alias("need"))  # the query's own rows are among the nearest
    most = own.agg(F.coalesce(F.max("need"), F.lit(k + 1)).alias("n")).first()["n"]
    least = coded.withColumn("part", F.spark_partition_id())  # least ids of a code: first in each partition, then of those
    for keys in (["code", "part"], ["code"]):
        w = Window.partitionBy(*keys).orderBy("vec_id")
        least = least.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")
    entries = least.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = materialise(entries.select("code", "ids", F.size("ids").alias("held"), F.col("ids")[0].alias("low_id")), "codes-entries")
    n_codes = entries.count()
    segments = cut(bits, n_codes)
    head = max(0, (-(-n_codes // PART) - 1).bit_length())  # first bits of a segment that name a part of the index
    heads = [min(head, width) for _, width in segments]

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, out = rows_of(batch.column("code")), []
        for s, (start, width) in enumerate(segments):
            out.append((np.full(len(codes), s), segment(codes, start, width) >> (width - heads[s])))
        at = pa.array(np.tile(np.arange(len(codes)), len(segments)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for s, _ in out]), pa.int32()), pa.array(np.concatenate([p for _, p in out])), *(batch.column(c).take(at) for c in ("code", "held", "low_id"))], names=["seg", "part", "code", "held", "low_id"])

    index = materialise(arrow_map(entries.select("code", "held", "low_id"), deal, "seg int, part long, code binary, held int, low_id long"), "codes-index")
    sizes = index.groupBy("seg", "part").agg(F.ceil(F.count(F.lit(1)) / (4 * PART)).cast("int").alias("chunks"))
    sizes = materialise(sizes, "codes-sizes")  # values that many codes share: parts in several chunks
    index = index.join(sizes, ["seg", "part"]).withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))
    index = materialise(index.drop("chunks"), "codes-chunks")

    open_ = materialise(queries.join(own, "query_id").withColumn("bound", F.lit(bits)), "codes-open")
    best = None
    for r in range(max(width for _, width in segments) + 1):

        def route(batch: pa.RecordBatch, r: int = r) -> pa.RecordBatch:
            """Each query and the parts that hold values ``r`` bits away; ``rest`` of these bits are past the part's own."""
            codes, pieces = rows_of(batch.column("code")), []
            for s, (start, width) in enumerate(segments):
                part = segment(codes, start, width) >> (width - heads[s])
                for d in range(max(0, r - (width - heads[s])), min(r, heads[s]) + 1):
                    away = ring(heads[s], d)
                    pieces.append((np.repeat(np.arange(len(codes)), len(away)), np.full(len(codes) * len(away), s), (part[:, None] ^ away).ravel(), np.full(len(codes) * len(away), r - d)))
            at, seg, part, rest = (np.concatenate(v) for v in zip(*pieces, strict=True)) if pieces else (np.zeros(0, np.int64),) * 4
            return pa.RecordBatch.from_arrays([pa.array(seg, pa.int32()), pa.array(part), pa.array(rest, pa.int32()), *(batch.column(c).take(pa.array(at)) for c in ("query_id", "code", "need", "bound"))], names=["seg", "part", "rest", "query_id", "code", "need", "bound"])

        visits = arrow_map(open_.select("query_id", "code", "need", "bound"), route, "seg int, part long, rest int, query_id long, code binary, need int, bound int")
        visits = materialise(visits.join(sizes, ["seg", "part"]), "codes-visits")  # parts that hold no code drop out
        crowds = materialise(visits.groupBy("seg", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("crowds")), "codes-crowds")
        asked = visits.join(crowds, ["seg", "part"]).withColumn("crowd", F.pmod(F.xxhash64("query_id", "code"), F.col("crowds")).cast("int"))
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "crowds")
        data = index.join(crowds, ["seg", "part"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds")

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if len(left) and len(right):
                s = left["seg"][0].as_py()
                start, width = segments[s]
                mask = (1 << (width - heads[s])) - 1
                codes, wanted = rows_of(left["code"]), rows_of(right["code"])
                held, low_id, packed = left["held"].to_numpy(), left["low_id"].to_numpy(), left["code"].to_pylist()
                low = segment(codes, start, width) & mask
                order = np.argsort(low, kind="stable")
                sorted_low, own_low = low[order], segment(wanted, start, width) & mask
                columns = (right[c].to_pylist() for c in ("query_id", "code", "need", "bound", "rest"))
                for query, value, (qid, code, need, bound, rest) in zip(wanted, own_low, zip(*columns, strict=True), strict=True):
                    at, far = look_up(codes, query, order, sorted_low, value ^ ring(width - heads[s], rest), bound)
                    nearest = np.lexsort((low_id[at], far))[:need]
                    out += [(qid, code, need, packed[e], int(d), int(held[e]), int(low_id[e])) for e, d in zip(at[nearest], far[nearest], strict=True)]
            names = (("query_id", pa.int64()), ("code", pa.binary()), ("need", pa.int32()), ("entry", pa.binary()), ("distance", pa.int32()), ("held", pa.int32()), ("low_id", pa.int64()))
            return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(names)})

        keys = ["seg", "part", "chunk", "crowd"]
        found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(probe, "query_id long, code binary, need int, entry binary, distance int, held int, low_id long")
        best = found.distinct() if best is None else best.unionByName(found).distinct()
        nearest = Window.partitionBy("query_id", "code").orderBy("distance", "low_id", "entry")
        best = best.withColumn("nth", F.row_number().over(nearest)).withColumn("sum", F.sum("held").over(nearest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        best = materialise(best.where("nth <= need").drop("nth"), "codes-best")
        reached = best.where("sum >= need").groupBy("query_id", "code").agg(F.min("distance").alias("kth"))
        covered = len(segments) * (r + 1) - 1
        best = best.drop("sum")
        open_ = open_.join(reached, ["query_id", "code"], "left").withColumn("bound", F.coalesce("kth", "bound")).drop("kth").where(F.col("bound") > covered)
        open_ = materialise(open_, "codes-open")
        if open_.isEmpty():
            break
    near = best.select("query_id", F.col("entry").alias("code"), "distance").distinct().join(entries.select("code", "ids"), "code")
    near = near.select("query_id", F.explode("ids").alias("vec_id"), "distance").where("vec_id <> query_id").distinct()
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
