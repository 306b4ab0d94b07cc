"""Mixing sources to target weights by Pareto order sampling.

Each source's share of all words follows its weight, up to ``max_copies`` times its own words.
A document of weight w is due r = min(max_copies, c * w) copies, with c such that the source's due
words meet its target.  floor(r) copies are certain.  The rest of the target is a Pareto order
sample: every document draws a uniform u, has the inclusion probability p = r - floor(r), and is ranked by
(u / (1 - u)) / (p / (1 - p)); the smallest ranks win until the words left are used up.

No source is sorted in one task.  Ranks fall into bins; a small table of words by source and bin
gives the bin where the words run out; only that bin and the next are walked, one
document after another, to fill the gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fields, materialise, small_batches

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: Documents that a rank bin holds in the mean.
BIN_DOCUMENTS = 400

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in each text of an Arrow column; null counts 0."""
    kind = pa.large_binary()
    column = texts.cast(pa.large_string()).cast(kind)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    solid = ~_BLANK[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    firsts = (offsets - offsets[0])[:-1]
    full = offsets[1:] > offsets[:-1]
    starts[firsts[full]] = solid[firsts[full]]  # a word can't run on from the text before
    total = np.concatenate([[0], np.cumsum(starts)])
    return total[offsets[1:] - offsets[0]] - total[firsts]


def waterfill(sizes: list[float], weights: list[float], cap: float = MAX_COPIES) -> list[float]:
    """Targets that share sum(sizes) by weight; none above cap * size, the excess reshared."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
            open_.discard(i)
    return targets


def _uniform(seed: int) -> Column:
    """A draw in (0, 1) that depends on the seed and the document alone."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size"))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_copies: int) -> DataFrame:
    """(source, source_size, documents, target): a row for each source, the null source last.

    The table of sources is one row a source name; it is the only thing that comes to the driver.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python orders strings by code point
    targets = waterfill([r["source_size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], max_copies)
    data = [(r["source"], r["source_size"], r["documents"], t) for r, t in zip(rows, targets, strict=True)]
    return sizes.sparkSession.createDataFrame(data, "source string, source_size long, documents long, target double")


def fill_gap(sizes: np.ndarray, gap: float) -> np.ndarray:
    """Which documents, taken in rank order, fill the gap: each that still fits, and at the end
    the one that overshoots least if that comes nearer than stopping short."""
    taken, left = np.zeros(len(sizes), bool), gap
    for i, n in enumerate(sizes):
        if 0 < n <= left:
            taken[i] = True
            left -= n
    rest = np.flatnonzero(~taken & (sizes > 0))
    if left > 0 and len(rest):
        best = rest[np.argmin(sizes[rest])]
        if sizes[best] - left < left:
            taken[best] = True
    return taken


def mix_sources(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 0,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Sample documents so that each source takes its target share of all words.

    Returns a row for each input row: ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target``
    (its source's), ``copies`` (whole copies taken) and ``taken`` (copies * size).  ``weight_col``, if given,
    holds positive document weights for unequal copies inside a source; without it all weigh the same.

    A null text has 0 words; documents without words take 0 copies.  The null source is a source of its
    own, after all others.  Rows that share an id are separate documents; equal rows draw
    the same rank and are told apart by their position among equals.  Reruns agree.  Clashing extra columns are
    ignored, save those that ``carry`` names, which come back with their row (the text as ``text``).  An empty table gives an empty result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(1e-9))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), weight.alias("weight"), F.col(text_col).alias("text"), *(c for c in carry if c != "text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "source", "weight")] + [pa.array(word_counts(batch.column("text"))), *(batch.column(c) for c in carry)], names=["doc_id", "source", "weight", "size", *carry])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = materialise(arrow_map(docs, count, f"doc_id {kind}, source string, weight double, size long{fields(docs, carry)}"), "mix-sizes")
    sources = source_targets(sizes, weights, max_copies)
    due = sizes.join(F.broadcast(sources), sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    due = due.join(F.broadcast(_scales(due, max_copies)), F.col("source").eqNullSafe(F.col("scale_source"))).drop("scale_source")
    r = F.least(F.lit(float(max_copies)), F.col("scale") * F.col("weight"))
    r = F.when(F.abs(r - F.round(r)) < 1e-9, F.round(r)).otherwise(r)
    ranked = due.withColumn("r", r).withColumn("certain", F.when(F.col("size") > 0, F.floor("r")).otherwise(0).cast("long")).withColumn("p", F.col("r") - F.floor("r"))
    u = _uniform(seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = ranked.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
    place = F.col("rank") / (1 + F.col("rank"))  # in (0, 1), in the same order
    bins = F.greatest(F.lit(1), F.ceil(F.col("documents") / BIN_DOCUMENTS))
    ranked = ranked.withColumn("bin", F.when(F.col("rank").isNotNull(), F.least(F.floor(place * bins), bins - 1)).cast("long"))
    by_bin = ranked.groupBy("source", "bin").agg(F.first("target").alias("target"), F.sum(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("bin_words"), F.sum(F.col("certain") * F.col("size")).alias("certain_words"))
    run = Window.partitionBy("source").orderBy(F.col("bin").asc_nulls_first())  # rows: one for each bin of a source
    by_bin = by_bin.withColumn("gap", F.col("target") - F.sum("certain_words").over(Window.partitionBy("source"))).withColumn("before", F.coalesce(F.sum("bin_words").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_bin = by_bin.withColumn("through", F.col("before") + F.coalesce("bin_words", F.lit(0)))
    by_bin = materialise(by_bin, "mix-bins")
    edge = by_bin.where(F.col("bin").isNotNull() & (F.col("through") > F.col("gap"))).groupBy("source").agg(F.min("bin").alias("edge"), F.min_by("before", "bin").alias("edge_before"), F.first("gap").alias("gap"))
    edge = edge.select(F.col("source").alias("edge_source"), "edge", (F.col("gap") - F.col("edge_before")).alias("left"))
    placed = ranked.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    inside = F.col("bin").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")))
    at_edge = F.col("edge").isNotNull() & F.col("bin").between(F.col("edge"), F.col("edge") + 1)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches), ignore_index=True)
        part = part.sort_values(["rank", "doc_id", "size", *carry], kind="stable", ignore_index=True)
        yield part.assign(extra=fill_gap(part["size"].to_numpy(), float(part["left"].iloc[0])).astype("int64"))

    columns = ["doc_id", "source", "size", "source_size", "target", "certain", *carry]
    walked = placed.where(at_edge).select(*columns, "rank", "left")
    walked = walked.groupBy("source").applyInPandas(lambda part: next(fill(iter([part]))), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in walked.schema) + ", extra long")
    rest = placed.where(~at_edge | at_edge.isNull()).select(*columns, F.when(inside, 1).otherwise(0).cast("long").alias("extra"))
    both = rest.unionByName(walked.select(*columns, "extra"))
    copies = F.col("certain") + F.col("extra")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)


def _scales(due: DataFrame, max_copies: int) -> DataFrame:
    """(scale_source, scale): copies due for a weight of 1, so that the source's due words meet its target.

    A document stops at ``max_copies``, which raises the scale for the others; each round adds those newly
    stopped, and all sources are done when none is.  With equal weights the first round ends it.
    """
    spark = due.sparkSession
    scales = None
    for _ in range(64):
        if scales is None:
            open_ = due.withColumn("stopped", F.lit(False))
        else:
            open_ = due.join(F.broadcast(scales), F.col("source").eqNullSafe(F.col("scale_source"))).withColumn("stopped", F.col("scale") * F.col("weight") >= max_copies)
        rows = open_.groupBy("source").agg(
            F.first("target").alias("target"),
            F.coalesce(F.sum(F.when(F.col("stopped"), max_copies * F.col("size"))), F.lit(0)).alias("whole"),
            F.coalesce(F.sum(F.when(~F.col("stopped"), F.col("weight") * F.col("size"))), F.lit(0.0)).alias("free"),
            F.max(F.when(~F.col("stopped"), F.col("weight"))).alias("most"),
        ).collect()
        data = [(r["source"], (r["target"] - r["whole"]) / r["free"] if r["free"] > 0 else float(max_copies)) for r in rows]
        scales = spark.createDataFrame(data, "scale_source string, scale double")
        if not any(r["free"] > 0 and s * r["most"] > max_copies * (1 + 1e-9) for r, (_, s) in zip(rows, data, strict=True)):
            break
    return scales
