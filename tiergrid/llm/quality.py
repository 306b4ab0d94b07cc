"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed byte pairs, weighed by the root of their share and by how rare they are, and
one term for words that repeat the word before.  A bounded sample of labelled texts gives the space (its
leading singular vectors) and the labelled vectors, which are broadcast.  Every document is compared
with every labelled vector, in blocks, and the nearest vote by a power of their cosine, rounded to five places; those that
tie with the last of the nearest vote too.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, arrow_map, fields, small_batches

#: Labelled texts that the classifier is fitted on; a documented bound on what is broadcast.
MAX_LABELLED = 4096
TERM_BITS = 11
DIMENSIONS = 32
NEIGHBOURS = 31
POWER = 8
REPEAT_WEIGHT = 2.0
THRESHOLD = 0.7
#: Texts that are compared at once.
BLOCK = 256


def terms(texts: list[bytes]) -> np.ndarray:
    """One row of term weights for each text; all zero for texts under two bytes."""
    size = 1 << TERM_BITS
    out = np.zeros((len(texts), size + 1), np.float32)
    for row, text in zip(out, texts, strict=True):
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        if len(b) < 2:
            continue
        pairs = ((b[:-1] * np.uint32(257) + b[1:]) * np.uint32(2654435761)) >> np.uint32(32 - TERM_BITS)
        row[:size] = np.sqrt(np.bincount(pairs, minlength=size) / len(pairs))
        words = text.split()
        if len(words) > 1:
            row[size] = REPEAT_WEIGHT * np.sqrt(sum(map(operator.eq, words, words[1:])) / len(words))
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class Voter:
    """Labelled vectors in the latent space and what maps a text into it."""

    def __init__(self, weighed: np.ndarray, labels: np.ndarray) -> None:
        n = len(labels)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if n else 1.0
        idf = np.log((1 + n) / (1 + (weighed > 0).sum(axis=0))) + 1
        a = unit(weighed * idf)
        _, vectors = np.linalg.eigh(a.T @ a)
        base = vectors[:, ::-1][:, :DIMENSIONS]
        self.space = (base * idf[:, None]).astype(np.float32)
        self.vectors = unit(a @ base).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(texts), BLOCK):
            rows = np.zeros((BLOCK, (1 << TERM_BITS) + 1), np.float32)  # whole blocks, so that a text's cosines don't hang on its neighbours in the batch
            held = terms(texts[start : start + BLOCK])
            rows[: len(held)] = held
            cosine = np.round(unit(rows @ self.space) @ self.vectors.T, 5)[: len(held)]
            least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k]
            row, near = np.nonzero(cosine >= least[:, None])  # all that tie with the last one vote too
            weight = np.maximum(cosine[row, near], 0).astype(np.float64) ** POWER
            total = np.bincount(row, weight, minlength=len(held))
            vote = np.bincount(row, weight * self.labels[near], minlength=len(held))
            out[start : start + BLOCK] = np.where(total > 1e-12, vote / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Voter:
    """Fit on at most ``max_labelled`` labelled documents, those with the least hash of their id.

    ``labels`` holds an id and a label 0 or 1; null ids and labels are left out, several labels of an id
    are averaged, and of documents that share an id the least text counts.  Their terms are computed on the executors.
    """
    small_batches(documents.sparkSession)
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null")
    chosen = chosen.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = terms(as_bytes(batch.column("text"))).astype(np.float16)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "row"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = arrow_map(texts, weigh, f"doc_id {kind}, label double, row binary").toArrow()
    found = sorted(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), rows["row"].to_pylist(), strict=True))[:max_labelled]
    weighed = np.array([np.frombuffer(r[2], np.float16) for r in found], np.float32).reshape(len(found), (1 << TERM_BITS) + 1)
    return Voter(weighed, np.array([r[1] for r in found]))


def score_quality(documents: DataFrame, voter: Voter, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score whole texts.

    Returns one row for each input row: ``doc_id``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``
    (1 from ``threshold`` on).  A text that shares no term with any labelled one, such as an empty or null
    text, scores the share of label 1; without any labelled text every score is 1.  Ids pass through unread,
    null or repeated; other columns are ignored, save those that ``carry`` names, which come back with their row
    (the text as ``text``).
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(voter)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(c for c in carry if c != "text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.scores(as_bytes(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *(batch.column(c) for c in carry)], names=["doc_id", "score", "predicted", *carry])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, run, f"doc_id {kind}, score double, predicted int{fields(docs, carry)}")
