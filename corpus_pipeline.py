"""The corpus pipeline: quality, line dedup, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``, whatever others clash with their own names.

An empty table gives an empty one at every stage.  A null or empty text is scored as the classifier scores texts without
known terms, and goes at the line dedup if it gets there.  Rows with a null id are judged by their text, lose no line, stand in no group and are mixed
and encoded like others.  Rows that share an id are one document to the line dedup and the join, and rows of their own elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergrid.llm import bpe, jaccard, line_dedup, mixing, quality
from tiergrid.llm.common import materialise
from tiergrid.llm.queries import table, tokenizer_path, training_labels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD = r"[^\x20\x09-\x0D]"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    voter = quality.fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return quality.score_quality(docs, voter, carry=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document left without any text but blanks goes too."""
    out = line_dedup.dedup_lines(docs, carry=("lang", "source")).withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.col("text").rlike(WORD)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; rows with a null id or without words are in no group."""
    gone = jaccard.near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("gone")) & F.col("text").rlike(WORD), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows with a null or repeated id are documents of their own."""
    taken = mixing.mix_sources(docs, carry=("text", "lang", "n_chars")).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that the mix took."""
    return bpe.encode_decode(docs, tokenizer_path()).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mix_sources", mix),
    ("bpe_codec", tokenize),
]

#: SQL can't express the classifier, the order sample or the encoding.  Tests hold quality's rows against the voter and the
#: line dedup's against brute force; near duplicates and the mix against their operators alone, the tokens by count.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
