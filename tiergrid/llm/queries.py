"""One query for each text operator: the operator over its whole table, and digests of what it returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hamming, html, jaccard, line_dedup, media, mixing, pii, quality, substring

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(column: Column) -> Column:
    """Lowercase hex over the UTF-8 of a string, or over the bytes of a binary."""
    return F.sha2(column, 256)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels aren't learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(table(spark, sf_dir, "embeddings"), k=10, every=50)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(table(spark, sf_dir, "documents"))
    size = F.octet_length("media").cast("long").alias("media_bytes")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", size, sha256(F.col("media")).alias("media_sha256"), "feature")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    voter = quality.fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return quality.score_quality(docs, voter).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", sha256(F.col("ids")).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", sha256(F.col("base")).alias("base_sha256"), "spans", "n_spans", "n_secret")


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_ngram_jaccard_join, op3_substring_dedup, op4_exact_topk, op5_mix_sources, op6_html_extraction, op7_media_columns, op8_quality_classifier, op9_bpe_codec, op10_pii)
}

ORACLES = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM shared WHERE 100 * common >= 90 * (n + m - common)),
reach(doc_id, node) AS (
  SELECT x, y FROM links
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.node = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.node), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s
""",
    "op4_exact_topk": r"""
WITH near AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_sum(list_transform(range(1, greatest(len(q.embedding), len(v.embedding)) + 1),
      lambda i: (coalesce(q.embedding[i] > 0, false) <> coalesce(v.embedding[i] > 0, false))::INTEGER))::INTEGER AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance FROM near)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
""",
    "op1_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keyed
  WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE r.keeper <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE r.keeper IS NULL OR r.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r ON k.key = r.key
GROUP BY k.doc_id
""",
}
