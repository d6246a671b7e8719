"""The registered queries of the corpus operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 ids."""
    from quire.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS kept_id FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept_id <> page_id THEN kept_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""


@register("op5_warc", OP5_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from deduplicated archives."""
    from quire.llm.warc import archive

    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))[1].drop("url", "payload")


@register("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the grammar-compressed id files."""
    from quire.llm.token_files import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))[1]


@register("op10_near_duplicates")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it stays."""
    from quire.llm.near_duplicates import near_duplicates

    return near_duplicates(documents(spark, sf_dir), k=4).drop("row_key", "n_links", "stands")


@register("op4_repetition")
def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's repetition counts and verdict."""
    from quire.llm.repetition import quality

    return quality(documents(spark, sf_dir))


@register("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which the document covers half in one stretch, or shares 13 tokens in a row."""
    from quire.llm.decontamination import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base spans, and those the weakly supervised classifier adds."""
    from quire.llm.personal_data import find

    return find(documents(spark, sf_dir))


@register("op2_repeats")
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur more than once."""
    from quire.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    from quire.llm.toxicity import score, train

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@register("op7_attention_lm")
def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under the word counts and under the attention model."""
    from quire.llm.attention_lm import score_texts

    return score_texts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


OP11_SQL = """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 256)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@register("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth embedding."""
    from quire.llm.hard_negatives import mine

    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding; ``deviation_exact`` holds the deviation where it outgrows a long."""
    from quire.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@register("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    from quire.llm.quality_classifier import score, train

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
