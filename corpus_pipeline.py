"""From raw documents to token ids, in five stages.

Each stage is ``(name, function(spark, docs, sf_dir) -> DataFrame)``; its
result is written as Parquet below the session's shared checkpoint folder and
read again as the next stage's documents, so a lost executor repeats one stage
at most.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm import mixing, piece_bpe, pii, quality_model, simhash
from creditlake.llm.queries import tokenizer_path
from creditlake.session import apply_job_conf, scratch_path

#: a byte-exact tokenizer is not expressible in SQL
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limits."""
    apply_job_conf(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_model.keep_good(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id."""
    apply_job_conf(spark)
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows."""
    apply_job_conf(spark)
    found = pii.find(docs, into="_pii")
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("_pii")))
    return clean.withColumn("n_chars", F.when(F.size("_pii") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    apply_job_conf(spark)
    takes, _ = mixing.mix(docs)
    return mixing.repeat(docs, takes)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and hashes of the ids and of the text decoded from them."""
    apply_job_conf(spark)
    keep = ("doc_id", "lang", "source")
    coded = piece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep=keep, decoded=True)
    return coded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline_{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
