"""Corpus pipeline: documents in, encoded documents out. Each stage works on all that the stage before it kept.

1. quality: documents that the classifier rejects go.
2. near_dedup: of each group of near-duplicates (similarity of word shingles 0.8 or more) the document of the smallest id stays.
3. decontam: documents that hold a benchmark passage go.
4. secrets: reported spans are replaced by a mark; every document stays.
5. bpe: doc_id, lang, source, n_tokens, the ids of every document, and the hash of the decoded text.

Nulls, empty texts, repeated rows and empty tables: as the operators define them. Columns of documents beyond the five known ones pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.llm import bpe, decontam, minhash, quality, secret_scan
from quillwatch.llm.queries import owner_of_source, vocabulary
from quillwatch.llm.training import remainder, small_batches
from quillwatch.sources.shared import materialize
from quillwatch.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return docs.where(quality.scorer(model)(F.coalesce("text", F.lit(""))) >= 0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.deduplicate(docs, percent=80)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, *owner_of_source())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    words = bpe.read_vocabulary(vocabulary())
    rows = docs.select("doc_id", "lang", "source", bpe.encoder(words)(F.coalesce("text", F.lit(""))).alias("ids"))
    rows = rows.withColumn("decoded", bpe.decoder(words)(F.col("ids")))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontam", decontam_stage), ("secrets", secrets_stage), ("bpe", bpe_stage)]

#: Fitted scores, signatures and encodings have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
