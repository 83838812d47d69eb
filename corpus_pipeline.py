"""A training corpus from documents: five stages, each an operator of sextant.llm, each a table for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import bpe, common, minhash, mixing, quality, secrets

RANKS = "byte_bpe_50k.tiktoken"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects (score under 0.3) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    return quality.score(docs, quality.train(docs, labels)).where(F.col(quality.SCORE) >= 0.3).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each component the first document stays; documents without words all do."""
    return minhash.first_of_each(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found gives way to a mark; all documents stay."""
    docs = docs.select(*COLUMNS)
    out = secrets.scan(docs, secrets.learn(docs), rewrite=True)
    text = F.col(secrets.REDACTED)
    changed = F.col(secrets.SPANS) != ""
    return out.select("doc_id", F.when(changed, text).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document appears as often as the mix takes it, up to twice; those it doesn't take go."""
    return mixing.repeated(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality classifier", classify), ("near-duplicates", deduplicate), ("secret scans", redact), ("mixing", mix), ("encoding", encode)]

#: A learnt classifier and learnt grammars are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each gives is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
