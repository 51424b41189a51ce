"""From raw documents to pieces: five stages, each written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import mixing, neardup, pieces, quality, secretscan
from tracklake.llm.queries import PIECES
from tracklake.llm.shared import remove, shared_dir, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    ship(spark)
    return quality.repetition(docs.select(COLUMNS), "text", "_m").where(quality.kept(F.col("_m"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8) the smallest doc_id stays."""
    ship(spark)
    return neardup.keep_one(docs.select(COLUMNS), k=5).select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mask; documents stay, with n_chars of the new text."""
    ship(spark)
    docs = docs.select(COLUMNS)
    out = secretscan.redact(docs, secretscan.train(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their source's budget stay: 90 % of the tokens by weight, each document once at most.

    Of the document in which a leaf's budget ends the first tokens stay (with n_chars of these), so that each leaf
    gives its budget exactly.
    """
    ship(spark)
    mixed = mixing.mix(docs.select(COLUMNS), mixing.number_domain(), mixing.WEIGHTS, percent=90, max_epochs=1)
    n = F.col("_mix.prefix_tokens")
    mixed = mixed.where((F.col("_mix.copies") > 0) | (n > 0)).withColumn("text", F.when(n > 0, mixing.first_tokens(F.col("text"), n)).otherwise(F.col("text")))
    return mixed.withColumn("n_chars", F.when(n > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    ship(spark)
    found = pieces.encode(docs.select(COLUMNS), pieces.load(PIECES))
    return found.select("doc_id", "lang", "source", F.size("pieces.ids").cast("long").alias("n_pieces"), F.col("pieces.ids").alias("ids"), "pieces.round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("secret scans", secret_scan),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Near-duplicates and a trained field have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
