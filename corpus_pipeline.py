"""Corpus pipeline: documents in, token ids out.

Five stages, each one operator over all its predecessor kept: language ID, line dedup,
SimHash near-dedup, benchmark decontamination, byte-level BPE. A stage's result is written as
Parquet and read again as the next one's documents, so no stage recomputes another.

No stage but the first two can be stated in SQL (models, fingerprints, token ranks), so the
whole is tested against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthframe import session
from hearthframe.llm import bpe, decontam, lang_id, line_dedup, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (``und``) go; of the others ``lang`` becomes the language found."""
    told = lang_id.predict(docs.select(*COLUMNS), lang_id.fit_documents(docs))
    return told.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, documents stay; ``n_chars`` follows the text. Copies of a page are near-dedup's, not boilerplate."""
    return line_dedup.drop_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the smallest id, and of texts with that id the least by hash.

    Documents without an id go where their group has one with an id; otherwise one of them stays.
    """
    key = ["text_a", "text_b"]
    heads = simhash.heads(docs).select(F.col("doc_id").alias("head"), *[F.col(c).alias(f"head_{c}") for c in key])
    rows = docs.select(*COLUMNS, *simhash.text_key(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("head"))
    for c in key:
        same &= F.col(c) == F.col(f"head_{c}")
    return rows.join(heads, same, "left_semi").dropDuplicates(["doc_id", *key]).drop(*key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.scan(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(~F.col("contaminated")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of what they decode to."""
    out = bpe.encode(docs, bpe.vocabulary(), keep=["doc_id"], decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's output lies in the shared folder until the next one is written; the last output stays
    there, as the returned rows read it. Runs have folders of their own, named pipeline-*.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, before = f"{session.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        folder = f"{root}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            session.remove_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
