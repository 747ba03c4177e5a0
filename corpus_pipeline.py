"""From raw documents to token ids: quality, line dedup, near-dedup, mixing, encoding.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and all but the
last give rows with the columns of ``documents``. Nulls in any column, empty texts, repeated rows and
empty tables have the results that the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymart.llm import bpe, line_crf, line_dedup, mixing, near_texts
from daymart.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or hold too few content lines go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_crf.keep_good(docs, line_crf.train(docs, labels))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go, and documents of which no word is left."""
    found = line_dedup.without_repeated_lines(docs)
    text = F.col("line_dedup.kept_text")
    changed = {"text": text, "n_chars": F.char_length(text).cast("long")}
    # A word is left; the row's other columns may have any name.
    found = found.where(text.rlike(r"[^\x20\x09-\x0D]"))
    return found.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are alike by 0.8 or more the one with the smallest id stays."""
    return near_texts.without_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return encoded.select(
        "doc_id",
        "n_tokens",
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("source mix", source_mix),
    ("BPE encoding", token_ids),
]

#: Random fields, fingerprints and encodings have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
