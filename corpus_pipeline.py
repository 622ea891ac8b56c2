"""A corpus pipeline over `documents`: language ID, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's `docs`. All stages but the last return the columns of `documents`; the last returns the packed pieces.

In every stage other columns, whatever their names, stay as they are, and an empty table gives no rows. Rows that repeat
an id, or have none, are rows of their own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seisloom.llm import compression_quality, hyperminhash, packing, ppm_langid, suffix_dedup
from seisloom.llm.common import shared_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: SQL cannot express the models, registers and tokens of these stages; tests compare them with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language has a posterior under 0.5, go: null and empty texts too. Where no document has a language, all go."""
    return ppm_langid.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 go. Null and empty texts have a score like any other."""
    return compression_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the least id stays. Equal texts are one group; texts without words are linked with nothing, and stay; null ids come last in a group, of which one row stays."""
    return hyperminhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of 200 bytes that starts anywhere else go from the texts, and a character of which a part would go goes as a whole. Null texts stay null."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 2048 tokens. A null or empty text is its end token alone."""
    return packing.packed(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them is written below the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
