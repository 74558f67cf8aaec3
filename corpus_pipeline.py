"""From raw documents to packed training sequences: quality, near copies, benchmark passages, personal data, packing.

Every stage takes documents with null ids or texts, repeated rows and further
columns, and all but the last return the columns that they got: a null or empty
text fails the first stage's base test and goes; rows without an id are linked
with nothing and stay; rows that repeat an id and a text stay or go together. An
empty table passes all stages empty. A text of any length is one row throughout.
Ties: of linked documents the smallest id stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import harmonic_packing, info_sanitize, jaccard_join, string_tiling, weak_quality
from webloom.llm.common import ensure_checkpoint_dir, remove_folder, table
from webloom.llm.entry import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return weak_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest id stays."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with most of a benchmark item go."""
    return string_tiling.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it become placeholders; n_chars follows the text."""
    clean = info_sanitize.sanitize(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences."""
    return harmonic_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]
#: SQL cannot fit the rules or tokenize; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's input goes once its output is written."""
    docs, base = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                remove_folder(spark, f"{base}/{k - 1}")
    return docs
