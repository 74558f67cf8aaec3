"""Token counts through a digest cache.

Counts are stored as (tokenizer, digest, n_tokens): the digest of a tokenizer's
file, by which the cache is partitioned, and that of a text. Texts are joined to
the stored counts by digest; only one text of each digest without a count is
encoded, and its count is appended to the cache, a Parquet table in a folder
that all executors share. Digests with over a thousandth of all rows are joined
by broadcast. Content is normalised only where that cannot change a count: a
null text is an empty one.

A cache at a stable place saves what a former run encoded; runs that write at
the same time may store a count twice, which readers merge. A run that fails
while it writes leaves no count behind, as Spark commits the files at the end.

Edge cases: a null text has 0 bytes and 0 tokens; a row with a null id stays; a
text of any length is encoded whole. Repeated rows and ids keep one result row
each; of equal texts one is encoded. An empty table gives an empty result. Other
columns of `docs` do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import cut, hot_keys, join_spread, slices
from .piece_tokens import PieceTokenizer

CACHE = "digest binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32]


def stored(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Counts of this tokenizer version; of twice stored ones (two writers at a time) one."""
    try:
        cache = spark.read.schema(CACHE).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], CACHE)
    # one folder of the cache, and no others
    return cache.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PieceTokenizer(path)
        for batch in batches:
            for part in slices(batch):
                counts = [tokenizer.count(x.as_py()) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs; fills the cache first."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.substring(F.sha2(F.col("text"), 256), 1, 32)))
    known = stored(spark, cache_path, version)
    distinct = cut(keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    misses = distinct.join(known, "digest", "left_anti").select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"))
    # one row a digest, even where ids repeat
    todo = keyed.join(misses, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    counted = todo.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
    counted.select("digest", "n_tokens", F.lit(version).alias("tokenizer")).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = stored(spark, cache_path, version)
    sized = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return join_spread(sized, counts, counts.join(hot_keys(distinct), "digest"), "digest", "n_tokens", F.unhex(F.hex("doc_id"))).select("doc_id", "n_bytes", "n_tokens")
