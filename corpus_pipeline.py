"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept and is written as Parquet in the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmetrica.llm import decontam, packing, quality, simhash, suffixes
from sparkmetrica.llm.common import bound_batches
from sparkmetrica.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Of an Arrow batch. A task holds several copies of one outside the heap, and one session runs all five stages, whose Python workers and buffers stay.
BATCH_BYTES = 1 << 20


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    bound_batches(spark, BATCH_BYTES)
    return quality.keep_good(docs, quality.fit(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of exact or near copies (five-word shingles, similarity 0.8)."""
    bound_batches(spark, BATCH_BYTES)
    return simhash.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes or more that also start earlier; ``n_chars`` is the new length."""
    bound_batches(spark, BATCH_BYTES)
    kept = suffixes.drop_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    bound_batches(spark, BATCH_BYTES)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    bound_batches(spark, BATCH_BYTES)
    return packing.pack(docs).withColumnsRenamed({"doc": "doc_id", "crc": "ids_crc32", "sequence": "sequence_id", "place": "offset"})


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", distinct_documents),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: The stages fit models and hash byte strings, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            place = shared_folder(spark, "stage")
            docs.write.parquet(place)
            docs = spark.read.schema(docs.schema).parquet(place)
    return docs
