"""A corpus pipeline of five stages, each an operator of fathom.llm.

Quality rules drop documents, SimHash keeps one document of each near-duplicate group, suffix-array dedup takes
repeated strings out of the texts, benchmark decontamination takes benchmark stretches out of them, and
SentencePiece encodes and decodes what is left. A character of which suffix-array dedup removes a byte goes
whole. Documents keep their rows even where nothing of their text is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import _common
from fathom.llm.decontamination import decontaminate
from fathom.llm.piece_codec import encode_decode
from fathom.llm.quality import quality_filter
from fathom.llm.simhash_dedup import one_of_each
from fathom.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs.select(*COLUMNS))


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(suffix_dedup(docs, keep="text", carry=("lang", "source")).withColumnRenamed("kept", "text"))


def benchmark_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True, carry=("lang", "source"))
    return _documents(cut.withColumnRenamed("clean_text", "text"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_removal),
    ("benchmark decontamination", benchmark_removal),
    ("SentencePiece encoding and decoding", encoding),
]

#: Forests, connected components of fingerprints and merges of a vocabulary are not expressible in SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again.

    What a stage wrote is removed once the next one is written; the result reads the last folder, which stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{_common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return docs
