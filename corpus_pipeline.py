"""Documents to training ids: quality rules, exact dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.llm.byte_bpe import ByteBpe, encode_documents
from harvestline.llm.common import shared_folder
from harvestline.llm.exact_dedup import drop_copies
from harvestline.llm.mixing import take_mix
from harvestline.llm.near_text import keep_one
from harvestline.llm.quality import keep_good

TABLE_WORDS = 65_536


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of each copy that the mix takes.

    The table of encoded words is a quarter of the operator's own: the driver, which passes it on, has five stages to hold here, and CPU
    time is not scarce. It changes the time only.
    """
    bpe = ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).prepared(docs, words=TABLE_WORDS)
    ids = encode_documents(docs.select("doc_id", "source", "text"), bpe)
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mix_sources", mix), ("byte_bpe", encode)]
#: The mix draws its copies from hashes, which SQL doesn't have; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
