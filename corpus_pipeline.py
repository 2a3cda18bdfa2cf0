"""The training-data pipeline over ``documents``: toxic and near-duplicate documents go, repeated passages are cut from
later copies, sources are interleaved to their target weights, and the rest is packed.

Each stage takes ``(spark, docs, sf_dir)``; its result is written and read again as the next one's ``docs``. The mixing
stage decides the order. Files are not read again in the order they were written in, so packing works out the same
positions (they depend on ids, sources and texts only), deals its tasks ranges of them, and fills its sequences in that order.

Defined cases: a null text is empty, counts as clean and as nobody's copy, and is packed as its end id; rows with a null id are kept
by every stage; rows that share an id are one document to the near-duplicate stage (they stay or go together) and pack one by
one; further columns, however they are called, go through all stages but the last; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm import minhash, mixing, packing, suffixes, toxicity
from tallgrass.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.remove(docs, keep="first")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(mixing.in_order(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffixes", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A classifier and suffix order have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
