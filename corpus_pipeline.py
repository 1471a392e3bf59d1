"""The corpus pipeline: stages that take documents and give documents, the last one packed sequences.

Each stage reads what its predecessor has written. Toxic documents go, then exact copies, then all but one of each group
of near-duplicates; mixing repeats or drops documents by their fitted rates; packing gives the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import exact_dedup, mixing, packing, simhash, toxicity
from tickloom.llm.common import Scratch, table
from tickloom.llm.queries import tokenizer_file

#: Shares of tokens of low and high quality; see mixing.py. Toxic documents have gone before.
TARGETS = (0.03, 0.97)
#: Tokens after mixing for each before; enough that documents of high quality are kept once at least.
BUDGET = 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resampled(docs, table(spark, sf_dir, "labels"), names=("quality",), targets=TARGETS, budget=BUDGET)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Classifiers, near-duplicates and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name.replace(' ', '-')}")
    return docs
