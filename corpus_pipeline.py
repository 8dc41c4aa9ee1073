"""From raw documents to packed training sequences, stage by stage.

Each stage gets all that its predecessor kept, as Parquet, and applies one operator with effect: rejected documents
and failing lines go, one document of each near-duplicate group stays, secrets are masked, documents are
taken as often as their source's target asks, and the result is packed. Null texts and empty tables pass as the
operators define them; columns beside those the operators read pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumentrace.llm import line_rules, minhash_bayes, mixing, secret_grammar, ss_packing
from lumentrace.llm.common import materialise, table
from lumentrace.llm.queries import byte_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_bayes.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_grammar.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ss_packing.pack(docs, *byte_bpe())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mix_sources),
    ("packing", packing),
]

#: Tokenising, MinHash components and learned automata are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
