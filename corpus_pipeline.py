"""From documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes
each stage's rows as Parquet in the shared folder and reads them again for the next one. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folio.llm import packing, quality, secret_scan, simhash, toxicity
from folio.llm._common import written
from folio.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. The model learns from the labelled documents."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir, docs))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Short ones are left to the rules' posterior: that
    they have fewer words than the base test of the report asks for is no fault of theirs."""
    return quality.keep_good(docs, min_words=1)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (Jaccard similarity 0.8 on 5-word shingles), the document with the smallest id stays."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces with a place in a sequence of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: SQL can't express trained models, connected components or packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
