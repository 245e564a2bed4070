"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as
Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, packing, simhash, substring_dedup, toxicity
from tessera.session import expose_package, load, materialize, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on `labels`, rejects at their language's threshold go."""
    expose_package(spark)
    labels = load(spark, sf_dir, "labels")
    return toxicity.reject_toxic(docs, toxicity.calibrate(toxicity.fit_classifier(docs, labels), docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    expose_package(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar texts (five-word shingles, 0.8) the document with the smallest id stays."""
    expose_package(spark)
    return simhash.keep_one_of_similar(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out of the text."""
    expose_package(spark)
    return substring_dedup.remove_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, filled with lexical neighbours."""
    expose_package(spark)
    files = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    return packing.pack_documents(docs, *files, public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("substring dedup", cut_passages), ("packing", pack)]

#: The classifier, the fingerprints, the chains and the tokenizer are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
