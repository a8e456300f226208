"""A training corpus from raw documents: toxic ones go, near copies go, recurring passages go, the mix is set, texts become ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage is written and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripleweave.llm import bpe, mixing, passages, simhash, toxicity
from tripleweave.llm.common import stored, table
from tripleweave.llm.queries_sql import TARGETS

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it learns from the labelled ones that are not held out."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints, the one with the smallest id; rows without an id come last."""
    return simhash.drop_near_duplicates(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words or more that occur earlier."""
    return passages.drop_passages(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, with or without an id, sampled towards the target shares of sources, languages and topics."""
    return mixing.keep_mixed(docs, TARGETS, every_row=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, their token ids, and digests of the ids and of the text decoded from them."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, digests=True)


STAGES = [("toxicity", toxicity_stage), ("simhash near-dedup", simhash_stage), ("substring dedup", passages_stage),
          ("mixing", mixing_stage), ("bpe", encoding_stage)]

#: The classifier and the fingerprints have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared scratch folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
