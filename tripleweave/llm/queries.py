"""The queries of the text operators, on whole tables, with production parameters; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, embeddings, fingerprints, html_text, licenses, manifest, mixing, passages, periodic, quality, simhash, suffix,
               toxicity)
from .common import table
from .queries_sql import LICENSES_SQL, MIXING_SQL, TARGETS
from .queries_sql_new import MANIFEST_SQL, QUALITY_SQL

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), TARGETS)


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.passage_digests(table(spark, folder, "documents"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return bpe.token_digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, folder, "pages"))


def op8_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.repeat_digests(table(spark, folder, "documents"))


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a tree source/language/hundreds."""
    docs = table(spark, folder, "documents")
    place = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan_licenses(docs.select("doc_id", place.alias("path"), "text"))


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_documents(table(spark, folder, "documents")).drop("char_distance", "word_distance")


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verified_proofs(manifest.document_manifest(table(spark, folder, "documents")))


def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of documents, a tenth of which is first made periodic from some word on, as the contract plants them."""
    return periodic_digests(with_planted_periods(table(spark, folder, "documents")))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents in which, if h = crc32(doc_id) ends in 0, words from a = g % n on repeat with period 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")
    planted = F.expr(r"""
      transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')), w ->
        transform(array(struct(CAST(g % size(w) AS INT) AS a, CAST(1 + (size(w) - g % size(w)) div (3 + g % 8) AS INT) AS p)), x ->
          array_join(transform(w, (y, i) -> IF(i < x.a, y, w[x.a + (i - x.a) % x.p])), ' '))[0])[0]""")
    some = F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) & (F.col("h") % 10 == 0)
    return docs.select("doc_id", "text", h.alias("h")).withColumn("g", g).select("doc_id", F.when(some, planted).otherwise(F.col("text")).alias("text"))


def periodic_digests(docs: DataFrame) -> DataFrame:
    """The longest run of each text and digests of all its runs and of its collapsed form."""
    found = periodic.periodic_runs(docs)
    # greatest length first, of equals the smallest start, then period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_mixing, op3_simhash, op4_passages, op5_bpe, op6_fingerprints, op7_html, op8_embeddings,
                              op9_substrings, op10_licenses, op11_quality, op12_manifest, op13_periodic)}

ORACLES: dict[str, str] = {"op2_mixing": MIXING_SQL, "op10_licenses": LICENSES_SQL, "op11_quality": QUALITY_SQL,
                           "op12_manifest": MANIFEST_SQL}
