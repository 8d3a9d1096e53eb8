"""The ready queries of this subpackage, each a thin use of its operator over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from oreline.llm.alignment import alignment_digests, share_both
from oreline.llm.bpe import digests, share
from oreline.llm.common import held_out, table
from oreline.llm.dedup import near_duplicates
from oreline.llm.embeddings import near_vectors
from oreline.llm.fingerprint import edited_fingerprints
from oreline.llm.language import fit_language, predict_language
from oreline.llm.mixing import mixed_sizes, mixing_sql
from oreline.llm.negatives import hard_negatives, negatives_sql
from oreline.llm.pages import extract_pages, fit_pages
from oreline.llm.personal import fit_field, personal_digests
from oreline.llm.quality import fit_quality, score_quality
from oreline.llm.sharding import extendible_shards, extendible_sql
from oreline.llm.toxicity import fit_toxicity, score_toxicity

#: Bytes of text in a shard.
SHARD_BYTES = 64 << 20


def op1_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    return extendible_shards(table(spark, folder, "documents"), "doc_id", "text", SHARD_BYTES)


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = predict_language(docs.drop("lang"), fit_language(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_personal(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return personal_digests(docs, fit_field(docs))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), share(spark, public_tokenizers.path("byte_bpe_50k.json")))


def op5_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_sizes(table(spark, folder, "documents")).drop("source")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op7_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


def op8_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op9_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = score_quality(docs, fit_quality(docs, table(spark, folder, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    both = share_both(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment_digests(table(spark, folder, "documents"), both)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("embedding"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
    )
    found = hard_negatives(rows, F.col("vec_id") % 100 == 0)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("positive_score", "negative_score")})


def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract_pages(pages, fit_pages(pages))


#: The least score of a good document.
GOOD = 0.3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_extendible_shards, op2_language, op3_personal, op4_bpe, op5_mix, op6_toxicity, op7_order_minhash, op8_superminhash, op9_embeddings, op10_quality, op11_alignment, op12_hard_negatives, op13_main_text)
}
TWINS: dict[str, str] = {"op1_extendible_shards": extendible_sql(SHARD_BYTES), "op5_mix": mixing_sql(), "op12_hard_negatives": negatives_sql()}
