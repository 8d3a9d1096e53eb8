"""From raw documents to token rows: stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from oreline.llm.bpe import encode_documents, share
from oreline.llm.common import table
from oreline.llm.dedup import near_duplicates
from oreline.llm.mixing import mixed_documents
from oreline.llm.personal import fit_field, mask_personal
from oreline.llm.quality import fit_quality, score_quality
from oreline.llm.queries import GOOD
from oreline.session import scratch_path, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to ``labels``, takes for good; empty ones are scored like any other."""
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), name="_good")
    return scored.filter(F.col("_good") >= GOOD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id and then of the smallest MD5 of its text, whatever other rows share its id.

    Rows get keys of their own, written once, so unlike rows with one id are unlike documents. Documents without words are in
    no group and stay, and so do rows without an id.
    """
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed-rows")
    found = near_duplicates(rows.filter("doc_id is not null"), "_row").select(F.col("_row").alias("_key"), "component_id")
    copies = stage(found.filter("_key != component_id"), "copies")  # only groups of several rows go on
    members = copies.union(copies.select("component_id", "component_id").distinct())
    named = members.join(rows.select("_row", "doc_id", F.md5("text").alias("_text")), F.col("_key") == F.col("_row"))
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_text", "_row"))["_row"].alias("_first"))
    later = members.join(first, F.col("_key") == F.col("_first"), "left_anti").select("_key")
    return rows.join(later.hint("merge"), rows["_row"] == later["_key"], "left_anti").select(*docs.columns)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    return mask_personal(docs, fit_field(docs), length="n_chars")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them, with ``n_chars`` counted anew; at most one cut per source."""
    return mixed_documents(docs, length="n_chars")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_chars, n_tokens, ids``."""
    return encode_documents(docs, share(spark, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal", personal_stage),
    ("mixing", mix_stage),
    ("bpe", token_stage),
]

#: SQL can express neither the fitted models nor the encoder; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
