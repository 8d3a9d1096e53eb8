"""Document fingerprints by Order MinHash: sketches whose likeness falls with edit distance, not only with other content.

A text's k-mers are numbered by occurrence, so that a repeated one counts as often as it comes. Each of ``SIGNS`` hash functions
selects the ``TUPLE`` smallest numbered k-mers, keeps them in the order they have in the text, and hashes that tuple to one sign.
Equal texts have equal signs; texts with the same k-mers in another order don't. The likeness of two fingerprints is the share of equal signs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

from oreline.llm.common import schema_with, slices
from oreline.llm.dedup import mixed

KMER, TUPLE, SIGNS = 8, 2, 32
#: Numbered k-mers looked at together.
_PART = 4096

_GOLD = np.uint64(0x9E3779B97F4A7C15)


_FLIP = (mixed(np.arange(1, SIGNS + 1, dtype=np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32)[:, None]
_TIMES = (mixed(np.arange(101, SIGNS + 101, dtype=np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_STEP = mixed(np.arange(1, KMER + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def numbered_kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers of a text with their occurrence numbers, in text order; a shorter text is a single one."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32)
    width = min(KMER, len(codes))
    h = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        h += (codes[k : len(codes) - width + 1 + k] + np.uint32(1)) * _STEP[k]
    h = mixed(h)
    # Value and place in one number: sorting brings equal k-mers together in text order.
    bits = np.uint64(max(1, int(len(h) - 1).bit_length()))
    ranked = np.sort((h >> bits) << bits | np.arange(len(h), dtype=np.uint64))
    same = ranked >> bits
    new = np.concatenate([[True], same[1:] != same[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    number = np.empty(len(h), np.uint64)
    number[(ranked & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = np.arange(len(h)) - start
    return (mixed(h + number * _GOLD) >> np.uint64(32)).astype(np.uint32)


def signs(text: str) -> np.ndarray:
    """The ``SIGNS`` tuple hashes of a text."""
    x = numbered_kmers(text)
    if not len(x):
        return np.zeros(SIGNS, np.uint32)
    full = np.uint32(0xFFFFFFFF)
    rows = np.arange(SIGNS)
    # The smallest of each part stay candidates; the last part decides among them.
    places, ranks = [], []
    for at in range(0, len(x), _PART):
        h = (x[at : at + _PART] ^ _FLIP) * _TIMES
        for _ in range(min(TUPLE, h.shape[1])):
            best = h.argmin(axis=1)
            places.append(best + at)
            ranks.append(h[rows, best].astype(np.int64))
            h[rows, best] = full
    places, ranks = np.array(places), np.array(ranks)
    if len(places) > TUPLE:
        order = np.lexsort((places, ranks), axis=0)[:TUPLE]
        places = np.take_along_axis(places, order, axis=0)
    places = np.sort(places, axis=0)
    out = np.full(SIGNS, len(places), np.uint64)
    for row in places:
        out = mixed(out * _GOLD + x[row].astype(np.uint64) + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str | None) -> str:
    """Signs as hexadecimal text of 8 letters each; a null text counts as empty."""
    return signs(text or "").astype(">u4").tobytes().hex()


@F.pandas_udf(StringType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of the whole text; a column of that name is replaced."""
    return docs.withColumn(name, _fingerprints(F.col(text)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signs of two fingerprints, 0 to 1."""
    sign = lambda c, i: F.substring(c, 8 * i + 1, 8)
    equal = sum((sign(a, i) == sign(b, i)).cast("int") for i in range(SIGNS))
    return equal / F.lit(float(SIGNS))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_range: int = 4000, most_ranges: int = 50_000) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The edited text ends with the beginning of the next document's, in order of ``key`` (null last, then by text), in place of its last
    quarter; the last document's next is the first one. Returns ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. Null texts count as empty; a single document is its own next; other columns don't matter.

    Rows are dealt to ranges of a numeric ``key`` of about ``rows_per_range`` rows (more beyond ``most_ranges`` ranges). The rows
    that begin a range also go to the range before it, marked, as what follows its last row, so no window spans more than a range.
    """
    ids = docs.select(F.col(key).alias("_key"))
    n, low = ids.agg(F.count(F.lit(1)), F.min("_key")).first()
    parts = max(1, min(most_ranges, -(-n // rows_per_range)))
    found = ids.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 100_000)).first()[0] if parts > 1 else None
    # Quantiles are keys of the table, so each range begins with the rows of its cut.
    cuts = sorted({*(found or [])} - {low})
    shared = docs.sparkSession.sparkContext.broadcast((cuts, low))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, low = shared.value
        begins = {c: i for i, c in enumerate(cuts)} | {low: len(cuts)}
        for part, texts in slices(batches, "_text"):
            keys = part.column("_key").to_pylist()
            places = [len(cuts) if k is None else bisect_right(cuts, k) for k in keys]
            again = [i for i, k in enumerate(keys) if k in begins]
            made = [fingerprint(t) for t in texts]
            take = pa.array([*range(len(keys)), *again])
            yield pa.RecordBatch.from_arrays([part.column("_key").take(take), pa.array(texts, pa.string()).take(take), pa.array(made, pa.string()).take(take), pa.array(places + [begins[keys[i]] for i in again], pa.int32()), pa.array([0] * len(keys) + [1] * len(again), pa.int32())], names=["_key", "_text", "_made", "_place", "_mark"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    dealt = rows.mapInArrow(deal, schema_with(rows, "_made string, _place int, _mark int"))
    order = W.partitionBy("_place").orderBy("_mark", F.col("_key").asc_nulls_last(), "_text")
    dealt = dealt.withColumn("_next", F.lead("_text").over(order)).withColumn("_next_made", F.lead("_made").over(order)).filter("_mark = 0").drop("_place", "_mark")
    size = F.length("_text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), size - quarter), F.substring("_next", F.lit(1), quarter))
    out = dealt.withColumn("_edited", edited).withColumn("edited_fingerprint", _fingerprints("_edited"))
    return out.select(
        F.col("_key").alias(key), size.cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), F.col("_made").alias("fingerprint"), "edited_fingerprint",
        likeness(F.col("_made"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("_made"), F.col("_next_made")).alias("near_next"),
    )
