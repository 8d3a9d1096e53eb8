"""Extendible hashing: a directory over prefixes of the key's hash in which only oversized buckets split on another bit.

The path of a row is a string of bits: 60 of the key's hash, then 60 of the whole row's, then 60 of its place, so that a key
that holds a third of all rows, and even rows that are alike in everything, can be split. A bucket is a prefix of paths; it
is split while it is over the limit and holds more than one row. Sizes are summed by prefix, a stretch of bits at a time, and
never by moving rows; only buckets that are still over the limit are looked at for a further stretch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from oreline.llm.common import hash60
from oreline.session import stage

BITS = 60
#: Bits that a later stretch adds.
STEP = 6


def _path() -> Column:
    return F.concat(*[F.lpad(F.bin(c), BITS, "0") for c in ("_h1", "_h2", "_h3")])


def _stretch(rows: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """Buckets of ``start`` to ``end`` bits: ``(prefix, depth, bytes, rows, over)``. ``rows``: ``(_path, _bytes)``."""
    cells = rows.groupBy(F.substring("_path", 1, end).alias("cell")).agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    deep = cells.select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth"), "cell", "bytes", "rows")
    sums = deep.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return sums.withColumn("over", (F.col("bytes") > limit) & (F.col("rows") > 1))


def _directory(buckets: DataFrame, start: int, end: int) -> DataFrame:
    """For each prefix of ``end`` bits its bucket: ``(cell, shard, depth, shard_bytes, shard_rows)``; a null shard is split further.

    A bucket is the shortest prefix that is not over the limit; its parent, which is longer than ``start`` or the root, is over it.
    """
    cells = buckets.filter(F.col("depth") == end).select(F.col("prefix").alias("cell"))
    deep = cells.select("cell", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth")).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    fits = buckets.filter(~F.col("over")).select("prefix", "depth", "bytes", "rows")
    found = deep.join(fits, ["prefix", "depth"], "left").filter(F.col("bytes").isNotNull() | (F.col("depth") == end))
    first = F.min(F.when(F.col("bytes").isNotNull(), F.struct("depth", "prefix", "bytes", "rows")))
    return found.groupBy("cell").agg(first.alias("_b")).select(
        "cell", F.col("_b.prefix").alias("shard"), F.col("_b.depth").alias("depth"), F.col("_b.bytes").alias("shard_bytes"), F.col("_b.rows").alias("shard_rows")
    )


def extendible_shards(df: DataFrame, key: str, content: str, max_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``df``: ``(key, bytes, shard, depth, shard_bytes, shard_rows)``.

    ``bytes`` is the UTF-8 length of ``content`` (null: 0). ``shard`` is the bucket's prefix as text of 0 and 1, ``''`` if all fits
    in one. A shard is over ``max_bytes`` only if it is a single row that is. A null key hashes as the text ``null``. Rows
    alike in everything may change places with each other between runs. An empty table gives no rows; other columns don't matter.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    thin = stage(
        df.select(F.col(key).alias("_key"), hash60(name).alias("_h1"), hash60(F.concat(name, F.lit("|"), text)).alias("_h2"), hash60(F.monotonically_increasing_id().cast("string")).alias("_h3"), F.octet_length(text).cast("bigint").alias("_bytes")),
        "shard-rows",
    )
    total = thin.agg(F.sum("_bytes")).first()[0] or 0
    left = thin.withColumn("_path", _path())
    # The first stretch reaches a little beyond the depth that even shards would have, so that one stretch is enough for most.
    start, end, parts = 0, 3 + math.ceil(math.log2(1 + total / max_bytes)), []
    while True:
        buckets = stage(_stretch(left, start, end, max_bytes), "shard-buckets")
        directory = stage(_directory(buckets, start, end), "shard-directory")
        placed = left.withColumn("cell", F.substring("_path", 1, end)).join(directory, "cell").drop("cell")
        parts.append(placed.filter(F.col("shard").isNotNull()))
        if end >= 3 * BITS or directory.filter(F.col("shard").isNull()).isEmpty():
            break
        left = stage(placed.filter(F.col("shard").isNull()).select(*left.columns), "shard-open")
        start, end = end + 1, min(end + STEP, 3 * BITS)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select(F.col("_key").alias(key), F.col("_bytes").alias("bytes"), "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


def extendible_sql(max_bytes: int) -> str:
    """DuckDB text for the same rows, for tables whose keys alone suffice."""
    return f"""
WITH RECURSIVE r AS MATERIALIZED (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
b AS (
  SELECT 0 AS depth, 0::BIGINT AS prefix, sum(bytes)::BIGINT AS bytes, count(*) AS rows FROM r HAVING count(*) > 0
  UNION ALL
  SELECT b.depth + 1, r.h >> (59 - b.depth), sum(r.bytes)::BIGINT, count(*)
  FROM b JOIN r ON r.h >> (60 - b.depth) = b.prefix
  WHERE b.bytes > {max_bytes} AND b.rows > 1 AND b.depth < 60
  GROUP BY 1, 2)
SELECT r.doc_id, r.bytes, CASE WHEN b.depth = 0 THEN '' ELSE right(lpad(bin(b.prefix), 64, '0'), b.depth) END AS shard,
       b.depth, b.bytes AS shard_bytes, b.rows AS shard_rows
FROM r JOIN b ON r.h >> (60 - b.depth) = b.prefix
WHERE NOT (b.bytes > {max_bytes} AND b.rows > 1)"""
