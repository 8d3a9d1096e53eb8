"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Documents are dealt to shards by hash. A source's documents, shard after shard and in hashed order, form a stream that is cut into blocks of
``block_words`` words. The blocks of the mix are apportioned to the sources by the highest quotients ``votes / (2 k - 1)``, where a
source's votes are its target in blocks. A quota of ``q`` blocks from a stream of ``n`` takes each block ``q div n`` times and ``q mod n`` of them,
spread evenly from a seeded start, once more. So a shard's quota is the whole number of chosen blocks that begin in it (``shard_quotas``):
what a source owes is carried from shard to shard, and a source of few words per shard comes as near to its target as any other.
Every step is a sum by key, a window over one stream of a shard, or one over the shards of a source or one row per source.

``mixed_sizes`` counts words of single blocks, as its SQL twin does. ``mixed_documents`` gives texts to learn from, so it takes what its
sources owe beyond whole rounds as whole documents: the first ones in hashed order, of which only the last may be cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oreline.llm.common import WORD, hash60
from oreline.session import stage

#: Given values: weights by the place of a source, repeating, and the most a source may be repeated.
WEIGHTS = (5, 2, 1)
MOST = 3


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", copies: str | None = None, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: ``(source, place, weight, source_size, whole_size, target)``.

    Targets share the size of all by weight, no source above ``most`` times its own. In order of ``size / weight``, the
    first source that its share does not fill up ends the full ones, so the level comes from running sums, without rounds.
    """
    amount = F.col(size) * F.col(copies) if copies else F.col(size)
    own = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(amount).cast("bigint").alias("source_size"))
    placed = own.withColumn("place", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    rows = placed.withColumn("weight", weight.cast("bigint")).withColumn("whole_size", F.sum("source_size").over(W.partitionBy(F.lit(1))))
    order = W.orderBy((most * F.col("source_size")) / F.col("weight"), "place")
    rows = rows.withColumn("_full", F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("_level", (F.col("whole_size") - F.col("_full")) / F.col("_rest"))
    rows = rows.withColumn("_ends", F.col("_level") * F.col("weight") <= most * F.col("source_size"))
    level = F.min(F.when(F.col("_ends"), F.struct(((most * F.col("source_size")) / F.col("weight")).alias("o"), "place", "_level"))).over(W.partitionBy(F.lit(1)))["_level"]
    target = F.least((most * F.col("source_size")).cast("double"), level * F.col("weight"))
    return rows.select("source", "place", "weight", "source_size", "whole_size", target.alias("target"))


def _up_to(x: Column, block: int) -> Column:
    """Words taken from the first ``x`` words of a stream: whole rounds, then the blocks chosen once more."""
    j = F.floor(x / F.lit(block)).cast("bigint")
    return F.col("_rounds") * x + block * _chosen(j) + (x - j * block) * (_chosen(j + 1) - _chosen(j))


def _dealt(docs: DataFrame, key: str, source: str, text: str, seed: str, shard_words: int, weights, most: int, by_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row per different ``(key, source, size)`` with its target and shard, and the targets of the sources.

    ``by_text`` tells rows apart by a hash of the text too, in ``_text``, and deals by it, so that the rows of one id go to all shards.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    more = {"_text": F.xxhash64(text)} if by_text else {}
    units = stage(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), *[c.alias(n) for n, c in more.items()]).groupBy("key", "source", "size", *more).agg(F.count(F.lit(1)).alias("copies")), "mix-units")
    targets = stage(source_targets(units, copies="copies", weights=weights, most=most), "mix-targets")
    name = F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("key").cast("string"), F.lit("null")), *[c for n in more for c in (F.lit(":"), F.col(n).cast("string"))])
    shards = F.greatest(F.lit(1), F.ceil(F.col("whole_size") / shard_words)).cast("bigint")
    rows = units.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return rows.withColumn("_hash", hash60(name)).withColumn("shard", F.col("_hash") % shards), targets


def _cuts(streams: DataFrame, seed: str, block_words: int, most: int) -> DataFrame:
    """``(shard, place, _blocks, _rounds, _extra, _start)`` of ``streams(shard, place, source_size, target, stream)``."""
    blocks = F.ceil(F.col("stream") / block_words).cast("bigint")
    votes = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * blocks).otherwise(F.lit(0.0))
    streams = streams.withColumn("votes", votes)
    shard = W.partitionBy("shard")
    some = streams.filter("votes > 0").withColumn("_all", F.sum(F.floor(F.col("votes") * 1048576)).over(shard) / 1048576.0).withColumn("_n", F.count(F.lit(1)).over(shard))
    some = some.withColumn("_seats", F.round(F.col("_all")).cast("bigint"))
    # The divisor lies between all / (seats + n / 2) and all / (seats - n / 2): seats surely won, and those that may be.
    sure = F.greatest(F.lit(0), F.floor(F.col("votes") * (F.col("_seats") - F.col("_n") / 2) / F.col("_all") - 0.5) - 1).cast("bigint")
    most_won = F.ceil(F.col("votes") * (F.col("_seats") + F.col("_n") / 2) / F.col("_all") + 0.5).cast("bigint") + 1
    some = some.withColumn("_sure", sure).withColumn("_open", F.col("_seats") - F.sum("_sure").over(shard))
    asked = some.withColumn("k", F.explode(F.sequence(F.col("_sure") + 1, most_won)))
    best = F.row_number().over(shard.orderBy((F.col("votes") / (2 * F.col("k") - 1)).desc(), "place", "k"))
    won = asked.withColumn("_best", best).groupBy("shard", "place").agg((F.max("_sure") + F.count(F.when(F.col("_best") <= F.col("_open"), 1))).alias("quota"))
    start = hash60(F.concat(F.lit(seed), F.lit("/"), F.col("shard").cast("string"), F.lit("/"), F.col("place").cast("string")))
    cuts = streams.join(won, ["shard", "place"], "left").select("shard", "place", F.greatest(blocks, F.lit(1)).alias("_blocks"), F.coalesce("quota", F.lit(0)).alias("quota"))
    cuts = cuts.withColumn("quota", F.least("quota", most * F.col("_blocks")))
    return cuts.select("shard", "place", "_blocks", F.floor(F.col("quota") / F.col("_blocks")).cast("bigint").alias("_rounds"), (F.col("quota") % F.col("_blocks")).alias("_extra"), (start % F.col("_blocks")).alias("_start"))


def _with_offsets(rows: DataFrame, *last: str) -> DataFrame:
    """``_offset``: words before a row in the stream of its shard and source."""
    order = W.partitionBy("shard", "place").orderBy("_hash", "key", "size", *last)
    amount = F.col("size") * F.col("copies")
    return rows.withColumn("_offset", (F.sum(amount).over(order.rowsBetween(W.unboundedPreceding, 0)) - amount).cast("bigint"))


def _streams(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("shard", "place", *by).agg(F.sum(F.col("size") * F.col("copies")).cast("bigint").alias("stream"))


def _placed(rows: DataFrame, targets: DataFrame, seed: str, block_words: int, most: int, *last: str) -> DataFrame:
    """``rows`` with their source's cut and, in ``_offset``, the words before them in its stream over all shards."""
    cuts = _cuts(targets.select(F.lit(0).alias("shard"), "place", "source_size", "target", F.col("source_size").alias("stream")), seed, block_words, most).drop("shard")
    before = F.sum("stream").over(W.partitionBy("place").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    streams = _streams(rows).withColumn("_before", F.coalesce(before, F.lit(0)).cast("bigint")).join(cuts, "place")
    placed = _with_offsets(rows.join(streams, ["shard", "place"]), *last)
    return placed.withColumn("_offset", F.col("_before") + F.col("_offset"))


def _chosen(k: Column) -> Column:
    """How many of the first ``k`` blocks of a stream are taken once more."""
    return F.floor((k * F.col("_extra") + F.col("_start")).cast("double") / F.col("_blocks"))


def plan_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", shard_words: int = 4 << 20, block_words: int = 16, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """What the mix takes: one row per different ``(key, source, size)``, with its number of ``copies`` and the cut of its stream.

    Columns: ``key, source, size, copies, shard, source_size, target, _offset, _blocks, _rounds, _extra, _start``. Nulls are values of
    their own in ``key`` and ``source``; a null text has size 0.
    """
    rows, targets = _dealt(docs, key, source, text, seed, shard_words, weights, most)
    rows = _placed(rows, targets, seed, block_words, most)
    return rows.select("key", "source", "size", "copies", "shard", "source_size", "target", "_offset", "_blocks", "_rounds", "_extra", "_start")


def shard_quotas(plan: DataFrame, block_words: int = 16) -> DataFrame:
    """``(source, shard, quota)``: the blocks that each shard gives of a source, whole rounds and chosen ones, of a plan of ``plan_mix``."""
    ends = plan.groupBy("source", "shard").agg(F.min("_offset").alias("a"), F.max(F.col("_offset") + F.col("size") * F.col("copies")).alias("b"), *[F.first(c).alias(c) for c in ("_blocks", "_rounds", "_extra", "_start")])
    first, last = (F.ceil(F.col(c) / block_words).cast("bigint") for c in "ab")  # blocks that begin in the shard
    return ends.select("source", "shard", (F.col("_rounds") * (last - first) + _chosen(last) - _chosen(first)).cast("bigint").alias("quota"))


def mixed_sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block_words: int = 16, **options) -> DataFrame:
    """One row per row of ``docs``: ``(key, source, size, source_size, target, taken)``; ``taken`` counts repeats. Reruns agree."""
    rows = plan_mix(docs, key, source, text, block_words=block_words, **options)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    begin = F.col("_offset") + F.col("_copy") * F.col("size")
    taken = (_up_to(begin + F.col("size"), block_words) - _up_to(begin, block_words)).cast("bigint")
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken.alias("taken"))


def plan_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", shard_words: int = 4 << 20, block_words: int = 16, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """What the mix of documents takes: ``key, source, size, _text, copies, _offset, _rounds, _words``, a row per different first four.

    ``_text`` is a hash of the text, so an id that many rows share is dealt to all shards.

    Every source takes each of its words ``_rounds`` times and the first ``_words`` words of its streams, shard after shard, once
    more. Blocks are apportioned once over all shards; running sums per source carry what it owes from shard to shard.
    """
    rows, targets = _dealt(docs, key, source, text, seed, shard_words, weights, most, by_text=True)
    rows = _placed(rows, targets, seed, block_words, most, "_text")
    # Of the last, shorter block only its own words count, if it is among the chosen ones.
    short = F.when(F.col("_start") < F.col("_extra"), F.col("_blocks") * block_words - F.col("source_size")).otherwise(F.lit(0))
    return rows.select("key", "source", "size", "_text", "copies", "_offset", "_rounds", (F.col("_extra") * block_words - short).cast("bigint").alias("_words"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block_words: int = 16, most: int = MOST, length: str | None = None, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns kept, with as many words of each source as ``plan_documents`` says.

    A document comes as often as whole rounds take it, and once more if it is among the first of its source in hashed order, where the
    last one is cut after as many words as are still owed; white space between words is kept. Documents without words are not
    taken. ``length`` names a column that gets the new number of code points.
    """
    plan = plan_documents(docs, key, source, text, block_words=block_words, most=most, **options)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    kept = docs.columns
    rows = docs.select(F.struct(*kept).alias("_row"), F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(text).alias("_t"), F.xxhash64(text).alias("_h"), size.alias("_n")).filter("_n > 0")
    cut = plan.withColumnsRenamed({"key": "_key", "source": "_source", "size": "_size", "copies": "_copies"})
    rows = rows.join(cut, F.col("_k").eqNullSafe(F.col("_key")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size")) & (F.col("_h") == F.col("_text")))
    # Only where a key comes again with its text are its rows numbered.
    once, again = rows.filter("_copies = 1").withColumn("_copy", F.lit(0).cast("bigint")), rows.filter("_copies > 1")
    again = again.withColumn("_copy", F.row_number().over(W.partitionBy("_key", "_source", "_size", "_text").orderBy(F.xxhash64("_t"))).cast("bigint") - 1)
    rows = once.unionByName(again).withColumn("_part", F.col("_words") - F.col("_offset") - F.col("_copy") * F.col("_size"))
    words = F.regexp_extract_all(F.col("_t"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("_part").cast("int")), "")
    times = (F.col("_rounds") + F.when(F.col("_part") >= F.col("_n"), 1).otherwise(0)).cast("int")
    whole = F.array_repeat(F.col("_t"), times)
    texts = F.when((F.col("_part") > 0) & (F.col("_part") < F.col("_n")), F.concat(whole, F.array(part))).otherwise(whole)
    rows = rows.withColumn("_t", F.explode(texts))
    out = rows.select(*[F.col("_t").alias(c) if c == text else F.col("_row")[c].alias(c) for c in kept])
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out


def mixing_sql(seed: str = "mix", shard_words: int = 4 << 20, block_words: int = 16) -> str:
    """DuckDB text for the rows of ``mixed_sizes`` over ``documents``, without ``source``."""
    h = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"

    def up_to(x: str) -> str:
        at = f"(({x}) // {block_words})"
        chosen = lambda j: f"(({j} * extra + start) // blocks)"
        return f"(rounds * ({x}) + {block_words} * {chosen(at)} + (({x}) % {block_words}) * ({chosen(f'({at} + 1)')} - {chosen(at)}))"

    return f"""
WITH units AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, count(*) AS copies FROM documents GROUP BY ALL),
own AS (SELECT source, sum(size * copies)::BIGINT AS source_size FROM units GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place, sum(source_size) OVER ()::BIGINT AS whole_size FROM own),
weighed AS (SELECT *, ([{', '.join(map(str, WEIGHTS))}])[(place - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM placed),
sums AS (SELECT *, ({MOST} * source_size)::DOUBLE / weight AS o,
   coalesce(sum({MOST} * source_size) OVER (ORDER BY ({MOST} * source_size)::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_size,
   sum(weight) OVER (ORDER BY ({MOST} * source_size)::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest FROM weighed),
levels AS (SELECT *, (whole_size - full_size)::DOUBLE / rest AS level FROM sums),
targets AS (SELECT source, place, source_size, whole_size, least(({MOST} * source_size)::DOUBLE,
   (SELECT level FROM levels WHERE level * weight <= {MOST} * source_size ORDER BY o, place LIMIT 1) * weight) AS target FROM levels),
rows AS (SELECT u.*, place, source_size, whole_size, target, {h(f"'{seed}:' || coalesce(doc_id::VARCHAR, 'null')")} AS hash
   FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source),
dealt AS (SELECT *, hash % greatest(1, ceil(whole_size / {shard_words}.0)::BIGINT) AS shard FROM rows),
streams AS (SELECT 0 AS shard, place, source_size AS stream,
   CASE WHEN source_size > 0 THEN target / source_size * ((source_size + {block_words - 1}) // {block_words}) ELSE 0.0 END AS votes FROM targets),
summed AS (SELECT *, sum(floor(votes * 1048576)::BIGINT) OVER (PARTITION BY shard) / 1048576.0 AS whole, count(*) OVER (PARTITION BY shard) AS n FROM streams WHERE votes > 0),
asked AS (SELECT *, round(whole::DOUBLE)::BIGINT AS seats FROM summed),
quotients AS (SELECT shard, place, seats, unnest(generate_series(1, ceil(votes * (seats + n / 2.0) / whole + 1.5)::BIGINT)) AS k, votes FROM asked),
best AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY votes / (2 * k - 1) DESC, place, k) AS r FROM quotients),
won AS (SELECT shard, place, count(*) FILTER (WHERE r <= seats) AS quota FROM best GROUP BY shard, place),
cuts AS (SELECT s.shard, s.place, greatest(1, (stream + {block_words - 1}) // {block_words}) AS blocks, coalesce(quota, 0) AS quota FROM streams s LEFT JOIN won USING (shard, place)),
turns AS (SELECT shard, place, blocks, least(quota, {MOST} * blocks) // blocks AS rounds, least(quota, {MOST} * blocks) % blocks AS extra,
   {h(f"'{seed}/' || shard || '/' || place")} % blocks AS start FROM cuts),
placed_rows AS (SELECT d.*, t.blocks, t.rounds, t.extra, t.start,
   (sum(size * copies) OVER (PARTITION BY d.place ORDER BY d.shard, hash, doc_id, size ROWS UNBOUNDED PRECEDING) - size * copies)::BIGINT AS o
   FROM dealt d JOIN turns t ON d.place = t.place),
each AS (SELECT *, o + c * size AS a, o + c * size + size AS b FROM (SELECT *, unnest(generate_series(0, copies - 1)) AS c FROM placed_rows))
SELECT doc_id, size, source_size, target, ({up_to('b')} - {up_to('a')})::BIGINT AS taken FROM each"""
