"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors are one class with a weight. In each table a class has as many sign bits as keep an average bucket near
``BUCKET`` classes; the number of tables follows from the chance ``MISSED`` that a pair just at the limit meets in none. A task reads its
buckets one after the other, sorted, and compares the members of one by a matrix product, those of large ones block against block; what
is near the limit is compared exactly in double precision. A pair counts in the first table only where it meets. Tasks return sums per
class and one link per member to the smallest member that it is joined with, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from oreline.llm.common import schema_with
from oreline.llm.components import connected_components
from oreline.session import stage

BUCKET, BLOCK, MISSED = 512, 2048, 1e-6


def plan_tables(classes: int, least: float) -> tuple[int, int]:
    """Bits and tables for so many classes and a cosine limit."""
    bits = max(4, round(math.log2(max(classes, 2) / BUCKET)))
    meet = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log1p(-meet))) if meet < 1 else 1


def sign_codes(vectors: np.ndarray, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    """``(vectors, tables)`` numbers of ``bits`` sign bits."""
    planes = np.random.RandomState(seed).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)


def linked_blocks(reps: np.ndarray, weight: np.ndarray, x: np.ndarray, codes: np.ndarray, split: int | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights linked to each member, and the place of the smallest member (by ``reps``) that each is joined with.

    The first ``split`` members meet the others; without it all meet each other. ``codes``: those of the tables before this one.
    """
    size = np.sqrt((x * x).sum(axis=1))
    unit = x / size[:, None]
    n = len(x)
    if split is None:
        i, j = np.nonzero(unit @ unit.T >= least - 1e-9)
        i, j = i[i < j], j[i < j]
    else:
        i, j = np.nonzero(unit[:split] @ unit[split:].T >= least - 1e-9)
        j = j + split
    fits = np.einsum("ij,ij->i", x[i], x[j]) / (size[i] * size[j]) >= least
    i, j = i[fits], j[fits]
    sums, order = np.zeros(n, np.int64), np.argsort(reps, kind="stable")
    first = ~(codes[i] == codes[j]).any(axis=1) if codes.shape[1] else np.ones(len(i), bool)
    np.add.at(sums, i[first], weight[j[first]])
    np.add.at(sums, j[first], weight[i[first]])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lowest = rank.copy()
    while len(i):
        before = lowest.copy()
        np.minimum.at(lowest, i, before[j])
        np.minimum.at(lowest, j, before[i])
        lowest = np.minimum(lowest, lowest[order[lowest]])
        if (lowest == before).all():
            break
    return sums, order[lowest]


def meetings(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each value of ``keys``, which lie one after the other; one group is held at a time."""
    now, held = None, []
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if values[start] != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = values[start], []
            held.append(batch.slice(start, end - start))
    if held:
        yield now, pa.Table.from_batches(held)


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per row of ``df``: ``(key, n_links, component_id, kept)``.

    ``n_links`` is the number of other rows whose cosine with it is ``least`` or more; components are named by their smallest key. Vectors that
    are null, zero, empty or hold null or non-finite components link with nothing, as do vectors of different lengths; rows with a null
    key link with nothing, have a null component and are kept. A pair just at the limit is missed with a chance of ``MISSED``.
    """
    kind = df.schema[key].dataType.simpleString()
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(key).alias("id"), F.when(fine & F.col(key).isNotNull(), v).alias("v")).withColumn("h", F.xxhash64("v"))
    some = rows.filter("v is not null")
    classes = stage(some.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")).withColumn("h", F.xxhash64("v")), "vector-classes")
    bits, tables = plan_tables(classes.count(), least)
    # Components that came as floats travel as floats; comparing is in double precision all the same.
    is_float = isinstance(df.schema[vector].dataType.elementType, FloatType)
    kinds = ("<f4" if is_float else "<f8", "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("v")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                for d in np.unique(sizes):
                    which = np.flatnonzero(sizes == d)
                    x = np.stack([flat[starts[i] : starts[i] + d] for i in which])
                    codes = sign_codes(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), bits, tables)
                    take = pa.array(np.repeat(which, tables))
                    repeat = lambda values: pa.array(values, pa.binary()).take(pa.array(np.repeat(np.arange(len(which)), tables)))
                    yield pa.RecordBatch.from_arrays([part.column("rep").take(take), part.column("h").take(take), part.column("w").take(take), pa.array(np.full(codes.size, d, np.int32)), pa.array(codes.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(which))), repeat([r.tobytes() for r in x.astype(kinds[0])]), repeat([r.tobytes() for r in codes.astype(kinds[1])])], names=["rep", "h", "w", "d", "bucket", "t", "vector", "codes"])

    dealt = classes.select("v", "rep", "h", "w").mapInArrow(deal, schema_with(classes.select("rep", "h", "w"), "d int, bucket bigint, t int, vector binary, codes binary"))
    cell = ["d", "t", "bucket"]
    counts = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    met = dealt.join(counts, cell).withColumn("i", F.pmod(F.xxhash64("rep", "h"), F.col("g")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(*cell, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "rep", "h", "w", "vector", "codes")
    meet = [*cell, "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, t, _, lo, hi), rows in meetings(batches, meet):
            split = None
            if lo != hi:
                rows = rows.sort_by("i")
                split = rows.column("i").to_pylist().count(lo)
            x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), kinds[0]).reshape(len(rows), -1).astype(np.float64)
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), kinds[1]).reshape(len(rows), -1)[:, :t]
            reps = rows.column("rep").combine_chunks()
            sums, joined = linked_blocks(reps.to_numpy(zero_copy_only=False), rows.column("w").to_numpy(), x, codes, split, least)
            some = pa.array(np.flatnonzero((sums > 0) | (joined != np.arange(len(x)))))
            if len(some):
                yield pa.RecordBatch.from_arrays([reps.take(some), rows.column("h").combine_chunks().take(some), pa.array(sums).take(some), reps.take(pa.array(joined).take(some))], names=["rep", "h", "n", "joined"])

    found = met.repartition(*meet).sortWithinPartitions(*meet).mapInArrow(compare, f"rep {kind}, h bigint, n bigint, joined {kind}")
    found = stage(found, "vector-links")
    sums = found.groupBy("rep", "h").agg(F.sum("n").alias("n"))
    named = classes.select("v", "rep", "h", "w").join(sums, ["rep", "h"], "left").select("v", "rep", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    # Rows meet their class by the whole vector; those without a valid one have none.
    of_rows = stage(rows.join(named, "v", "left").select("id", "rep", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "vector-rows")
    links = found.filter("rep != joined").select(F.col("rep").alias("a"), F.col("joined").alias("b")).union(of_rows.filter("rep is not null and id != rep").select("id", "rep"))
    groups = connected_components(links)
    out = of_rows.join(groups, F.col("id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
