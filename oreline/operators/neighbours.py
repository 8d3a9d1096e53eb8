"""Exact nearest-neighbour, range and distance-summary joins.

No pair table of two groups is ever made. Points lie in a tree: those of a crowded node go to the nearest of
pivots drawn from that node, until every leaf fits. Triangle inequalities tell which nodes can hold a wanted
neighbour of a query. The tree is a table per level, so neither the driver nor a broadcast holds its pivots.
Queries of a node are cut into chunks by hash, rows into blocks, and every (chunk, block) meeting is one NumPy
product whose result is already reduced (k rows, or one row per cluster, for each query).
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from oreline.functions.core import as_list, dtype, number
from oreline.operators.selection import top_k_per_group
from oreline.session import stage

MOST_PIVOTS = 512  # of one node
BLOCK = 2048
RANGE_BLOCK = 8192  # rows of a few plain numbers: a chunk and a block of them fit anywhere, and fewer copies of both are moved
ROWS, COLUMNS = 512, 2048  # of one matrix product
ROUNDING = 1e-12  # what a product can be wrong by, as a share of the lengths
FEW_PAIRS = 1 << 28  # so many are measured sooner than a tree is made
WIDE = 1 << 21  # numbers of a block of rows that meet all queries
SLICE = 1 << 15  # numbers that stay near a core while they are worked on


def vector_of(df: DataFrame, columns) -> Column:
    """The columns (numbers, one array or one ML vector) as one array of doubles."""
    names = as_list(columns)
    if len(names) == 1:
        kind = dtype(df, names[0])
        if isinstance(kind, VectorUDT):
            return vector_to_array(F.col(names[0]))
        if isinstance(kind, ArrayType):
            return F.col(names[0]).cast("array<double>")
    return F.array(*[number(df, n) for n in names])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.concatenate(v.to_numpy()).astype("float64", copy=False).reshape(len(v), len(v.iloc[0]))


def _rows(v: pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of arrays, all of one length, as a matrix, without an object per row."""
    whole = v.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(v), -1)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, summed coordinate by coordinate."""
    out, step = np.zeros((len(a), len(b))), _step(b)
    columns, room = np.ascontiguousarray(b.T), np.empty((step, len(b)))
    for i in range(0, len(a), step):
        part = out[i : i + step]
        for j in range(a.shape[1]):
            d = np.subtract(a[i : i + step, j, None], columns[j], out=room[: len(part)])
            d *= d
            part += d
    return out


def _step(b: np.ndarray) -> int:
    """How many rows meet all rows of ``b`` in one slice."""
    return max(1, SLICE // max(1, len(b)))


def _closest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` its closest row of ``b``, the first of equal ones, and how far that is.

    Products tell which it is where no other row of ``b`` is nearly as close; else coordinates are measured.
    """
    slot, step = np.zeros(len(a), "int64"), _step(b)
    with np.errstate(invalid="ignore", over="ignore"):
        mid = b.mean(axis=0)
        x, y = a - mid, b - mid
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        finite = np.isfinite(xx.sum() + yy.sum())
        for i in range(0, len(a), step):
            doubt = np.arange(i, min(i + step, len(a)))
            if finite:
                d = x[i : i + step] @ y.T
                d *= -2
                d += yy
                slot[i : i + step] = here = d.argmin(axis=1)
                least = d[np.arange(len(d)), here] + 2 * ROUNDING * (xx[i : i + step] + yy.max())
                doubt = i + np.flatnonzero(np.count_nonzero(d <= least[:, None], axis=1) > 1)
            if len(doubt):
                d = np.sqrt(_between(a[doubt], b))
                slot[doubt] = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
        return slot, np.sqrt(_beside(a, b, np.arange(len(a)), slot))


def _beside(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The same of row ``r`` of ``a`` and row ``c`` of ``b``, pair by pair."""
    out = np.zeros(len(r))
    for j in range(a.shape[1]):
        out += (a[r, j] - b[c, j]) ** 2
    return out


def _products(a: np.ndarray, b: np.ndarray):
    """Squared distances by matrix products, a slice at a time: ``(first row, first column, distances, their error)``.

    Both sides are moved by the mean of ``b``, so that lengths are small and little cancels. The error is per row of the slice.
    """
    mid = b.mean(axis=0)
    a, b = a - mid, b - mid
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    for i in range(0, len(a), ROWS):
        error = ROUNDING * (aa[i : i + ROWS] + bb.max())
        for j in range(0, len(b), COLUMNS):
            d = a[i : i + ROWS] @ b[j : j + COLUMNS].T
            d *= -2
            d += aa[i : i + ROWS, None]
            d += bb[None, j : j + COLUMNS]
            yield i, j, d, error


def _nearest(a: np.ndarray, b: np.ndarray, wanted: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of a, row of b, squared distance)`` of the ``wanted`` nearest rows of ``b``, equal ones in their order there.

    ``bound`` (of squared distances) leaves out what is farther. Products only tell which rows can be meant; what they
    leave is measured coordinate by coordinate.
    """
    found, r, c, d = [], *(np.zeros(0, "int64"),) * 2, np.zeros(0)
    top, limit = -1, None

    def best() -> tuple:
        order = np.lexsort((c, d, r))
        place = np.arange(len(order)) - np.searchsorted(r[order], r[order])
        return tuple(x[order[place < wanted]] for x in (r, c, d))

    with np.errstate(invalid="ignore", over="ignore"):
        finite = np.isfinite((a * a).sum() + (b * b).sum())
        plain = ((i, j, _between(a[i : i + ROWS], b[j : j + COLUMNS]), np.zeros(1)) for i in range(0, len(a), ROWS) for j in range(0, len(b), COLUMNS))
        for i, j, near, error in _products(a, b) if finite else plain:
            if not finite:
                near = np.nan_to_num(near, nan=np.inf, posinf=np.inf)
            if i != top:
                found.append(best())
                r, c, d = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
                top, limit = i, bound[i : i + ROWS].copy()
            if j == 0 and near.shape[1] >= wanted and np.isinf(limit).any():
                limit = np.minimum(limit, np.partition(near, wanted - 1, axis=1)[:, wanted - 1] + error)
            rows, columns = np.nonzero(near <= (limit + error)[:, None])
            r, c = np.append(r, rows + i), np.append(c, columns + j)
            d = np.append(d, _beside(a, b, rows + i, columns + j))
            if len(r) > 8 * wanted * len(near):
                r, c, d = best()
                last = np.searchsorted(r, np.arange(i, i + len(near)), "right") - 1
                whole = np.bincount(r - i, minlength=len(near)) == wanted
                limit[whole] = np.fmin(limit[whole], d[last[whole]])
        found.append(best())
    return tuple(np.concatenate(x) for x in zip(*found))


def _split(rows: DataFrame, parts: DataFrame, own: str, other: str, by: Column) -> DataFrame:
    """Rows of a node dealt to their own ``parts`` by hash, and given to each of the other side's."""
    dealt = rows.join(parts, "node").withColumn(own, F.pmod(by, F.col(f"{own}s")))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1))).drop(f"{own}s", f"{other}s")


def _parts(rows: DataFrame, name: str, most: int) -> DataFrame:
    return rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / most).alias(name))


def _grown(t: DataFrame, pivots: int | None, leaf: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """The leaf ``node`` of each row ``(id, v)``, and one table ``(node, child, pivot, radius, n, is_leaf)`` per level of the tree.

    Rows of a node with more than ``leaf`` rows go to the nearest of pivots drawn from that node, until all nodes fit. A node
    whose rows can't be told apart by their distances in doubles stays whole. Nodes are named by their path.
    """
    kind = dtype(t, "id")
    schema = StructType([
        StructField("node", StringType()), StructField("child", StringType()), StructField("id", kind),
        StructField("v", ArrayType(DoubleType())), StructField("away", DoubleType()),
    ])

    def settle(rows: pa.Table, heads: pa.Table) -> pa.Table:
        slot, away = np.zeros(0, "int64"), np.zeros(0)
        if len(rows):
            slot, away = _closest(_rows(rows["v"]), _rows(heads["pivot"]))
        return pa.table({"node": rows["node"], "child": heads["child"].take(pa.array(slot)), "id": rows["id"], "v": rows["v"], "away": away})

    leaves, levels = [], []
    open_rows = t.withColumn("node", F.lit("0"))
    while True:
        sizes = stage(open_rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "knn-sizes")
        if not levels and sizes.filter(F.col("n") > leaf).limit(1).count() == 0:
            return open_rows, []
        # so many that children come near the size of a leaf: tiny leaves cost more than they let be skipped
        few = F.greatest(F.lit(4), F.least(F.sqrt("n").cast("int"), F.ceil(4 * F.col("n") / leaf).cast("int")))
        fan = F.lit(pivots) if pivots else F.least(F.lit(MOST_PIVOTS), few)
        drawn = top_k_per_group(open_rows.select("node", "v").distinct(), "node", [F.xxhash64("v"), F.col("v")], pivots or MOST_PIVOTS, "_slot")
        heads = drawn.join(sizes, "node").filter(F.col("_slot") <= fan)
        heads = stage(heads.select("node", F.concat_ws(".", "node", "_slot").alias("child"), F.col("v").alias("pivot")), "knn-pivots")
        parts = sizes.select("node", F.ceil(F.col("n") / (4 * block)).alias("chunks"), F.lit(1).cast("bigint").alias("blocks"))
        left = _split(open_rows, parts, "chunk", "block", F.xxhash64("id", "v"))
        right = _split(heads, parts, "block", "chunk", F.lit(0))
        homed = stage(left.groupBy("node", "chunk").cogroup(right.groupBy("node", "chunk")).applyInArrow(settle, schema), "knn-level")
        children = homed.groupBy("node", "child").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        whole = sizes.select("node", F.col("n").alias("_n"))
        is_leaf = (F.col("n") <= leaf) | (F.col("n") >= F.col("_n"))
        level = children.join(whole, "node").join(heads, ["node", "child"]).select("node", "child", "pivot", "radius", "n", is_leaf.alias("is_leaf"))
        levels.append(stage(level, "knn-tree"))
        marked = homed.join(levels[-1].select("child", "is_leaf"), "child").select("id", "v", F.col("child").alias("node"), "is_leaf")
        leaves.append(marked.filter("is_leaf").drop("is_leaf"))
        if levels[-1].filter("NOT is_leaf").limit(1).count() == 0:
            return reduce(DataFrame.unionByName, leaves), levels
        open_rows = stage(marked.filter("NOT is_leaf").drop("is_leaf"), "knn-open")


def _least_distance(d: np.ndarray, between: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How far the rows of each pivot are from a query at least, by the pivot's radius and by its border with the query's own pivot.

    ``d`` is how far the pivots are from the query, ``between`` how far they are from each other.
    """
    with np.errstate(all="ignore"):
        own = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
        nearest = d[np.arange(len(d)), own][:, None]
        border = (d**2 - nearest**2 - ROUNDING * (d**2 + nearest**2 + radius**2)) / (2 * between[own])
        return np.fmax(*(np.nan_to_num(x, nan=-np.inf, posinf=np.inf, neginf=-np.inf) for x in (d - radius, border)))


def _prunes(t: DataFrame, q: DataFrame, wanted: int, pivots: int = 64, rows: int = 4096, asked: int = 256) -> bool:
    """Whether a tree lets a query skip half of the rows, tried on a bounded sample of both sides.

    It only chooses between two ways to the same neighbours.
    """
    some = [r[0] for r in t.select("v").orderBy(F.xxhash64("id", "v")).limit(rows).collect()]  # bounded by ``rows``
    few = [r[0] for r in q.select("v").orderBy(F.xxhash64("query_id", "v")).limit(asked).collect()]
    x, y = np.array(some, dtype="float64"), np.array(few, dtype="float64")
    if len(x) < wanted or not len(y):
        return True
    with np.errstate(all="ignore"):
        d = np.sqrt(_between(x, x[:pivots]))
        cell = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
        size = np.bincount(cell, minlength=len(x[:pivots]))
        radius = np.array([d[cell == i, i].max(initial=0) for i in range(len(size))])
        reach = np.sqrt(np.sort(_between(y, x), axis=1)[:, wanted - 1])
        heads = x[:pivots]
        seen = _least_distance(np.sqrt(_between(y, heads)), np.sqrt(_between(heads, heads)), radius) <= reach[:, None]
    return (seen * size).sum() <= len(x) * len(y) / 2


def _bounded(q: DataFrame, placed: DataFrame, levels: list[DataFrame], wanted: int, block: int) -> DataFrame:
    """Queries with ``bound``: how far the last of the wanted rows is in the leaf that a query itself would lie in."""
    kind = dtype(q, "query_id")
    fields = [StructField("query_id", kind), StructField("v", ArrayType(DoubleType()))]
    schema = StructType([*fields, StructField("node", StringType()), StructField("is_leaf", BooleanType())])

    def settle(rows: pa.Table, heads: pa.Table) -> pa.Table:
        slot = np.zeros(0, "int64")
        if len(rows) and len(heads):
            slot, _ = _closest(_rows(rows["v"]), _rows(heads["pivot"]))
        rows, home = rows.slice(0, len(slot)), heads.take(pa.array(slot))
        return pa.table({"query_id": rows["query_id"], "v": rows["v"], "node": home["child"], "is_leaf": home["is_leaf"]})

    one = F.lit(1).cast("bigint")
    front, homes = q.select("query_id", "v", F.lit("0").alias("node"), F.lit(not levels).alias("is_leaf")), []
    for level in levels:
        inner = front.filter("NOT is_leaf")
        parts = _parts(inner, "chunks", block).withColumn("blocks", one)
        left = _split(inner, parts, "chunk", "block", F.xxhash64("query_id", "v"))
        right = _split(level, parts, "block", "chunk", F.lit(0))
        homes.append(front.filter("is_leaf"))
        front = stage(left.groupBy("node", "chunk").cogroup(right.groupBy("node", "chunk")).applyInArrow(settle, schema), "knn-home")
    home = reduce(DataFrame.unionByName, [*homes, front]).drop("is_leaf")
    # of a leaf that could not be split, one block is enough for a bound
    parts = _parts(home, "chunks", block).join(_parts(placed, "blocks", block), "node")
    left = _split(home, parts.withColumn("blocks", one), "chunk", "block", F.xxhash64("query_id", "v"))
    right = _split(placed, parts, "block", "chunk", F.xxhash64("id")).filter("block = 0")

    def measure(a: pa.Table, b: pa.Table) -> pa.Table:
        bound = np.full(len(a), np.inf)
        if len(a) and len(b) >= wanted:
            d = _nearest(_rows(a["v"]), _rows(b["v"]), wanted, bound)[2]
            bound = np.nan_to_num(np.sqrt(d.reshape(len(a), wanted)[:, -1]), nan=np.inf, posinf=np.inf)
        return pa.table({"query_id": a["query_id"], "v": a["v"], "bound": bound})

    schema = StructType([*fields, StructField("bound", DoubleType())])
    return stage(left.groupBy("node", "chunk").cogroup(right.groupBy("node", "chunk")).applyInArrow(measure, schema), "knn-bound")


def _visited(q: DataFrame, levels: list[DataFrame], wanted: int, block: int) -> DataFrame:
    """``(query_id, v, bound, node)``: the leaves that can hold one of the ``wanted`` nearest rows of a query with a ``bound``.

    A query goes down the tree level by level. Nodes that surely hold enough rows bound how far its neighbours can be; nodes
    that lie farther away than the least bound found so far are left out, those of earlier levels too.
    """
    kind = dtype(q, "query_id")
    schema = StructType([
        StructField("query_id", kind), StructField("v", ArrayType(DoubleType())), StructField("bound", DoubleType()),
        StructField("node", ArrayType(StringType())), StructField("is_leaf", ArrayType(BooleanType())), StructField("low", ArrayType(DoubleType())),
    ])  # a row per query, so that Python holds its coordinates once and not once per child
    slack = 1e-9

    def descend(rows: pa.Table, heads: pa.Table) -> pa.Table:
        rows = rows if len(heads) else rows.slice(0, 0)
        bounds, picked, lows, many = rows["bound"].to_numpy().copy(), [np.zeros(0, "int64")], [np.zeros(0)], [np.zeros(1, "int64")]
        if len(rows):
            asked, pivots = _rows(rows["v"]), _rows(heads["pivot"])
            radius, size = heads["radius"].to_numpy(), heads["n"].to_numpy()
            between, step = np.sqrt(_between(pivots, pivots)), _step(pivots)
        for i in range(0, len(rows), step if len(rows) else 1):
            d, bound = np.sqrt(_between(asked[i : i + step], pivots)), bounds[i : i + step]
            loose = np.flatnonzero(np.isinf(bound))  # their own leaves hold too few rows
            if len(loose):
                far = np.nan_to_num(d[loose] + radius, nan=np.inf, posinf=np.inf)
                order = far.argsort(axis=1)
                held = size[order].cumsum(axis=1)
                every = np.arange(len(loose))
                bound[loose] = np.where(held[:, -1] >= wanted, far[every, order[every, (held >= wanted).argmax(axis=1)]], np.inf)
            low = _least_distance(d, between, radius)
            near = low <= bound[:, None] * (1 + slack) + slack
            picked.append(np.nonzero(near)[1])
            lows.append(low[near])
            many.append(np.count_nonzero(near, axis=1))
        ends, seen = pa.array(np.concatenate(many).cumsum(), pa.int32()), heads.take(pa.array(np.concatenate(picked)))
        lists = {"node": seen["child"], "is_leaf": seen["is_leaf"], "low": pa.chunked_array([np.concatenate(lows)])}
        lists = {n: pa.ListArray.from_arrays(ends, pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)) for n, c in lists.items()}
        return pa.table({"query_id": rows["query_id"], "v": rows["v"], "bound": bounds, **lists})

    front = q.select("query_id", "v", F.lit("0").alias("node"), F.lit(not levels).alias("is_leaf"), F.lit(0.0).alias("low"), "bound")
    per_query = Window.partitionBy("query_id")
    for level in levels:
        parts = _parts(front.filter("NOT is_leaf"), "chunks", block).withColumn("blocks", F.lit(1).cast("bigint"))
        left = _split(front.filter("NOT is_leaf"), parts, "chunk", "block", F.xxhash64("query_id", "v"))
        right = _split(level, parts, "block", "chunk", F.lit(0))
        deeper = left.groupBy("node", "chunk").cogroup(right.groupBy("node", "chunk")).applyInArrow(descend, schema)
        deeper = deeper.select("query_id", "v", "bound", F.inline(F.arrays_zip("node", "is_leaf", "low")))
        seen = front.filter("is_leaf").unionByName(deeper).withColumn("bound", F.min("bound").over(per_query))
        front = stage(seen.filter(F.col("low") <= F.col("bound") * (1 + slack) + slack), "knn-visits")
    return front.select("query_id", "v", "bound", "node")


def knn_join(
    queries: DataFrame, train: DataFrame, key: str, columns, k: int = 5, skip_same_key: bool = False,
    pivots: int | None = None, block: int = BLOCK, train_key: str | None = None,
) -> DataFrame:
    """``(query_id, neighbour_id, squared_distance, rank)``: the k nearest training rows of each query.

    Exact; equal distances go to the smaller id. Without training rows there are no neighbours. Training rows lie in a tree
    whose leaves hold at most ``block`` rows; every node draws ``pivots`` pivots, by default the root of its rows. Where a tree
    lets little be skipped (many independent columns, few rows), and ``pivots`` are not given, all chunks meet all blocks.
    """
    train_key = train_key or key
    wanted = k + 1 if skip_same_key else k
    t = train.select(F.col(train_key).alias("id"), vector_of(train, columns).alias("v"))
    t = t.filter("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))")
    q = queries.select(F.col(key).alias("query_id"), vector_of(queries, columns).alias("v"))
    q = q.filter("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))")  # no coordinates, no neighbours
    # of identical points only the first few ids can ever be among the nearest
    t = t.withColumn("_h", F.xxhash64("v"))  # numbers sort faster than arrays
    t = stage(top_k_per_group(t, ["_h", "v"], [F.asc("id")], wanted, "_same").drop("_same", "_h"), "knn")
    q = stage(q, "knn-q")
    asked, held = q.count(), t.count()
    every = None
    if asked * held > FEW_PAIRS:
        # queries at the same place have the same neighbours, so each place asks once
        places = stage(q.withColumn("_h", F.xxhash64("v")).groupBy("_h", "v").agg(F.count(F.lit(1)).alias("n")).select("v"), "knn-places")
        distinct = places.count()
        if 2 * distinct <= asked:
            every, q, asked = q, stage(places.select(F.monotonically_increasing_id().alias("query_id"), "v"), "knn-once"), distinct
    if pivots is None and (asked * held <= FEW_PAIRS or not _prunes(t, q, wanted)):
        placed, visits = t.withColumn("node", F.lit("0")), q.select("query_id", "v", F.lit(math.inf).alias("bound"), F.lit("0").alias("node"))
        width = t.agg(F.max(F.size("v"))).first()[0] or 1
        wide = max(wanted, WIDE // width)
        parts = t.sparkSession.range(1).select(
            F.lit("0").alias("node"), F.lit(max(1, -(-held // wide))).cast("bigint").alias("blocks"),
            F.lit(max(1, -(-asked // 8192), min(12, asked // 512))).cast("bigint").alias("chunks"),
        )
    else:
        placed, levels = _grown(t, pivots, max(block, wanted), block)
        visits = _visited(_bounded(q, placed, levels, wanted, block), levels, wanted, block)
        parts = stage(_parts(placed, "blocks", block).join(_parts(visits, "chunks", block), "node"), "knn-parts")
    right = _split(placed, parts, "block", "chunk", F.xxhash64("id"))
    left = _split(visits, parts, "chunk", "block", F.xxhash64("query_id"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, pick, d = *(np.zeros(0, "int64"),) * 2, np.zeros(0)
        if len(a) and len(b):
            b = b.take(pc.sort_indices(b["id"]))
            reach = (a["bound"].to_numpy() * (1 + 1e-9) + 1e-9) ** 2
            rows, pick, d = _nearest(_rows(a["v"]), _rows(b["v"]), wanted, reach)
        return pa.table({"query_id": a["query_id"].take(pa.array(rows)), "neighbour_id": b["id"].take(pa.array(pick)), "squared_distance": d})

    schema = StructType(
        [StructField("query_id", dtype(q, "query_id")), StructField("neighbour_id", dtype(t, "id")), StructField("squared_distance", DoubleType())]
    )
    keys = ["node", "block", "chunk"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    if every is not None:
        best = top_k_per_group(near, "query_id", [F.asc("squared_distance"), F.asc("neighbour_id")], wanted)
        best = best.groupBy("query_id").agg(F.collect_list(F.struct("neighbour_id", "squared_distance")).alias("_best"))
        best = best.join(q, "query_id").select(F.xxhash64("v").alias("_h"), "v", "_best")
        near = every.withColumn("_h", F.xxhash64("v")).join(best, ["_h", "v"]).select("query_id", F.inline("_best"))
    if skip_same_key:
        near = near.filter(F.col("query_id") != F.col("neighbour_id"))
    return top_k_per_group(near, "query_id", [F.asc("squared_distance"), F.asc("neighbour_id")], k)


def cluster_distances(df: DataFrame, key: str, columns, cluster: str, block: int | None = None) -> DataFrame:
    """``(id, own, cluster, total, n)``: the sum of Euclidean distances of each row to each cluster.

    Work grows with the square of the rows, as the exact Euclidean silhouette does; it is spread over
    (chunk, block) meetings, each a row of matrix products that leaves one row per query and cluster.
    """
    rows = df.select(F.col(key).alias("id"), F.col(cluster).cast("long").alias("own"), vector_of(df, columns).alias("v"))
    rows = stage(rows, "distances")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(n / (block or max(1, WIDE // (width or 1)))))
    chunks = max(1, math.ceil(n / (block or 8192)), min(12, n // 512))
    part = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("chunk", part(chunks)).withColumn("block", every(blocks))
    right = rows.withColumn("block", part(blocks)).withColumn("chunk", every(chunks))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"][:0], "own": a["own"][:0], "cluster": b["own"][:0], "total": np.zeros(0), "n": np.zeros(0, "int64")})
        b = b.sort_values("own")
        x, y, own = _matrix(a["v"]), _matrix(b["v"]), b["own"].to_numpy()
        clusters, place = np.unique(own, return_inverse=True)
        total = np.zeros((len(x), len(clusters)))
        with np.errstate(invalid="ignore", over="ignore"):
            finite = np.isfinite((x * x).sum() + (y * y).sum())
            plain = ((i, j, _between(x[i : i + ROWS], y[j : j + COLUMNS]), None) for i in range(0, len(x), ROWS) for j in range(0, len(y), COLUMNS))
            for i, j, d, error in _products(x, y) if finite else plain:
                if finite:  # where little is left of the lengths, coordinates are measured
                    r, c = np.nonzero(d <= 1e6 * error[:, None])
                    d[r, c] = _beside(x, y, r + i, c + j)
                here = place[j : j + d.shape[1]]
                starts = np.flatnonzero(np.diff(here, prepend=-1))
                total[i : i + len(d), here[starts]] += np.add.reduceat(np.sqrt(d, out=d), starts, axis=1)
        k = len(clusters)
        return pd.DataFrame({
            "id": np.repeat(a["id"].to_numpy(), k), "own": np.repeat(a["own"].to_numpy(), k), "cluster": np.tile(clusters, len(x)),
            "total": total.ravel(), "n": np.tile(np.bincount(place, minlength=k), len(x)),
        })

    schema = StructType(
        [StructField("id", dtype(rows, "id")), StructField("own", dtype(rows, "own")), StructField("cluster", dtype(rows, "own")),
         StructField("total", DoubleType()), StructField("n", dtype(rows, "own"))]
    )
    met = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(meet, schema)
    return met.groupBy("id", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def crowded_cells(visitors: DataFrame, held: DataFrame, around: Column, most: int = BLOCK) -> DataFrame:
    """``(cell, chunks, blocks)`` of the grid cells that more than ``most`` rows lie in or visit.

    A cell's visits are the rows of the cells around it, so they are added up from counts per cell.
    """
    count = F.count(F.lit(1))
    sent = visitors.groupBy("cell").agg(count.alias("_n")).withColumn("_o", F.explode(around))
    sent = sent.groupBy(F.zip_with("cell", "_o", lambda a, b: a + b).alias("cell")).agg(F.ceil(F.sum("_n") / most).alias("chunks"))
    kept = held.groupBy("cell").agg(F.ceil(count / most).alias("blocks"))
    return sent.join(kept, "cell").filter("chunks > 1 OR blocks > 1")


def cell_join(visits: DataFrame, held: DataFrame, crowded: DataFrame, visitor: str, row: str) -> DataFrame:
    """Visits beside the rows of their ``cell``; rows of a crowded cell are dealt to its blocks, visits to its chunks, and
    each chunk meets each block, so that no key has more than a block and a chunk. Other cells move each row once."""
    one, nil = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    partitions = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sides(rows: DataFrame, own: str, other: str, by: str) -> DataFrame:
        beside = rows.join(crowded, "cell", "left").withColumn(own, F.pmod(F.xxhash64(by), F.coalesce(f"{own}s", one)))
        met = beside.withColumn(other, F.explode(F.sequence(nil, F.coalesce(f"{other}s", one) - 1))).drop("chunks", "blocks")
        # few bytes make many pairs, so the partitions are not to be put together by their bytes
        return met.repartition(partitions, "cell", "block", "chunk")

    return sides(visits, "chunk", "block", visitor).join(sides(held, "block", "chunk", row), ["cell", "block", "chunk"])


def eps_range_join(df: DataFrame, key: str, columns: list[str], eps: float, block: int = RANGE_BLOCK) -> DataFrame:
    """``(a, b, distance)`` with ``a < b`` for all rows at most ``eps`` apart, by grid cells of side ``eps``.

    One side visits its own cell and half of those around it, so each pair meets once; crowded cells are cut by their counts.
    """
    p = df.select(F.col(key).alias("id"), vector_of(df, columns).alias("v"))
    p = stage(p.withColumn("cell", F.transform("v", lambda x: F.floor(x / eps))), "range")
    every = range(len(columns))
    here = tuple([0] * len(columns))
    forward = [o for o in product((-1, 0, 1), repeat=len(columns)) if o >= here]
    around = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in o]) for o in forward])
    # the pairs see plain numbers, which compiled code compares; arrays and lambdas are interpreted
    visits = p.select(F.col("id").alias("a"), *[F.col("v")[i].alias(f"_a{i}") for i in every], F.col("cell").alias("_home"), F.explode(around).alias("_o"))
    visits = visits.select("a", *[f"_a{i}" for i in every], F.zip_with("_home", "_o", lambda x, y: x + y).alias("cell"), "_home")
    visits = visits.withColumn("_own", F.col("_home") == F.col("cell")).drop("_home")
    held = p.select(F.col("id").alias("b"), *[F.col("v")[i].alias(f"_b{i}") for i in every], "cell")
    d = reduce(lambda s, i: s + (F.col(f"_a{i}") - F.col(f"_b{i}")) * (F.col(f"_a{i}") - F.col(f"_b{i}")), every, F.lit(0.0))
    near = cell_join(visits, held, stage(crowded_cells(p, p, around, block), "crowded"), "a", "b").filter(d <= eps * eps)
    once = F.when(F.col("_own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    return near.filter(once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.sqrt(d).alias("distance"))
