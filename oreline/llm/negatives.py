"""Hard negatives by inner product: cover trees over norm-augmented candidates, searched best first.

Candidates are dealt into blocks of bounded size, and a task builds the cover tree of a block. A coordinate more makes all candidates of a
tree equally long, so that inner products fall with the distance; the radius that a node's rows really reach bounds them from
both sides. A search descends the node of highest bound first, skips nodes outside all of an anchor's windows or below what it has
found already, and takes exact inner products in the leaves. Chunks of anchors meet parts of the trees, one tree at a time,
and hand on their first rows only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.session import stage

#: Rows of a tree, rows of a leaf, how much smaller the radius of a level is than that of the one above.
TREE, LEAF, BASE = 4096, 128, 1.3
#: Anchors of a chunk, and groups of labels that have trees of their own.
ANCHORS, GROUPS = 4096, 64


@dataclass
class CoverTree:
    """Rows in an order in which every node is a run ``start`` to ``end``; children of a node are a run of nodes."""

    x: np.ndarray
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    centre: list[int] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)

    def __post_init__(self):
        #: The squared length that all rows have with the coordinate more.
        self.longest = float((self.x * self.x).sum(axis=1).max(initial=0.0))


def augmented(x: np.ndarray) -> np.ndarray:
    """``x`` with a coordinate that makes all rows as long as the longest."""
    square = (x * x).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))])


def build_tree(x: np.ndarray) -> tuple[CoverTree, np.ndarray]:
    """The tree of the rows ``x`` and their order in it.

    From level to level the radius shrinks by ``BASE``. The centres of a level are farther than its radius from each other, and each row goes
    to its nearest centre. Sets of at most ``LEAF`` rows, and rows that are all alike, are leaves; small sets below one node share leaves.
    """
    points = augmented(x)
    tree, order = CoverTree(x), np.arange(len(x))

    def add(start: int, end: int, centre: int) -> int:
        rows = points[order[start:end]]
        tree.start.append(start)
        tree.end.append(end)
        tree.centre.append(centre)
        tree.radius.append(float(np.sqrt(((rows - points[centre]) ** 2).sum(axis=1).max())))
        tree.first.append(-1)
        tree.children.append(0)
        return len(tree.start) - 1

    waiting = [add(0, len(x), 0)] if len(x) else []
    while waiting:
        node = waiting.pop()
        start, end = tree.start[node], tree.end[node]
        if end - start <= LEAF or tree.radius[node] == 0:
            continue
        inside, limit = order[start:end], tree.radius[node] / BASE
        rows = points[inside]
        nearest = np.sqrt(((rows - points[tree.centre[node]]) ** 2).sum(axis=1))
        owner, centres = np.zeros(len(rows), np.int64), [tree.centre[node]]
        while nearest.max() > limit:  # the farthest row is a centre of the next level
            far = int(nearest.argmax())
            distance = np.sqrt(((rows - rows[far]) ** 2).sum(axis=1))
            closer = distance < nearest
            nearest[closer], owner[closer] = distance[closer], len(centres)
            centres.append(int(inside[far]))
        by_owner = np.argsort(owner, kind="stable")
        order[start:end] = inside[by_owner]
        sizes = np.bincount(owner, minlength=len(centres))
        runs, at = [], start
        for n, centre in zip(sizes.tolist(), centres):
            if n == 0:
                continue
            small = n <= LEAF // 2
            if small and runs and runs[-1][3] and at + n - runs[-1][0] <= LEAF:
                runs[-1] = (runs[-1][0], at + n, runs[-1][2], True)
            else:
                runs.append((at, at + n, centre, small))
            at += n
        tree.first[node], tree.children[node] = len(tree.start), len(runs)
        waiting += [add(s, e, c) for s, e, c, _ in runs]
    tree.x = x[order]
    places = np.empty(len(x), np.int64)
    places[order] = np.arange(len(x))
    tree.centre = places[np.array(tree.centre, np.int64)].tolist() if tree.centre else []
    return tree, order


class Found:
    """The first ``k`` rows of each window of an anchor: highest score first, then smallest id, then smallest row."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.rows = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(windows)]
        self.least = np.full(windows, -np.inf)

    def add(self, window: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores, ids, rows = (np.concatenate(pair) for pair in zip(self.rows[window], (scores, ids, rows)))
        best = np.lexsort((rows, ids, -scores))[: self.k]
        self.rows[window] = (scores[best], ids[best], rows[best])
        if len(best) == self.k:
            self.least[window] = self.rows[window][0][-1]


def search(tree: CoverTree, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, anchor: dict, nodes: np.ndarray, same: bool, whole: float, found: Found) -> int:
    """Add a tree's rows to what an anchor has ``found``; the number of leaves read.

    ``nodes`` are the anchor's inner products with the centres. Scores are ``whole`` times an inner product and lie within a window's ``low``
    and ``high``. Rows are of the anchor's label and not itself (``same``), or of another label.
    """
    q, low, high = anchor["x"], anchor["low"], anchor["high"]
    length, radius = tree.longest + float(q @ q), np.asarray(tree.radius)
    distance = np.sqrt(np.maximum(length - 2 * nodes, 0.0))
    slack = 1e-9 * length + 1e-9
    upper = whole * ((length - np.maximum(distance - radius, 0.0) ** 2) / 2 + slack)
    lower = whole * ((length - (distance + radius) ** 2) / 2 - slack)
    read, waiting = 0, [(-upper[0], 0)]
    while waiting:
        above, node = heapq.heappop(waiting)
        need = np.maximum(low, found.least)
        if -above < need.min():
            break  # no node that waits reaches higher
        useful = (upper[node] >= need) & (lower[node] <= high)
        if not useful.any():
            continue
        if tree.children[node]:
            first = tree.first[node]
            for child in range(first, first + tree.children[node]):
                if ((upper[child] >= need) & (lower[child] <= high)).any():
                    heapq.heappush(waiting, (-upper[child], child))
            continue
        read += 1
        run = slice(tree.start[node], tree.end[node])
        scores = whole * (tree.x[run] @ q)
        fits = (scores >= need[useful].min()) & (scores <= high[useful].max())
        fits &= (labels[run] == anchor["label"]) & (rows[run] != anchor["row"]) if same else labels[run] != anchor["label"]
        which = np.flatnonzero(fits)
        if len(which):
            s, at = scores[which], which + tree.start[node]
            for w in np.flatnonzero(useful).tolist():
                inside = (s >= need[w]) & (s <= high[w])
                if inside.any():
                    found.add(w, s[inside], ids[at[inside]], rows[at[inside]])
    return read


_TREE = "d int, g int, tree bigint, ids binary, rows binary, labels binary, x binary, start binary, end binary, centre binary, radius binary, first binary, children binary"


def cover_trees(rows: DataFrame, seed: int = 11) -> DataFrame:
    """One row per tree of ``rows(row, id, label, x, d, g)``: blocks of about ``TREE`` rows of one vector length and one group of labels."""
    blocks = rows.groupBy("d", "g").agg(F.ceil(F.count(F.lit(1)) / TREE).cast("int").alias("blocks"))
    dealt = rows.join(blocks, ["d", "g"]).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row"), F.col("blocks")).cast("int"))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        x = np.array(part["x"].tolist(), np.float64).reshape(len(part), -1)
        tree, order = build_tree(x)
        pack = lambda values, kind: np.ascontiguousarray(values, kind).tobytes()
        d, g, block = (int(v) for v in key)
        values = [d, g, (g << 32) + block, *(pack(part[c].to_numpy()[order], "<i8") for c in ("id", "row", "label")), pack(tree.x, "<f8"), *(pack(v, "<i4") for v in (tree.start, tree.end, tree.centre)), pack(tree.radius, "<f8"), pack(tree.first, "<i4"), pack(tree.children, "<i4")]
        return pd.DataFrame([values], columns=[c.split()[0] for c in _TREE.split(", ")])

    return dealt.select("d", "g", "block", "row", "id", "label", "x").groupBy("d", "g", "block").applyInPandas(build, _TREE)


def _read_tree(batch: pa.RecordBatch, i: int) -> tuple[CoverTree, np.ndarray, np.ndarray, np.ndarray]:
    read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)
    x = read("x", "<f8").reshape(len(read("rows", "<i8")), -1)
    tree = CoverTree(x, *(read(c, k).tolist() for c, k in (("start", "<i4"), ("end", "<i4"), ("centre", "<i4"), ("radius", "<f8"), ("first", "<i4"), ("children", "<i4"))))
    return tree, read("ids", "<i8"), read("rows", "<i8"), read("labels", "<i8")


def first_rows(anchors: DataFrame, trees: DataFrame, k: int, same: bool, whole: float, chunks: int, parts: int) -> DataFrame:
    """``(row, window, score, id, found)``: the first ``k`` rows of each window of each anchor, with ranks left to the caller.

    ``anchors(row, label, x, d, g, lows, highs)`` are dealt in ``chunks`` and trees in ``parts``; each chunk meets each part in a task of its own
    that holds its anchors and reads one tree at a time. With ``same`` only trees of an anchor's own group of labels are met.
    """
    cell = ["d", "g", "chunk", "part"] if same else ["d", "chunk", "part"]
    left = anchors.select(F.lit(0).alias("kind"), "d", "g", "row", "label", "x", "lows", "highs", F.pmod(F.xxhash64(F.lit("chunk"), "row"), F.lit(chunks)).cast("int").alias("chunk"))
    left = left.withColumnRenamed("x", "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = trees.withColumn("kind", F.lit(1)).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "tree"), F.lit(parts)).cast("int"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    both = left.unionByName(right, allowMissingColumns=True).repartition(*cell).sortWithinPartitions(*cell, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, states = None, [], []

        def results() -> Iterator[pa.RecordBatch]:
            out = [(a["row"], w, s, i, r) for a, f in zip(held, states) for w, hit in enumerate(f.rows) if len(hit[0]) for s, i, r in zip(*(v.tolist() for v in hit))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()))], names=["row", "window", "score", "id", "found"])

        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in cell)))
            kinds = batch.column("kind").to_pylist()
            for i in range(batch.num_rows):
                if cells[i] != now:
                    yield from results()
                    now, held, states = cells[i], [], []
                if kinds[i] == 0:
                    a = {c: batch.column(c)[i].as_py() for c in ("row", "label", "q", "lows", "highs")}
                    held.append({"row": a["row"], "label": a["label"], "x": np.array(a["q"], np.float64), "low": np.where(np.array(a["lows"]) <= np.array(a["highs"]), a["lows"], np.inf), "high": np.array(a["highs"], np.float64)})
                    states.append(Found(len(a["lows"]), k))
                elif held:
                    tree, ids, rows, labels = _read_tree(batch, i)
                    centres = tree.x[np.array(tree.centre)]
                    for at in range(0, len(held), 256):
                        nodes = np.stack([a["x"] for a in held[at : at + 256]]) @ centres.T
                        for a, f, products in zip(held[at : at + 256], states[at : at + 256], nodes):
                            search(tree, ids, rows, labels, a, products, same, whole, f)
        yield from results()

    return both.mapInArrow(run, "row bigint, window int, score double, id bigint, found bigint")


def hard_negatives(
    df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: float = 30, high: float = 90, whole: float = 100
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, scores being inner products in double precision.

    Anchors are the rows for which ``anchors`` holds. Their positives are the first other rows of their label; for each, the first
    rows of other labels with ``low * positive <= whole * negative <= high * positive`` are its negatives. Higher scores come first, ties go to
    the smaller key. Keys and labels are whole numbers. Rows with a null key or label, a null vector, or a null or non-finite component take no
    part; vectors of different lengths don't meet. Repeated rows are rows of their own, so a row that is repeated is a positive of its
    copies, and a repeated anchor is returned once for each copy. Anchors without positives, and positives without negatives, give no row.
    Scores are exact while they are whole numbers below 2**53. Results don't depend on how rows are dealt.
    """
    v = F.transform(vector, lambda c: c.cast("double"))
    fine = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = df.filter(fine).select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), v.alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("d", F.size("x")).withColumn("g", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))
    rows = stage(rows, "candidates")
    trees = stage(cover_trees(rows), "cover-trees")
    chosen = rows.filter("anchor").drop("anchor")
    chunks, parts = max(1, math.ceil(chosen.count() / ANCHORS)), max(1, math.ceil(2 * math.sqrt(trees.count())))
    of_group = max(1, trees.groupBy("d", "g").count().agg(F.max("count")).first()[0] or 1)

    def ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id", "found")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    every = chosen.withColumn("lows", F.array(F.lit(float("-inf")))).withColumn("highs", F.array(F.lit(float("inf"))))
    near = ranked(first_rows(every, trees, positives, True, 1.0, chunks, math.ceil(2 * math.sqrt(of_group))), positives)
    near = stage(near.select("row", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    windows = chosen.join(scores, "row").withColumn("lows", F.transform("scores", lambda s: s * low)).withColumn("highs", F.transform("scores", lambda s: s * high))
    hard = ranked(first_rows(windows, trees, negatives, False, float(whole), chunks, parts), negatives)
    out = hard.join(near, (hard["row"] == near["row"]) & (hard["window"] + 1 == near["nth"])).join(chosen.select(F.col("row").alias("of"), F.col("id").alias("anchor_id")), hard["row"] == F.col("of"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", (F.col("score") / whole).alias("negative_score"))


def negatives_sql() -> str:
    """DuckDB text for the rows of the ready query."""
    return """
with fine as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(x::double * 256) for x in embedding] as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from fine a join fine b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
), positive as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as integer) as rank,
  s.other_id as negative_id, p.positive_score, s.score as negative_score
from positive p join scored s on s.anchor_id = p.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
"""
