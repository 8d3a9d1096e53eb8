"""Near-duplicate documents: SuperMinHash signatures, banding, verification on whole shingle sets, and grouping.

A document's set is that of its distinct shingles of five words. Equal sets become one class at once. A signature is a row
of smallest ranks, where an element meets every position once, in an order of its own, with a rank in [0, 1), [1, 2), ... by
turn; most sets fill all positions in the first turns and stop. Positions are cut into bands; sets alike in a band meet in a bucket.

Finding the groups takes two rounds, both exact for what meets in a bucket:

1. Every member of a bucket is compared with the bucket's smallest member, and groups are formed of the links confirmed.
2. A bucket whose members still belong to several groups is open. All pairs of members from different groups are compared:
   in small buckets as pairs of ids, in large ones block against block inside tasks, which return no more links than they need to
   join groups. So a group of thousands of near copies never becomes thousands squared of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oreline.llm.common import schema_with, slices
from oreline.llm.components import connected_components
from oreline.session import stage

WIDTH = 5
#: 36 bands of 6 positions: two sets of likeness 0.85 miss each other with a chance of 4e-8.
BANDS, ROWS = 36, 6
#: Members up to which an open bucket is compared as pairs of ids, and members of a block beyond that.
SMALL, BLOCK = 24, 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD) | np.uint64(1)


def word_hashes(data: bytes, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of lower-cased UTF-8 text, which is read in parts of about ``most`` bytes."""
    raw = np.frombuffer(data, np.uint8)
    hashes, firsts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + most)
        while end < len(raw) and not _BLANK[raw[end]]:
            end += 1
        h, first = _word_hashes(raw[at:end])
        hashes.append(h)
        firsts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(firsts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = _BLANK[raw]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(first):
        return np.zeros(0, np.uint64), first
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    place = np.zeros(len(raw), np.int64)
    place[first[0] :] = np.arange(first[0], len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    value = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _PLACE[place & 255]
    far = np.flatnonzero(place > 255)
    if len(far):  # words of more than 256 bytes
        value[far] = mixed(value[far] + (place[far] >> 8).astype(np.uint64) * _GOLD)
    value[blank] = 0
    return mixed(np.add.reduceat(value, first) + (ends - first).astype(np.uint64) * _GOLD), first


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    datas = [t.encode() for t in texts]
    hashes, first = word_hashes(b"\n".join(datas))
    edges = np.cumsum([0, *(len(d) + 1 for d in datas)])
    cuts = np.searchsorted(first, edges)
    shingles = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        shingles += hashes[k : len(hashes) - width + 1 + k] * _PLACE[k]
    shingles = mixed(shingles)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= width:
            out.append(np.unique(shingles[a : b - width + 1]))
        elif b > a:
            out.append(mixed((hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(shingles[:0])
    return out


def super_minhash(elements: np.ndarray, positions: int) -> np.ndarray:
    """Smallest rank at each position: turn in the high bits, 40 random bits below."""
    best = np.full(positions, np.iinfo(np.uint64).max, np.uint64)
    turns = np.arange(1, positions + 1, dtype=np.uint64) * _GOLD
    for at in range(0, len(elements), 4096):
        part = elements[at : at + 4096]
        rows, order = np.arange(len(part)), None
        for turn in range(positions):
            draw = mixed(part + turns[turn])
            pick = turn + ((draw & np.uint64(0xFFFFFF)) * np.uint64(positions - turn) >> np.uint64(24)).astype(np.int64)
            if turn == 0:
                place = pick
            else:
                if order is None:  # the shuffled order of positions of each element, made once a second turn is needed
                    order = np.tile(np.arange(positions, dtype=np.int32), (len(part), 1))
                    order[rows, before] = 0
                place = order[rows, pick]
                order[rows, pick] = order[:, turn]
            before = pick if turn == 0 else before
            np.minimum.at(best, place, (draw >> np.uint64(24)) | np.uint64(turn << 40))
            if best.max() < np.uint64((turn + 1) << 40):
                break
    return best


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per band, different for the same values in another band."""
    parts = mixed(signature.reshape(bands, rows)) * _PLACE[:rows]
    return mixed(parts.sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _GOLD).view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, n_shingles, s1, s2, bands)`` per row: the set's size, two sums that stand for it, and its band hashes.

    A set of n elements has at most n / (n + 1) in common with another one. Where that is under ``percent``, only equal sets
    are alike, which are one class anyway, and the bands are null.
    """
    few = (percent - 1) // (100 - percent) if percent < 100 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", 1 << 20):
            sizes, s1, s2, found = [], [], [], []
            for s in shingle_sets(texts):
                sizes.append(len(s))
                s1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                s2.append(int(mixed(s ^ _GOLD).sum(dtype=np.uint64).astype(np.int64)))
                found.append(band_hashes(super_minhash(s, bands * rows), bands, rows) if few is not None and len(s) > few else None)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "n_shingles", "s1", "s2", "bands"])

    rows_in = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = schema_with(rows_in.select("id"), "n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")
    return rows_in.mapInArrow(run, schema)


def _sets(docs: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """``(id, shingles)`` of the documents in ``ids(id)``: sorted hashes as bytes, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["id", "shingles"])

    # The same plan at every size: ids grow with the corpus, so they are not sent to every task.
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids.hint("merge"), "id", "left_semi")
    return rows.mapInArrow(run, schema_with(rows.select("id"), "shingles binary"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_x = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_x.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, both.select("a", "b").schema)


def _joins_groups(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between members of different groups, no more than needed to join the groups; ``a`` and ``b``: blocks of a bucket."""
    group: dict = {}

    def top(g):
        while (up := group.get(g, g)) != g:
            group[g] = group.get(up, up)
            g = group[g]
        return g

    sets = [[np.frombuffer(x, np.uint64) for x in part["shingles"]] for part in (a, b)]
    sizes = [np.array([len(s) for s in part]) for part in sets]
    owners = [np.repeat(np.arange(len(part)), n) for part, n in zip(sets, sizes)]
    coded = [np.concatenate(part) for part in sets]
    common = np.intersect1d(np.unique(coded[0]), np.unique(coded[1]))
    shared = np.zeros((len(sets[0]), len(sets[1])), np.float32)
    places = [np.searchsorted(common, c) for c in coded]
    own = [(p < len(common)) & (common[np.minimum(p, len(common) - 1)] == c) if len(common) else np.zeros(len(c), bool) for p, c in zip(places, coded)]
    for start in range(0, len(common), 4096):
        grids = []
        for side in (0, 1):
            inside = own[side] & (places[side] >= start) & (places[side] < start + 4096)
            grid = np.zeros((len(sets[side]), min(4096, len(common) - start)), np.float32)
            grid[owners[side][inside], places[side][inside] - start] = 1
            grids.append(grid)
        shared += grids[0] @ grids[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    ga, gb = a["grp"].to_numpy(), b["grp"].to_numpy()
    alike = (100 * shared >= percent * union) & (ga[:, None] != gb[None, :])
    out = []
    for i, j in np.argwhere(alike):
        p, q = top(ga[i]), top(gb[j])
        if p != q:
            group[max(p, q)] = min(p, q)
            out.append((a["id"].iat[i], b["id"].iat[j]))
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: ``(key, n_shingles, component_id, kept)``.

    Documents are linked if ``100 * |intersection| >= percent * |union|``; a component is named by its smallest key. Texts without
    words, nulls included, link with nothing. A repeated key is one document with all its texts. Rows with a null key link with
    nothing: their component is null and they are kept. An empty table gives no rows; further columns don't matter.
    """
    sk = stage(sketches(docs, key, text, percent), "sketches")
    some = sk.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stage(some.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")), "classes")
    copies = some.select("id", "s1", "s2", "n_shingles").join(classes.drop("bands"), ["s1", "s2", "n_shingles"]).filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    members = classes.filter("bands is not null").select("rep", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
    members = stage(members.join(buckets, "bucket"), "members")

    stars = stage(members.filter("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    sets = stage(_sets(docs, key, text, stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()), "sets")
    links = stage(_confirmed(stars, sets, percent), "star-links")
    groups = stage(connected_components(links.union(copies)), "groups")

    named = members.join(groups, members["rep"] == groups["node"], "left").select("bucket", "n", F.col("rep").alias("id"), F.coalesce("component", "rep").alias("grp"))
    open_ones = named.groupBy("bucket").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low != high").select("bucket")
    named = stage(named.join(open_ones, "bucket"), "open-members")
    few = named.filter(F.col("n") <= SMALL)
    x, y = few.select("bucket", F.col("id").alias("a"), F.col("grp").alias("ga")), few.select("bucket", F.col("id").alias("b"), F.col("grp").alias("gb"))
    pairs = x.join(y, "bucket").filter("ga != gb and a > b").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = _confirmed(pairs, sets, percent)

    # Large open buckets: members dealt to blocks by hash; a task gets two blocks of a bucket, or one against itself.
    many = named.filter(F.col("n") > SMALL).withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int"))
    many = many.withColumn("i", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")).join(sets, "id")
    dealt = many.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "id", "grp", "shingles")
    kind = docs.schema[key].dataType.simpleString()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        lo, hi = part["lo"].iat[0], part["hi"].iat[0]
        found = _joins_groups(part[part["i"] == lo], part[part["i"] == hi], percent)
        return pd.DataFrame(found, columns=["a", "b"])

    block_links = dealt.groupBy("bucket", "lo", "hi").applyInPandas(compare, f"a {kind}, b {kind}")
    last = stage(more.union(block_links), "late-links")
    late = connected_components(
        last.join(groups.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(groups.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    ).withColumnsRenamed({"node": "_node", "component": "_late"})
    first = sk.select("id", "n_shingles").join(groups, F.col("id") == F.col("node"), "left").withColumn("_first", F.coalesce("component", "id"))
    final = first.join(late, F.col("_first") == F.col("_node"), "left").withColumn("component_id", F.coalesce("_late", "_first"))
    return final.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
