"""Hard negatives against all inner products, and cover trees against their definition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.llm import negatives
from oreline.llm.negatives import Found, augmented, build_tree, hard_negatives, search

INT, NAN = float("inf"), float("nan")


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain(rows, positives=5, most=10, low=30, high=90, whole=100):
    """All pairs, row by row."""
    rows = [r for r in rows if r[0] is not None and r[2] is not None and fine(r[1])]
    out = []
    for a, (anchor, x, label) in enumerate(rows):
        if anchor % 100:
            continue
        scored = sorted((-float(np.dot(x, y)), i, n, other == label) for n, (i, y, other) in enumerate(rows) if n != a and len(x) == len(y))
        for p, i, _, _ in [s for s in scored if s[3]][:positives]:
            hits = [s for s in scored if not s[3] and low * -p <= whole * -s[0] <= high * -p][:most]
            out += [(anchor, i, rank + 1, s[1], -p, -s[0]) for rank, s in enumerate(hits)]
    return sorted(out)


def checked(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect())
    assert found == plain(rows)
    return found


def vectors(seed, n, d, labels, spread=40):
    draw = np.random.RandomState(seed)
    centres = draw.randint(-60, 60, (7, d))
    return [(i, (centres[i % 7] + draw.randint(-spread, spread + 1, d)).astype(float).tolist(), int(draw.randint(labels))) for i in range(n)]


def test_equals_all_inner_products(spark):
    rows = vectors(1, 900, 6, 4)
    rows += [(1000, None, 1), (1001, [1.0, None] * 3, 1), (1002, [NAN] * 6, 1), (1003, [INT] * 6, 2), (1004, [1.0] * 6, None), (None, [1.0] * 6, 1), (1100, [0.0] * 6, 3), (1200, [5.0, 1.0], 1), (1300, [], 1), (1301, [], 2), (1302, [], 1)]
    assert len(checked(spark, rows)) > 200


def test_ties_copies_and_repeated_rows(spark):
    draw = random.Random(3)
    few = [[1.0, 2.0, 0.0], [2.0, 4.0, 0.0], [1.0, 1.0, 1.0], [3.0, 0.0, 1.0]]
    rows = [(i, draw.choice(few), draw.randrange(3)) for i in range(400)]
    checked(spark, rows + rows[:120])


def test_many_trees_chunks_and_labels(spark, monkeypatch):
    """Parts of any size give the same rows; one label holds most rows, another has too few for five positives."""
    for name, value in (("TREE", 64), ("LEAF", 8), ("ANCHORS", 2), ("GROUPS", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = [(i, v, 0 if i % 3 else label + 1) for i, v, label in vectors(4, 700, 5, 50)]
    checked(spark, [*rows, (5000, [9.0] * 5, 77)])


def test_search_skips_what_is_outside(spark):
    """On clustered rows the search reads a part of the leaves only, and finds what a whole scan finds."""
    x = np.array([v for _, v, _ in vectors(5, 4000, 4, 2, spread=4)])
    tree, order = build_tree(x)
    leaves = sum(c == 0 for c in tree.children)
    ids = rows = order.astype(np.int64)
    labels = np.zeros(len(x), np.int64)
    read = 0
    for q in range(0, 4000, 100):
        anchor = {"row": q, "label": 1, "x": x[q], "low": np.array([2000.0, -INT]), "high": np.array([4000.0, 3000.0])}
        found = Found(2, 10)
        read += search(tree, ids, rows, labels, anchor, x[q] @ tree.x[tree.centre].T, False, 1.0, found)
        scores = x @ x[q]
        for w in range(2):
            inside = np.flatnonzero((scores >= anchor["low"][w]) & (scores <= anchor["high"][w]))
            expected = inside[np.lexsort((inside, -scores[inside]))][:10]
            assert found.rows[w][1].tolist() == expected.tolist()
    assert read < 0.5 * 40 * leaves


@pytest.mark.parametrize("x", [np.zeros((300, 3)), np.random.RandomState(1).randint(-9, 9, (500, 8)).astype(float), np.repeat(np.eye(4), 200, axis=0), np.zeros((0, 2)), np.zeros((5, 0))])
def test_tree_covers(x):
    tree, order = build_tree(x)
    assert sorted(order.tolist()) == list(range(len(x))) and (tree.x == x[order]).all()
    points = augmented(tree.x)
    for node, (start, end, children) in enumerate(zip(tree.start, tree.end, tree.children)):
        far = np.sqrt(((points[start:end] - points[tree.centre[node]]) ** 2).sum(axis=1)).max()
        assert far <= tree.radius[node] + 1e-9
        kids = range(tree.first[node], tree.first[node] + children)
        if children:
            assert [tree.start[k] for k in kids] + [end] == [start] + [tree.end[k] for k in kids]
        else:
            assert end - start <= negatives.LEAF or tree.radius[node] == 0


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")
    assert hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == []
    rows = vectors(8, 300, 4, 3)
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, row int, score double, tree string")
    assert sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 100 == 0).collect()) == plain(rows)


def test_long_vectors(spark):
    checked(spark, vectors(9, 60, 5000, 2))
