import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.operators import explain as ex, learning as ml, selection_of_features as sf

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def priced(spark):
    draw = np.random.default_rng(3)
    rows = [(f"k{i}", float(a), float(b), "xyz"[c]) for i, (a, b, c) in enumerate(zip(draw.normal(5, 2, 20_000), draw.uniform(0, 9, 20_000), draw.integers(0, 3, 20_000)))]
    rows = [(*r, 3 * r[1] + r[2] * "xyz".index(r[3])) for r in rows]
    return rows, spark.createDataFrame(rows, "id string, a double, b double, c string, y double").repartition(7)


@pytest.fixture(scope="module")
def tree(priced):
    return ml.fit(priced[1], "y", "regression", "tree", COLUMNS)


def no_copies(*_):
    raise AssertionError("a row per changed copy went through the model")


def test_blocks_score_as_the_model(priced, tree):
    rows = tree.encoding.apply(priced[1]).limit(3000)
    found = tree.model.transform(rows).select("features", "prediction").collect()
    assert tree.on_blocks()(np.array([r.features.toArray() for r in found])).tolist() == [r.prediction for r in found]
    assert ml.fit(priced[1], "y", "regression", "linear", COLUMNS).on_blocks() is None
    assert ml.tree_on_blocks("a tree\n  If (feature 0 in {1.0})\n   Predict: 1.0\n  Else (feature 0 not in {1.0})\n   Predict: 2.0") is None


@pytest.mark.parametrize("repeats", [1, 3])  # one row ahead in three chunks, or 15,839 in a single one
def test_importance_by_shifts(spark, priced, tree, monkeypatch, repeats):
    """Shifted columns scored by the model one by one, in NumPy order, give the same drops."""
    rows = sorted(priced[0], key=lambda r: hashlib.md5(r[0].encode()).hexdigest())
    variants = [("", rows)]
    for c in range(3):
        for r in range(repeats):
            step = 1 + r * 7919
            variants.append((COLUMNS[c], [tuple(o[i] if i == c + 1 else x for i, x in enumerate(row)) for row, o in zip(rows, rows[step:] + rows[:step])]))
    flat = [(i, *row) for i, (_, changed) in enumerate(variants) for row in changed]
    scored = tree.score(spark.createDataFrame(flat, "v int, id string, a double, b double, c string, y double"))
    y = np.array([r[4] for r in rows])
    lost = {r.v: 1 - r.e / ((y - y.mean()) ** 2).sum() for r in scored.groupBy("v").agg(F.sum(F.pow(F.col("y") - F.col("prediction"), 2)).alias("e")).collect()}
    monkeypatch.setattr(ml.Fitted, "score", no_copies)
    found = {r.feature: r for r in ex.permutation_importance(tree, priced[1], "id", repeats).collect()}
    assert set(found) == set(COLUMNS)
    for c in COLUMNS:
        drop = round(lost[0], 4) - np.mean([round(lost[i], 4) for i, (f, _) in enumerate(variants) if f == c])
        assert found[c].importance == pytest.approx(drop, abs=2e-4) and found[c].baseline == pytest.approx(lost[0], abs=1e-4)


def test_importance_of_few_rows(priced, spark):
    few = priced[1].filter("id in ('k1', 'k2', 'k3')").unionByName(spark.createDataFrame([(None, 1.0, 2.0, "x", 3.0)], priced[1].schema))
    for kind in ("tree", "linear"):
        model = ml.fit(priced[1], "y", "regression", kind, COLUMNS)
        for rows in (few, few.limit(1)):
            assert ex.permutation_importance(model, rows, "id").count() == 3


def test_chunks_of_a_ring():
    counts = [(f"{i:04x}", 700 + i % 5) for i in range(200)]
    where, start = {}, 0
    for b, n in counts:
        where[b], start = (start, n), start + n
    for reach in (1, 900, 5000):
        chunks = {}
        for b, c, turn in ex._ring_chunks(counts, reach):
            chunks.setdefault(c, []).append((turn, b))
        assert sorted(b for c in chunks.values() for t, b in c if t == 0) == [b for b, _ in counts]
        for rows in chunks.values():
            rows.sort()
            at = [where[b] for _, b in rows]
            assert all((p + n) % start == q for (p, n), (q, _) in zip(at, at[1:]))  # nothing is left out between
            assert sum(where[b][1] for t, b in rows if t) >= reach


@pytest.mark.parametrize("feature", ["a", "c"])
def test_dependence_by_one_scoring_per_grid_value(priced, tree, monkeypatch, feature):
    df = priced[1]
    ends = df.agg(F.min("a").alias("lo"), F.max("a").alias("hi")).first()
    grid = "xyz" if feature == "c" else [round(ends.lo + (ends.hi - ends.lo) * i / 4, 4) for i in range(5)]
    wanted = {x: tree.score(df.withColumn(feature, F.lit(x))).agg(F.avg("prediction")).first()[0] for x in grid}
    monkeypatch.setattr(ml.Fitted, "score", no_copies)
    found = {r.x: r.y for r in ex.partial_dependence(tree, df, feature, 5).collect()}
    assert found.keys() == wanted.keys() and all(found[x] == pytest.approx(wanted[x], abs=6e-5) for x in grid)
    assert ex.partial_dependence(tree, df.withColumn("a", F.col("a").cast("float")), "a", 5).count() == 5


def test_selection_measures_inflation_in_one_pass(spark, monkeypatch):
    """As R² of a least-squares fit on the others, beside a number without spread and one that repeats another; an incomplete row is left out."""
    draw = np.random.default_rng(5)
    a, b = draw.normal(0, 1, 500), draw.normal(4, 2, 500)
    c = a + 0.3 * b + draw.normal(0, 0.5, 500)
    rows = [(*map(float, r), 7.0, float(2 * r[0] + r[1])) for r in zip(a, b, c)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 7.0, 1.0)], "a double, b double, c double, d double, y double")
    found = {r.feature: r.vif for r in sf.select_features(df, "y", "regression", ["a", "b", "c", "d"]).collect()}
    x = np.column_stack([a, b, c])
    for i, name in enumerate("abc"):
        others = np.column_stack([np.delete(x, i, 1), np.ones(500)])
        lost = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert found[name] == pytest.approx(x[:, i].var() / lost.var(), abs=1e-3)
    assert sf.inflation(df.withColumn("e", F.col("a") * 3), ["a", "e"])["a"] > 1e6
