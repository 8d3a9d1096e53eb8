"""Class balancing, encoders on untidy values, hazards, longer patterns, Holt's scan and step graphs, each against a plain version."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.operators import features as fe, sequences as sq, series as ts, survival as su
from oreline.operators.neighbours import knn_join
from oreline.plans.steps import OPERATORS, Step, run_steps


@pytest.fixture(scope="module")
def classes(spark):
    draw = random.Random(1)
    sizes = {"a": 40, "b": 20, "c": 15, None: 30}
    rows = [(i, label, draw.gauss(3 * n, 1), draw.gauss(-n, 1)) for n, (label, k) in enumerate(sizes.items()) for i in range(100 * n, 100 * n + k)]
    return spark.createDataFrame(rows, "id bigint, label string, x double, y double")


def sizes(df, where="true"):
    return {r[0]: r[1] for r in df.filter(where).groupBy("label").count().collect()}


def test_three_classes_and_rows_without_a_label(classes):
    """Every smaller class is filled from its own neighbours; rows without a label stay as they are in all five ways."""
    grown = fe.smote(classes, "label", "id", ["x", "y"], 5).cache()
    assert sizes(grown, "not synthetic") == sizes(classes)
    made = sizes(grown, "synthetic")
    assert set(made) == {"b", "c"} and 15 <= made["b"] <= 25 and 19 <= made["c"] <= 31
    box = {r.label: r for r in classes.groupBy("label").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    assert all(box[r.label].lo <= r.x <= box[r.label].hi for r in grown.filter("synthetic").collect())
    cleaned = fe.smoteenn(classes, "label", "id", ["x", "y"], 5)
    assert sizes(cleaned)["a"] <= 40 and set(sizes(cleaned, "synthetic")) <= {"b", "c"}
    over, under = sizes(fe.random_over(classes, "label", "id")), sizes(fe.random_under(classes, "label", "id"))
    assert over["a"] == 40 and over["b"] == 40 and 35 <= over["c"] <= 45 and over[None] == 30
    assert under["c"] == 15 and 10 <= under["a"] <= 22 and under[None] == 30
    weights = {r.label: r.weight for r in fe.class_weights(classes, "label").select("label", "weight").distinct().collect()}
    assert weights == {"a": 75 / (3 * 40), "b": 75 / (3 * 20), "c": 75 / (3 * 15), None: None}


def test_blanks_around_a_category(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (2, " A", 0.0), (3, "B ", 4.0), (4, "A", 2.0), (5, " ", 9.0), (6, None, 9.0)], "id int, c string, y double")
    rows = lambda d, n: [r[n] for r in d.orderBy("id").collect()]
    assert rows(fe.ordinal_encode(df, "c", ["A ", "B"]), "c_ord") == [0, 0, 1, 0, None, None]
    assert rows(fe.target_encode(df, "c", "y"), "c_te") == [1.0, 1.0, 4.0, 1.0, None, None]
    assert rows(fe.frequency_encode(df, "c"), "c_freq") == [0.5, 0.5, 1 / 6, 0.5, None, None]


def test_no_training_rows_no_neighbours(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id bigint, x double")
    none = knn_join(df, df.filter("id > 5"), "id", ["x"], 3)
    assert none.collect() == [] and set(none.columns) == set(knn_join(df, df, "id", ["x"], 1).columns)


def plain_cox(rows, rounds=40):
    """Efron's partial likelihood, time by time and failure by failure."""
    t, e, x = (np.array(v, float) for v in zip(*[(r[0], r[1], r[2:]) for r in rows]))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        slope, info = np.zeros(len(beta)), np.zeros((len(beta),) * 2)
        w = np.exp(x @ beta)
        for at in np.unique(t[e == 1]):
            risk, dead = t >= at, (t == at) & (e == 1)
            for n in range(dead.sum()):
                v = np.where(risk, w, 0) - n / dead.sum() * np.where(dead, w, 0)
                mean = (v[:, None] * x).sum(axis=0) / v.sum()
                info += (v[:, None, None] * x[:, :, None] * x[:, None, :]).sum(axis=0) / v.sum() - np.outer(mean, mean)
                slope -= mean
            slope += x[dead].sum(axis=0)
        beta = beta + np.linalg.solve(info, slope)
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def test_hazards_equal_the_plain_likelihood(spark, monkeypatch):
    """Rows with many ties, one time with a third of the failures, blocks of ties smaller than that."""
    monkeypatch.setattr(su, "TIES", 4)
    draw = random.Random(3)
    rows = []
    for i in range(240):
        x, z = draw.gauss(0, 1), draw.randrange(3)
        time_ = 7 if i % 3 == 0 else 1 + int(draw.expovariate(0.12 * math.exp(0.7 * x - 0.4 * z)))
        rows.append((time_, int(draw.random() < 0.7), 100 * x + 5, float(z)))
    df = spark.createDataFrame(rows + [(None, 1, 1.0, 1.0), (3, 1, None, 1.0)], "t int, e int, x double, z double").withColumn("flat", F.lit(2.0))
    found = {r.feature: r for r in su.cox_regression(df, "t", "e", ["x", "z", "flat"]).collect()}
    beta, errors = plain_cox(rows)
    for name, b, s in zip("xz", beta, errors):
        r = found[name]
        assert (r.coefficient, r.std_error, r.hazard_ratio) == pytest.approx((b, s, math.exp(b)), rel=1e-6)
        assert (r.lower, r.upper) == pytest.approx((math.exp(b - 1.959963985 * s), math.exp(b + 1.959963985 * s)), rel=1e-6)
        assert r.p_value == pytest.approx(math.erfc(abs(b / s) / math.sqrt(2)))
    assert found["flat"].coefficient is None
    with pytest.raises(ValueError, match="no failures"):
        su.cox_regression(df.filter("e = 0"), "t", "e", ["x"])
    with pytest.raises(ValueError, match="determine each other"):
        su.cox_regression(df.withColumn("x2", F.lit(0.0) + F.col("z")), "t", "e", ["z", "x2"])


def plain_patterns(rows, share, longest):
    held = {}
    for g, at, item in sorted(rows, key=lambda r: (r[0], r[1])):
        held.setdefault(g, []).append(item)
    long = [s for s in held.values() if len(s) >= 2]
    least, counts = max(2, math.ceil(share * len(long))), Counter()
    items = sorted({i for s in long for i in s})

    def within(pattern, s):
        rest = iter(s)
        return all(p in rest for p in pattern)

    front = [(i,) for i in items]
    for _ in range(2, longest + 1):
        grown = {p + (i,): sum(within(p + (i,), s) for s in long) for p in front for i in items}
        front = [p for p, n in grown.items() if n >= least]
        counts.update({p: grown[p] for p in front})
    return counts, len(long)


def test_longer_patterns(spark, monkeypatch):
    """Length 4 and more, one sequence that holds most rows, and places cut into short runs."""
    monkeypatch.setattr(sq, "PLACES", 3)
    draw = random.Random(5)
    rows = [(f"g{draw.randrange(12)}", n, draw.choice("abcd")) for n in range(90)] + [("hot", 1000 + n, draw.choice("abcde")) for n in range(200)]
    df = spark.createDataFrame(rows, "g string, at int, item string")
    expected, n = plain_patterns(rows, 0.4, 5)
    assert max(map(len, expected)) >= 4
    found = sq.sequence_patterns(df, "g", "item", "at", 0.4, 5).collect()
    assert {tuple(r["pattern"]): r["count"] for r in found} == dict(expected)
    assert all(r["size"] == len(r["pattern"]) and r["support"] == round(r["count"] / n, 4) for r in found)
    pairs = sorted(((-c, " → ".join(p)) for p, c in expected.items() if len(p) == 2))[:15]
    assert [(-r["count"], r["pattern"]) for r in sq.top_pairs(df, "g", "item", "at", 0.4).collect()] == pairs
    assert sq.sequence_patterns(df.limit(0), "g", "item", "at").collect() == []


def test_holt_equals_the_loop(spark):
    """Series longer than a chunk, as long as one, and of one and two values."""
    draw = random.Random(7)
    rows = [(name, i, draw.gauss(0, 1) + i * 0.1) for name, n in (("long", 1000), ("even", 128), ("one", 1), ("two", 2), ("odd", 65)) for i in range(n)]
    found = {(r.series, r.position): r for r in ts.holt(spark.createDataFrame(rows, "series string, position bigint, value double"), 0.4, 0.15, 64).collect()}
    assert len(found) == len(rows)
    for name, group in itertools.groupby(rows, lambda r: r[0]):
        v = [r[2] for r in group]
        level, slope, fit = v[0], v[1] - v[0] if len(v) > 1 else 0.0, v[0]
        for i, x in enumerate(v):
            if i:
                last, level = level, 0.4 * x + 0.6 * (level + slope)
                slope = 0.15 * (level - last) + 0.85 * slope
                fit = last + slope
            r = found[name, i]
            assert (r.fitted, r.level, r.slope) == pytest.approx((fit, level, slope), rel=1e-9, abs=1e-9)


def test_step_graph(spark):
    """A diamond with a union and a join, and tables that a step can't take."""
    steps = [Step("low", "filter", {"condition": "id < 10"}), Step("high", "filter", {"condition": "id >= 40"}), Step("both", "union"), Step("named", "rename", {"names": {"x": "z"}}), Step("met", "join", {"on": "id"}), Step("odd", "sort", {"columns": ["id"]})]
    edges = [("low", "both"), ("high", "both"), ("low", "named"), ("both", "met"), ("named", "met"), ("low", "odd"), ("high", "odd")]
    run = run_steps(spark.range(50).withColumn("x", F.col("id") * 2), steps, edges)
    assert sorted(tuple(r) for r in run.outputs["met"].collect()) == [(i, 2 * i, 2 * i) for i in range(10)]
    log = {r.step: r for r in run.log.collect()}
    assert (log["both"].rows_in, log["both"].rows_out, log["met"].rows_in) == (20, 20, 30) and log["met"].added == []
    assert log["odd"].status == "failed" and "takes one table" in log["odd"].error


def test_branches_run_at_once_and_fail_alone(spark):
    seen = {}

    def slow(df, name):
        seen[name] = [time.time()]
        time.sleep(2)
        seen[name].append(time.time())
        return df

    OPERATORS["slow"] = slow
    OPERATORS["stuck"] = lambda df: df.filter(F.expr("java_method('java.lang.Thread', 'sleep', 60000L) is null or id >= 0"))
    try:
        steps = [Step("a", "slow", {"name": "a"}), Step("b", "slow", {"name": "b"}), Step("c", "no such step"), Step("d", "stuck", timeout=3), Step("e", "sort", {"columns": ["id"]}), Step("f", "union")]
        run = run_steps(spark.range(8), steps, [("c", "e"), ("a", "f"), ("b", "f")])
    finally:
        del OPERATORS["slow"], OPERATORS["stuck"]
    assert max(seen["a"][0], seen["b"][0]) < min(seen["a"][1], seen["b"][1])
    assert {r.step: r.status for r in run.log.collect()} == {"a": "success", "b": "success", "c": "failed", "d": "timeout", "e": "skipped", "f": "success"}
    assert run.outputs["f"].count() == 16
