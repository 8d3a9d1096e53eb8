import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.operators import clustering as cl, evaluation as ev, explain as ex, learning as ml, neighbours as nn

FEATURES = ["renda", "idade", "emprestimo", "regiao"]


def test_encoding(class_rows):
    enc = ml.encode(class_rows, "diagnostico", "classification")
    assert "renda" in enc.names and "id" not in enc.columns and enc.classes == ["0", "1"]
    assert {"regiao=S", "regiao=N", "regiao=L"} <= set(enc.names)


def test_leaderboards(class_rows, reg_rows):
    board = ml.train_leaderboard(class_rows, "diagnostico", "classification", "id", ["logistic", "tree", "forest", "knn"], columns=FEATURES).collect()
    assert [r["rank"] for r in board] == [1, 2, 3, 4] and board[0].accuracy > 0.8
    assert [r.f1 for r in board] == sorted((r.f1 for r in board), reverse=True)
    assert all(0 <= r.accuracy <= 1 and 0 <= r.f1 <= 1 for r in board)
    reg = ml.train_leaderboard(reg_rows, "zona", "regression", "id", ["linear", "ridge", "boosting"], columns=["x1", "x2"]).collect()
    assert reg[0].r2 > 0.9
    with pytest.raises(ValueError):
        ml.train_leaderboard(class_rows.limit(5), "diagnostico", "classification", "id", ["tree"])


def test_probabilities_and_explanations(class_rows):
    model = ml.fit(class_rows, "diagnostico", "classification", "random forest", FEATURES)
    out = ml.predict_with_probability(model, class_rows).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-6 for r in out)
    imp = ex.permutation_importance(model, class_rows, "id").orderBy(F.desc("importance")).collect()
    assert imp[0].feature == "renda"
    pdp = ex.partial_dependence(model, class_rows, "renda").orderBy("x").collect()
    assert len(pdp) == 20 and pdp[-1].y > pdp[0].y
    shap = ex.shap_values(model, class_rows, "id", 6)
    total = shap.groupBy("id").agg(F.sum("shap").alias("s"))
    assert total.count() == 300 and shap.select("feature").distinct().count() == 4
    assert ex.local_contribution(model, class_rows, "id").count() == 1200


def test_shapley_of_a_linear_model(reg_rows):
    """For a linear model the values are slope * (x - mean of the background), summing to the difference of scores."""
    model = ml.fit(reg_rows, "zona", "regression", "linear", ["x1", "x2"])
    s = {(r.id, r.feature): r.shap for r in ex.shap_values(model, reg_rows, "id", 64).collect()}
    for r in reg_rows.limit(20).collect():
        assert s[(r.id, "x1")] == pytest.approx(2 * (r.x1 - 5), abs=3.5) and s[(r.id, "x2")] == pytest.approx(3 * (r.x2 - 5), abs=5)


def test_search_and_validation(class_rows):
    found = ml.hyper_search(class_rows, "diagnostico", "classification", "id", "decision_tree", 3, 2, FEATURES).collect()
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True) and any(r.params == "{}" for r in found)
    cv = ml.cross_validate(class_rows, "diagnostico", "classification", "id", "tree", 3, FEATURES).first()
    assert cv.folds == 3 and cv.accuracy_mean > 0.8


def test_score_a_new_table(class_rows):
    model = ml.fit(class_rows, "diagnostico", "classification", "tree", FEATURES)
    new = class_rows.drop("diagnostico").limit(7)
    assert ml.batch_score(model, new).filter("predicao_diagnostico in ('0', '1')").count() == 7


def test_auc_and_fairness(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.1)], "y int, s double")
    assert ev.auc_exact(df, "y", "s").first().auc == pytest.approx(5 / 6)
    g = spark.createDataFrame([("F", "1", "1")] * 6 + [("M", "1", "0")] * 6, "g string, y string, p string")
    f = ev.fairness(g, "y", "p", "g", "1").collect()
    assert len(f) == 2 and f[0].disparate_impact == 0.0 and not f[0].fair and f[0].accuracy_gap == 1.0


def points(spark, n, dims, seed, hot=0):
    r = np.random.default_rng(seed)
    x = np.vstack([r.normal(c, 0.6, (n // 3, dims)) for c in (0, 4, 9)] + [r.uniform(-3, 12, (n // 6, dims))])
    if hot:
        x = np.vstack([x, np.tile(x[0], (hot, 1))])
    cols = [f"x{i}" for i in range(dims)]
    return x, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id bigint, " + ", ".join(f"{c} double" for c in cols)), cols


def test_knn_against_brute_force(spark):
    x, df, cols = points(spark, 240, 3, 1, hot=80)
    got = {}
    for r in nn.knn_join(df, df, "id", cols, 4, skip_same_key=True, pivots=8, block=32).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.neighbour_id
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == order


def brute_dbscan(x, eps, least):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = (d <= eps) & ~np.eye(n, dtype=bool)
    core = near.sum(axis=1) >= least
    label, c = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = c
            while stack:
                p = stack.pop()
                for q in np.nonzero(near[p] & core)[0]:
                    if label[q] < 0:
                        label[q] = c
                        stack.append(q)
            c += 1
    for i in range(n):
        if not core[i]:
            touch = [label[q] for q in np.nonzero(near[i] & core)[0]]
            label[i] = min(touch) if touch else -1
    return label


@pytest.mark.parametrize("dims,eps,least,seed", [(2, 0.5, 5, 2), (3, 0.9, 4, 3), (2, 0.25, 3, 4)])
def test_dbscan_against_brute_force(spark, dims, eps, least, seed):
    x, df, cols = points(spark, 300, dims, seed, hot=60)
    got = {r.id: r.cluster for r in cl.dbscan(df, "id", cols, eps, least).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, eps, least)


@pytest.mark.parametrize("block", [4, 2048])
def test_range_join(spark, block):
    """A cell that holds a third of the rows is cut; every pair comes once."""
    x, df, cols = points(spark, 90, 2, 5, hot=40)
    got = [(r.a, r.b) for r in nn.eps_range_join(df, "id", cols, 0.7, block).collect()]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 0.7}


def test_range_join_keeps_its_partitions(spark):
    """Few bytes make many pairs: the join is not put together into one task."""
    x, df, cols = points(spark, 90, 2, 5)
    assert nn.eps_range_join(df, "id", cols, 0.7).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_dbscan_in_small_blocks(spark):
    x, df, cols = points(spark, 300, 2, 8, hot=150)
    got = {r.id: r.cluster for r in cl.dbscan(df, "id", cols, 0.5, 5, block=3).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, 0.5, 5)


def test_clusters(reg_rows, spark):
    sizes = cl.kmeans_summary(reg_rows, 3, ["x1", "x2"]).collect()
    assert sum(r["size"] for r in sizes) == 200
    x, df, cols = points(spark, 300, 2, 6)
    scan = {r.k: r for r in cl.k_scan(df, cols, range(2, 5)).collect()}
    assert scan[3].silhouette > 0.5 and [k for k, r in scan.items() if r.optimal] == [max(scan, key=lambda k: scan[k].silhouette)]
    curve = cl.pca_variance_curve(df, cols, 2).orderBy("component").collect()
    assert curve[-1].cumulative == pytest.approx(1.0) and sum(r.reaches for r in curve) == 1
    scores, _ = cl.pca(df, cols, 2)
    box = scores.agg(F.min("pc1"), F.max("pc1")).first()
    assert box[0] == pytest.approx(-5) and box[1] == pytest.approx(5)


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (51, 52)]
    e = spark.createDataFrame(chain + [(b, a) for a, b in chain], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in list(range(41)) + [50, 51, 52, 60]], "node bigint")
    got = {r.node: r.root for r in cl.connected(e, nodes).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50, 52: 50, 60: 60}


def test_anomalies(spark):
    x, df, cols = points(spark, 300, 2, 7)
    for method in ("zscore", "iqr", "centre", "knn"):
        s = cl.anomaly_summary(cl.anomaly_scores(df, "id", cols, method, 0.1)).first()
        assert s["rows"] == len(x) and s.anomalies >= math.floor(0.1 * len(x))


@pytest.mark.parametrize("dims,pivots", [(2, 4), (3, None)])
def test_knn_in_a_deep_tree(spark, dims, pivots):
    """Several levels, a crowd of near points and one of equal points, ids that are texts, queries that are no training rows."""
    x, _, _ = points(spark, 1200, dims, 9, hot=70)
    x = np.vstack([x, x[0] + np.random.default_rng(10).normal(0, 1e-3, (500, dims))])
    cols = [f"x{i}" for i in range(dims)]
    kind = "id string, " + ", ".join(f"{c} double" for c in cols)
    df = spark.createDataFrame([(f"{i:05}", *map(float, p)) for i, p in enumerate(x)], kind)
    asked = x[::17] + 0.05
    q = spark.createDataFrame([(f"q{i}", *map(float, p)) for i, p in enumerate(asked)], kind)
    placed, levels = nn._grown(df.select("id", F.array(*cols).alias("v")), pivots, 80, 40)
    assert len(levels) > 1 and placed.count() == len(x) and placed.groupBy("node").count().agg(F.max("count")).first()[0] <= 80
    got = {}
    for r in nn.knn_join(q, df, "id", cols, 3, pivots=pivots, block=40).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = int(r.neighbour_id)
    for i, p in enumerate(asked):
        d = np.zeros(len(x))
        for j in range(dims):
            d += (x[:, j] - p[j]) ** 2
        assert [got[f"q{i}"][n] for n in (1, 2, 3)] == list(np.lexsort((np.arange(len(x)), d))[:3])


def brute_knn(x, asked, k):
    for p in asked:
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[:, j] - p[j]) ** 2
        yield list(np.lexsort((np.arange(len(x)), d))[:k])


@pytest.mark.parametrize("pivots", [8, None])
def test_knn_with_ties_and_endless_numbers(spark, pivots):
    """Many rows at the same distance, rows far from 0, and infinite coordinates, through the tree and without it."""
    r = np.random.default_rng(11)
    x = np.vstack([r.integers(0, 6, (900, 3)).astype(float), 1e7 + r.integers(0, 3, (300, 3)) / 8])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows + [(5000, [math.inf, 0.0, 0.0])], "id bigint, v array<double>")
    got = {}
    for r in nn.knn_join(df.filter("id % 7 = 0 AND id < 5000"), df, "id", "v", 4, pivots=pivots, block=64).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.neighbour_id
    for i, best in zip(range(0, len(x), 7), brute_knn(x, x[::7], 9)):
        assert [got[i][n] for n in (1, 2, 3, 4)] == [b for b in best if b < 5000][:4]


def test_knn_visits_few_leaves(spark):
    """A query's own leaf says how near its neighbours are, so that in three columns few other leaves are visited."""
    x = np.random.default_rng(12).random((4000, 3))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, v array<double>")
    q = df.select(F.col("id").alias("query_id"), "v")
    assert nn._prunes(df, q, 5)
    placed, levels = nn._grown(df, None, 100, 100)
    visits = nn._visited(nn._bounded(q, placed, levels, 5, 100), levels, 5, 100)
    assert visits.count() <= 6 * len(x)
    wide = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(np.random.default_rng(13).normal(size=(2000, 40)))], "id bigint, v array<double>")
    assert not nn._prunes(wide, wide.select(F.col("id").alias("query_id"), "v"), 5)


@pytest.mark.parametrize("block", [70, None])
def test_distances_to_clusters(spark, block):
    """Far from 0, with copies; every meeting is a matrix product and no loop over coordinates."""
    r = np.random.default_rng(14)
    x = 1000 + np.vstack([r.normal(0, 1, (250, 5)), np.repeat(r.normal(3, 1, (10, 5)), 5, axis=0)])
    own = np.arange(len(x)) % 3
    df = spark.createDataFrame([(i, int(c), [float(v) for v in p]) for i, (c, p) in enumerate(zip(own, x))], "id bigint, c int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    seen = {(r.id, r.cluster): (r.total, r.n, r.own) for r in nn.cluster_distances(df, "id", "v", "c", block).collect()}
    assert len(seen) == 3 * len(x)
    for (i, c), (total, n, mine) in seen.items():
        assert total == pytest.approx(d[i, own == c].sum(), abs=1e-9) and n == (own == c).sum() and mine == own[i]


def test_products_move_no_loop_over_rows():
    """A block of 64 numbers a row meets its queries in a moment."""
    r = np.random.default_rng(15)
    a, b = r.normal(size=(1500, 64)), r.normal(size=(6000, 64))
    i, j, d = nn._nearest(a, b, 5, np.full(len(a), np.inf))
    assert len(i) == 5 * len(a)
    for n in (0, 700, 1499):
        assert list(j[i == n]) == next(brute_knn(b, a[n : n + 1], 5))


def test_compared_models_encode_once(class_rows, monkeypatch):
    """The measures of models compared at once are those of each alone, from one encoding."""
    names = ["logistic", "tree"]
    alone = {n: ev.class_metrics(ml.evaluate_holdout(class_rows, "diagnostico", "classification", "id", n, 75, FEATURES), "label", "prediction").first() for n in names}
    calls, encode = [], ml.encode
    monkeypatch.setattr(ml, "encode", lambda *a, **k: (calls.append(1), encode(*a, **k))[1])
    both = {r.model: r for r in ml.compare_models(class_rows, "diagnostico", "classification", "id", names, columns=FEATURES).collect()}
    assert len(calls) == 1
    for n in names:
        assert both[n].n == alone[n].n and both[n].accuracy == pytest.approx(alone[n].accuracy, abs=0.02) and 0.5 < both[n].auc <= 1


def test_knn_asks_once_per_place(spark, monkeypatch):
    """Many queries at few places: a place goes through the tree once, and every query gets its neighbours, repeated ids too."""
    x = np.random.default_rng(16).integers(0, 7, (900, 3)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, v array<double>")
    q = df.filter("id < 400").unionByName(df.filter("id = 3")).unionByName(df.filter("id = 5").withColumn("id", F.lit(None).cast("bigint")))
    seen, bounded = [], nn._bounded
    monkeypatch.setattr(nn, "FEW_PAIRS", 0)
    monkeypatch.setattr(nn, "_prunes", lambda *a: True)
    monkeypatch.setattr(nn, "_bounded", lambda q, *a: (seen.append(q.count()), bounded(q, *a))[1])
    some = q.filter("id IS NULL OR id < 40")
    rows = nn.knn_join(some, df, "id", "v", 4, skip_same_key=True, block=64).collect()
    monkeypatch.setattr(nn, "FEW_PAIRS", 1 << 28)
    few = nn.knn_join(some, df, "id", "v", 4, skip_same_key=True).collect()
    assert sorted(map(str, rows)) == sorted(map(str, few))
    monkeypatch.setattr(nn, "FEW_PAIRS", 0)
    seen.clear()
    got = {}
    for r in nn.knn_join(df.unionByName(df.withColumn("id", F.col("id") + 1000)), df, "id", "v", 4, block=64).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.neighbour_id
    assert seen == [len(np.unique(x, axis=0))] and len(got) == 2 * len(x)
    for i, best in enumerate(brute_knn(x, x, 4)):
        assert [got[i][n] for n in (1, 2, 3, 4)] == best == [got[i + 1000][n] for n in (1, 2, 3, 4)]


def test_leaves_are_not_tiny(spark):
    """A node a little larger than a leaf gets a few children and not the root of its rows."""
    x = np.random.default_rng(17).random((3000, 3))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, v array<double>")
    placed, _ = nn._grown(df, None, 2000, 2000)
    assert placed.count() == len(x) and placed.select("node").distinct().count() <= 12


def test_closest_pivots_are_exact():
    """Also far from 0, between equal pivots (the first counts), and with endless numbers, where products tell nothing."""
    r = np.random.default_rng(18)
    a, b = r.normal(size=(500, 9)), r.normal(size=(60, 9))
    for x, y in ((a, b), (a + 1e7, b + 1e7), (a, np.vstack([b, b])), (a.round(), b.round()), (np.where(a > 2, np.inf, a), b)):
        with np.errstate(invalid="ignore"):
            d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        slot, away = nn._closest(x, y)
        plain = np.sqrt(nn._between(x, y))
        assert list(slot) == list(np.where(np.isnan(plain), np.inf, plain).argmin(axis=1)) and np.allclose(away, d[np.arange(len(x)), slot], equal_nan=True)


def test_leaderboard_makes_its_rows_once(reg_rows, spark, monkeypatch):
    """A costly input is computed for one written table, not again for every pass over it."""
    read, encode = [], ml.encode
    monkeypatch.setattr(ml, "encode", lambda df, *a, **k: (read.append(df.inputFiles()), encode(df, *a, **k))[1])
    board = ml.train_leaderboard(reg_rows, "zona", "regression", "id", ["linear", "knn"], columns=["x1", "x2"]).collect()
    assert read[0] and "leaderboard" in read[0][0] and [r["rank"] for r in board] == [1, 2]


def test_range_join_moves_few_copies(spark, monkeypatch):
    """Cells of a few thousand rows are not cut, as every cut moves more copies; the written result has every pair once."""
    moved, join = [], nn.cell_join
    monkeypatch.setattr(nn, "cell_join", lambda visits, held, crowded, *a: (moved.append(crowded.count()), join(visits, held, crowded, *a))[1])
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 100 / 1000).alias("x"), (F.col("id") * 10 / 1000).alias("y"))
    near = nn.eps_range_join(df, "id", ["x", "y"], 40.0)
    assert near.count() == near.select("a", "b").distinct().count() == 3000 * 2999 // 2 and moved == [0]
