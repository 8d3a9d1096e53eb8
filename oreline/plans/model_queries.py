"""Models, evaluation, explanation and clusters."""

from pyspark.sql import functions as F

from oreline.operators import clustering as cl, evaluation as ev, explain as ex, features as fe, learning as ml, neighbours as nn
from oreline.plans.catalog import query
from oreline.session import scratch_path, stage
from oreline.sources.models import load_model, save_model

# --- measures of a prediction table: returned lines scored by quantity -------------------------------


def scored(t):
    """Every line item with y = returned, a score from its quantity, and a prediction at .6."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_quantity") / 50).alias("score"), F.when(F.col("l_quantity") > 30, "R").when(F.col("l_quantity") > 15, "A").otherwise("N").alias("said"),
    )


SCORED = """(SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, (l_returnflag = 'R')::INT AS y, l_quantity / 50 AS score,
  CASE WHEN l_quantity > 30 THEN 'R' WHEN l_quantity > 15 THEN 'A' ELSE 'N' END AS said FROM lineitem)"""
REPORT = f"""(SELECT label, support, tp, tp / coalesce(nullif(predicted, 0), 1) AS precision, tp / support AS recall,
   coalesce(2 * (tp / predicted) * (tp / support) / nullif(tp / predicted + tp / support, 0), 0) AS f1
  FROM (SELECT l_returnflag AS label, count(*) AS support, count_if(l_returnflag = said)::BIGINT AS tp FROM {SCORED} GROUP BY 1)
  JOIN (SELECT said AS label, count(*) AS predicted FROM {SCORED} GROUP BY 1) USING (label))"""


@query("confusion_matrix", f"SELECT l_returnflag AS label, said AS prediction, count(*) AS n FROM {SCORED} GROUP BY 1, 2")
def confusion(t):
    return ev.confusion(scored(t), "l_returnflag", "said")


@query("class_report", f"SELECT label, support, tp, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM {REPORT}")
def class_report(t):
    return ev.class_report(scored(t), "l_returnflag", "said").withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


@query(
    "class_metrics",
    f"SELECT round(sum(tp) / sum(support), 4) AS accuracy, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, sum(support)::BIGINT AS n FROM {REPORT}",
)
def class_metrics(t):
    return ev.class_metrics(scored(t), "l_returnflag", "said")


@query(
    "reg_metrics",
    """WITH d AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
       SELECT round(1 - sum((y - p) ^ 2) / (var_pop(y) * count(*)), 4) AS r2, round(sqrt(avg((y - p) ^ 2)), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae,
              round(100 * avg(CASE WHEN y = 0 THEN 0 ELSE abs((y - p) / y) END), 3) AS mape, count(*) AS n FROM d""",
)
def reg_metrics(t):
    return ev.reg_metrics(t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")), "y", "p")


@query(
    "confusion_at_threshold",
    f"""WITH c AS (SELECT l_linestatus, count_if(y = 1 AND score >= 0.35)::BIGINT AS tp, count_if(y = 0 AND score >= 0.35)::BIGINT AS fp,
                          count_if(y = 0 AND score < 0.35)::BIGINT AS tn, count_if(y = 1 AND score < 0.35)::BIGINT AS fn FROM {SCORED} GROUP BY 1)
        SELECT *, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
               round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""",
)
def confusion_threshold(t):
    return ev.confusion_at_threshold(scored(t), "y", "score", 0.35, "l_linestatus")


CURVE = f"""(WITH s AS (SELECT y, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM {SCORED}), t AS (SELECT unnest(range(21)) / 20 AS threshold)
 SELECT threshold, count_if(y = 0 AND s >= threshold) / count_if(y = 0) AS fpr, count_if(y = 1 AND s >= threshold) / count_if(y = 1) AS tpr,
        coalesce(count_if(y = 1 AND s >= threshold) / nullif(count_if(s >= threshold), 0), 1) AS precision FROM s, t GROUP BY 1)"""


@query("roc_pr_curve", f"SELECT threshold, round(fpr, 4) AS fpr, round(tpr, 4) AS tpr, round(precision, 4) AS precision FROM {CURVE}")
def roc(t):
    return ev.roc_pr_curve(scored(t), "y", "score").select("threshold", *[F.round(c, 4).alias(c) for c in ("fpr", "tpr", "precision")])


@query(
    "auc",
    f"SELECT round(abs(sum((fpr - pf) * (tpr + pt) / 2)), 3) AS auc FROM (SELECT *, lag(fpr) OVER (ORDER BY fpr, tpr) AS pf, lag(tpr) OVER (ORDER BY fpr, tpr) AS pt FROM {CURVE})",
)
def auc(t):
    return ev.auc(ev.roc_pr_curve(scored(t), "y", "score"))


@query(
    "auc_exact",
    f"""WITH g AS (SELECT l_linestatus, score, count_if(y = 1) AS p, count_if(y = 0) AS n FROM {SCORED} GROUP BY 1, 2)
        SELECT l_linestatus, round(sum(p * (before + n / 2)) / (sum(p) * sum(n)), 6) AS auc
        FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_linestatus ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) GROUP BY 1""",
)
def auc_exact(t):
    return ev.auc_exact(scored(t), "y", "score", "l_linestatus").withColumn("auc", F.round("auc", 6))


@query(
    "fairness",
    f"""WITH g AS (SELECT l_linestatus AS grp, count(*) AS n, round(avg((l_returnflag = said)::INT), 4) AS accuracy, round(avg((said = 'R')::INT), 4) AS selection_rate,
                          round(count_if(said = 'R' AND l_returnflag = 'R') / count_if(l_returnflag = 'R'), 4) AS tpr FROM {SCORED} GROUP BY 1),
        w AS (SELECT max(accuracy) - min(accuracy) AS gap, max(selection_rate) - min(selection_rate) AS sgap, min(selection_rate) / max(selection_rate) AS di FROM g)
        SELECT g.*, round(gap, 4) AS accuracy_gap, round(sgap, 4) AS selection_rate_gap, round(di, 4) AS disparate_impact, di >= 0.8 AND gap <= 0.1 AS fair FROM g, w""",
)
def fairness(t):
    return ev.fairness(scored(t), "l_returnflag", "said", "l_linestatus", "R")


@query(
    "calibration_curve",
    f"SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(score), 4) AS mean_pred, round(avg(y), 4) AS fraction_pos FROM {SCORED} GROUP BY 1",
)
def calibration(t):
    return ev.calibration_curve(scored(t), "y", "score").withColumns({c: F.round(c, 4) for c in ("mean_pred", "fraction_pos")})


@query(
    "calibration_scores",
    f"""WITH b AS (SELECT count(*) AS n, avg(score) AS m, avg(y) AS f FROM {SCORED} GROUP BY least(floor(score * 10), 9))
        SELECT round(sum(n * abs(m - f)) / sum(n), 4) AS ece, (SELECT round(avg((score - y) ^ 2), 4) FROM {SCORED}) AS brier FROM b""",
)
def calibration_scores(t):
    return ev.calibration_scores(scored(t), "y", "score")


@query(
    "cost_threshold",
    f"""WITH t AS (SELECT unnest(range(21)) / 20 AS threshold),
        c AS (SELECT threshold, count_if(y = 1 AND score >= threshold) AS tp, count_if(y = 0 AND score >= threshold) AS fp, count_if(y = 1 AND score < threshold) AS fn, count(*) AS n
              FROM {SCORED}, t GROUP BY 1), e AS (SELECT *, (fp * 100 + fn * 500) / n AS cost FROM c)
        SELECT threshold, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(cost, 4) AS expected_cost,
               threshold = (SELECT arg_min(threshold, (cost, threshold)) FROM e) AS optimal,
               round(((SELECT cost FROM e WHERE threshold = 0.5) - (SELECT min(cost) FROM e)) * n, 2) AS savings FROM e""",
)
def cost_threshold(t):
    return ev.cost_threshold(scored(t), "y", "score")


MULTI = """(SELECT quality AS y1, toxic AS y2, (n_chars > 300)::INT AS p1, (n_chars % 7 = 0)::INT AS p2 FROM labels JOIN documents USING (doc_id))"""


def multi(t):
    return t.labels.join(t.documents, "doc_id").select(
        F.col("quality").alias("y1"), F.col("toxic").alias("y2"), (F.col("n_chars") > 300).cast("int").alias("p1"),
        (F.col("n_chars") % 7 == 0).cast("int").alias("p2"),
    )


@query(
    "multilabel_report",
    f"""SELECT name, sum(y)::BIGINT AS support, round(sum(y * p) / sum(p), 4) AS precision, round(sum(y * p) / sum(y), 4) AS recall, round(2 * sum(y * p) / (sum(y) + sum(p)), 4) AS f1
        FROM (SELECT 'y1' AS name, y1 AS y, p1 AS p FROM {MULTI} UNION ALL SELECT 'y2', y2, p2 FROM {MULTI}) GROUP BY 1""",
)
def multilabel_report(t):
    return ev.multilabel_report(multi(t), ["y1", "y2"], ["p1", "p2"])


@query(
    "multilabel_metrics",
    f"""SELECT round(avg(((y1 <> p1)::INT + (y2 <> p2)::INT) / 2), 4) AS hamming_loss,
               round(avg(CASE WHEN y1 + p1 + y2 + p2 = 0 THEN 1 ELSE (y1 * p1 + y2 * p2) / (greatest(y1, p1) + greatest(y2, p2)) END), 4) AS jaccard,
               round(avg((y1 = p1 AND y2 = p2)::INT), 4) AS exact_match, round(avg(y1 + y2), 4) AS cardinality,
               round((2 * sum(y1 * p1) / (sum(y1) + sum(p1)) + 2 * sum(y2 * p2) / (sum(y2) + sum(p2))) / 2, 4) AS macro_f1 FROM {MULTI}""",
)
def multilabel_metrics(t):
    return ev.multilabel_metrics(multi(t), ["y1", "y2"], ["p1", "p2"])


# --- neighbours -----------------------------------------------------------------------------------

DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ^ 2))"


@query(
    "knn_join",
    f"""SELECT query_id, neighbour_id, round(d, 6) AS squared_distance, rank FROM
        (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rank
         FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5""",
)
def knn_join(t):
    return nn.knn_join(t.embeddings, t.embeddings, "vec_id", "embedding", 5, skip_same_key=True).withColumn(
        "squared_distance", F.round("squared_distance", 6)
    )


@query(
    "eps_range_join",
    """SELECT a.c_custkey AS a, b.c_custkey AS b, round(sqrt(((a.c_acctbal - b.c_acctbal) / 100) ^ 2 + (a.c_nationkey - b.c_nationkey) ^ 2), 6) AS distance
       FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND ((a.c_acctbal - b.c_acctbal) / 100) ^ 2 + (a.c_nationkey - b.c_nationkey) ^ 2 <= 1.44""",
)
def eps_range_join(t):
    rows = t.customer.select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").alias("y"))
    return nn.eps_range_join(rows, "c_custkey", ["x", "y"], 1.2).withColumn("distance", F.round("distance", 6))


@query(
    "silhouette",
    f"""WITH d AS (SELECT a.vec_id AS id, a.label AS own, b.label AS c, sqrt({DIST}) AS d FROM embeddings a, embeddings b),
        s AS (SELECT id, own, c, sum(d) AS t, count(*) AS n FROM d GROUP BY 1, 2, 3),
        w AS (SELECT id, max(CASE WHEN c = own AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN c <> own THEN t / n END) AS b FROM s GROUP BY 1)
        SELECT id, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) AS silhouette FROM w""",
)
def silhouette(t):
    return cl.silhouette(t.embeddings, "vec_id", "embedding", "label").select("id", *[F.round(c, 6).alias(c) for c in ("a", "b", "silhouette")])


@query(
    "silhouette_squared",
    f"""WITH d AS (SELECT a.vec_id AS id, a.label AS own, b.label AS c, {DIST} AS d FROM embeddings a, embeddings b),
        s AS (SELECT id, own, c, sum(d) AS t, count(*) AS n FROM d GROUP BY 1, 2, 3),
        w AS (SELECT id, max(CASE WHEN c = own AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN c <> own THEN t / n END) AS b FROM s GROUP BY 1)
        SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM w""",
)
def silhouette_squared(t):
    rows = cl.vectors(t.embeddings, "embedding", scale=False)
    return cl.silhouette_squared(rows, "features", "label").select(F.round("silhouette", 6).alias("silhouette"))


# --- models (rows only: coefficients depend on the solver) ----------------------------------------

NUMBERS = ["l_quantity", "p_size", "p_retailprice", "p_type"]


def priced(t):
    """Line items with their part: the price is quantity times retail price, near enough."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("line"), "l_quantity", "p_size", "p_retailprice", "p_type", "l_extendedprice"
    )


def rated(t):
    """Documents with a quality label and simple counts."""
    d = t.documents
    return d.join(t.labels, "doc_id").select(
        "doc_id", "lang", "n_chars", F.size(F.split("text", " ")).alias("n_words"),
        F.length(F.regexp_replace("text", r"[\p{L}\s]", "")).alias("n_marks"), "quality", "toxic",
    )


DOC = ["lang", "n_chars", "n_words", "n_marks"]


@query("encode_features")
def encode_features(t):
    rows = rated(t)
    enc = ml.encode(rows, "quality", "classification", DOC)
    return enc.labelled(rows).select("doc_id", "label", F.col("features").cast("string").alias("features"))


@query("leaderboard_classification")
def leaderboard_classification(t):
    return ml.train_leaderboard(rated(t), "quality", "classification", "doc_id", columns=DOC)


@query("leaderboard_regression")
def leaderboard_regression(t):
    return ml.train_leaderboard(priced(t), "l_extendedprice", "regression", "line", columns=NUMBERS)


@query("leaderboard_more_models")
def leaderboard_more(t):
    return ml.train_leaderboard(priced(t), "l_extendedprice", "regression", "line", ["elasticnet", "polynomial"], columns=NUMBERS)


@query("multiclass_models")
def multiclass(t):
    return ml.train_leaderboard(rated(t), "lang", "classification", "doc_id", ["boosting", "svm", "mlp"], columns=["n_chars", "n_words", "n_marks"])


@query("knn_regression")
def knn_regression(t):
    rows = t.part.select("p_partkey", "p_size", "p_retailprice")
    return ml.train_leaderboard(rows, "p_retailprice", "regression", "p_partkey", ["knn", "linear"], columns=["p_partkey", "p_size"])


@query("automl")
def automl(t):
    return ml.automl(rated(t), "quality", "classification", "doc_id", DOC)


@query("cross_validate")
def cross_validate(t):
    return ml.cross_validate(rated(t), "quality", "classification", "doc_id", "tree", 5, DOC)


@query("hyper_search")
def hyper_search(t):
    return ml.hyper_search(rated(t), "quality", "classification", "doc_id", "tree", columns=DOC)


@query("batch_score")
def batch_score(t):
    rows = priced(t)
    return ml.batch_score(ml.fit(rows, "l_extendedprice", "regression", "linear", NUMBERS), rows)


@query("predict_with_probability")
def predict_probability(t):
    rows = rated(t)
    return ml.predict_with_probability(ml.fit(rows, "quality", "classification", "logistic", DOC), rows)


@query("retrain_with_feedback")
def retrain(t):
    rows = rated(t)
    fixed = rows.filter("toxic = 1").withColumn("quality", F.lit(0))
    return ml.batch_score(ml.retrain_with_feedback(rows, fixed, "quality", "classification", "tree", DOC, "doc_id"), rows)


@query("save_load_model")
def save_load(t):
    rows = priced(t)
    model = ml.fit(rows, "l_extendedprice", "regression", "linear", NUMBERS)
    path = scratch_path(t.spark, "model")
    save_model(model.as_pipeline(), path, t.spark, target="l_extendedprice", kind=model.kind)
    loaded, about = load_model(path, t.spark)
    return loaded.transform(rows).select("line", "prediction", F.lit(about["kind"]).alias("kind"))


@query("evaluate_holdout")
def holdout(t):
    return ml.evaluate_holdout(rated(t), "quality", "classification", "doc_id", "logistic", columns=DOC)


@query("compare_models")
def compare_models(t):
    return ml.compare_models(rated(t), "quality", "classification", "doc_id", ["logistic", "tree", "forest"], columns=DOC)


@query("select_features")
def select_features(t):
    from oreline.operators.selection_of_features import select_features as choose

    return choose(rated(t), "quality", "classification", DOC)


@query("select_features_regression")
def select_features_regression(t):
    from oreline.operators.selection_of_features import select_features as choose

    return choose(priced(t), "l_extendedprice", "regression", NUMBERS)


@query("smote")
def smote(t):
    return fe.smote(rated(t), "toxic", "doc_id", ["n_chars", "n_words"], 5)


@query("smoteenn")
def smoteenn(t):
    return fe.smoteenn(rated(t), "toxic", "doc_id", ["n_chars", "n_words"], 5)


def price_model(t):
    rows = stage(priced(t), "priced")
    return ml.fit(rows, "l_extendedprice", "regression", "tree", NUMBERS), rows


@query("permutation_importance")
def permutation(t):
    model, rows = price_model(t)
    return ex.permutation_importance(model, rows, "line")


@query("tree_importance")
def tree_importance(t):
    model, rows = price_model(t)
    return ex.tree_importance(model, t.spark)


@query("partial_dependence")
def partial(t):
    model, rows = price_model(t)
    return ex.partial_dependence(model, rows, "l_quantity")


@query("ice_curves")
def ice(t):
    model, rows = price_model(t)
    return ex.ice_curves(model, rows, "l_quantity", "line")


@query("local_contribution")
def contribution(t):
    rows = rated(t)
    return ex.local_contribution(ml.fit(rows, "quality", "classification", "logistic", DOC), rows, "doc_id")


@query("what_if")
def what_if(t):
    model, rows = price_model(t)
    return ex.what_if(model, rows, {"l_quantity": F.col("l_quantity") + 5})


@query("shap_values")
def shap(t):
    rows = rated(t)
    return ex.shap_values(ml.fit(rows, "quality", "classification", "logistic", DOC), rows, "doc_id")


@query("decision_grid")
def decision_grid(t):
    model, rows = price_model(t)
    return ex.decision_grid(model, rows, "l_quantity", "p_retailprice")


# --- clusters -------------------------------------------------------------------------------------


@query("kmeans")
def kmeans(t):
    return cl.kmeans_summary(t.embeddings, 10, "embedding", scale=False)


@query("kmeans_on_components")
def kmeans_components(t):
    points, _ = cl.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 3)
    return cl.kmeans_summary(points, 3, ["pc1", "pc2", "pc3"], scale=False)


@query("hierarchical_clusters")
def hierarchical(t):
    rows = cl.hierarchical(t.part.select("p_partkey", "p_size", "p_retailprice"), 4, ["p_size", "p_retailprice"])
    return cl.cluster_profile(rows, "cluster", ["p_size", "p_retailprice"])


@query("gaussian_mixture")
def mixture(t):
    rows = cl.gaussian_mixture(t.part.select("p_partkey", "p_size", "p_retailprice"), 3, ["p_size", "p_retailprice"])
    return cl.cluster_profile(rows, "cluster", ["p_size", "p_retailprice"])


@query("k_scan")
def k_scan(t):
    return cl.k_scan(t.customer, ["c_acctbal", "c_nationkey"])


@query(
    "cluster_profile",
    """SELECT label AS cluster, count(*) AS size, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM embeddings), 2) AS pct, round(avg(embedding[1]), 4) AS mean_x
       FROM embeddings GROUP BY 1""",
)
def cluster_profile(t):
    rows = t.embeddings.select(F.col("label").alias("cluster"), F.col("embedding")[0].cast("double").alias("x"))
    return cl.cluster_profile(rows, "cluster", ["x"])


@query(
    "dbscan",
    """WITH RECURSIVE p AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey
                            AND ((a.c_acctbal - b.c_acctbal) / 100) ^ 2 + (a.c_nationkey - b.c_nationkey) ^ 2 <= 1.44),
       core AS (SELECT a AS id FROM p GROUP BY 1 HAVING count(*) >= 5), e AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
       r AS (SELECT id, id AS root FROM core UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
       c AS (SELECT id, min(root) AS root FROM r GROUP BY 1), n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM c)),
       l AS (SELECT id, cluster FROM c JOIN n USING (root))
       SELECT c_custkey AS id, coalesce((SELECT cluster FROM l WHERE l.id = c_custkey), (SELECT min(cluster) FROM p JOIN l ON p.b = l.id WHERE p.a = c_custkey), -1)::BIGINT AS cluster
       FROM customer""",
)
def dbscan(t):
    rows = t.customer.select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return cl.dbscan(rows, "c_custkey", ["x", "y"], 1.2, 5)


@query("pca")
def pca(t):
    rows, _ = cl.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 3)
    return rows.drop("embedding")


@query("pca_variance_curve")
def variance_curve(t):
    return cl.pca_variance_curve(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query(
    "anomalies_zscore",
    """WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS d FROM lineitem),
       s AS (SELECT greatest(abs(l_quantity - a) / b, abs(l_extendedprice - c) / d) AS score FROM lineitem, m),
       r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS rn, count(*) OVER () AS n FROM s),
       q AS (SELECT max(CASE WHEN rn = least(floor(0.95::DOUBLE * n), n - 1) THEN score END) AS t FROM r)
       SELECT count(*) AS rows, count_if(score >= t)::BIGINT AS anomalies, round(100.0::DOUBLE * count_if(score >= t) / count(*), 2) AS pct, round(any_value(t), 4) AS threshold FROM s, q""",
)
def anomalies_zscore(t):
    rows = t.lineitem.withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return cl.anomaly_summary(cl.anomaly_scores(rows, "line", ["l_quantity", "l_extendedprice"]))


@query("anomalies_iqr")
def anomalies_iqr(t):
    return cl.anomaly_scores(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], "iqr")


@query("anomalies_centre")
def anomalies_centre(t):
    return cl.anomaly_scores(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], "centre")


@query("anomalies_knn")
def anomalies_knn(t):
    return cl.anomaly_scores(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], "knn")
