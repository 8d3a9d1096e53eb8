"""Encoding, training, comparing and applying classical models with ``pyspark.ml``."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from oreline.functions.core import as_list, bucket, dtype, is_numeric, number, present
from oreline.operators import evaluation as ev
from oreline.operators.neighbours import knn_join
from oreline.session import stage

# Parts of a column's name that mark an identifier, and the longest name that ``id`` at its end marks.
ID_PARTS = ("codigo", "código", "cpf", "cnpj", "uuid", "guid", "matric")
LONGEST_ID_NAME = 16
CLASSIFIERS = ["logistic", "tree", "forest", "boosting", "svm", "knn", "bayes"]
REGRESSORS = ["linear", "ridge", "lasso", "tree", "forest", "boosting", "knn"]


# --- encoding -------------------------------------------------------------------------------------


@dataclass
class Encoding:
    """Fitted features: a pipeline from raw columns to the vector ``features``, and what is in it."""

    stages: PipelineModel
    columns: list[str]
    names: list[str]
    owners: list[str]
    target: str
    task: str
    classes: list[str]

    def label(self, df: DataFrame) -> Column:
        """The target as a number: its value, or its place among the sorted classes."""
        if self.task == "regression":
            return number(df, self.target)
        place = F.array_position(F.array(*[F.lit(c) for c in self.classes]), present(df, self.target).cast("string"))
        return F.when(place > 0, (place - 1).cast("double"))

    def class_of(self, index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(c) for c in self.classes]), (index + 1).cast("int"))

    def apply(self, df: DataFrame) -> DataFrame:
        return self.stages.transform(df)

    def numbers(self, df: DataFrame, prefix: str) -> DataFrame:
        """``df`` with the encoded features as plain columns ``<prefix>0``, ``<prefix>1``, …"""
        plain = self.stages.stages[0].transform(df)  # the projection in front of the assembler
        return plain.withColumnsRenamed({f"_x{i}": f"{prefix}{i}" for i in range(len(self.names))})

    def labelled(self, df: DataFrame) -> DataFrame:
        return self.apply(df).withColumn("label", self.label(df)).filter("label IS NOT NULL")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def named_like_id(column: str) -> bool:
    """Whether a name reads like that of an identifier."""
    name = column.lower().strip()
    if name == "id" or name.endswith("_id"):
        return True
    if name.endswith("id") and len(name) <= LONGEST_ID_NAME:
        return True
    return any(part in name for part in ID_PARTS)


def id_like(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns named like an identifier whose values are at least half distinct."""
    named = [c for c in columns if named_like_id(c)]
    if not named:
        return []
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.countDistinct(c).alias(f"u{i}") for i, c in enumerate(named)]).first()
    return [c for i, c in enumerate(named) if row[f"u{i}"] >= 0.5 * row["_n"]]


CLASSES = "the classes of the target"


def frequent_values(df: DataFrame, columns: list[str], top: int, target: str | None) -> dict[str, list[str]]:
    """The ``top`` most frequent values of each text column and all classes of the target, in one job."""
    cells = {c: present(df, c).cast("string") for c in columns}
    if target is not None:
        cells[CLASSES] = present(df, target).cast("string")
    if not cells:
        return {}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in cells.items()])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.*").filter("value IS NOT NULL")
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("_rn", F.row_number().over(best))
    wanted = ranked.filter((F.col("_rn") <= top) | (F.col("name") == CLASSES))  # a model has a column per class anyway
    out: dict[str, list[str]] = {}
    for r in wanted.orderBy("name", "_rn").collect():
        out.setdefault(r["name"], []).append(r["value"])
    return out


def encode(df: DataFrame, target: str, task: str, columns=None, top: int = 15, scale: bool = True) -> Encoding:
    """Fit the features of ``df``.

    Identifiers are left out, texts become flags of their most frequent values, what is not a number counts
    as 0, and every feature is scaled by its population deviation. All of it is one SQL projection with
    constants, so it can be saved with a model.
    """
    wanted = as_list(columns) or [c for c in df.columns if c != target]
    dropped = id_like(df, wanted) if not columns else []
    kept = [c for c in wanted if c not in dropped] or wanted
    values = frequent_values(df, [c for c in kept if not is_numeric(df, c)], top, target if task == "classification" else None)
    classes = sorted(values.pop(CLASSES, []))
    if task == "classification" and len(classes) < 2:
        raise ValueError("the target needs two classes or more")
    cells: list[tuple[str, str, str]] = []  # (feature name, column, SQL)
    for c in kept:
        if is_numeric(df, c):
            cells.append((c, c, f"coalesce(nanvl(cast({_quoted(c)} as double), 0D), 0D)"))
        for v in values.get(c, []):
            cells.append((f"{c}={v}", c, f"(case when {'trim(' if isinstance(dtype(df, c), StringType) else '('}cast({_quoted(c)} as string)) = {_text(v)} then 1D else 0D end)"))
    sql = [s for _, _, s in cells]
    if scale:
        stats = df.agg(*[f(F.expr(s)).alias(f"{n}{i}") for i, s in enumerate(sql) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        sql = [f"(({s}) - ({stats[f'm{i}']!r}D)) / {(stats[f's{i}'] or 1.0)!r}D" for i, s in enumerate(sql)]
    inner = [f"_x{i}" for i in range(len(sql))]
    select = "SELECT *, " + ", ".join(f"{s} AS {n}" for s, n in zip(sql, inner)) + " FROM __THIS__"
    tidy = SQLTransformer(statement="SELECT * EXCEPT (" + ", ".join(inner) + ") FROM __THIS__")
    stages = PipelineModel([SQLTransformer(statement=select), VectorAssembler(inputCols=inner, outputCol="features"), tidy])
    return Encoding(stages, kept, [n for n, _, _ in cells], [c for _, c, _ in cells], target, task, classes)


# --- models ---------------------------------------------------------------------------------------


def model_kind(name: str, task: str) -> str:
    """The model a free name stands for: the first keyword found in it decides."""
    s = (name or "").lower()
    # Keywords of model names. "gradient", "xgb", "neural", "nearest" and the accented spellings are additions, and
    # "tree" stands after the names that may hold it.
    for words, kind in (
        (("random", "forest", "floresta"), "forest"), (("boosting", "gradient", "xgb"), "boosting"),
        (("svm", "svr", "vector"), "svm"), (("ridge",), "ridge"), (("lasso",), "lasso"), (("elastic",), "elasticnet"),
        (("poly", "polin"), "polynomial"), (("mlp", "perceptron", "neural"), "mlp"), (("tree", "árvore", "arvore"), "tree"),
        (("knn", "nearest"), "knn"), (("naive", "bayes"), "bayes"), (("linear",), "linear"), (("logist", "logíst"), "logistic"),
    ):
        if any(w in s for w in words):
            return kind
    return "linear" if task == "regression" else "logistic"


def estimator(kind: str, task: str, classes: int = 2, features: int = 1, **p) -> Estimator:
    """Estimators with the settings of the leaderboards; ``p`` overrides them."""
    if task == "regression":
        deep = dict(maxDepth=p.get("max_depth", 10), minInstancesPerNode=p.get("min_leaf", 2), seed=7)
        made = {
            "linear": lambda: LinearRegression(regParam=0.0),
            "ridge": lambda: LinearRegression(regParam=p.get("alpha", 0.5), elasticNetParam=0.0),
            "lasso": lambda: LinearRegression(regParam=p.get("alpha", 0.1), elasticNetParam=1.0),
            "elasticnet": lambda: LinearRegression(regParam=p.get("alpha", 0.1), elasticNetParam=0.5),
            "polynomial": lambda: Pipeline(stages=[PolynomialExpansion(degree=2, inputCol="features", outputCol="poly"), LinearRegression(featuresCol="poly", regParam=1e-6)]),
            "tree": lambda: DecisionTreeRegressor(**deep),
            "forest": lambda: RandomForestRegressor(numTrees=p.get("n_trees", 12), maxDepth=p.get("max_depth", 9), featureSubsetStrategy="all", seed=7),
            "boosting": lambda: GBTRegressor(maxIter=p.get("rounds", 25), stepSize=p.get("learning_rate", 0.2), maxDepth=p.get("max_depth", 3), seed=7),
        }
        return made.get(kind, made["linear"])()
    boost = GBTClassifier(maxIter=p.get("rounds", 22), stepSize=p.get("learning_rate", 0.3), maxDepth=p.get("max_depth", 3), seed=7)
    svc = LinearSVC(regParam=p.get("lambda", 0.001), maxIter=50)
    made = {
        "logistic": lambda: LogisticRegression(regParam=p.get("lambda", 0.0001), maxIter=p.get("epochs", 100)),
        "tree": lambda: DecisionTreeClassifier(maxDepth=p.get("max_depth", 10), minInstancesPerNode=p.get("min_leaf", 2), seed=7),
        "forest": lambda: RandomForestClassifier(numTrees=p.get("n_trees", 12), maxDepth=p.get("max_depth", 9), featureSubsetStrategy="all", seed=7),
        "boosting": lambda: boost if classes == 2 else OneVsRest(classifier=boost, parallelism=min(classes, 8)),
        "svm": lambda: svc if classes == 2 else OneVsRest(classifier=svc, parallelism=min(classes, 8)),
        "bayes": lambda: NaiveBayes(modelType="gaussian"),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[features, max(4, features), classes], seed=7, maxIter=60),
    }
    return made.get(kind, made["logistic"])()


@dataclass
class Fitted:
    """An encoding with a trained model on top."""

    encoding: Encoding
    model: Transformer
    kind: str

    @property
    def task(self) -> str:
        return self.encoding.task

    def score_encoded(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        extra = [c for c in ("rawPrediction", "poly") if c in out.columns]
        return out.drop(*extra)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and, where the model has them, ``probability`` as an array."""
        return self.score_encoded(self.encoding.apply(df)).drop("features")

    def scalar(self, df: DataFrame) -> DataFrame:
        """Add ``score``: the predicted number, or the probability of the last class."""
        return self.scalar_encoded(self.encoding.apply(df)).drop("features")

    def scalar_encoded(self, df: DataFrame) -> DataFrame:
        out = self.score_encoded(df)
        if self.task == "regression":
            return out.withColumn("score", F.col("prediction"))
        if "probability" in out.columns:
            return out.withColumn("score", F.element_at(vector_to_array("probability"), -1))
        return out.withColumn("score", (F.col("prediction") == len(self.encoding.classes) - 1).cast("double"))

    def on_blocks(self) -> Callable[[np.ndarray], np.ndarray] | None:
        """The predictions of a block of encoded rows as a NumPy function, for models that have one: regression trees."""
        return tree_on_blocks(self.model.toDebugString) if isinstance(self.model, DecisionTreeRegressionModel) else None

    def slots(self, column: str) -> list[int]:
        """The places of a column in the encoded vector."""
        return [i for i, owner in enumerate(self.encoding.owners) if owner == column]

    def as_pipeline(self) -> PipelineModel:
        return PipelineModel([*self.encoding.stages.stages, self.model])


def tree_on_blocks(text: str) -> Callable[[np.ndarray], np.ndarray] | None:
    """A printed regression tree as a function of a block of rows, which go down one level at a time; None if it has other splits than ``<=``."""
    feature, threshold, left, right, value, depths = [], [], [], [], [], [0]
    lines = iter(line.strip() for line in text.splitlines()[1:] if line.strip())

    def node(depth: int) -> int | None:
        line, me = next(lines), len(feature)
        for a, v in ((feature, 0), (threshold, np.inf), (left, me), (right, me), (value, 0.0)):
            a.append(v)  # a leaf leads to itself
        depths.append(depth)
        if line.startswith("Predict: "):
            value[me] = float(line[len("Predict: "):])
            return me
        split = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        if split is None:
            return None
        feature[me], threshold[me] = int(split[1]), float(split[2])
        left[me] = node(depth + 1)
        if left[me] is None or not next(lines).startswith("Else"):
            return None
        right[me] = node(depth + 1)
        return None if right[me] is None else me

    if node(0) is None:
        return None
    features, thresholds, values = np.array(feature), np.array(threshold), np.array(value)
    lefts, rights, levels = np.array(left), np.array(right), max(depths)

    def predict(x: np.ndarray) -> np.ndarray:
        flat, start, at = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), dtype=np.int64)
        for _ in range(levels):
            at = np.where(flat.take(start + features.take(at)) <= thresholds.take(at), lefts.take(at), rights.take(at))
        return values.take(at)

    return predict


def fit(df: DataFrame, target: str, task: str, name: str = "", columns=None, **params) -> Fitted:
    enc = encode(df, target, task, columns)
    kind = model_kind(name, task)
    ready = enc.labelled(df).select("features", "label")
    return Fitted(enc, estimator(kind, task, len(enc.classes), len(enc.names), **params).fit(ready), kind)


def knn_predict(train: DataFrame, test: DataFrame, key: str, task: str, k: int = 5, columns="features") -> DataFrame:
    """Majority (ties to the smaller label) or mean of the k nearest training rows; all training rows count."""
    near = knn_join(test, train, key, columns, k)
    labels = train.select(F.col(key).alias("neighbour_id"), F.col("label").alias("_l"))
    seen = near.join(labels, "neighbour_id")
    if task == "regression":
        vote = seen.groupBy("query_id").agg(F.avg("_l").alias("prediction"))
    else:
        counts = seen.groupBy("query_id", "_l").agg(F.count(F.lit(1)).alias("c"))
        vote = counts.groupBy("query_id").agg(F.min_by("_l", F.struct((-F.col("c")).alias("c"), "_l")).alias("prediction"))
    return test.join(vote, F.col(key) == F.col("query_id")).drop("query_id")


def _predicted(kind: str, task: str, enc: Encoding, train: DataFrame, test: DataFrame, key: str, **p) -> DataFrame:
    if kind == "knn":
        out = knn_predict(train, test, key, task, p.get("k", 5))
    else:
        out = estimator(kind, task, len(enc.classes), len(enc.names), **p).fit(train).transform(test)
    return out.select(key, "label", "prediction")


#: Fits that run at the same time; each is a chain of Spark jobs of its own.
AT_ONCE = 4


def together(jobs: list[Callable[[], object]], at_once: int = AT_ONCE) -> list:
    """The results of independent fits, a few at a time, in the order given."""
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def train_leaderboard(
    df: DataFrame, target: str, task: str, key: str, models=None, train_percent: int = 80, columns=None, seed: int = 0
) -> DataFrame:
    """Every model on the same hashed split, one row each, best first (macro F1 or R²)."""
    columns = as_list(columns) or [c for c in df.columns if c not in (target, key)]
    if df.limit(20).count() < 20:
        raise ValueError("at least 20 rows are needed")
    rows = stage(df.select(*dict.fromkeys([key, target, *columns])), "leaderboard")  # else each pass makes them again
    enc = encode(rows, target, task, columns)
    split = bucket(F.col(key), 100, seed) < train_percent
    ready = stage(enc.labelled(rows).select(key, "label", "features", split.alias("is_train")), "split")
    train, test = ready.filter("is_train").drop("is_train"), ready.filter("NOT is_train").drop("is_train")
    names = models or (CLASSIFIERS if task == "classification" else REGRESSORS)

    def board(name: str) -> dict:
        started = time.time()
        out = _predicted(model_kind(name, task) if name not in (CLASSIFIERS + REGRESSORS) else name, task, enc, train, test, key)
        measure = ev.class_metrics if task == "classification" else ev.reg_metrics
        row = measure(out, "label", "prediction").first().asDict()  # one row of metrics
        return {"model": name, **row, "training_time": round(time.time() - started, 2)}

    # the longest chain of jobs begins first, so that the others run beside it
    boards = together([partial(board, name) for name in sorted(names, key=lambda name: name != "knn")])
    best = "f1" if task == "classification" else "r2"
    boards.sort(key=lambda r: (-r[best], r["model"]))
    return df.sparkSession.createDataFrame([{"rank": i + 1, **r} for i, r in enumerate(boards)])


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", bucket(F.col(key), k, seed + 1))


def _cv(ready: DataFrame, enc: Encoding, kind: str, task: str, key: str, k: int, at_once: int = AT_ONCE, **p) -> DataFrame:
    def fold(f: int) -> DataFrame:
        train, test = ready.filter(F.col("fold") != f).drop("fold"), ready.filter(F.col("fold") == f).drop("fold")
        return _predicted(kind, task, enc, train, test, key, **p).withColumn("fold", F.lit(f))

    every = reduce(lambda a, b: a.unionByName(b), together([partial(fold, f) for f in range(k)], at_once))
    measure = ev.class_metrics if task == "classification" else ev.reg_metrics
    return measure(every, "label", "prediction", "fold")


def cross_validate(df: DataFrame, target: str, task: str, key: str, name: str = "", k: int = 5, columns=None, **p) -> DataFrame:
    """Mean and population deviation of the measures over hashed folds."""
    columns = as_list(columns) or [c for c in df.columns if c not in (target, key)]
    enc = encode(df, target, task, columns)
    ready = stage(folds(enc.labelled(df), key, k).select(key, "label", "features", "fold"), "folds")
    scores = _cv(ready, enc, model_kind(name, task), task, key, k, **p)
    metrics = ["accuracy", "f1"] if task == "classification" else ["r2", "rmse"]
    return scores.agg(
        F.count(F.lit(1)).alias("folds"),
        *[F.round(F.avg(m), 4).alias(f"{m}_mean") for m in metrics], *[F.round(F.stddev_pop(m), 4).alias(f"{m}_std") for m in metrics],
    )


def automl(df: DataFrame, target: str, task: str, key: str, columns=None, k: int = 5, models=None) -> DataFrame:
    """The leaderboard with the cross-validated scores of its winner."""
    board = train_leaderboard(df, target, task, key, models, columns=columns)
    best = board.orderBy("rank").first().model
    cv = cross_validate(df, target, task, key, best, k, columns).withColumn("model", F.lit(best))
    return board.join(cv, "model", "left").orderBy("rank")


# --- search ---------------------------------------------------------------------------------------

# What is varied per model, as (name, kind, lowest, highest).
SPACES = {
    "knn": [("k", "int", 1, 25)],
    "tree": [("max_depth", "int", 3, 16), ("min_leaf", "int", 1, 10)],
    "forest": [("n_trees", "int", 6, 40), ("max_depth", "int", 4, 14)],
    "boosting": [("rounds", "int", 10, 60), ("learning_rate", "float", 0.05, 0.5), ("max_depth", "int", 2, 5)],
    "svm": [("lambda", "float", 0.0001, 0.05)],
    "ridge": [("alpha", "float", 0.05, 5.0)],
    "lasso": [("alpha", "float", 0.02, 2.0)],
    "logistic": [("lambda", "float", 0.0001, 0.1), ("epochs", "int", 120, 400)],
}


def hyper_space(name: str, task: str) -> list[tuple]:
    return SPACES.get(model_kind(name, task), [])


def hyper_search(df: DataFrame, target: str, task: str, key: str, name: str, trials: int = 20, k: int = 4, columns=None, seed: int = 42) -> DataFrame:
    """Random search scored by k-fold validation; the defaults are trial 1 and repeated settings are skipped."""
    columns = as_list(columns) or [c for c in df.columns if c not in (target, key)]
    if df.limit(30).count() < 30:
        raise ValueError("at least 30 rows are needed")
    enc = encode(df, target, task, columns)
    ready = stage(folds(enc.labelled(df), key, k).select(key, "label", "features", "fold"), "search")
    draw, kind = random.Random(seed), model_kind(name, task)
    tried: dict[str, dict] = {}
    for i in range(trials):
        p = {} if i == 0 else {
            n: draw.randint(lo, hi) if t == "int" else round(draw.uniform(lo, hi), 4) for n, t, lo, hi in hyper_space(name, task)
        }
        tried.setdefault(json.dumps(p, sort_keys=True), p)
    metric = "f1" if task == "classification" else "r2"

    def trial(i: int, text: str, p: dict) -> tuple:
        s = _cv(ready, enc, kind, task, key, k, at_once=1, **p).agg(F.avg(metric).alias("m"), F.stddev_pop(metric).alias("s")).first()
        return i + 1, text, round(s.m, 4), round(s.s, 4)

    rows = together([partial(trial, i, text, p) for i, (text, p) in enumerate(tried.items())])
    rows.sort(key=lambda r: (-r[2], r[0]))
    return df.sparkSession.createDataFrame(
        [(rank + 1, *r) for rank, r in enumerate(rows)], "rank bigint, trial bigint, params string, score double, cv_std double"
    )


# --- applying -------------------------------------------------------------------------------------


def batch_score(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Add ``predicao_<target>`` to a new table, with the class name for classifiers."""
    out = fitted.score(df)
    value = F.round("prediction", 4) if fitted.task == "regression" else fitted.encoding.class_of(F.col("prediction"))
    return out.select(*df.columns, value.alias(f"predicao_{fitted.encoding.target}"))


def predict_with_probability(fitted: Fitted, df: DataFrame) -> DataFrame:
    out = fitted.score(df)
    p = vector_to_array("probability")
    return out.select(
        *df.columns, fitted.encoding.class_of(F.col("prediction")).alias("predicted"), F.round(F.array_max(p), 4).alias("confidence"),
        p.alias("probabilities"),
    )


def retrain_with_feedback(df: DataFrame, corrections: DataFrame, target: str, task: str, name: str = "", columns=None, key: str | None = None) -> Fitted:
    """Fit again with the corrected rows (same columns, target as corrected by the user).

    With ``key`` a correction takes the place of the row it corrects; without, it is one more row.
    """
    if key is not None:
        df = df.join(corrections.select(key).distinct(), key, "left_anti")
    return fit(df.unionByName(corrections, allowMissingColumns=True), target, task, name, columns)


def evaluate_holdout(df: DataFrame, target: str, task: str, key: str, name: str = "", train_percent: int = 75, columns=None) -> DataFrame:
    """Predictions on held-out rows: ``(key, label, prediction[, score])``."""
    columns = as_list(columns) or [c for c in df.columns if c not in (target, key)]
    train = bucket(F.col(key), 100) < train_percent
    model = fit(df.filter(train), target, task, name, columns)
    out = model.scalar(df.filter(~train))
    label = model.encoding.label(df)
    return out.select(key, label.alias("label"), "prediction", "score").filter("label IS NOT NULL")


def compare_models(df: DataFrame, target: str, task: str, key: str, names: list[str], train_percent: int = 75, columns=None) -> DataFrame:
    """The same held-out rows for all models, encoded once: measures, and the area under the curve for two classes."""
    columns = as_list(columns) or [c for c in df.columns if c not in (target, key)]
    rows = stage(df.select(*dict.fromkeys([key, target, *columns])), "compare-rows")
    split = bucket(F.col(key), 100) < train_percent
    enc = encode(rows.filter(split), target, task, columns)
    ready = stage(enc.labelled(rows).select(key, "label", "features", split.alias("is_train")), "compare-split")
    train, test = ready.filter("is_train").select("features", "label"), ready.filter("NOT is_train").drop("is_train")

    def held_out(name: str) -> DataFrame:
        kind = model_kind(name, task)
        model = Fitted(enc, estimator(kind, task, len(enc.classes), len(enc.names)).fit(train), kind)
        return model.scalar_encoded(test).select(key, "label", "prediction", "score", F.lit(name).alias("model"))

    held = reduce(lambda a, b: a.unionByName(b), together([partial(held_out, n) for n in names]))
    held = stage(held, "compare")
    if task == "regression":
        return ev.reg_metrics(held, "label", "prediction", "model")
    out = ev.class_metrics(held, "label", "prediction", "model")
    if held.select("label").distinct().limit(3).count() == 2:
        out = out.join(ev.auc(ev.roc_pr_curve(held, "label", "score", "model"), "model"), "model", "left")
    return out
