"""Regressors on lag features, compared by walking forward through time."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from oreline.functions.ordered import with_history
from oreline.operators.learning import estimator
from oreline.session import stage

LAGS = (1, 2, 3)


def lag_features(s: DataFrame, window: int = 7) -> DataFrame:
    """Lags 1 to 3 and the mean of the ``window`` values before each row of a prepared series."""
    looks = {f"lag{k}": (lambda w, k=k: F.lag("value", k).over(w)) for k in LAGS}
    looks["rolling"] = lambda w: F.avg("value").over(w.rowsBetween(-window, -1))
    return with_history(s, "position", max(window, *LAGS), looks, "series").dropna(subset=list(looks))


def walk_forward_models(s: DataFrame, models=("linear", "boosting", "forest"), folds: int = 3) -> DataFrame:
    """MAPE, RMSE and MASE per model. Fold f tests the f-th of the last ``folds`` equal parts of every series
    and trains on all that comes before; ``naive`` repeats the last value."""
    sizes = s.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    part = F.floor((folds + 1) * F.col("position") / F.col("n"))
    rows = lag_features(s).join(sizes, "series").withColumn("part", F.least(part, F.lit(folds)))
    names = [f"lag{k}" for k in LAGS] + ["rolling"]
    ready = stage(VectorAssembler(inputCols=names, outputCol="features").transform(rows).withColumn("label", F.col("value")), "walk")
    out = []
    for f in range(1, folds + 1):
        train, test = ready.filter(F.col("part") < f), ready.filter(F.col("part") == f)
        keep = ("series", "position", "label", "prediction")
        out.append(test.withColumn("prediction", F.col("lag1")).select(*keep).withColumn("model", F.lit("naive")))
        for m in models:
            fitted = estimator(m, "regression").fit(train.select("features", "label"))
            out.append(fitted.transform(test).select(*keep).withColumn("model", F.lit(m)))
    every = reduce(lambda a, b: a.unionByName(b), out)
    step = ready.groupBy("series").agg(F.avg(F.abs(F.col("value") - F.col("lag1"))).alias("_step"))
    e = F.col("label") - F.col("prediction")
    return every.join(step, "series").groupBy("model").agg(
        F.round(100 * F.avg(F.abs(F.try_divide(e, F.col("label")))), 4).alias("mape"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"),
        F.round(F.avg(F.try_divide(F.abs(e), F.col("_step"))), 4).alias("mase"), F.count(F.lit(1)).alias("n"),
    )
