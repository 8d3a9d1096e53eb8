"""Treatment effects, calibration of scores, several labels."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions.core import bucket, single
from oreline.functions.tails import normal_p
from oreline.operators.aggregates import histogram
from oreline.operators.learning import encode, estimator
from oreline.operators.neighbours import knn_join
from oreline.session import stage


def _effect(df: DataFrame, method: str) -> DataFrame:
    """``(ate, se)`` to the reported row."""
    return df.select(
        F.lit(method).alias("method"), F.round("ate", 4).alias("ate"), F.round("se", 4).alias("se"),
        F.round(F.col("ate") - 1.96 * F.col("se"), 4).alias("ci_lower"), F.round(F.col("ate") + 1.96 * F.col("se"), 4).alias("ci_upper"),
        F.round(normal_p(F.try_divide(F.col("ate"), F.col("se"))), 4).alias("p_value"),
    )


def propensity(df: DataFrame, treatment: str, columns: list[str], name: str = "propensity") -> DataFrame:
    """Probability of treatment given the covariates, kept inside .01 … .99."""
    enc = encode(df, treatment, "regression", columns)
    ready = enc.labelled(df)
    model = LogisticRegression(regParam=1e-4).fit(ready.select("features", "label"))
    p = F.element_at(vector_to_array("probability"), 2)
    scored = model.transform(ready).withColumn(name, F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99)))
    return scored.select(*df.columns, name)


def ipw_ate(df: DataFrame, treatment: str, outcome: str, p: str = "propensity") -> DataFrame:
    """Inverse-probability weighting with normalised weights; the error from the influence of each row."""
    t, y = F.col(treatment) == 1, F.col(outcome).cast("double")
    w1, w0 = F.when(t, 1 / F.col(p)).otherwise(0.0), F.when(~t, 1 / (1 - F.col(p))).otherwise(0.0)
    m = single(df.agg((F.sum(w1 * y) / F.sum(w1)).alias("m1"), (F.sum(w0 * y) / F.sum(w0)).alias("m0")))
    pull = w1 * (y - m["m1"]) - w0 * (y - m["m0"])
    out = df.agg((F.max(m["m1"]) - F.max(m["m0"])).alias("ate"), (F.sqrt(F.avg(pull * pull) / F.count(F.lit(1)))).alias("se"))
    return _effect(out, "IPW")


def matching_ate(df: DataFrame, key: str, treatment: str, outcome: str, p: str = "propensity") -> DataFrame:
    """Each row against the nearest row of the other group by propensity (exact, any size)."""
    rows = stage(df.select(key, F.col(treatment).alias("_t"), F.col(outcome).cast("double").alias("_y"), p), "matching")
    one, zero = rows.filter("_t = 1"), rows.filter("_t <> 1")
    pairs = knn_join(one, zero, key, p, 1).select("query_id", "neighbour_id", F.lit(1.0).alias("sign")).unionByName(
        knn_join(zero, one, key, p, 1).select("query_id", "neighbour_id", F.lit(-1.0).alias("sign"))
    )
    own = rows.select(F.col(key).alias("query_id"), F.col("_y").alias("a"))
    other = rows.select(F.col(key).alias("neighbour_id"), F.col("_y").alias("b"))
    gain = F.col("sign") * (F.col("a") - F.col("b"))
    out = pairs.join(own, "query_id").join(other, "neighbour_id").agg(
        F.avg(gain).alias("ate"), (F.stddev_samp(gain) / F.sqrt(F.count(F.lit(1)))).alias("se")
    )
    return _effect(out, "matching")


def learner_effects(df: DataFrame, key: str, treatment: str, outcome: str, columns: list[str], kind: str = "T", model: str = "boosting") -> DataFrame:
    """Effect per row: one model with the treatment among its features (S) or one model per group (T)."""
    rows = df.select(key, *columns, F.col(treatment).cast("double").alias("_t"), F.col(outcome).cast("double").alias("_y"))
    used = [*columns, "_t"] if kind == "S" else columns
    enc = encode(rows, "_y", "regression", used)

    def predicted(trained, data: DataFrame, name: str) -> DataFrame:
        return trained.transform(enc.apply(data)).select(F.col(key), F.col("prediction").alias(name))

    if kind == "S":
        both = estimator(model, "regression").fit(enc.labelled(rows).select("features", "label"))
        y1, y0 = (predicted(both, rows.withColumn("_t", F.lit(v)), n) for v, n in ((1.0, "y1"), (0.0, "y0")))
    else:
        y1, y0 = (
            predicted(estimator(model, "regression").fit(enc.labelled(rows.filter(F.col("_t") == v)).select("features", "label")), rows, n)
            for v, n in ((1.0, "y1"), (0.0, "y0"))
        )
    return y1.join(y0, key).select(key, (F.col("y1") - F.col("y0")).alias("cate"))


def learner_ate(effects: DataFrame, kind: str) -> DataFrame:
    out = effects.agg(F.avg("cate").alias("ate"), (F.stddev_samp("cate") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return _effect(out, f"{kind}-learner")


def cate_distribution(effects: DataFrame, bins: int = 13) -> DataFrame:
    return histogram(effects, "cate", bins)


def double_ml(df: DataFrame, key: str, treatment: str, outcome: str, columns: list[str], k: int = 2, model: str = "boosting") -> DataFrame:
    """Slope of outcome residuals on treatment residuals, both predicted on folds not trained on."""
    rows = stage(df.select(key, *columns, F.col(treatment).cast("double").alias("_t"), F.col(outcome).cast("double").alias("_y"),
                           bucket(F.col(key), k, 3).alias("_fold")), "double")
    enc = encode(rows, "_y", "regression", columns)
    parts = None
    for f in range(k):
        train, test = enc.apply(rows.filter(F.col("_fold") != f)), enc.apply(rows.filter(F.col("_fold") == f))
        out = test
        for c in ("_y", "_t"):
            fitted = estimator(model, "regression").fit(train.select("features", F.col(c).alias("label")))
            out = fitted.transform(out).withColumn(f"r{c}", F.col(c) - F.col("prediction")).drop("prediction")
        out = out.select("r_y", "r_t")
        parts = out if parts is None else parts.unionByName(out)
    parts = stage(parts, "residuals")
    slope = single(parts.agg((F.sum(F.col("r_y") * F.col("r_t")) / F.sum(F.col("r_t") ** 2)).alias("b")))
    e = F.col("r_y") - slope["b"] * F.col("r_t")
    out = parts.agg(F.max(slope["b"]).alias("ate"), (F.sqrt(F.sum((e * F.col("r_t")) ** 2)) / F.sum(F.col("r_t") ** 2)).alias("se"))
    return _effect(out, "double ML")


def covariate_balance(df: DataFrame, treatment: str, columns: list[str], p: str = "propensity") -> DataFrame:
    """Standardised mean differences before and after weighting, from one pass."""
    t = F.col(treatment) == 1
    w = F.when(t, 1 / F.col(p)).otherwise(1 / (1 - F.col(p)))
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        side = lambda v, on: F.when(on, v)
        m1, m0 = F.avg(side(x, t)), F.avg(side(x, ~t))
        sd = F.sqrt((F.var_samp(side(x, t)) + F.var_samp(side(x, ~t))) / 2)
        a1, a0 = (F.sum(side(w * x, on)) / F.sum(side(w, on)) for on in (t, ~t))
        cells.append(F.struct(F.lit(c).alias("covariate"), (F.abs(F.try_divide(m1 - m0, sd))).alias("b"), F.abs(F.try_divide(a1 - a0, sd)).alias("a")))
    out = df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
    return out.select("covariate", F.round("b", 4).alias("smd_before"), F.round("a", 4).alias("smd_after"), (F.col("a") < 0.1).alias("balanced"))


def propensity_histogram(df: DataFrame, treatment: str, p: str = "propensity", bins: int = 20) -> DataFrame:
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return df.groupBy(at.alias("bin")).agg(F.count_if(F.col(treatment) == 1).alias("treated"), F.count_if(F.col(treatment) != 1).alias("control"))


# --- calibration ----------------------------------------------------------------------------------


def calibrate(df: DataFrame, y: str, p: str, method: str = "platt", name: str = "calibrated") -> DataFrame:
    """Platt (logistic on the score) or isotonic calibration.

    Isotonic is fitted on one weighted point per distinct score.
    """
    if method == "isotonic":
        points = df.select(F.col(p).cast("double").alias("features"), (F.col(y) == 1).cast("double").alias("_y")).groupBy("features").agg(
            F.avg("_y").alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
        )
        model = IsotonicRegression(weightCol="weight", predictionCol=name).fit(points)
        return model.transform(df.withColumn("features", F.col(p).cast("double"))).drop("features")
    ready = VectorAssembler(inputCols=[p], outputCol="_f").transform(df.withColumn("_y", (F.col(y) == 1).cast("double")))
    model = LogisticRegression(featuresCol="_f", labelCol="_y").fit(ready)
    out = model.transform(ready).withColumn(name, F.element_at(vector_to_array("probability"), 2))
    return out.select(*df.columns, name)


# --- several labels -------------------------------------------------------------------------------


def multilabel_predict(df: DataFrame, key: str, labels: list[str], columns: list[str], strategy: str = "relevance", model: str = "tree") -> DataFrame:
    """Add ``pred_<label>`` by one model per label, by a chain of models, or by one model of label sets."""
    data = stage(df.select(key, *columns, *[F.col(c).cast("int").alias(c) for c in labels]), "labels")
    if strategy == "powerset":
        rows = data.withColumn("_set", F.concat_ws("", *[F.col(c).cast("string") for c in labels]))
        enc = encode(rows, "_set", "classification", columns)
        fitted = estimator(model, "classification", len(enc.classes)).fit(enc.labelled(rows).select("features", "label"))
        out = fitted.transform(enc.apply(rows)).withColumn("_p", enc.class_of(F.col("prediction")))
        return out.select(key, *labels, *[F.substring("_p", i + 1, 1).cast("int").alias(f"pred_{c}") for i, c in enumerate(labels)])
    done, known = data, []
    for c in labels:
        # in a chain the labels before are features: true ones to train, predicted ones to apply
        seen = data.withColumns({f"pred_{k}": F.col(k) for k in known}) if strategy == "chain" else data
        used = columns + ([f"pred_{k}" for k in known] if strategy == "chain" else [])
        enc = encode(seen, c, "classification", used)
        fitted = estimator(model, "classification", 2).fit(enc.labelled(seen).select("features", "label"))
        scored = fitted.transform(enc.apply(done)).withColumn(f"pred_{c}", enc.class_of(F.col("prediction")).cast("int"))
        done = scored.select(*done.columns, f"pred_{c}")
        known.append(c)
    return done.select(key, *labels, *[f"pred_{c}" for c in labels])
