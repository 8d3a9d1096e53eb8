"""Quality of predictions: every measure is an aggregate of a prediction table, optionally per group ``by``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.functions.core import as_list, single
from oreline.functions.ordered import running_sums
from oreline.session import stage

THRESHOLDS = [i / 20 for i in range(21)]


def confusion(df: DataFrame, label: str, prediction: str, by=None) -> DataFrame:
    return df.groupBy(*as_list(by), F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, prediction: str, by=None) -> DataFrame:
    """Precision, recall and F1 of every class that occurs."""
    by = as_list(by)
    cm = confusion(df, label, prediction, by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    real = cm.groupBy(*by, "label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    said = cm.groupBy(*by, F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    out = real.join(said, [*by, "label"], "left")
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.col("tp") / F.col("support")
    both = out.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return both.select(*by, "label", "support", "tp", "precision", "recall", f1.alias("f1"))


def class_metrics(df: DataFrame, label: str, prediction: str, by=None) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the classes that occur."""
    by = as_list(by)
    return class_report(df, label, prediction, by).groupBy(*by).agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg("precision"), 4).alias("precision"),
        F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("f1"), 4).alias("f1"), F.sum("support").alias("n"),
    )


def reg_metrics(df: DataFrame, label: str, prediction: str, by=None) -> DataFrame:
    """R², RMSE, MAE and MAPE; an actual of zero adds nothing to MAPE."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    total = F.var_pop(y) * F.count(y)
    return df.groupBy(*as_list(by)).agg(
        F.round(1 - F.sum(e * e) / F.when(total == 0, 1.0).otherwise(total), 4).alias("r2"),
        F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"), F.round(F.avg(F.abs(e)), 3).alias("mae"),
        F.round(100 * F.avg(F.coalesce(F.abs(F.try_divide(e, y)), F.lit(0.0))), 3).alias("mape"), F.count(y).alias("n"),
    )


def confusion_at_threshold(df: DataFrame, y: str, score: str, threshold: float, by=None) -> DataFrame:
    one, said = F.col(y) == 1, F.col(score) >= threshold
    c = df.groupBy(*as_list(by)).agg(
        F.count_if(one & said).alias("tp"), F.count_if(~one & said).alias("fp"),
        F.count_if(~one & ~said).alias("tn"), F.count_if(one & ~said).alias("fn"),
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    out = c.withColumns(
        {"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
         "precision": precision, "recall": recall}
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1).withColumns({m: F.round(m, 4) for m in ("accuracy", "precision", "recall", "f1")})


def threshold_counts(df: DataFrame, y: str, score: Column, by=None) -> DataFrame:
    """``(threshold, tp, fp, p, n)`` for 0, .05, … 1 in one pass: a pair of counters per threshold."""
    by, one = as_list(by), F.col(y) == 1
    rows = df.select(*by, one.alias("_y"), score.alias("_s"))
    counters = [F.count_if(F.col("_y")).alias("p"), F.count_if(~F.col("_y")).alias("n")]
    for i, t in enumerate(THRESHOLDS):
        counters += [F.count_if(F.col("_y") & (F.col("_s") >= t)).alias(f"tp{i}"), F.count_if(~F.col("_y") & (F.col("_s") >= t)).alias(f"fp{i}")]
    points = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(THRESHOLDS)]
    )
    return rows.groupBy(*by).agg(*counters).select(*by, "p", "n", F.inline(points))


def scaled_scores(df: DataFrame, score: str, by=None) -> DataFrame:
    """Scores moved to 0 … 1."""
    by = as_list(by)
    if by:
        edges = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
        joined = df.join(edges, by)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        edge = single(df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")))
        joined, lo, hi = df, edge["lo"], edge["hi"]
    return joined.withColumn("_scaled", (F.col(score) - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo))


def roc_pr_curve(df: DataFrame, y: str, score: str, by=None) -> DataFrame:
    """ROC and precision-recall points at 21 thresholds of the scaled score."""
    c = threshold_counts(scaled_scores(df, score, by), y, F.col("_scaled"), by)
    zero = F.lit(0.0)
    return c.select(
        *as_list(by), "threshold", F.coalesce(F.try_divide(F.col("fp"), F.col("n")), zero).alias("fpr"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("p")), zero).alias("tpr"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"),
    )


def auc(curve: DataFrame, by=None) -> DataFrame:
    """Trapezoid over the (21) curve points of each group."""
    by = as_list(by)
    spec = Window.partitionBy(*by).orderBy("fpr", "tpr")
    step = (F.col("fpr") - F.lag("fpr").over(spec)) * (F.col("tpr") + F.lag("tpr").over(spec)) / 2
    return curve.withColumn("_s", step).groupBy(*by).agg(F.round(F.abs(F.sum("_s")), 3).alias("auc"))


def auc_exact(df: DataFrame, y: str, score: str, by=None) -> DataFrame:
    """Area over all distinct scores: the share of (positive, negative) pairs in the right order, ties half."""
    by = as_list(by)
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    upto = running_sums(stage(counts, "scores"), ["_s"], {"neg_upto": "neg"}, by)
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    return upto.groupBy(*by).agg(F.try_divide(F.sum(won), F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def fairness(df: DataFrame, label: str, prediction: str, sensitive: str, positive, least: int = 5) -> DataFrame:
    """Accuracy, selection rate and true positive rate per group, with the gaps between groups on every row."""
    ok, said, real = F.col(label) == F.col(prediction), F.col(prediction) == positive, F.col(label) == positive
    g = df.filter(F.col(sensitive).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(sensitive).cast("string").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("double")), 4).alias("accuracy"),
        F.round(F.avg(said.cast("double")), 4).alias("selection_rate"),
        F.round(F.try_divide(F.count_if(said & real), F.count_if(real)), 4).alias("tpr"),
    ).filter(F.col("n") >= least)
    w = single(
        g.agg(
            F.count(F.lit(1)).alias("k"), F.min("accuracy").alias("a0"), F.max("accuracy").alias("a1"),
            F.min("selection_rate").alias("s0"), F.max("selection_rate").alias("s1"),
        )
    )
    impact = w["s0"] / F.when(w["s1"] == 0, 1.0).otherwise(w["s1"])
    gap = w["a1"] - w["a0"]
    return g.filter(w["k"] >= 2).select(
        "*", F.round(gap, 4).alias("accuracy_gap"), F.round(w["s1"] - w["s0"], 4).alias("selection_rate_gap"),
        F.round(impact, 4).alias("disparate_impact"), ((impact >= 0.8) & (gap <= 0.1)).alias("fair"),
    )


# --- calibration and cost -------------------------------------------------------------------------


def calibration_curve(df: DataFrame, y: str, p: str, bins: int = 10, by=None) -> DataFrame:
    """Mean prediction and share of positives per bin."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return df.groupBy(*as_list(by), at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg((F.col(y) == 1).cast("double")).alias("fraction_pos")
    )


def calibration_scores(df: DataFrame, y: str, p: str, bins: int = 10, by=None) -> DataFrame:
    """Expected calibration error and Brier score."""
    by = as_list(by)
    curve = calibration_curve(df, y, p, bins, by).groupBy(*by).agg(
        F.round(F.sum(F.col("n") * F.abs(F.col("mean_pred") - F.col("fraction_pos"))) / F.sum("n"), 4).alias("ece")
    )
    miss = F.col(p) - (F.col(y) == 1).cast("double")
    brier = df.groupBy(*by).agg(F.round(F.avg(miss * miss), 4).alias("brier"))
    return curve.join(brier, by) if by else curve.withColumn("brier", brier.scalar())


def cost_threshold(df: DataFrame, y: str, p: str, fp_cost: float = 100, fn_cost: float = 500) -> DataFrame:
    """F1 and expected cost per row at each threshold, the cheapest one, and what it saves against .5."""
    fn, n = F.col("p") - F.col("tp"), F.col("p") + F.col("n")
    c = threshold_counts(df, y, F.col(p)).select(
        "threshold",
        F.round(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn), F.lit(0.0)), 4).alias("f1"),
        ((F.col("fp") * fp_cost + fn * fn_cost) / n).alias("_cost"), n.alias("_n"),
    )
    best = single(c.agg(F.min_by("threshold", F.struct("_cost", "threshold")).alias("t"), F.min("_cost").alias("c"),
                        F.max(F.when(F.col("threshold") == 0.5, F.col("_cost"))).alias("half"), F.max("_n").alias("n")))
    return c.select(
        "threshold", "f1", F.round("_cost", 4).alias("expected_cost"), (F.col("threshold") == best["t"]).alias("optimal"),
        F.round((best["half"] - best["c"]) * best["n"], 2).alias("savings"),
    )


# --- several labels at once -----------------------------------------------------------------------


def _label_scores(df: DataFrame, labels: list[str], predictions: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("name"), F.col(a).alias("y"), F.col(b).alias("p")) for a, b in zip(labels, predictions)])
    long = df.select(F.inline(pairs))
    c = long.groupBy("name").agg(
        F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if(F.col("y") == 1).alias("support"),
        F.count_if(F.col("p") == 1).alias("said"),
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("said")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("said")), F.lit(0.0))
    return c.select("name", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def multilabel_report(df: DataFrame, labels: list[str], predictions: list[str]) -> DataFrame:
    """Precision, recall and F1 of every label."""
    out = _label_scores(df, labels, predictions)
    return out.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def multilabel_metrics(df: DataFrame, labels: list[str], predictions: list[str]) -> DataFrame:
    """Hamming loss, Jaccard, exact match and label cardinality; two empty sets agree fully."""
    ys, ps = [F.col(c) == 1 for c in labels], [F.col(c) == 1 for c in predictions]
    total = lambda cs: sum((c.cast("int") for c in cs), F.lit(0))
    wrong = total([y != p for y, p in zip(ys, ps)])
    both, either = total([y & p for y, p in zip(ys, ps)]), total([y | p for y, p in zip(ys, ps)])
    macro = _label_scores(df, labels, predictions).agg(F.avg("f1")).scalar()
    return df.agg(
        F.round(F.avg(wrong / len(labels)), 4).alias("hamming_loss"),
        F.round(F.avg(F.coalesce(F.try_divide(both, either), F.lit(1.0))), 4).alias("jaccard"),
        F.round(F.avg((wrong == 0).cast("double")), 4).alias("exact_match"), F.round(F.avg(total(ys)), 4).alias("cardinality"),
    ).withColumn("macro_f1", F.round(macro, 4))
