"""Ranking features by filter scores and forest importance."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, functions as F

from oreline.functions.core import is_missing, is_numeric, pearson
from oreline.operators.features import bin_width
from oreline.operators.hypothesis import anova_oneway, chi2_independence
from oreline.operators.aggregates import crosstab
from oreline.operators.learning import encode, estimator
from oreline.session import stage


def mutual_information(df: DataFrame, a: str, b: str) -> float:
    """In nats, from the contingency table."""
    cells = crosstab(df, a, b)
    n = cells.agg(F.sum("n")).scalar()
    ra, rb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    p = F.col("n") / n
    part = p * F.ln(F.col("n") * n.cast("double") / (F.col("na") * F.col("nb")))
    return cells.join(ra, "a").join(rb, "b").agg(F.sum(part)).first()[0] or 0.0


def inflation(df: DataFrame, numbers: list[str]) -> dict[str, float]:
    """Variance inflation of each number by the others: ``1 / (1 - R²)`` from one pass for all covariances of complete rows."""
    if len(numbers) < 2:
        return {}
    whole = reduce(and_, [~is_missing(df, c) for c in numbers])
    cells = {(i, j): F.covar_pop(f"_x{i}", f"_x{j}").alias(f"c{i}_{j}") for i in range(len(numbers)) for j in range(i + 1)}
    one = df.filter(whole).select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(numbers)]).agg(*cells.values()).first()
    cov = np.array([[one[f"c{max(i, j)}_{min(i, j)}"] for j in range(len(numbers))] for i in range(len(numbers))], dtype=float)
    spread = np.sqrt(np.diag(cov))
    r = cov / np.outer(np.where(spread > 0, spread, 1.0), np.where(spread > 0, spread, 1.0))
    out = {}
    for i, c in enumerate(numbers):
        others = [j for j in range(len(numbers)) if j != i and spread[j] > 0]
        explained = float(r[i, others] @ np.linalg.pinv(r[np.ix_(others, others)], hermitian=True) @ r[i, others]) if others else 0.0
        out[c] = 1 / max(1 - explained, 1e-9)
    return out


def select_features(df: DataFrame, target: str, task: str, columns: list[str]) -> DataFrame:
    """Chi-square and mutual information (classes) or Pearson and F (numbers), forest importance and VIF.

    Numbers are cut into ten bins for the contingency tables. The best 60 %, at least three, are selected.
    """
    df = stage(df.select(*columns, target), "select")
    enc = encode(df, target, task, columns)
    ready = stage(enc.labelled(df).select("features", "label"), "select-encoded")  # the forest reads it several times
    model = estimator("forest", task, len(enc.classes)).fit(ready)
    weight: dict[str, float] = {c: 0.0 for c in columns}
    for owner, v in zip(enc.owners, model.featureImportances.toArray()):
        weight[owner] = weight.get(owner, 0.0) + float(v)
    numbers = [c for c in columns if is_numeric(df, c)]
    vif = inflation(df, numbers)
    against = {}
    if task != "classification" and numbers:
        y = F.col(target).cast("double")
        against = df.agg(F.count(F.lit(1)).alias("_n"), *[pearson(F.col(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(numbers)]).first()
    rows = []
    for c in columns:
        if task == "classification":
            binned = bin_width(df, c, 10, "_bin") if c in numbers else df.withColumn("_bin", F.col(c))
            test = chi2_independence(binned.withColumn("_t", F.col(target)), "_bin", "_t").first()
            first, second = (test.statistic if test else 0.0), mutual_information(binned, "_bin", target)
        elif c in numbers:
            r, n = against[f"r{numbers.index(c)}"], against["_n"]
            first, second = abs(r), (r * r * (n - 2) / (1 - r * r) if abs(r) < 1 else float("inf"))
        else:
            test = anova_oneway(df, target, c).first()
            first, second = 0.0, test.statistic if test else 0.0
        rows.append((c, round(first, 4), round(second, 4), round(weight[c], 4), round(vif[c], 4) if c in vif else None))
    rows.sort(key=lambda r: (-r[3], r[0]))
    keep = max(3, round(0.6 * len(rows)))
    names = ("chi2", "mutual_information") if task == "classification" else ("correlation", "f_statistic")
    return df.sparkSession.createDataFrame(
        [(*r, i < keep) for i, r in enumerate(rows)],
        f"feature string, {names[0]} double, {names[1]} double, forest_importance double, vif double, selected boolean",
    )
