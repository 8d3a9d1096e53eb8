"""Aggregations, distributions and class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions.core import as_list, is_missing, ladder, number, ordered_struct, present, single
from oreline.functions.ordered import element_at_rank


def aggregate(df: DataFrame, fn: str, name: str = "*") -> Column:
    """COUNT, SUM, AVG, MIN or MAX over what reads as a number, rounded to four places."""
    fn = fn.lower()
    if fn == "count":
        return F.count(F.lit(1)) if name == "*" else F.count_if(~is_missing(df, name))
    over = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn]
    return F.round(over(number(df, name)), 4)


def group_by(
    df: DataFrame, keys, aggregates: dict[str, tuple[str, str]], firsts=None, order=None
) -> DataFrame:
    """Group on the keys (missing is a group of its own); ``firsts`` are taken from the group's first row.

    Without keys the result is exactly one row, also for an empty table.
    """
    outputs = [aggregate(df, fn, c).alias(n) for n, (fn, c) in aggregates.items()]
    if firsts:
        order = as_list(order)
        for c in as_list(firsts):
            outputs.append(F.min_by(F.col(c), ordered_struct(order)).alias(c) if order else F.first(c).alias(c))
    keys = as_list(keys)
    return df.groupBy(*keys).agg(*outputs) if keys else df.agg(*outputs)


def value_counts(df: DataFrame, name: str, limit: int | None = 50) -> DataFrame:
    counts = (
        df.select(present(df, name).cast("string").alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    )
    return counts if limit is None else counts.orderBy(F.desc("count"), "value").limit(limit)


def null_share(df: DataFrame, name: str, places: int = 0) -> list[Column]:
    nulls = F.count_if(is_missing(df, name))
    return [
        nulls.alias("nulls"),
        F.round(F.coalesce(F.try_divide(100.0 * nulls, F.count(F.lit(1))), F.lit(0.0)), places).alias("null_percent"),
    ]


def central(df: DataFrame, name: str, by=None) -> DataFrame:
    """Mean, exact interpolated median and mode (ties go to the smallest value), from distinct values.

    The median walks running counts of the distinct values, so no task sorts or holds a whole group.
    """
    by = as_list(by)
    counted = df.filter(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count(F.lit(1)).alias("_c"))
    basics = counted.groupBy(*by).agg(
        (F.sum(F.col(name) * F.col("_c")) / F.sum("_c")).alias("mean"),
        F.min_by(name, F.struct((-F.col("_c")).alias("c"), F.col(name).alias("v"))).alias("mode"),
        F.sum("_c").alias("n"),
    )
    middle = element_at_rank(
        df, name, {"_lo": F.floor((F.col("_n") - 1) / 2), "_hi": F.floor(F.col("_n") / 2)}, by, {"_lo": 0.5, "_hi": 0.5}
    ).withColumn("median", (F.col("_lo") + F.col("_hi")) / 2).drop("_lo", "_hi")
    if by:
        return basics.join(middle, by)
    return basics.withColumn("median", middle.select("median").scalar())


def spread(df: DataFrame, name: str, by=None) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(
        F.var_pop(name).alias("var_pop"), F.var_samp(name).alias("var_samp"),
        F.stddev_pop(name).alias("std_pop"), F.stddev_samp(name).alias("std_samp"),
    )


def order_statistic(df: DataFrame, name: str, shares: dict[str, float], by=None, exact: bool = True) -> DataFrame:
    """The element at ``floor(share * n)`` of the sorted values, or a sketch's element near it."""
    if not exact:
        return df.groupBy(*as_list(by)).agg(*[F.percentile_approx(name, p, 10_000).alias(n) for n, p in shares.items()])
    ranks = {n: F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1) for n, p in shares.items()}
    return element_at_rank(df, name, ranks, by, shares)


def histogram(df: DataFrame, name: str, bins: int = 12) -> DataFrame:
    """Equal-width bins with their counts, empty bins included; the maximum is in the last bin."""
    x = number(df, name)
    values = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    edge = single(values.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    step = F.when(edge["hi"] > edge["lo"], (edge["hi"] - edge["lo"]) / bins).otherwise(F.lit(1.0))
    counts = (
        values.select(F.least(F.floor((F.col("_x") - edge["lo"]) / step), F.lit(bins - 1)).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("_n"))
    )
    slots = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return slots.join(counts, "bin", "left").select(
        "bin", (edge["lo"] + F.col("bin") * step).alias("start"), F.coalesce("_n", F.lit(0)).alias("n")
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return (
        df.select(present(df, a).cast("string").alias("a"), present(df, b).cast("string").alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    )


def group_means(df: DataFrame, value: str, group: str) -> DataFrame:
    x = number(df, value)
    return df.filter(x.isNotNull() & ~is_missing(df, group)).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Per class its count and share, with the table's ratio, minority share and severity."""
    classes = value_counts(df, label, None).withColumnRenamed("value", "label")
    whole = single(classes.agg(F.sum("count").alias("t"), F.min("count").alias("lo"), F.max("count").alias("hi")))
    total, low, high = whole["t"], whole["lo"], whole["hi"]
    out = classes.select(
        "label", "count", F.round(100.0 * F.col("count") / total, 1).alias("pct"),
        F.round(high / low, 2).alias("ratio"), F.round(100.0 * low / total, 1).alias("minority_pct"),
        (high / low).alias("_r"), (100.0 * low / total).alias("_m"),
    )
    severe = (F.col("_r") >= 10) | (F.col("_m") < 5)
    some = (F.col("_r") >= 3) | (F.col("_m") < 15)
    return out.select(
        "label", "count", "pct", "ratio", "minority_pct", some.alias("imbalanced"),
        ladder([(severe, "severe"), (some, "moderate")], "balanced").alias("severity"),
    )


def balance_verdict(df: DataFrame, label: str) -> DataFrame:
    ratio = F.max("count") / F.min("count")
    return value_counts(df, label, None).agg(
        F.count(F.lit(1)).alias("classes"), F.round(ratio, 4).alias("ratio"),
        ladder([(ratio < 1.5, "balanced"), (ratio < 3, "slightly imbalanced"), (ratio <= 10, "imbalanced")],
               "severely imbalanced").alias("verdict"),
    )


def kpi_counts(df: DataFrame, conditions: dict[str, Column], sums: dict[str, str] | None = None, by=None) -> DataFrame:
    """Totals by condition in one pass."""
    return df.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(c).alias(n) for n, c in conditions.items()],
        *[F.round(F.sum(c), 2).alias(n) for n, c in (sums or {}).items()],
    )


def weekly_buckets(df: DataFrame, ts: str, now: Column, done: Column, weeks: int = 8) -> DataFrame:
    """Rows and finished rows per week back from ``now``, for the newest ``weeks`` weeks."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    week = F.floor(age / F.lit(7 * 86400 * 1_000_000))
    return (
        df.select(week.alias("weeks_ago"), done.alias("_done"))
        .filter(F.col("weeks_ago").between(0, weeks - 1))
        .groupBy("weeks_ago").agg(F.count(F.lit(1)).alias("total"), F.count_if("_done").alias("completed"))
    )


def bucket_distribution(df: DataFrame, score: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Counts between consecutive edges, the last one closed on the right."""
    x = F.col(score)
    steps = [(x < edges[0], None)]
    for lo, hi, label in zip(edges, edges[1:], labels):
        last = hi == edges[-1]
        steps.append(((x >= lo) & ((x <= hi) if last else (x < hi)), label))
    return (
        df.select(ladder([s for s in steps if s[1]], "outside").alias("bucket"))
        .filter(F.col("bucket") != "outside")
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def metric_pivot(df: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Long (row, column, value) to one row per ``row``; ``names`` are the wanted columns."""
    return df.groupBy(row).pivot(column, names).agg(F.first(value))
