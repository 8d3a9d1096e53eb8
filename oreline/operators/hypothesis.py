"""Classical tests: each reduces the table to a few sums on Spark, then one row gets its p-value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.functions.core import is_missing, ladder, number, pearson, single
from oreline.functions.tails import chi2_p, f_p, t_p
from oreline.operators.aggregates import crosstab
from oreline.operators.quality import strength


def significance_label(p: Column) -> Column:
    return ladder([(p < 0.001, "very high"), (p < 0.01, "high"), (p < 0.05, "significant")], "not significant")


def _judged(df: DataFrame, p: Column, alpha: float, *raw: str) -> DataFrame:
    """Add the p-value, judge it unrounded, then round the reported numbers to four places."""
    out = df.withColumn("_p", p).withColumns(
        {"significant": F.col("_p") < alpha, "significance": significance_label(F.col("_p")), "p_value": F.round("_p", 4)}
    )
    return out.withColumns({c: F.round(c, 4) for c in raw}).drop("_p")


def _groups(df: DataFrame, value: str, group: str) -> DataFrame:
    x = number(df, value)
    return df.filter(x.isNotNull() & ~is_missing(df, group)).groupBy(F.col(group).cast("string").alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")
    ).filter("n >= 2")


def t_test_welch(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """The two largest groups; no variance at all gives t = 0."""
    top = _groups(df, value, group).orderBy(F.desc("n"), "g").limit(2)
    ranked = top.withColumn("_r", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "g")))
    pick = [
        F.max(F.when(F.col("_r") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("g", "n", "m", "v")
    ]
    one = ranked.agg(*pick).filter("n2 IS NOT NULL")
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    se = F.sqrt(e1 + e2)
    welch = F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    out = one.select(
        F.col("g1").alias("group_a"), F.col("g2").alias("group_b"), F.col("n1").alias("n_a"), F.col("n2").alias("n_b"),
        F.col("m1").alias("mean_a"), F.col("m2").alias("mean_b"), F.sqrt("v1").alias("sd_a"), F.sqrt("v2").alias("sd_b"),
        F.coalesce(F.try_divide(F.col("m1") - F.col("m2"), se), F.lit(0.0)).alias("statistic"),
        F.coalesce(welch, (F.col("n1") + F.col("n2") - 2).cast("double")).alias("df"),
    )
    return _judged(out, t_p(F.abs("statistic"), F.col("df")), alpha, "statistic", "df", "mean_a", "mean_b", "sd_a", "sd_b")


def anova_oneway(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    g = _groups(df, value, group)
    whole = single(g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand")))
    away = F.col("m") - whole["grand"]
    sums = g.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * away * away).alias("ssb"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"),
    ).filter("k >= 2")
    msb, msw = F.col("ssb") / (F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))
    out = sums.select(
        F.coalesce(F.try_divide(msb, msw), F.lit(0.0)).alias("statistic"), (F.col("k") - 1).alias("df1"),
        (F.col("n") - F.col("k")).alias("df2"),
    )
    return _judged(out, f_p(F.col("statistic"), F.col("df1").cast("double"), F.col("df2").cast("double")), alpha, "statistic")


def chi2_independence(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Expected counts come from the margins; cells without any row add their expectation."""
    cells = crosstab(df, a, b)
    rows = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("cb"))
    size = single(
        cells.agg(F.sum("n").alias("n"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"))
    )
    # sum over all cells of (o-e)^2/e equals n * (sum over filled cells of o^2 / (row * col)) - n
    part = cells.join(rows, "a").join(cols, "b").agg(
        F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb").cast("double"))).alias("s")
    )
    n, ka, kb = size["n"], size["ka"], size["kb"]
    out = part.select(
        n.alias("n"), (n * F.col("s") - n).alias("statistic"), ((ka - 1) * (kb - 1)).alias("df"), ka.alias("ka"), kb.alias("kb")
    ).filter("n >= 5 AND ka >= 2 AND kb >= 2")
    out = out.withColumn(
        "cramers_v", F.sqrt(F.col("statistic") / (F.col("n") * (F.least("ka", "kb") - 1)))
    ).drop("ka", "kb")
    return _judged(out, chi2_p(F.col("statistic"), F.col("df").cast("double")), alpha, "statistic", "cramers_v")


def jarque_bera(df: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    x = number(df, value)
    m = df.select(x.alias("x")).dropna().agg(
        F.count(F.lit(1)).alias("n"), F.skewness("x").alias("skewness"), (F.kurtosis("x") + 3).alias("kurtosis")
    ).filter("n >= 8")
    out = m.withColumn(
        "statistic", F.col("n") / 6.0 * (F.col("skewness") ** 2 + (F.col("kurtosis") - 3) ** 2 / 4.0)
    )
    return _judged(out, F.exp(-F.col("statistic") / 2), alpha, "statistic", "skewness", "kurtosis")


def correlation_test(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    both = df.select(number(df, a).alias("x"), number(df, b).alias("y")).dropna()
    one = both.agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col("x"), F.col("y")).alias("r"),
    ).filter("n >= 4")
    exact = F.abs("r") >= 1 - 1e-12
    t = F.when(~exact, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    out = one.withColumns({"statistic": t, "df": F.col("n") - 2, "strength": strength(F.col("r"))})
    p = F.when(exact, F.lit(0.0)).otherwise(t_p(F.abs("statistic"), F.col("df").cast("double")))
    return _judged(out, p, alpha, "statistic", "r")
