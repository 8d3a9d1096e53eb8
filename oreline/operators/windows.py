"""Moving, ranking and cumulative columns. A series may be of any length: see ``functions.ordered``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.functions.core import as_list
from oreline.functions.ordered import forward_filled, positions, running_sums, with_history


def numbered_series(df: DataFrame, order, by=None, name: str = "position") -> DataFrame:
    return positions(df, order, by, name)


def moving_average(df: DataFrame, value: str, window: int, position: str, by=None, name="moving_avg") -> DataFrame:
    """Mean of up to ``window`` values ending at the row."""
    return with_history(
        df, position, window - 1, {name: lambda w: F.avg(value).over(w.rowsBetween(-(window - 1), 0))}, by
    )


def lagged_moving_average(df: DataFrame, value: str, window: int, position: str, by=None, name="lagged_avg") -> DataFrame:
    """Mean of up to ``window`` values before the row."""
    return with_history(df, position, window, {name: lambda w: F.avg(value).over(w.rowsBetween(-window, -1))}, by)


def rolling_mean(df: DataFrame, value: str, window: int, position: str, by=None, name="rolling_mean") -> DataFrame:
    """Mean of exactly ``window`` values, NULL until that many exist."""

    def make(w):
        frame = w.rowsBetween(-(window - 1), 0)
        return F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))

    return with_history(df, position, window - 1, {name: make}, by)


def lagged(df: DataFrame, value: str, k: int, position: str, by=None, name="lag") -> DataFrame:
    return with_history(df, position, k, {name: lambda w: F.lag(value, k).over(w)}, by)


def forward_fill(df: DataFrame, value: str, order, by=None, name=None) -> DataFrame:
    return forward_filled(df, value, order, by, name)


def running_total(df: DataFrame, value: str, order, by=None, name="running_total") -> DataFrame:
    return running_sums(df, order, {name: value}, by)


def rank_rows(df: DataFrame, order: list[Column], by=None, name="rank") -> DataFrame:
    """1..n after a sort, for result tables such as leaderboards (their size is the number of models)."""
    number = F.row_number().over(Window.partitionBy(*as_list(by)).orderBy(*order))
    return df.withColumn(name, number.cast("bigint"))


def running_best(df: DataFrame, value: str, order, by=None, name="best_so_far") -> DataFrame:
    """Highest value so far, for trial logs."""
    spec = Window.partitionBy(*as_list(by)).orderBy(*as_list(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(value).over(spec))


def cumulative_share(df: DataFrame, share: str, order: str, reach: float = 0.9) -> DataFrame:
    """Running share of a component table and whether this row is the first to reach ``reach``."""
    spec = Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("cumulative", F.sum(share).over(spec))
    before = F.col("cumulative") - F.col(share)
    return summed.withColumn("reaches", (F.col("cumulative") >= reach) & (before < reach))


def last_n_average(df: DataFrame, value: str, order: list[str], n: int, by=None, name="recent_avg") -> DataFrame:
    """Mean of the newest ``n`` rows of each group; each task sends at most n rows of a group on."""
    by = as_list(by)
    spec = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    newest = df.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") <= n)
    return newest.groupBy(*by).agg(F.avg(value).alias(name), F.count(F.lit(1)).alias("n"))


def share_of_total(df: DataFrame, key: str, places: int = 1) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.round(100.0 * F.col("n") / total, places))


def half_means(df: DataFrame, value: str, position: str, by=None) -> DataFrame:
    """Means of the first ``floor(n/2)`` positions and of the rest."""
    by = as_list(by)
    sizes = df.groupBy(*by).agg((F.max(position) + 1).alias("_n"))
    sized = df.join(sizes, by) if by else df.withColumn("_n", sizes.scalar())
    early = F.col(position) < F.floor(F.col("_n") / 2)
    return sized.groupBy(*by).agg(
        F.avg(F.when(early, F.col(value))).alias("first_half"),
        F.avg(F.when(~early, F.col(value))).alias("second_half"),
    )


def position_in_cycle(df: DataFrame, position: str, period: int, name="cycle") -> DataFrame:
    return df.withColumn(name, F.pmod(F.col(position), F.lit(period)))
