"""Time series, many at once: trend, seasonality, decomposition, anomalies and forecasts.

A prepared series has the columns ``series, period, value, position``. Nothing here needs a whole series
in one task: look-backs run on chunks (``functions.ordered.with_history``) and the rest are aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from oreline.functions.core import dtype, ladder, number
from oreline.functions.ordered import positions, with_history
from oreline.session import stage

# Seasonal lags looked at, with the names given to them.
LAGS = {4: "quarterly", 6: "semestral", 7: "weekly", 12: "monthly", 24: "daily", 52: "annual"}
SEASONAL_FROM = 0.35


def prepare_series(df: DataFrame, value: str, ts: str, by: str | None = None, tie: str | None = None) -> DataFrame:
    """Read the values, drop the missing ones and number each series by time."""
    rows = df.select(
        (F.col(by).cast("string") if by else F.lit("all")).alias("series"), F.col(ts).alias("period"),
        number(df, value).alias("value"), *([F.col(tie).alias("_tie")] if tie else []),
    ).filter(F.col("value").isNotNull() & F.col("period").isNotNull())
    order = ["period", "_tie"] if tie else ["period", "value"]
    return stage(positions(rows, order, "series").drop("_tie"), "series")


def describe(s: DataFrame) -> DataFrame:
    """Size, moments, least-squares line on the position and means of both halves, per series."""
    base = s.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.coalesce(F.regr_slope("value", "position"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("value", "position"), F.avg("value")).alias("intercept"),
    )
    early = F.col("position") < F.floor(F.col("n") / 2)
    halves = s.join(base.select("series", "n"), "series").groupBy("series").agg(
        F.avg(F.when(early, F.col("value"))).alias("first_half"), F.avg(F.when(~early, F.col("value"))).alias("second_half")
    )
    return base.join(halves, "series")


def autocorrelations(s: DataFrame, lags: list[int]) -> DataFrame:
    """``(series, n, ac_<lag> …)`` with the common denominator of the biased estimate."""
    means = s.groupBy("series").agg(F.avg("value").alias("_m"), F.count(F.lit(1)).alias("n"))
    away = s.join(means, "series").withColumn("_d", F.col("value") - F.col("_m"))
    looks = {f"_l{k}": (lambda w, k=k: F.lag("_d", k).over(w)) for k in lags}
    seen = with_history(away.select("series", "position", "n", "_d"), "position", max(lags), looks, "series")
    return seen.groupBy("series").agg(
        F.max("n").alias("n"),
        *[
            F.coalesce(F.try_divide(F.sum(F.col("_d") * F.col(f"_l{k}")), F.sum(F.col("_d") * F.col("_d"))), F.lit(0.0)).alias(f"ac_{k}")
            for k in lags
        ],
    )


def seasonality(s: DataFrame) -> DataFrame:
    """Strongest candidate lag below half the length; detected above 0.35."""
    ac = autocorrelations(s, list(LAGS))
    fits = F.filter(
        F.array(*[F.struct(F.col(f"ac_{k}").alias("ac"), F.lit(-k).alias("neg")) for k in LAGS]),
        lambda x: (-x["neg"] < F.col("n") / 2) & (x["ac"] > 0),
    )
    best = F.array_max(fits)
    out = ac.select("series", F.coalesce(best["ac"], F.lit(0.0)).alias("strength"), F.coalesce(-best["neg"], F.lit(0)).alias("lag"))
    found = F.col("strength") > SEASONAL_FROM
    return out.select(
        "series", found.alias("detected"), F.when(found, F.col("lag")).otherwise(0).alias("period"),
        F.when(found, ladder([(F.col("lag") == k, n) for k, n in LAGS.items()], "seasonal")).otherwise("none").alias("type"),
        F.round("strength", 3).alias("strength"),
    )


def trend(s: DataFrame) -> DataFrame:
    d = describe(s).join(seasonality(s).select("series", "detected"), "series")
    flat = (F.abs(F.col("slope") * (F.col("n") - 1)) < 0.5 * F.col("std")) | (F.col("std") == 0)
    return d.select(
        "series", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
        ladder([(flat & F.col("detected"), "cyclical"), (flat, "stable"), (F.col("slope") > 0, "ascending")], "descending").alias("trend"),
    )


def stationarity(s: DataFrame) -> DataFrame:
    still = (F.col("std") == 0) | (F.abs(F.col("second_half") - F.col("first_half")) < 0.5 * F.col("std"))
    return describe(s).select("series", "n", still.alias("stationary"))


def decompose(s: DataFrame, window: int = 7) -> DataFrame:
    """Trend by a trailing mean, seasonal part by position in the cycle, and what is left."""
    season = seasonality(s).select("series", "detected", F.when(F.col("detected"), F.col("period")).otherwise(window).alias("_p"))
    widths = sorted({max(k, window) for k in LAGS} | {window})
    means = {f"_ma{k}": (lambda w, k=k: F.avg("value").over(w.rowsBetween(-(k - 1), 0))) for k in widths}
    ma = with_history(s.join(season, "series"), "position", max(widths) - 1, means, "series")
    wide = F.greatest(F.col("_p"), F.lit(window))
    pick = F.coalesce(*[F.when(wide == k, F.col(f"_ma{k}")) for k in widths])
    rows = ma.select(
        "series", "period", "value", "position", "detected", pick.alias("trend"), F.pmod("position", F.col("_p")).alias("cycle")
    ).withColumn("_d", F.col("value") - F.col("trend"))
    cycles = rows.groupBy("series", "cycle").agg(F.avg(F.when(F.col("detected"), F.col("_d"))).alias("_s"))
    return rows.join(cycles, ["series", "cycle"]).select(
        "series", "period", "position", "value", "trend", F.coalesce("_s", F.lit(0.0)).alias("seasonal"),
        (F.col("_d") - F.coalesce("_s", F.lit(0.0))).alias("residual"),
    )


def anomalies(parts: DataFrame) -> DataFrame:
    """Rows of a decomposition whose residual is beyond two standard deviations."""
    sd = parts.groupBy("series").agg(F.stddev_samp("residual").alias("_sd"))
    z = F.coalesce(F.try_divide(F.col("residual"), F.col("_sd")), F.lit(0.0))
    out = parts.join(sd, "series").withColumn("z", z).filter(F.abs("z") > 2)
    return out.select(
        "series", "period", "position", F.round("value", 3).alias("value"),
        F.round(F.col("trend") + F.col("seasonal"), 3).alias("expected"), F.round("z", 2).alias("z_score"),
        ladder([(F.abs("z") > 3, "high"), (F.abs("z") > 2.5, "medium")], "low").alias("severity"),
    )


# --- Holt -----------------------------------------------------------------------------------------


def _steps(alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """The recurrence of (level, trend) as an affine map: what it makes of the state before, and of the value."""
    if not (0 < alpha < 1 and 0 < beta < 1):
        raise ValueError("alpha and beta must lie between 0 and 1")
    return np.array([[1 - alpha, 1 - alpha], [-alpha * beta, beta * (1 - alpha) + 1 - beta]]), np.array([alpha, alpha * beta])


def affine_scan(values: np.ndarray, turn: np.ndarray, push: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All states of ``s = turn @ s + push * value`` from ``start`` on, one per value.

    The maps are composed by doubling: after each round a state holds what twice as many values did to it.
    """
    states = np.concatenate([start[None, :], values[:, None] * push[None, :]])
    power, reach = turn.copy(), 1
    while reach < len(states):
        states[reach:] = states[reach:] + states[:-reach] @ power.T
        power, reach = power @ power, 2 * reach
    return states[1:]


def holt(s: DataFrame, alpha: float = 0.4, beta: float = 0.15, chunk: int = 8192) -> DataFrame:
    """One-step fit of level and trend with the state after every row.

    The recurrence is an affine map, so a chunk of a series is one, too: chunks are summed up on their own, the states at their
    starts follow from a row per chunk, and each chunk is then run from its start. Exact for any length, with no chunk twice.
    """
    turn, push = _steps(alpha, beta)
    chunk = max(chunk, 2)
    rows = s.select("series", "position", "value", F.floor(F.col("position") / chunk).cast("bigint").alias("chunk"))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("position")["value"].to_numpy(dtype=float)
        head = [v[0], v[1] - v[0] if len(v) > 1 else 0.0]
        rest = v[1:] if pdf["chunk"].iat[0] == 0 else v  # the first value is a state, not a step
        ends = affine_scan(rest, turn, push, np.zeros(2))[-1] if len(rest) else np.zeros(2)
        return pd.DataFrame([(pdf["series"].iat[0], pdf["chunk"].iat[0], len(rest), *ends, *head)], columns=["series", "chunk", "n", "level", "slope", "first", "rise"])

    kind = dtype(s, "series").simpleString()
    sums = rows.groupBy("series", "chunk").applyInPandas(summed, f"series {kind}, chunk bigint, n bigint, level double, slope double, first double, rise double")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:  # a row per chunk of a series
        pdf = pdf.sort_values("chunk")
        state, out = pdf[["first", "rise"]].to_numpy()[0], []
        for n, end in zip(pdf["n"], pdf[["level", "slope"]].to_numpy()):
            out.append(state)
            state = np.linalg.matrix_power(turn, int(n)) @ state + end
        return pd.DataFrame({"series": pdf["series"], "chunk": pdf["chunk"], "level0": [o[0] for o in out], "slope0": [o[1] for o in out]})

    begun = sums.groupBy("series").applyInPandas(starts, f"series {kind}, chunk bigint, level0 double, slope0 double")

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        v, start = pdf["value"].to_numpy(dtype=float), pdf[["level0", "slope0"]].to_numpy()[0]
        if pdf["chunk"].iat[0] == 0:
            states = np.concatenate([start[None, :], affine_scan(v[1:], turn, push, start)])
            fit = np.concatenate([v[:1], states[:-1, 0] + states[1:, 1]])
        else:
            states = affine_scan(v, turn, push, start)
            fit = np.concatenate([start[:1], states[:-1, 0]]) + states[:, 1]
        return pdf[["series", "position", "value"]].assign(fitted=fit, level=states[:, 0], slope=states[:, 1])

    return rows.join(begun, ["series", "chunk"]).groupBy("series", "chunk").applyInPandas(
        smooth, f"series {kind}, position bigint, value double, fitted double, level double, slope double"
    )


# --- forecasts ------------------------------------------------------------------------------------


def _sizes(s: DataFrame) -> DataFrame:
    return s.groupBy("series").agg(F.count(F.lit(1)).alias("n"))


def fitted_linear(s: DataFrame) -> DataFrame:
    line = describe(s).select("series", "slope", "intercept")
    return s.join(line, "series").select(
        "series", "position", "value", (F.col("intercept") + F.col("slope") * F.col("position")).alias("fitted")
    )


def fitted_moving_avg(s: DataFrame, window: int = 7) -> DataFrame:
    seen = with_history(s, "position", window, {"_a": lambda w: F.avg("value").over(w.rowsBetween(-window, -1))}, "series")
    return seen.select("series", "position", "value", F.coalesce("_a", "value").alias("fitted"))


def fitted_seasonal_naive(s: DataFrame) -> DataFrame:
    """The value one period back; series without a season are left to Holt."""
    season = seasonality(s).filter("detected").select("series", F.col("period").alias("_p"))
    looks = {f"_l{k}": (lambda w, k=k: F.lag("value", k).over(w)) for k in LAGS}
    seen = with_history(s.join(season, "series"), "position", max(LAGS), looks, "series")
    back = F.coalesce(*[F.when(F.col("_p") == k, F.col(f"_l{k}")) for k in LAGS], F.col("value"))
    naive = seen.select("series", "position", "value", back.alias("fitted"))
    rest = holt(s.join(season, "series", "left_anti")).select("series", "position", "value", "fitted")
    return naive.unionByName(rest)


def fitted(s: DataFrame, model: str = "exp_smoothing", window: int = 7) -> DataFrame:
    if model == "linear_trend":
        return fitted_linear(s)
    if model == "moving_avg":
        return fitted_moving_avg(s, window)
    if model == "seasonal_naive":
        return fitted_seasonal_naive(s)
    return holt(s).select("series", "position", "value", "fitted")


def _holt_ahead(s: DataFrame, steps: DataFrame) -> DataFrame:
    last = holt(s).groupBy("series").agg(F.max_by(F.struct("level", "slope"), "position").alias("_s"))
    return steps.join(last, "series").select("series", "h", (F.col("_s.level") + (F.col("h") + 1) * F.col("_s.slope")).alias("forecast"))


def forecast_values(s: DataFrame, model: str = "exp_smoothing", horizon: int = 12, window: int = 7) -> DataFrame:
    """``(series, h, forecast)`` for h = 0 … horizon - 1."""
    sizes = _sizes(s)
    steps = sizes.select("series", "n", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"))
    if model == "linear_trend":
        line = describe(s).select("series", "slope", "intercept")
        return steps.join(line, "series").select("series", "h", (F.col("intercept") + F.col("slope") * (F.col("n") + F.col("h"))).alias("forecast"))
    if model == "moving_avg":
        level = s.join(sizes, "series").filter(F.col("position") >= F.col("n") - window).groupBy("series").agg(F.avg("value").alias("forecast"))
        return steps.join(level, "series").select("series", "h", "forecast")
    if model == "seasonal_naive":
        season = seasonality(s).filter("detected").select("series", F.col("period").alias("_p"))
        at = (F.col("n") - F.col("_p") + F.pmod(F.col("h"), F.col("_p"))).alias("position")
        want = steps.join(season, "series").select("series", "h", at)
        tail = s.select("series", "position", F.col("value").alias("forecast"))
        naive = want.join(tail, ["series", "position"]).select("series", "h", "forecast")
        plain = s.join(season, "series", "left_anti")
        return naive.unionByName(_holt_ahead(plain, steps.join(season, "series", "left_anti")))
    return _holt_ahead(s, steps)


def forecast_errors(fit: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE (non-zero actuals only) in sample from the second row on."""
    e = F.col("value") - F.col("fitted")
    return fit.filter("position >= 1").groupBy("series").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.coalesce(100 * F.avg(F.when(F.col("value") != 0, F.abs(e / F.nullif("value", F.lit(0.0))))), F.lit(0.0)).alias("mape"),
    )


def next_periods(s: DataFrame, horizon: int = 12) -> DataFrame:
    """Labels after the last period, as far apart as the last two."""
    kind = s.schema["period"].dataType
    last = s.join(_sizes(s), "series").filter(F.col("position") >= F.col("n") - 2).groupBy("series").agg(
        F.max_by("period", "position").alias("_b"), F.min_by("period", "position").alias("_a")
    ).select("series", "_a", "_b", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        a, b = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("_a", "_b"))
        step = F.when(b > a, b - a).otherwise(F.lit(86_400_000_000))
        label = F.date_format(F.timestamp_micros(b + step * (F.col("h") + 1)), "yyyy-MM-dd")
    elif isinstance(kind, T.NumericType):
        step = F.when(F.col("_b") != F.col("_a"), F.col("_b") - F.col("_a")).otherwise(1)
        label = F.round(F.col("_b") + step * (F.col("h") + 1), 2).cast("string")
    else:
        label = F.concat(F.lit("t+"), (F.col("h") + 1).cast("string"))
    return last.select("series", "h", label.alias("next_period"))


def forecast(s: DataFrame, model: str = "exp_smoothing", horizon: int = 12, window: int = 7) -> DataFrame:
    """Forecasts with labels, bounds of ±1.96 residual deviations growing with the root of the step, and confidence."""
    res = decompose(s, window).groupBy("series").agg(F.stddev_samp("residual").alias("_rs"))
    err = forecast_errors(fitted(s, model, window)).select("series", "rmse")
    sd = describe(s).select("series", "std")
    ahead = forecast_values(s, model, horizon, window).join(next_periods(s, horizon), ["series", "h"])
    spread = res.join(err, "series").join(sd, "series").select(
        "series",
        (1.96 * F.coalesce(F.nullif("_rs", F.lit(0.0)), F.nullif("rmse", F.lit(0.0)), F.col("std") * 0.1)).alias("_band"),
    )
    wide = F.col("_band") * F.sqrt(F.col("h") + 1)
    return ahead.join(spread, "series").select(
        "series", "h", "next_period", F.round("forecast", 3).alias("value"),
        F.round(F.col("forecast") - wide, 3).alias("lower_bound"), F.round(F.col("forecast") + wide, 3).alias("upper_bound"),
        F.round(F.greatest(F.lit(0.5), 0.95 - 0.03 * F.col("h")), 2).alias("confidence"),
    )
