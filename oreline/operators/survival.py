"""Time to event: survival curves, comparison of groups, a parametric regression."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import DataFrame, functions as F

from oreline.functions.core import as_list, number, single
from oreline.functions.ordered import positions, running_sums
from oreline.functions.tails import chi2_p
from oreline.session import stage


def kaplan_meier(df: DataFrame, time: str, event: str, by=None) -> DataFrame:
    """Survival after each distinct time; the work after the first aggregate is on distinct times."""
    by = as_list(by)
    t = df.groupBy(*by, F.col(time).alias("time")).agg(
        F.count_if(F.col(event) == 1).alias("events"), F.count_if(F.col(event) != 1).alias("censored")
    ).withColumn("_gone", F.col("events") + F.col("censored"))
    sized = running_sums(stage(t, "times"), ["time"], {"_left": "_gone"}, by, {"_n": "_gone"})
    risk = sized.withColumn("at_risk", F.col("_n") - F.col("_left") + F.col("_gone"))
    stays = 1 - F.col("events") / F.col("at_risk")
    logs = risk.withColumns({"_ln": F.when(stays > 0, F.ln(F.when(stays > 0, stays))).otherwise(0.0), "_zero": (stays <= 0).cast("int")})
    out = running_sums(stage(logs.drop("_left", "_n", "_gone"), "at-risk"), ["time"], {"_sum": "_ln", "_dead": "_zero"}, by)
    return out.select(
        *by, "time", "at_risk", "events", "censored", F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_sum")).alias("survival")
    )


def median_survival(curve: DataFrame, by=None) -> DataFrame:
    """The first time at which survival is one half or less; NULL when it never is."""
    return curve.groupBy(*as_list(by)).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time"))).alias("median"))


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Chi-square test between the two values of ``group``."""
    pair = single(df.agg(F.min(group).alias("a"), F.max(group).alias("b")))
    first = F.col(group) == pair["a"]
    dead = F.col(event) == 1
    t = df.groupBy(F.col(time).alias("time")).agg(
        F.count_if(dead).alias("d"), F.count_if(dead & first).alias("da"), F.count(F.lit(1)).alias("g"), F.count_if(first).alias("ga")
    )
    upto = running_sums(stage(t, "times"), ["time"], {"_g": "g", "_ga": "ga"}, None, {"_n": "g", "_na": "ga"})
    r = upto.withColumns({"n": F.col("_n") - F.col("_g") + F.col("g"), "na": F.col("_na") - F.col("_ga") + F.col("ga")})
    share = F.col("na") / F.col("n")
    var = F.when(F.col("n") > 1, F.col("d") * share * (1 - share) * (F.col("n") - F.col("d")) / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(0.0)
    s = r.agg(F.sum("da").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(var).alias("_v"))
    x = F.coalesce(F.try_divide((F.col("observed") - F.col("expected")) ** 2, F.col("_v")), F.lit(0.0))
    out = s.withColumn("_x", x)
    return out.select(
        "observed", F.round("expected", 4).alias("expected"), F.round("_x", 4).alias("statistic"), F.round(chi2_p(F.col("_x"), F.lit(1.0)), 4).alias("p_value")
    )


def aft_regression(df: DataFrame, time: str, event: str, columns: list[str]) -> DataFrame:
    """Weibull regression: per feature the factor on survival time and the hazard ratio it implies."""
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(df.filter(F.col(time) > 0))
    ready = ready.select("features", F.col(time).cast("double").alias("label"), F.col(event).cast("double").alias("censor"))
    model = AFTSurvivalRegression(maxIter=100).fit(ready)
    rows = [(c, float(b), float(model.scale)) for c, b in zip(columns, model.coefficients)]
    out = df.sparkSession.createDataFrame(rows, "feature string, coefficient double, scale double")
    return out.select(
        "feature", F.round("coefficient", 4).alias("coefficient"), F.round(F.exp("coefficient"), 4).alias("time_ratio"),
        F.round(F.exp(-F.col("coefficient") / F.col("scale")), 4).alias("hazard_ratio"),
    )


#: Ties of one time that a row takes on at once.
TIES = 4096


def _cox_sums(rows: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood with Efron's ties, its slope and its information at ``beta``; one row comes back.

    Weights, weighted sums and weighted products are summed per time, then over all later times, so the work after the first
    aggregate is on distinct times. The failures of one time leave its risk set one after the other, each taking an equal share.
    """
    k = len(beta)
    x = [F.col(f"x{i}") for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    eta = sum((c * float(b) for c, b in zip(x, beta)), F.lit(0.0))
    w, fails = F.exp(eta), F.col("event") == 1
    moments = {"w": w, **{f"w{i}": w * x[i] for i in range(k)}, **{f"w{i}_{j}": w * x[i] * x[j] for i, j in cells}}
    each = rows.groupBy("time").agg(
        F.count_if(fails).alias("d"), F.sum(F.when(fails, eta)).alias("eta"), *[F.sum(F.when(fails, x[i])).alias(f"x{i}") for i in range(k)],
        *[F.sum(v).alias(f"s{n}") for n, v in moments.items()], *[F.sum(F.when(fails, v)).alias(f"f{n}") for n, v in moments.items()],
    )
    later = running_sums(stage(each.withColumn("_back", -F.col("time")), "risk-sets"), ["_back"], {f"r{n}": f"s{n}" for n in moments}).filter("d > 0")
    tied = later.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("d") - 1, F.lit(TIES).cast("bigint"))))
    tied = tied.repartition("time", "_from").withColumn("_nth", F.explode(F.sequence("_from", F.least(F.col("d"), F.col("_from") + TIES) - 1)))
    left = {n: F.col(f"r{n}") - F.col("_nth") / F.col("d") * F.col(f"f{n}") for n in moments}
    first = F.when(F.col("_nth") == 0, 1.0).otherwise(0.0)
    out = tied.agg(
        F.sum(first * F.col("eta") - F.ln(left["w"])),
        *[F.sum(first * F.col(f"x{i}") - left[f"w{i}"] / left["w"]) for i in range(k)],
        *[F.sum(left[f"w{i}_{j}"] / left["w"] - left[f"w{i}"] * left[f"w{j}"] / (left["w"] * left["w"])) for i, j in cells],
    ).first()
    values = [float("nan") if v is None else float(v) for v in out]
    information = np.zeros((k, k))
    for (i, j), v in zip(cells, values[1 + k :]):
        information[i, j] = information[j, i] = v
    return values[0], np.array(values[1 : 1 + k]), information


def cox_regression(df: DataFrame, time: str, event: str, columns: list[str], confidence: float = 0.95, rounds: int = 30) -> DataFrame:
    """Proportional hazards: per feature ``coefficient, std_error, z, p_value, hazard_ratio, lower, upper``.

    Newton steps on the partial likelihood with Efron's ties, halved until they help; each is one pass over the rows and one over the
    distinct times. Rows that lack the time or a feature are left out; what is not 1 in ``event`` is censored. A feature that doesn't
    vary has NULLs. Without failures, or with features that determine each other, a ``ValueError`` says so.
    """
    rows = df.select(number(df, time).alias("time"), F.col(event).cast("int").alias("event"), *[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)]).dropna(subset=["time", *[f"x{i}" for i in range(len(columns))]])
    about = rows.agg(F.count_if(F.col("event") == 1), *[f(f"x{i}") for i in range(len(columns)) for f in (F.avg, F.stddev_pop)]).first()
    if not about[0]:
        raise ValueError("no failures")
    varies = [i for i in range(len(columns)) if about[2 + 2 * i] and about[2 + 2 * i] > 0]
    spread = np.array([about[2 + 2 * i] for i in varies])
    rows = stage(rows.select("time", "event", *[((F.col(f"x{i}") - about[1 + 2 * i]) / about[2 + 2 * i]).alias(f"x{n}") for n, i in enumerate(varies)]), "cox")
    beta = np.zeros(len(varies))
    now, slope, information = _cox_sums(rows, beta)
    for _ in range(rounds if len(varies) else 0):
        try:
            step = np.linalg.solve(information, slope)
        except np.linalg.LinAlgError as e:
            raise ValueError("features determine each other") from e
        size = 1.0
        while True:
            then = _cox_sums(rows, beta + size * step)
            if then[0] >= now - 1e-12 * abs(now) or size < 1e-6:
                break
            size /= 2
        beta, done = beta + size * step, abs(then[0] - now) <= 1e-12 * (1 + abs(now)) and np.abs(size * step).max() < 1e-8
        now, slope, information = then
        if done:
            break
    errors = np.sqrt(np.diag(np.linalg.inv(information))) if len(varies) else np.zeros(0)
    reach = NormalDist().inv_cdf(0.5 + confidence / 2)
    found = {columns[i]: (float(b / s), float(e / s)) for i, b, e, s in zip(varies, beta, errors, spread)}
    out = []
    for c in columns:
        if c not in found:
            out.append((c, *[None] * 7))
            continue
        b, e = found[c]
        out.append((c, b, e, b / e, math.erfc(abs(b / e) / math.sqrt(2)), math.exp(b), math.exp(b - reach * e), math.exp(b + reach * e)))
    return df.sparkSession.createDataFrame(out, "feature string, coefficient double, std_error double, z double, p_value double, hazard_ratio double, lower double, upper double")


def concordance(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """C-index: of the pairs whose order is known, the share in which the higher risk fails first; equal risks count half.

    Exact, without making pairs. Distinct risks are numbered. A number is lower than another one if, at the first bit where
    they differ, it has a 0 and the other one a 1. So for each bit and each common prefix, the later rows with a 0 are
    counted for the failures with a 1 by running sums over time; two more levels count equal risks and all later rows.
    Rows without time or risk are left out.
    """
    rows = df.filter(F.col(time).isNotNull() & F.col(risk).isNotNull()).groupBy(F.col(time).alias("time"), F.col(risk).alias("risk")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 1).alias("e")
    )
    cells = stage(rows, "risks")
    placed = stage(positions(cells.select("risk").distinct(), "risk", None, "rank"), "ranks")
    cells = cells.join(placed, "risk")
    bits = max(1, int(placed.agg(F.max("rank")).first()[0] or 0).bit_length())
    bit = lambda b: F.shiftright("rank", b) % 2
    zero = F.lit(0).cast("bigint")
    levels = [F.struct(F.lit(b).alias("level"), F.shiftright("rank", b + 1).alias("prefix"), F.when(bit(b) == 0, F.col("n")).otherwise(zero).alias("lower"), F.when(bit(b) == 1, F.col("e")).otherwise(zero).alias("fails")) for b in range(bits)]
    levels.append(F.struct(F.lit(-1).alias("level"), F.col("rank").alias("prefix"), F.col("n").alias("lower"), F.col("e").alias("fails")))
    levels.append(F.struct(F.lit(-2).alias("level"), zero.alias("prefix"), F.col("n").alias("lower"), F.col("e").alias("fails")))
    deep = cells.select("time", F.explode(F.array(*levels)).alias("_l")).select("time", "_l.*")
    sums = deep.groupBy("level", "prefix", "time").agg(F.sum("lower").alias("lower"), F.sum("fails").alias("fails"))
    upto = running_sums(stage(sums, "levels"), ["time"], {"_upto": "lower"}, ["level", "prefix"], {"_all": "lower"})
    met = F.col("fails") * (F.col("_all") - F.col("_upto")).cast("double")
    won = F.sum(F.when(F.col("level") >= 0, met).when(F.col("level") == -1, met / 2).otherwise(0.0))
    return upto.agg(F.try_divide(won, F.sum(F.when(F.col("level") == -2, met).otherwise(0.0))).alias("c_index"))
