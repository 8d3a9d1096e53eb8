"""Drift, experiments, model comparison and run logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.functions.core import as_list, is_numeric, ladder, single
from oreline.functions.ordered import running_sums
from oreline.functions.tails import chi2_p, normal_p
from oreline.operators.quality import long_numbers, long_texts
from oreline.session import stage

DRIFTED, IMPACT = 0.15, (0.4, 0.15)


def impact(score: Column) -> Column:
    return ladder([(score > IMPACT[0], "high"), (score > IMPACT[1], "medium")], "low")


def _marked(baseline: DataFrame, batch: DataFrame, columns: list[str], long) -> DataFrame:
    both = baseline.select(*columns, F.lit(0).alias("_side")).unionByName(batch.select(*columns, F.lit(1).alias("_side")))
    return long(both, columns, ["_side"])


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    root = F.sqrt(n * m / (n + m).cast("double"))
    x = (root + 0.12 + F.lit(0.11) / root) * d
    total = sum((2.0 * (-1) ** (j - 1) * F.exp(-2.0 * j * j * x * x) for j in range(1, 31)), F.lit(0.0))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def drift_numbers(baseline: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """Largest gap of the two distribution functions per column, with means and deviations.

    Distribution functions are running counts over the distinct values of all columns at once.
    """
    cells = _marked(baseline, batch, columns, long_numbers)
    counts = cells.groupBy("name", "value").agg(F.count_if(F.col("_side") == 0).alias("a"), F.count_if(F.col("_side") == 1).alias("b"))
    upto = running_sums(stage(counts, "counts"), ["value"], {"ca": "a", "cb": "b"}, ["name"], {"na": "a", "nb": "b"})
    side = lambda s, c="value": F.when(F.col("_side") == s, F.col(c))
    base = cells.groupBy("name").agg(
        F.count(side(0)).alias("n_base"), F.count(side(1)).alias("n_batch"),
        F.avg(side(0)).alias("original_mean"), F.avg(side(1)).alias("batch_mean"),
        F.stddev_samp(side(0)).alias("original_std"), F.stddev_samp(side(1)).alias("batch_std"),
    )
    gaps = upto.groupBy("name").agg(
        F.max(F.abs(F.try_divide(F.col("ca"), F.col("na")) - F.try_divide(F.col("cb"), F.col("nb")))).alias("_d")
    )
    return base.join(gaps, "name").select(
        F.col("name").alias("column"), F.round("_d", 4).alias("drift_score"), F.lit("KS").alias("method"),
        F.round(ks_p(F.col("_d"), F.col("n_base"), F.col("n_batch")), 4).alias("p_value"),
        *[F.round(c, 3).alias(c) for c in ("original_mean", "batch_mean", "original_std", "batch_std")],
    )


def drift_texts(baseline: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """Half the sum of the differences of the shares, and the chi-square test of the two distributions."""
    cells = _marked(baseline, batch, columns, long_texts).filter("value IS NOT NULL")
    counts = cells.groupBy("name", "value").agg(
        F.count_if(F.col("_side") == 0).cast("double").alias("a"), F.count_if(F.col("_side") == 1).cast("double").alias("b")
    )
    sizes = counts.groupBy("name").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    a, b, na, nb = (F.col(c) for c in ("a", "b", "na", "nb"))
    n = na + nb
    ea, eb = (a + b) * na / n, (a + b) * nb / n
    out = counts.join(sizes, "name").groupBy("name").agg(
        (F.sum(F.abs(F.try_divide(a, na) - F.try_divide(b, nb))) / 2).alias("_d"),
        F.sum(F.coalesce(F.try_divide((a - ea) * (a - ea), ea), F.lit(0.0)) + F.coalesce(F.try_divide((b - eb) * (b - eb), eb), F.lit(0.0))).alias("_x"),
        (F.count(F.lit(1)) - 1).alias("_df"),
    )
    none = F.lit(None).cast("double")
    return out.select(
        F.col("name").alias("column"), F.round("_d", 4).alias("drift_score"), F.lit("chi-square").alias("method"),
        F.round(F.when(F.col("_df") > 0, chi2_p(F.col("_x"), F.col("_df").cast("double"))).otherwise(1.0), 4).alias("p_value"),
        *[none.alias(c) for c in ("original_mean", "batch_mean", "original_std", "batch_std")],
    )


def drift_report(baseline: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column that both tables have."""
    numbers = [c for c in columns if is_numeric(baseline, c)]
    texts = [c for c in columns if c not in numbers]
    parts = ([drift_numbers(baseline, batch, numbers)] if numbers else []) + ([drift_texts(baseline, batch, texts)] if texts else [])
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumns({"drifted": F.col("drift_score") > DRIFTED, "impact": impact(F.col("drift_score"))})


def drift_summary(report: DataFrame) -> DataFrame:
    s = F.avg("drift_score")
    return report.agg(
        F.round(s, 3).alias("overall_score"),
        ladder([(s > 0.4, "critical"), (s > 0.2, "moderate"), (s > 0.08, "light")], "none").alias("severity"),
        F.count_if("drifted").alias("columns_with_drift"), F.count_if(~F.col("drifted")).alias("columns_stable"),
    )


def _bins(baseline: DataFrame, columns: list[str], bins: int) -> dict[str, tuple[float, float]]:
    """Start and width of the baseline's bins: two numbers per column."""
    edges = long_numbers(baseline, columns).groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    return {r["name"]: (r.lo, ((r.hi - r.lo) / bins) or 1.0) for r in edges}


def _binned(df: DataFrame, edges: dict, bins: int, keep=()) -> DataFrame:
    return long_numbers(df, list(edges), list(keep)).withColumn("bin", _bin(edges, bins))


def psi(baseline: DataFrame, batch: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Population stability index over equal-width bins of the baseline; an empty bin counts as 0.0001."""
    edges = _bins(baseline, columns, bins)
    a = _binned(baseline, edges, bins).groupBy("name", "bin").agg(F.count(F.lit(1)).alias("a"))
    b = _binned(batch, edges, bins).groupBy("name", "bin").agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, ["name", "bin"], "full").fillna(0, ["a", "b"])
    sizes = both.groupBy("name").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    pa = F.greatest(F.try_divide(F.col("a"), F.col("na")), F.lit(0.0001))
    pb = F.greatest(F.try_divide(F.col("b"), F.col("nb")), F.lit(0.0001))
    return both.join(sizes, "name").groupBy(F.col("name").alias("column")).agg(F.round(F.sum((pb - pa) * F.ln(pb / pa)), 4).alias("psi"))


@dataclass
class BaselineSummary:
    """What batches are compared with: running counts per distinct value in buckets, bins of the stability index, and means.

    ``running`` is ``(name, value, a, bucket, ca)`` with ``ca`` counted within the bucket; ``cuts`` has the sorted first values of a
    column's buckets beyond bucket 0, ``before`` the rows below each bucket.
    """

    numbers: list[str]
    texts: list[str]
    running: DataFrame | None
    cuts: DataFrame | None
    before: DataFrame | None
    edges: dict[str, tuple[float, float]]
    bins: DataFrame | None
    moments: DataFrame | None
    text_counts: DataFrame | None


def summarize_baseline(baseline: DataFrame, columns: list[str], psi_bins: int = 10) -> BaselineSummary:
    """Read the baseline once for its distinct values; all else comes from those."""
    numbers = [c for c in columns if is_numeric(baseline, c)]
    texts = [c for c in columns if c not in numbers]
    running = cuts = before = binned = moments = words = None
    edges: dict[str, tuple[float, float]] = {}
    if numbers:
        values = stage(long_numbers(baseline, numbers).groupBy("name", "value").agg(F.count(F.lit(1)).alias("a")), "baseline")
        buckets = max(2, int(baseline.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        at = F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 100 * buckets)
        mean = F.sum(F.col("value") * F.col("a")) / F.sum("a")
        moments = stage(values.groupBy("name").agg(
            F.array_distinct(at).alias("_cuts"), F.min("value").alias("lo"), F.max("value").alias("hi"), mean.alias("original_mean"), F.sum("a").alias("na"),
        ), "moments")
        cuts = moments.select("name", "_cuts")
        edges = {r["name"]: (r.lo, ((r.hi - r.lo) / psi_bins) or 1.0) for r in moments.select("name", "lo", "hi").collect()}  # a row per column
        moments = moments.select("name", "original_mean", "na")
        inside = Window.partitionBy("name", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        running = stage(_bucketed(values, cuts).withColumn("ca", F.sum("a").over(inside)), "baseline-running")
        below = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
        sums = running.groupBy("name", "bucket").agg(F.sum("a").alias("_sum"))
        before = stage(sums.select("name", "bucket", F.coalesce(F.sum("_sum").over(below), F.lit(0)).alias("_before")), "baseline-before")
        if edges:
            binned = stage(values.withColumn("bin", _bin(edges, psi_bins)).groupBy("name", "bin").agg(F.sum("a").alias("a")), "bins")
    if texts:
        words = stage(long_texts(baseline, texts).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("a")), "texts")
    return BaselineSummary(numbers, texts, running, cuts, before, edges, binned, moments, words)


def _bucketed(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The bucket of each value, by binary search among its column's cuts (under 2^20); ``cuts`` has a row per column."""
    bits = F.array(*[F.lit(1 << b) for b in reversed(range(20))])
    found = F.aggregate(bits, F.lit(0), lambda s, b: F.when(F.get("_cuts", s + b - 1) <= F.col("value"), s + b).otherwise(s))
    return rows.join(F.broadcast(cuts), "name", "left").withColumn("bucket", found).drop("_cuts")


def _baseline_at(summary: BaselineSummary, asked: DataFrame) -> DataFrame:
    """``(name, value, a, ca, na)``: the baseline's rows at and up to each of the values ``(name, value)``.

    Only the buckets that hold a value asked for are read and merged with it; the rest of the baseline counts by its carry.
    """
    asked = stage(_bucketed(asked, summary.cuts), "asked")
    touched = asked.select("name", "bucket").distinct()
    none = F.lit(None).cast("bigint")
    held = summary.running.join(F.broadcast(touched), ["name", "bucket"], "left_semi")  # at most a row per bucket
    held = held.select("name", "bucket", "value", "a", "ca", F.lit(0).alias("_seen"))
    both = held.unionByName(asked.select("name", "bucket", "value", none.alias("a"), none.alias("ca"), F.lit(1).alias("_seen")))
    upto = Window.partitionBy("name", "bucket").orderBy("value", "_seen").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_seen") == 0, F.struct("value", "a", "ca")), ignorenulls=True).over(upto)
    met = both.withColumn("_last", last).filter("_seen = 1").join(F.broadcast(summary.before), ["name", "bucket"], "left")
    return met.join(F.broadcast(summary.moments.select("name", "na")), "name", "left").select(
        "name", "value", F.when(F.col("_last.value") == F.col("value"), F.col("_last.a")).otherwise(0).alias("a"),
        (F.coalesce("_before", F.lit(0)) + F.coalesce("_last.ca", F.lit(0))).alias("ca"), "na",
    )


def _bin(edges: dict, bins: int) -> Column:
    lo = F.create_map(*[F.lit(x) for n, (a, _) in edges.items() for x in (n, a)])
    step = F.create_map(*[F.lit(x) for n, (_, s) in edges.items() for x in (n, s)])
    at = F.floor((F.col("value") - lo[F.col("name")]) / step[F.col("name")])
    return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("bigint")


def _number_drift(summary: BaselineSummary, rows: DataFrame, psi_bins: int) -> DataFrame:
    """The gap between two distribution functions is largest just before or at one of the batch's values: between these
    the batch's function stands still, while the baseline's only grows."""
    b = stage(long_numbers(rows, summary.numbers, ["period"]).groupBy("period", "name", "value").agg(F.count(F.lit(1)).alias("b")), "batch")
    base = _baseline_at(summary, b.select("name", "value").distinct())
    upto = running_sums(b, ["value"], {"cb": "b"}, ["period", "name"], {"nb": "b"}).join(base, ["name", "value"])
    share = lambda c, n: F.try_divide(F.col(c), F.col(n))
    gap = F.greatest(F.abs(share("ca", "na") - share("cb", "nb")), F.abs(F.try_divide(F.col("ca") - F.col("a"), F.col("na")) - F.try_divide(F.col("cb") - F.col("b"), F.col("nb"))))
    gaps = upto.groupBy("period", "name").agg(F.max(gap).alias("_gap"), F.sum("b").alias("n"), (F.sum(F.col("value") * F.col("b")) / F.sum("b")).alias("batch_mean"))
    if not summary.edges:  # a baseline without any number
        none = F.lit(None).cast("double")
        return gaps.select(F.col("name").alias("column"), "period", "n", none.alias("drift_score"), none.alias("psi"), none.alias("original_mean"), F.round("batch_mean", 3).alias("batch_mean"))
    binned = b.filter(F.col("name").isin(*summary.edges)).withColumn("bin", _bin(summary.edges, psi_bins)).groupBy("period", "name", "bin").agg(F.sum("b").alias("b"))
    slots = gaps.select("period", "name").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(psi_bins - 1).cast("bigint"))))
    grid = slots.join(summary.bins, ["name", "bin"], "left").join(binned, ["period", "name", "bin"], "left").join(summary.moments.select("name", "na"), "name").join(gaps.select("period", "name", "n"), ["period", "name"])
    pa = F.greatest(F.coalesce("a", F.lit(0)) / F.col("na"), F.lit(0.0001))
    pb = F.greatest(F.coalesce("b", F.lit(0)) / F.col("n"), F.lit(0.0001))
    psi = grid.groupBy("period", "name").agg(F.sum((pb - pa) * F.ln(pb / pa)).alias("psi"))
    return gaps.join(psi, ["period", "name"], "left").join(summary.moments.drop("na"), "name", "left").select(
        F.col("name").alias("column"), "period", "n", F.round("_gap", 4).alias("drift_score"), F.round("psi", 4).alias("psi"), F.round("original_mean", 3).alias("original_mean"), F.round("batch_mean", 3).alias("batch_mean"),
    )


def _text_drift(summary: BaselineSummary, rows: DataFrame) -> DataFrame:
    """Half the sum of the differences of the shares."""
    b = long_texts(rows, summary.texts, ["period"]).filter("value IS NOT NULL").groupBy("period", "name", "value").agg(F.count(F.lit(1)).alias("b"))
    b = stage(b, "batch-texts")
    n = b.groupBy("period", "name").agg(F.sum("b").alias("n"))
    na = summary.text_counts.groupBy("name").agg(F.sum("a").alias("na"))
    # Values that the batch lacks add the rest of the baseline's share, so they need not be joined.
    met = b.join(n, ["period", "name"]).join(summary.text_counts, ["name", "value"], "left").join(na, "name")
    pa, pb = F.coalesce("a", F.lit(0)) / F.col("na"), F.col("b") / F.col("n")
    score = (F.sum(F.abs(pa - pb)) + 1 - F.sum(pa)) / 2
    none = F.lit(None).cast("double")
    return met.groupBy("period", "name").agg(F.max("n").alias("n"), F.round(score, 4).alias("drift_score")).select(
        F.col("name").alias("column"), "period", "n", "drift_score", none.alias("psi"), none.alias("original_mean"), none.alias("batch_mean")
    )


def batch_drift(summary: BaselineSummary, batch: DataFrame, period: Column | None = None, psi_bins: int = 10) -> DataFrame:
    """Per column (and period): the exact drift score, for numbers also the stability index over equal-width bins of the
    baseline and the means. The baseline itself is not read again."""
    rows = batch.withColumn("period", period if period is not None else F.lit("all"))
    parts = ([_number_drift(summary, rows, psi_bins)] if summary.numbers else []) + ([_text_drift(summary, rows)] if summary.texts else [])
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumns({"drifted": F.col("drift_score") > DRIFTED, "impact": impact(F.col("drift_score"))})


def drift_timeline(baseline: DataFrame, batch: DataFrame, columns: list[str], period: Column) -> DataFrame:
    """Mean score of the columns per period."""
    found = batch_drift(summarize_baseline(baseline, columns), batch, period)
    return found.groupBy("period").agg(F.round(F.avg("drift_score"), 4).alias("drift_score"))


def retrain_trigger(summary: DataFrame, accuracy_before: Column, accuracy_now: Column) -> DataFrame:
    """Retrain when drift is above .2 or accuracy fell by more than .1."""
    drop = accuracy_before - accuracy_now
    return summary.withColumns(
        {"accuracy_drop": F.round(drop, 4), "retrain": (F.col("overall_score") > 0.2) | (drop > 0.1),
         "reason": ladder([(F.col("overall_score") > 0.2, "drift"), (drop > 0.1, "accuracy")], "none")}
    )


# --- comparisons ----------------------------------------------------------------------------------


def champion_challenger(df: DataFrame, label: str, champion: str, challenger: str) -> DataFrame:
    """Both models' measures on the same labelled rows, and the verdict on accuracy."""
    from oreline.operators.evaluation import class_metrics

    pair = F.array(
        F.struct(F.lit("champion").alias("model"), F.col(champion).alias("p")), F.struct(F.lit("challenger").alias("model"), F.col(challenger).alias("p"))
    )
    m = class_metrics(df.select(F.col(label).alias("y"), F.inline(pair)), "y", "p", "model")
    long = m.select("model", "n", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("accuracy", "f1", "precision", "recall")])))
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("model") == "champion", F.col("v"))).alias("champion"),
        F.max(F.when(F.col("model") == "challenger", F.col("v"))).alias("challenger"), F.max("n").alias("n"),
    )
    delta = F.col("challenger") - F.col("champion")
    acc = single(wide.filter("metric = 'accuracy'").select("champion", "challenger", "n"))
    gain = F.round(acc["challenger"] - acc["champion"], 4)
    pooled = (acc["champion"] + acc["challenger"]) / 2
    z = F.try_divide(gain, F.sqrt(pooled * (1 - pooled) * 2 / acc["n"]))
    return wide.select(
        "metric", "champion", "challenger",
        ladder([(F.abs(delta) < 0.005, "tie"), (delta > 0, "challenger")], "champion").alias("better"),
        F.round(F.coalesce(100 * F.try_divide(delta, F.col("champion")), F.lit(0.0)), 1).alias("delta_pct"),
        ladder([(F.abs(gain) < 0.01, "tie"), (gain > 0, "challenger")], "champion").alias("winner"),
        ladder([(F.abs(gain) > 0.05, "high"), (F.abs(gain) > 0.02, "medium")], "low").alias("confidence"),
        ladder([(gain > 0.02, "promote_challenger"), (gain < -0.02, "keep_champion")], "more_testing").alias("recommendation"),
        F.coalesce(z, F.lit(0.0)).alias("z"),
    ).withColumn("p_value", F.round(normal_p(F.col("z")), 4)).withColumn("z", F.round("z", 4))


def ab_test(df: DataFrame, step: Column, variant: str, correct: Column, latency: Column, error: Column) -> DataFrame:
    """Accuracy, latency and error rate per time step and variant; score = accuracy - latency / 1000."""
    g = df.groupBy(step.alias("step"), F.col(variant).alias("variant")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(latency).alias("latency"),
        F.avg(error.cast("double")).alias("error_rate"),
    )
    return g.withColumn("score", F.col("accuracy") - F.col("latency") / 1000)


def ab_winner(steps: DataFrame) -> DataFrame:
    """Variants by their score over all steps."""
    n = F.sum("n")
    out = steps.groupBy("variant").agg(
        n.alias("n"), (F.sum(F.col("accuracy") * F.col("n")) / n).alias("accuracy"), (F.sum(F.col("latency") * F.col("n")) / n).alias("latency"),
        (F.sum(F.col("error_rate") * F.col("n")) / n).alias("error_rate"),
    )
    score = F.col("accuracy") - F.col("latency") / 1000
    best = out.agg(F.max(score)).scalar()
    return out.withColumns({"score": F.round(score, 4), "winner": score == best}).withColumns({c: F.round(c, 4) for c in ("accuracy", "latency", "error_rate")})


def compare_deployments(a: DataFrame, b: DataFrame, higher: list[str], lower: list[str]) -> DataFrame:
    """Two one-row tables of metrics: who is better on each, the majority, and the running cost of both."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in higher + lower])))

    cost = {n: single(d.select((F.col("total_calls") * F.col("avg_latency_ms") / 1000 * 5e-5).alias("c"))) for n, d in (("a", a), ("b", b))}
    both = long(a, "a").join(long(b, "b"), "metric")
    sign = F.when(F.col("metric").isin(*lower), F.signum(F.col("b") - F.col("a"))).otherwise(F.signum(F.col("a") - F.col("b")))
    votes = both.agg(F.sum(sign)).scalar()
    return both.select(
        "metric", "a", "b", ladder([(sign > 0, "a"), (sign < 0, "b")], "tie").alias("better"),
        ladder([(votes > 0, "a"), (votes < 0, "b")], "tie").alias("overall"),
        F.round(cost["a"]["c"], 6).alias("cost_a"), F.round(cost["b"]["c"], 6).alias("cost_b"),
    )


def feedback_accuracy(logs: DataFrame, model: str, correct: Column, status: Column) -> DataFrame:
    """Confirmed and corrected predictions per model."""
    return logs.groupBy(F.col(model).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(status == "confirmed").alias("confirmed"), F.count_if(status == "corrected").alias("corrected"),
        F.round(F.avg(correct.cast("double")), 4).alias("accuracy"),
    )


def unnest_logs(runs: DataFrame) -> DataFrame:
    """Log rows ``(run_id, node, status, rows_in, rows_out, duration_ms)`` of runs that keep them as an array."""
    return runs.select("run_id", F.inline("node_logs"))


def run_history(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Counts, durations and rows per status of ``(run_id, status, duration_ms)``."""
    rows = logs.groupBy("run_id").agg(F.sum("rows_out").alias("_out"))
    return runs.join(rows, "run_id", "left").groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"),
        F.coalesce(F.sum("_out"), F.lit(0)).alias("rows_out"),
    )


def node_history(logs: DataFrame) -> DataFrame:
    """Runs, failures and rows per node."""
    return logs.groupBy("node").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("rows_in").alias("rows_in"),
        F.sum("rows_out").alias("rows_out"), F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"),
    )
