import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.operators import causal as ca, geo, monitoring as mo, survival as su
from oreline.plans.steps import Step, run_steps
from oreline.streaming import jobs


def test_drift(spark):
    a = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), F.lit("u").alias("c"))
    same = mo.drift_report(a, a, ["x", "c"]).collect()
    assert all(r.drift_score == 0 and not r.drifted for r in same)
    b = a.select((F.col("x") + 60).alias("x"), F.when(F.col("x") < 50, "u").otherwise("w").alias("c"))
    r = {x.column: x for x in mo.drift_report(a, b, ["x", "c"]).collect()}
    assert r["x"].drift_score == 0.6 and r["x"].p_value == 0 and r["x"].impact == "high"
    assert r["c"].drift_score == 0.5 and r["c"].p_value == 0
    s = mo.drift_summary(mo.drift_report(a, b, ["x", "c"])).first()
    assert s.severity == "critical" and s.columns_with_drift == 2


def test_champion(spark):
    df = spark.createDataFrame([(1, 1 if i < 60 else 0, 1 if i < 90 else 0) for i in range(100)], "y int, a int, b int")
    r = {x.metric: x for x in mo.champion_challenger(df, "y", "a", "b").collect()}
    assert r["accuracy"].winner == "challenger" and r["accuracy"].recommendation == "promote_challenger" and r["accuracy"].p_value < 0.001


def test_survival(spark):
    """The leukaemia remission times of Freireich et al. (1963), as in every textbook."""
    drug = [(6, 1)] * 3 + [(7, 1), (10, 1), (13, 1), (16, 1), (22, 1), (23, 1), (6, 0), (9, 0), (10, 0), (11, 0), (17, 0), (19, 0), (20, 0), (25, 0), (32, 0), (32, 0), (34, 0), (35, 0)]
    plain = [(t, 1) for t in (1, 1, 2, 2, 3, 4, 4, 5, 5, 8, 8, 8, 8, 11, 11, 12, 12, 15, 17, 22, 23)]
    df = spark.createDataFrame([("drug", *r) for r in drug] + [("plain", *r) for r in plain], "arm string, t int, e int")
    km = {(r.arm, r.time): r.survival for r in su.kaplan_meier(df, "t", "e", "arm").collect()}
    assert km[("drug", 6)] == pytest.approx(0.857, abs=1e-3) and km[("drug", 23)] == pytest.approx(0.448, abs=1e-3)
    assert km[("plain", 23)] == 0.0
    med = {r.arm: r["median"] for r in su.median_survival(su.kaplan_meier(df, "t", "e", "arm"), "arm").collect()}
    assert med == {"drug": 23, "plain": 8}
    lr = su.log_rank(df, "t", "e", "arm").first()
    assert lr.statistic == pytest.approx(16.79, abs=0.01) and lr.p_value == pytest.approx(0.0, abs=1e-4)


def test_effects(spark):
    df = spark.range(2000).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(2))).alias("t"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100).alias("x")
    ).withColumn("y", 3 * F.col("t") + 2 * F.col("x")).withColumn("propensity", F.lit(0.5))
    assert ca.ipw_ate(df, "t", "y").first().ate == pytest.approx(3, abs=0.1)
    for kind in ("S", "T"):
        e = ca.learner_effects(df, "id", "t", "y", ["x"], kind, "linear")
        assert ca.learner_ate(e, kind).first().ate == pytest.approx(3, abs=0.05)
    assert ca.double_ml(df, "id", "t", "y", ["x"], 2, "linear").first().ate == pytest.approx(3, abs=0.05)
    assert ca.matching_ate(df.withColumn("propensity", F.col("x")), "id", "t", "y").first().ate == pytest.approx(3, abs=0.05)
    rows = df.collect()
    one, zero = (np.array([r.x for r in rows if r.t == v]) for v in (1, 0))
    smd = abs(one.mean() - zero.mean()) / np.sqrt((one.var(ddof=1) + zero.var(ddof=1)) / 2)
    balance = ca.covariate_balance(df, "t", ["x"]).first()
    assert balance.smd_before == balance.smd_after == pytest.approx(smd, abs=1e-4)
    assert balance.balanced == (smd < 0.1)


def test_calibration_helps(spark):
    from oreline.operators import evaluation as ev

    df = spark.range(4000).select(
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("p"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1000)) / 1000).alias("u")
    ).withColumn("y", (F.col("u") < F.col("p") * F.col("p")).cast("int"))
    before = ev.calibration_scores(df, "y", "p").first().ece
    for method in ("platt", "isotonic"):
        after = ev.calibration_scores(ca.calibrate(df, "y", "p", method), "y", "calibrated").first().ece
        assert after < before


def test_geo(spark):
    df = spark.createDataFrame([("10", "20"), ("95", "0"), ("x", "1"), ("-90", "180")], "Latitude string, lng string")
    assert geo.valid_geo(df).count() == 2


def test_steps_in_dependency_order(spark):
    df = spark.range(100)
    chain = [
        Step("last", "sort", {"columns": ["id"]}), Step("even", "filter", {"condition": "id % 2 = 0"}),
        Step("bad", "scaler", {"method": "?"}), Step("after_bad", "sort", {"columns": ["id"]}),
    ]
    run = run_steps(df, chain, [("even", "last"), ("last", "bad"), ("bad", "after_bad")])
    log = {r.step: r for r in run.log.collect()}
    assert (log["even"].rows_in, log["even"].rows_out, log["last"].rows_out) == (100, 50, 50)
    assert log["bad"].status == "failed" and log["after_bad"].status == "skipped" and log["bad"].rows_out is None


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select(
        F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("v"), F.col("id").cast("double").alias("x")
    )
    for i in range(3):
        rows.filter(F.pmod(F.floor(F.unix_seconds("ts") / 10_200), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), "*.parquet", rows.schema, "ts")
    out = jobs.run_updates(jobs.ab_metrics(stream, "ts", F.col("v"), F.col("x"), F.col("x") > 400, "1 hour", "30 days"), ["start", "variant"])
    batch = rows.groupBy(F.window("ts", "1 hour").start.alias("start"), F.col("v").alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    assert {(r.start, r.variant, r.n) for r in out.collect()} == {(r.start, r.variant, r.n) for r in batch.collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, v int"
    path = str(tmp_path / "late")
    first = spark.createDataFrame([(1_000_000, 1)], "s long, v int").select(F.timestamp_seconds("s").alias("ts"), "v")
    late = spark.createDataFrame([(1, 1)], "s long, v int").select(F.timestamp_seconds("s").alias("ts"), "v")
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in (first, late):
        part.write.mode("append").parquet(path)
        s = jobs.read_stream(spark, path, "*.parquet", part.schema, "ts")
        out = jobs.run_updates(jobs.ab_metrics(s, "ts", F.col("v"), F.col("v"), F.lit(False), "1 hour", "1 hour"), ["start", "variant"], sink, state)
    assert out.count() == 1


def test_feedback_meets_its_prediction(spark, tmp_path):
    """Feedback before its prediction, corrections in later batches, an older label that comes late, and keys that are forgotten."""
    kind = "k int, s long, model string, p string, y string"
    batches = [
        [(1, 10, "a", "x", None), (2, 12, None, None, "x"), (3, 14, "b", "z", None)],
        [(1, 20, None, None, "w"), (2, 16, "a", "x", None), (3, 22, None, None, "z"), (4, 23, None, None, "x")],
        [(1, 40, None, None, "x"), (3, 18, None, None, "q"), (2, 41, None, None, None), (2, 42, "b", "w", None)],
        [(9, 100_000, "a", "x", None)],
        [(3, 100_001, None, None, "q"), (9, 100_002, None, None, "x")],  # 3 is forgotten by now
    ]
    folder, sink, state = (str(tmp_path / n) for n in ("rows", "out", "state"))
    seen = []
    for rows in batches:
        part = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        part.write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, "*.parquet", part.schema, "ts")
        changes = jobs.matched_feedback(
            stream.filter("p is not null"), stream.filter("p is null"), "ts", F.col("k"), F.col("model"), F.col("p"), F.col("y"), "1 hour", 3600,
        )
        out = jobs.accuracy_of(jobs.run_available(changes, sink, state))
        seen.append({r.model: (r.n, r.accuracy, r.corrected) for r in out.collect()})
    assert seen[0] == {}
    assert seen[1] == {"a": (2, 0.5, 0), "b": (1, 1.0, 0)}
    assert seen[2] == seen[3] == {"a": (2, 1.0, 1), "b": (1, 1.0, 0)}
    assert seen[4] == {"a": (3, 1.0, 1), "b": (1, 1.0, 0)}


def test_keys_wait_in_buckets(spark, tmp_path):
    """Keys of one bucket keep to themselves: their labels, corrections and times to be forgotten; the state has a row per bucket."""
    kind = "k int, s long, p string, y string"
    batches = [
        [(k, 10 + k, "x", None) for k in range(60)] + [(k, 200, None, "x" if k % 3 else "w") for k in range(0, 60, 2)],
        [(k, 300, None, "x") for k in range(60)],
        [(100, 100_000, "x", None)],
        [(k, 100_001, None, "w") for k in range(60)] + [(100, 100_002, None, "x")],
    ]
    folder, sink, state = (str(tmp_path / n) for n in ("rows", "out", "state"))
    seen = []
    for rows in batches:
        part = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        part.write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, "*.parquet", part.schema, "ts")
        changes = jobs.matched_feedback(
            stream.filter("p is not null"), stream.filter("p is null"), "ts", F.col("k"), F.lit("m"), F.col("p"), F.col("y"), "1 hour", 3600, buckets=4,
        )
        rows = jobs.run_available(changes, sink, state)
        seen.append(jobs.accuracy_of(rows).select("n", "accuracy", "corrected").first())
        assert rows.groupBy("key").agg(F.sum("n").alias("n")).filter("n <> 1").count() == 0
    assert seen[0] == (30, 20 / 30, 0) and seen[1] == (60, 1.0, 10)
    assert seen[2] == seen[1] and seen[3] == (61, 1.0, 10)


def test_baseline_in_buckets(spark):
    """Counts at and up to any value, between, below and above those of the baseline, in every bucket."""
    r = np.random.default_rng(4)
    x = np.concatenate([np.round(r.normal(0, 30, 900)), np.full(450, 7.0)])
    asked = np.concatenate([np.arange(-150, 150, 3.5), [7.0, x.min(), x.max(), -1e9, 1e9]])
    base = spark.createDataFrame([(float(v), 1.0) for v in x], "x double, one double")
    summary = mo.summarize_baseline(base, ["x", "one"])
    assert summary.running.filter("name = 'x'").select("bucket").distinct().count() > 2
    q = spark.createDataFrame([("x", float(v)) for v in asked] + [("one", 0.0), ("one", 1.0), ("one", 2.0)], "name string, value double").distinct()
    got = {(r.name, r.value): (r.a, r.ca, r.na) for r in mo._baseline_at(summary, q).collect()}
    assert got == {("x", float(v)): ((x == v).sum(), (x <= v).sum(), len(x)) for v in asked} | {
        ("one", 0.0): (0, 0, len(x)), ("one", 1.0): (len(x), len(x), len(x)), ("one", 2.0): (0, len(x), len(x))}
