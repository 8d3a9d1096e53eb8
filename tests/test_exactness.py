"""Answers that must not depend on bins, caps, blanks, missing values or the layout of files."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreline.operators import causal as ca, clustering as cl, features as fe, learning as ml, monitoring as mo, rules as ru, scalars as sc, survival as su, text as tx
from oreline.operators.neighbours import knn_join
from oreline.plans.steps import OPERATORS, Step, run_steps
from oreline.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def brute_concordance(rows):
    won = total = 0.0
    for t, e, r in rows:
        for t2, _, r2 in rows:
            if e == 1 and t < t2:
                total += 1
                won += 1.0 if r > r2 else 0.5 if r == r2 else 0.0
    return won / total


@pytest.mark.parametrize("case", ["perfect", "outlier", "ties", "one"])
def test_concordance_counts_all_pairs(spark, case):
    draw = np.random.RandomState(4)
    rows = {
        "perfect": [(i, 1, float(1000 - i)) for i in range(400)],
        "outlier": [(int(draw.randint(60)), int(draw.rand() < 0.6), float(draw.rand())) for _ in range(300)] + [(5, 1, 1e12)],
        "ties": [(int(draw.randint(10)), int(draw.rand() < 0.5), float(draw.randint(4))) for _ in range(200)],
        "one": [(1, 1, 2.0), (2, 1, 2.0)],
    }[case]
    df = spark.createDataFrame(rows + [(None, 1, 1.0), (3, 1, None)], "days int, died int, risk double")
    assert su.concordance(df, "days", "died", "risk").first().c_index == pytest.approx(brute_concordance(rows))


def test_drift_of_periods_with_an_outlier(spark):
    base = spark.range(1000).select((F.col("id") / 1000).alias("x"), F.lit("u").alias("c")).unionByName(spark.createDataFrame([(1e9, "u")], "x double, c string"))
    batch = base.filter("x < 1").select((F.col("x") + 0.6).alias("x"), F.when(F.col("x") < 0.25, "v").otherwise("u").alias("c"))
    report = {r.column: r.drift_score for r in mo.drift_report(base, batch, ["x", "c"]).collect()}
    found = {r.column: r for r in mo.batch_drift(mo.summarize_baseline(base, ["x", "c"]), batch).collect()}
    assert found["x"].drift_score == report["x"] > 0.59 and found["c"].drift_score == report["c"] == 0.25
    assert found["x"].drifted and found["x"].impact == "high" and found["c"].impact == "medium"
    assert mo.drift_timeline(base, batch, ["x"], F.lit("2020")).first().drift_score == report["x"]


def test_isotonic_reads_scores_exactly(spark):
    df = spark.range(2000).select((F.col("id") * 1e-9).alias("p"), (F.col("id") >= 1000).cast("int").alias("y"))
    r = ca.calibrate(df, "y", "p", "isotonic").groupBy("y").agg(F.min("calibrated").alias("a"), F.max("calibrated").alias("b")).collect()
    assert {(x.y, x.a, x.b) for x in r} == {(0, 0.0, 0.0), (1, 1.0, 1.0)}


def test_transactions_of_many_columns(spark):
    df = spark.range(1).select(*[F.lit("v").alias(f"c{i}") for i in range(20)])
    assert len(ru.to_transactions(df).first()["items"]) == 20 and len(ru.to_transactions(df, most=3).first()["items"]) == 3


def test_blanks_around_categories(spark):
    df = spark.createDataFrame([(1, " A", 1.0), (2, "A", 2.0), (3, "B ", 3.0), (4, "", 4.0), (5, None, 5.0)], "id int, c string, x double")
    hot = {r.id: (r["c=A"], r["c=B"]) for r in fe.one_hot(df, "c").collect()}
    assert hot == {1: (1, 0), 2: (1, 0), 3: (0, 1), 4: (0, 0), 5: (0, 0)}
    codes = {r.id: r.c_cod for r in fe.label_encode(df, "c").collect()}
    assert codes == {1: 0, 2: 0, 3: 1, 4: None, 5: None}
    assert {r.id: r.c_b0 for r in fe.binary_encode(df, "c").collect()} == codes
    assert {r.id: r.color for r in sc.palette_index(df, "c", 5).collect()} == codes
    made = ml.encode(df.withColumn("y", F.col("x")), "y", "regression", ["c"], scale=False)
    rows = made.stages.transform(df.withColumn("y", F.col("x"))).orderBy("id").collect()
    assert [list(r.features) for r in rows] == [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_missing_values_are_left_out(spark):
    rows = [(i, float(i % 5), float(i % 3), i % 2) for i in range(40)] + [(100, None, 1.0, 0), (101, 1.0, float("nan"), 1), (102, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "id int, x double, y double, label int")
    cols = ["x", "y"]
    assert cl.kmeans(df, 2, cols)[0].count() == 41 and cl.hierarchical(df, 2, cols).count() == 41
    assert cl.gaussian_mixture(df, 2, cols).count() == 41 and cl.pca(df, cols, 2)[0].count() == 41
    assert cl.pca_variance_curve(df, cols).count() == 2
    near = knn_join(df, df, "id", cols, 3, skip_same_key=True)
    assert {r.query_id for r in near.collect()} == {r[0] for r in rows} - {100, 101}
    assert fe.class_weights(df, "label").count() == len(rows)
    grown = fe.smote(df.filter("id < 30 or id > 99").unionByName(df.filter("id < 30 and label = 1").withColumn("id", F.col("id") + 500)), "label", "id", cols)
    assert grown.filter("not synthetic").count() == 48 and grown.filter("synthetic").count() > 0


def test_letters_are_composed(spark):
    parts = unicodedata.normalize("NFD", "한국 café")
    assert tx.composed(spark.createDataFrame([(parts,), ("plain",), (None,)], "t string"), "t").first().t == unicodedata.normalize("NFC", parts)


def test_steps_fail_where_rows_are_made(spark):
    OPERATORS["breaks"] = lambda df: df.withColumn("z", F.raise_error(F.lit("no such luck")))
    try:
        run = run_steps(spark.range(50), [Step("a", "filter", {"condition": "id < 40"}), Step("b", "breaks"), Step("c", "sort", {"columns": ["id"]})])
    finally:
        del OPERATORS["breaks"]
    log = {r.step: r for r in run.log.collect()}
    assert [log[s].status for s in "abc"] == ["success", "failed", "skipped"] and "no such luck" in log["b"].error
    assert (log["a"].rows_in, log["a"].rows_out, log["b"].rows_in, log["b"].rows_out) == (50, 40, 40, None) and log["a"].seconds > 0


def test_steps_stop_in_time(spark):
    OPERATORS["slow"] = lambda df: df.filter(F.expr("java_method('java.lang.Thread', 'sleep', 60000L) is null or id >= 0"))
    try:
        run = run_steps(spark.range(8), [Step("a", "slow"), Step("b", "sort", {"columns": ["id"]})], timeout=3)
    finally:
        del OPERATORS["slow"]
    assert [(r.step, r.status) for r in run.log.orderBy("step").collect()] == [("a", "timeout"), ("b", "skipped")]


def test_streams_of_one_file_and_of_a_folder(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "one" / "raw"))
    (part,) = (tmp_path / "one" / "raw").glob("part-*.parquet")
    part.rename(tmp_path / "one" / "events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "many" / "events.parquet"))

    def answers(folder):
        stream = lambda: jobs.read_stream(spark, str(tmp_path / folder), "events.parquet", events.schema, "ts")
        ab = jobs.run_updates(jobs.ab_metrics(stream(), "ts", F.col("user_id") % 2, F.col("value"), F.col("event_type") == "error"), ["start", "variant"])
        cut = jobs.run_available(jobs.sessions(stream(), "ts", "user_id", "event_type", "event_id"))
        drift = jobs.run_drift(stream(), events.filter("ts < '2024-01-10'"), ["value", "event_type"])
        return [sorted(map(str, df.drop("batch").collect())) for df in (ab.withColumn("avg_value", F.round("avg_value", 6)), cut, drift)]

    one, many = answers("one"), answers("many")
    assert one == many and all(one)


def test_stream_without_rows(spark, tmp_path):
    schema = "ts timestamp, v int, x double"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "events.parquet"))
    stream = jobs.read_stream(spark, str(tmp_path), "events.parquet", spark.createDataFrame([], schema).schema, "ts")
    assert jobs.run_updates(jobs.ab_metrics(stream, "ts", F.col("v"), F.col("x"), F.col("x") > 1), ["start", "variant"]).count() == 0
