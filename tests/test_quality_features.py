import pytest
from pyspark.sql import functions as F

from oreline.operators import features as fe, quality as dq


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(1.0, "x", 5.0), (1.0, "x", 5.0), (None, "y", 7.0), (4.0, "", 9.0), (2.0, "y", float("nan"))]
    return spark.createDataFrame(rows, "a double, b string, c double")


def test_quality_counts(messy):
    r = {x["name"]: x for x in dq.analyze_quality(messy).collect()}
    assert (r["a"].nulls, r["b"].nulls, r["c"].nulls) == (1, 1, 1)
    assert r["a"].null_pct == 20.0 and r["a"].unique_count == 3
    s = dq.quality_summary(messy).first()
    assert (s["rows"], s.duplicates, s.total_nulls, s.issues) == (5, 1, 3, 4)


def test_declared_number(spark):
    df = spark.createDataFrame([("1",), ("b",), ("3,5",)], "v string")
    assert dq.analyze_quality(df, {"v": "numeric"}).first().type_mismatch == 1
    assert [r.v for r in dq.coerce_types(df, ["v"]).collect()] == [1.0, None, 3.5]
    assert dq.count_coerced(df, ["v"]).first().coerced == 2


def test_impute(messy):
    for strategy in ("mean", "median"):
        assert dq.count_missing(dq.impute(messy, strategy)).first().missing == 0
    fills = dq.fill_values(messy, "median")
    assert fills == {"a": 1.5, "b": "x", "c": 6.0}


def test_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 7.0) for i in range(4)], "p double, q double, k double")
    r = {(x.a, x.b): x for x in dq.correlation_matrix(df).collect()}
    assert r[("p", "q")].r == 1.0 and r[("p", "q")].high and r[("p", "k")].r == 0.0


def test_leakage(spark):
    rows = [(i % 7 * 10.0, i % 2, 100.0 + i if i % 2 else i / 1000, "AB"[i % 2], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "renda double, copia int, quase double, regiao_leak string, alvo int")
    r = {x.feature: x.reason for x in dq.detect_leakage(df, "alvo", "classification").collect()}
    assert r == {"copia": "copy", "quase": "threshold", "regiao_leak": "one class per category", "renda": "none"}
    reg = spark.createDataFrame([(float(i * 7919 % 101), 2.0 * i, 6.0 * i) for i in range(100)], "x double, alvo double, quase double")
    r = {x.feature: x.leak for x in dq.detect_leakage(reg, "alvo", "regression").collect()}
    assert r == {"x": False, "quase": True}


def test_histogram_keeps_the_maximum(spark):
    from oreline.operators.aggregates import histogram

    h = histogram(spark.range(11).select(F.col("id").cast("double").alias("v")), "v", 5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 2, 2, 2, 3]


def test_feature_fixture(spark):
    df = spark.createDataFrame([(10, 2, "x"), (20, 4, "y"), (30, 5, "x")], "a int, b int, cat string")
    assert [r.a_faixa for r in fe.bin_width(df, "a", 2).orderBy("a").collect()] == ["faixa_1", "faixa_1", "faixa_2"]
    hot = fe.one_hot(df, "cat").orderBy("a").collect()
    assert [r["cat=x"] for r in hot] == [1, 0, 1] and [r["cat=y"] for r in hot] == [0, 1, 0]
    assert [r.cat_cod for r in fe.label_encode(df, "cat").orderBy("a").collect()] == [0, 1, 0]
    z = [r.a_norm for r in fe.scale_zscore(df, "a").orderBy("a").collect()]
    assert z == [-1.224745, 0.0, 1.224745]
    assert [r.a_norm for r in fe.scale_minmax(df, "a").orderBy("a").collect()] == [0.0, 0.5, 1.0]
    same = spark.createDataFrame([(3,), (3,)], "a int")
    assert [r.a_norm for r in fe.scale_zscore(same, "a").collect()] == [0.0, 0.0]


def test_splits_are_stable(class_rows):
    a = {r.id for r in fe.train_test_split(class_rows.repartition(1), "id").filter("is_train").collect()}
    assert a == {r.id for r in fe.train_test_split(class_rows.repartition(7), "id").filter("is_train").collect()}
    s = fe.stratified_split(class_rows, "id", "diagnostico", 70).groupBy("diagnostico").agg(F.avg(F.col("is_train").cast("int")).alias("p")).collect()
    assert all(abs(r.p - 0.7) < 0.02 for r in s)


def test_balancing(class_rows):
    n = {r.diagnostico: r["count"] for r in class_rows.groupBy("diagnostico").count().collect()}
    over = {r.diagnostico: r["count"] for r in fe.random_over(class_rows, "diagnostico", "id").groupBy("diagnostico").count().collect()}
    assert abs(over[1] - over[0]) < 0.2 * max(n.values())
    made = fe.smote(class_rows, "diagnostico", "id", ["renda", "idade"])
    new = made.filter("synthetic")
    low = min(n, key=n.get)
    assert new.filter(f"diagnostico <> {low}").count() == 0
    assert abs(new.count() + n[low] - max(n.values())) < 0.2 * max(n.values())
    box = class_rows.filter(f"diagnostico = {low}").agg(F.min("renda"), F.max("renda")).first()
    assert new.filter((F.col("renda") < box[0]) | (F.col("renda") > box[1])).count() == 0


def test_registry(spark):
    row = spark.createDataFrame([("f", "numeric", "a * 2", ["a"])], "name string, feature_type string, formula string, source_columns array<string>")
    log = fe.register_feature(fe.register_feature(None, row), row)
    latest = fe.latest_feature(log).first()
    assert latest.version == 2 and latest.lineage == ["a -> f"]
