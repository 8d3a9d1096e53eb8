import pytest
from pyspark.sql import functions as F

from oreline.operators import scalars as sc
from oreline.sources import tables as tb


def test_delimited_text(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('name; age ;note\n"Ana; B" ; 31 ;"said ""hi"""\n\nRui;;\nEva;5\n', encoding="utf-8")
    df = tb.read_delimited(spark, str(p))
    assert df.columns == ["name", "age", "note"]
    got = {r.name: (r.age, r.note) for r in df.collect()}
    assert got == {"Ana; B": ("31", 'said "hi"'), "Rui": (None, None), "Eva": ("5", None)}
    typed = dict(tb.infer_types(df).dtypes)
    assert typed["age"] == "double" and typed["name"] == "string"


def test_binary_is_refused(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes(b"PK\x03\x04rest")
    with pytest.raises(ValueError):
        tb.read_delimited(spark, str(p))


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b', None), (2, "c\td", 1.5)], "i int, s string, v double")
    tb.write_tsv(df, str(tmp_path / "t.tsv"))
    back = tb.infer_types(tb.read_any(spark, str(tmp_path / "t.tsv")))
    assert sorted(map(tuple, back.collect())) == [(1.0, 'a,"b', None), (2.0, "c\td", 1.5)]
    tb.write_json(df, str(tmp_path / "j.json"), ["i", "s"])
    assert tb.read_any(spark, str(tmp_path / "j.json")).count() == 2


def test_store_and_rows(spark, tmp_path):
    df = spark.range(5)
    tb.save_dataset(df, "kept_rows", str(tmp_path))
    assert tb.has_dataset(spark, "kept_rows") and tb.load_dataset(spark, "kept_rows").count() == 5
    assert "kept_rows" in [r.name for r in tb.list_datasets(spark).collect()]
    tb.delete_dataset(spark, "kept_rows")
    assert not tb.has_dataset(spark, "kept_rows")
    path = str(tmp_path / "rows")
    for p in ("a", "b"):
        tb.append_rows(spark.range(10).withColumnRenamed("id", "v"), path, "v", p)
    rows = spark.read.parquet(path)
    assert sorted(r._row_idx for r in rows.collect()) == list(range(20))
    assert [r._row_idx for r in tb.page_rows(rows, 5, 3).collect()] == [5, 6, 7]
    assert tb.page_rows(rows, 5, 3, dense=True).count() == 3
    assert tb.without_project(rows, "a").count() == 10


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "_row_idx")
    assert tb.stride_sample(df, 300).count() == 250
    a = {r[0] for r in tb.random_sample(df.repartition(1), 50, "_row_idx").collect()}
    assert a == {r[0] for r in tb.random_sample(df.repartition(9), 50, "_row_idx").collect()} and len(a) == 50
    assert tb.bounded_sample(df, "_row_idx", 100, 10).count() == 50


def test_formula(spark):
    df = spark.createDataFrame([(10, 2, "x"), (20, 0, "y"), (30, None, "9z")], "a int, b int, `my col` string")
    run = lambda f: [r.v for r in sc.derive(df, "v", f).orderBy("a").collect()]
    assert run("a / b + log(100)") == [7.0, 2.0, 2.0]
    assert run("-a ^ 2") == [-100.0, -400.0, -900.0]
    assert run("2 ^ 3 ^ 2") == [512.0] * 3
    assert run("max(a, 15) % 7") == [1.0, 6.0, 2.0]
    assert run("my col * 2") == [0.0, 0.0, 18.0]
    assert run("ln(0 - a)") == [None] * 3
    with pytest.raises(ValueError):
        sc.derive(df, "v", "__import__('os')")
    assert "code" not in df.columns


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("2024-01-07 05:00:00",)], "s string").withColumn("t", F.col("s").cast("timestamp"))
    r = sc.date_extract(df, "t", list(sc.DATE_PARTS)).first()
    assert (r.t_year, r.t_weekday, r.t_is_weekend, r.t_week, r.t_hour) == (2024, 0, True, 1, 5)
    assert spark.range(1).select(sc.parse_number(F.lit("3,5 kg"))).first()[0] == 3.5
