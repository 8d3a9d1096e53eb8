import pytest
from pyspark.sql import functions as F

from oreline.functions.core import bucket, number_in
from oreline.functions.ordered import RUN, _fenced, element_at_rank, in_ranges, forward_filled, positions, running_sums, with_history
from oreline.operators import aggregates as ag, joins as jn, selection as sl, windows as wn


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def test_sql_fixture(sql_rows):
    total = sl.limit_with_total(sql_rows, [F.asc("id")], 10).collect()
    assert len(total) == 10 and total[0].total == 120
    g = ag.group_by(sql_rows, "regiao", {"n": ("count", "*"), "m": ("avg", "renda")}).collect()
    assert len(g) == 3 and sum(r.n for r in g) == 120
    assert ag.group_by(sql_rows, None, {"m": ("max", "renda")}).first().m == 5500
    assert sl.where_chain(sql_rows, [("and", "regiao", "like", "s%")]).count() == 40


def test_where_chain_folds_from_the_left(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1)], "a int, b int, c int")
    chain = sl.where_chain(df, [("and", "a", "=", 1), ("or", "b", "=", 1), ("and", "c", "=", 1)])
    assert rows(chain) == [(1, 0, 1)]


def test_like_takes_underscore_literally(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), (None,)], "s string")
    assert rows(df.filter(sl.like(df, "s", "A_%"))) == [("a_b",)]


def test_compare_mixed(spark):
    df = spark.createDataFrame([("10",), ("9",), ("abc",), (None,)], "s string")
    assert rows(df.filter(sl.compare(df, "s", ">", 9))) == [("10",), ("abc",)]
    assert rows(df.filter(sl.compare(df, "s", "=", ""))) == [(None,)]


def test_filter_rows_null(spark):
    df = spark.createDataFrame([(1, None), (40, 2), (50, None)], "dias int, x int")
    assert rows(sl.filter_rows(df, "dias > 30 and x != null")) == [(40, 2)]
    assert rows(sl.filter_rows(df, "x = null"), "dias") == [(1,), (50,)]


def test_order_by_mixed(spark):
    df = spark.createDataFrame([("10",), ("9",), (None,)], "s string")
    assert [r.s for r in sl.order_by_mixed(df, "s").collect()] == [None, "9", "10"]
    assert [r.s for r in sl.order_by_mixed(df, "s", True).collect()] == ["10", "9", None]


def test_blend(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, nome string")
    b = spark.createDataFrame([(1, 10), (2, 20), (2, 99)], "id int, score int")
    left = jn.join_first(a, b, "id", "id", "score", "left")
    assert rows(left) == [(1, "x", 10), (2, "y", 20), (3, "z", None)]
    assert jn.join_first(a, b, "id", "id", "score", "inner").count() == 2
    v = spark.createDataFrame([(1, 5)], "id int, v int")
    assert jn.join_first(v, v, "id", "id", "v").columns == ["id", "v", "v_b"]
    assert jn.concat_union(a, b).count() == 6
    text = spark.createDataFrame([("1", 7)], "id string, other int")
    assert dict(jn.concat_union(a, text).dtypes)["id"] == "string"
    assert jn.join_first(a, text, "id", "id", "other", "inner").count() == 1


def test_missing_key_never_matches(spark):
    a = spark.createDataFrame([(None, 1), ("", 2), ("k", 3)], "k string, v int")
    assert rows(jn.join_first(a, a, "k", "k", "v", "inner"), "v") == [(3,)]


def test_distinct_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (1, "a")], "x int, y string")
    assert jn.count_duplicates(df).first().duplicates == 2
    assert jn.drop_duplicates(df).count() == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_work_does_not_depend_on_partitions(spark, parts):
    data = [(i, "hot" if i % 3 else "cold", float(i * i % 17) if i % 4 else None) for i in range(500)]
    df = spark.createDataFrame(data, "i int, g string, v double").repartition(parts)
    want_pos, want_sum, want_fill, seen, acc, last = {}, {}, {}, {}, {}, {}
    for i, g, v in data:
        want_pos[i] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
        acc[g] = acc.get(g, 0.0) + (v or 0.0)
        want_sum[i] = acc[g]
        last[g] = v if v is not None else last.get(g)
        want_fill[i] = last[g]
    assert {r.i: r.position for r in positions(df, "i", "g").collect()} == want_pos
    summed = running_sums(df, "i", {"s": "v"}, "g", {"t": "v"}).collect()
    assert {r.i: r.s for r in summed} == want_sum and all(r.t == acc[r.g] for r in summed)
    alone = {r.i: (r.s, r.position) for r in positions(running_sums(df, "i", {"s": "v"}), "i").collect()}
    assert alone[499] == (sum(acc.values()), 499)
    assert {r.i: r.v for r in forward_filled(df, "v", "i", "g").collect()} == want_fill


@pytest.mark.parametrize("ranges", [2, 16])
def test_ranges_with_a_hot_group_and_nulls(spark, ranges):
    """A group of a third of the rows, small groups, a NULL group and NULL values, against Python, and ranges of like size."""
    data = [((None if i % 11 == 0 else "hot" if i % 3 == 0 else f"g{i % 97}"), i * 7919 % 6007, None if i % 5 == 0 else i % 13) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, o int, v int").repartition(6)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        out = running_sums(positions(df, "o", "g"), "o", {"s": "v"}, "g", {"t": "v"})
        got = {(r.g, r.o): (r.position, r.s, r.t) for r in out.collect()}
        filled = {(r.g, r.o): r.v for r in forward_filled(df, "v", "o", "g").collect()}
        spread = [r["count"] for r in in_ranges(df, ["o"], ["g"])[0].groupBy(RUN).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    groups = {}
    for g, o, v in data:
        groups.setdefault(g, []).append((o, v))
    want, fills = {}, {}
    for g, rows in groups.items():
        upto, last = 0, None
        for at, (o, v) in enumerate(sorted(rows, key=lambda r: r[0])):
            upto, last = upto + (v or 0), last if v is None else v
            want[g, o], fills[g, o] = (at, upto), last
        total = sum(v or 0 for _, v in rows)
        want.update({(g, o): (*want[g, o], total) for o, _ in rows})
    assert got == want and filled == fills
    assert len(spread) == ranges and max(spread) < 2.5 * len(data) / ranges


def test_running_sums_keep_decimals_and_empty_tables(spark):
    df = spark.range(40).select("id", (F.col("id") / 8).cast("decimal(20,10)").alias("v"))
    out = running_sums(df, "id", {"s": "v"})
    assert out.schema["s"].dataType == df.agg(F.sum("v").alias("s")).schema["s"].dataType
    assert float(out.filter("id = 39").first().s) == sum(i / 8 for i in range(40))
    assert running_sums(df.filter("id < 0"), "id", {"s": "v"}, totals={"t": "v"}).collect() == []
    assert positions(df.filter("id < 0"), "id").collect() == [] and forward_filled(df.filter("id < 0"), "v", "id").collect() == []


def test_history_crosses_chunks(spark):
    df = spark.range(100).select(F.col("id").alias("position"), F.lit("s").alias("g"), (F.col("id") % 11).cast("double").alias("v"))
    out = with_history(df, "position", 3, {"m": lambda w: F.avg("v").over(w.rowsBetween(-3, 0)), "l": lambda w: F.lag("v", 3).over(w)}, "g", chunk=8)
    got = {r.position: (round(r.m, 9), r.l) for r in out.collect()}
    v = [float(i % 11) for i in range(100)]
    for i in range(100):
        part = v[max(0, i - 3): i + 1]
        assert got[i] == (round(sum(part) / len(part), 9), v[i - 3] if i >= 3 else None)


def test_element_at_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 1, 9, 7]], "v double")
    out = element_at_rank(df, "v", {"a": F.lit(2), "b": F.lit(3), "c": F.col("_n") - 1}).first()
    assert (out.a, out.b, out.c) == (1.0, 5.0, 9.0)


def test_series_windows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "position int, v double")
    df = df.withColumn("position", F.col("position").cast("bigint"))
    roll = {r.position: r.rolling_mean for r in wn.rolling_mean(df, "v", 7, "position").collect()}
    assert roll[5] is None and roll[6] == 3.0
    lagged = {r.position: r.lagged_avg for r in wn.lagged_moving_average(df, "v", 3, "position").collect()}
    assert lagged[0] is None and lagged[4] == 2.0


def test_numbers_and_buckets(spark):
    df = spark.createDataFrame([("12abc",), ("",), (" -3.5e2x",), ("abc",)], "s string")
    assert [r[0] for r in df.select(number_in(F.col("s"))).collect()] == [12.0, None, -350.0, None]
    b = spark.range(1000).select(bucket(F.col("id"), 10).alias("b")).distinct().count()
    assert b == 10


def test_class_balance(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10, "y string")
    r = {x.label: x for x in ag.class_balance(df, "y").collect()}
    assert r["a"].ratio == 9.0 and r["b"].minority_pct == 10.0 and r["a"].severity == "moderate" and r["a"].imbalanced


@pytest.mark.parametrize("by", [None, "g"])
def test_fenced_order_statistics(spark, by):
    """Fences on a table with ties, against sorting in Python."""
    data = [("a" if i % 3 else "b", float((i * 7919) % 5003) if i % 5 else 42.0) for i in range(30_000)]
    df = spark.createDataFrame(data, "g string, v double")
    near = {"q1": 0.25, "q2": 0.5, "last": 1.0}
    ranks = {"q1": F.floor(F.col("_n") / 4), "q2": F.floor(F.col("_n") / 2), "last": F.col("_n") - 1}
    assert _fenced(df, "v", ranks, [by] if by else [], near) is not None
    for r in element_at_rank(df, "v", ranks, by, near, few_groups=True).collect():
        v = sorted(x for g, x in data if by is None or g == r.g)
        assert (r.q1, r.q2, r.last) == (v[len(v) // 4], v[len(v) // 2], v[-1])
