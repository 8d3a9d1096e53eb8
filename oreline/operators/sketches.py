"""Profiles that merge: a row of sketches per column and part of a table, so that an append is profiled by its own rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from oreline.functions.core import as_list, is_missing, is_numeric, number

#: Bits of the distinct-value sketch (standard error 1.04 / sqrt(2 ** bits)), and the size of the quantile sketch.
BITS, QUANTILES = 12, 400


def column_sketches(df: DataFrame, columns=None, part: str | None = None) -> DataFrame:
    """``(part, name, n, missing, distinct, numbers, min, max, total, quantiles)``: a row per column of each value of ``part``.

    One pass with a combine in every task; ``distinct`` and ``quantiles`` are sketches of bounded size. Texts have no numbers.
    Without ``part`` the whole table is one part, called NULL. The result is a table to keep and to add to.
    """
    columns = as_list(columns) or [c for c in df.columns if c != part]
    cells = [
        F.struct(
            F.lit(c).alias("name"), F.when(~is_missing(df, c), F.col(c).cast("string")).alias("v"),
            (F.nullif(number(df, c), F.lit(float("nan"))) if is_numeric(df, c) else F.lit(None).cast("double")).alias("x"),
        )
        for c in columns
    ]
    of = F.col(part).cast("string") if part else F.lit(None).cast("string")
    long = df.select(of.alias("part"), F.explode(F.array(*cells)).alias("c")).select("part", "c.*")
    return long.groupBy("part", "name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.hll_sketch_agg("v", BITS).alias("distinct"),
        F.count("x").alias("numbers"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("total"),
        F.kll_sketch_agg_double("x", QUANTILES).alias("quantiles"),
    )


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One row per column from the rows of its parts; merging again changes nothing."""
    return sketches.groupBy("name").agg(
        F.lit(None).cast("string").alias("part"), F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.hll_union_agg("distinct").alias("distinct"),
        F.sum("numbers").alias("numbers"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    ).select(*sketches.columns)


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """``name, n, missing, distinct_values, min, max, mean, q1, median, q3`` of a kept table of sketches; the table itself isn't read.

    Counts, extremes and means are exact. Distinct values have the sketch's standard error, quartiles its error in rank.
    """
    one = merged_sketches(sketches)
    at = lambda q: F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(q)))
    return one.select(
        "name", "n", "missing", F.hll_sketch_estimate("distinct").alias("distinct_values"), "min", "max", F.try_divide("total", "numbers").alias("mean"),
        at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"),
    )
