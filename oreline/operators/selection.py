"""Projections, predicates, ordering and limits."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.functions.core import as_list, is_missing, is_numeric, number, number_in

COMPARE = {
    "=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne,
    ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le,
}


def select_columns(df: DataFrame, columns=None) -> DataFrame:
    """Keep the listed columns; none listed keeps all. A pair ``(name, alias)`` renames."""
    if not columns:
        return df
    return df.select([F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in columns])


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def compare(df: DataFrame, name: str, op: str, value) -> Column:
    """Numeric comparison when cell and value both read as numbers, else comparison of texts.

    A missing cell reads as the empty text, so it is below every other text.
    """
    test = COMPARE[op]
    as_text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    text_test = test(as_text, F.lit(str(value)))
    try:
        literal = float(value)
    except (TypeError, ValueError):
        return text_test
    cell = number(df, name)
    return F.when(cell.isNotNull(), test(cell, F.lit(literal))).otherwise(text_test)


def like(df: DataFrame, name: str, pattern: str) -> Column:
    """``%`` is the only wildcard; case is ignored and the whole value must match."""
    escaped = pattern.replace("\\", "\\\\").replace("_", "\\_")
    return F.ilike(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(escaped))


def condition(df: DataFrame, name: str, op: str, value=None) -> Column:
    kind = op.lower()
    if kind == "is null":
        return is_missing(df, name)
    if kind == "is not null":
        return ~is_missing(df, name)
    if kind == "like":
        return like(df, name, value)
    return compare(df, name, op, value)


def where_chain(df: DataFrame, conditions: list[tuple]) -> DataFrame:
    """Fold ``(conjunction, column, operator, value)`` from left to right, without AND before OR.

    ``a OR b AND c`` therefore means ``(a OR b) AND c``; use ``DataFrame.filter`` for SQL precedence.
    """
    if not conditions:
        return df
    tests = [(c[0], condition(df, *c[1:])) for c in conditions]
    joined = reduce(
        lambda acc, t: (acc | t[1]) if str(t[0]).lower() == "or" else (acc & t[1]), tests[1:], tests[0][1]
    )
    return df.filter(joined)


def filter_rows(df: DataFrame, text: str) -> DataFrame:
    """Filter by a condition text; comparing with ``null`` tests for missing."""
    for sign, test in (("!=", "IS NOT NULL"), ("<>", "IS NOT NULL"), ("==", "IS NULL"), ("=", "IS NULL")):
        for null in ("null", "NULL"):
            text = text.replace(f"{sign} {null}", test).replace(f"{sign}{null}", f" {test}")
    return df.filter(F.expr(text))


def match_equal(df: DataFrame, values: dict) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in values.items()], F.lit(True)))


def search_terms(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows whose joined, lower-cased columns contain every whitespace-separated term."""
    hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.filter(reduce(lambda a, t: a & hay.contains(t), text.lower().split(), F.lit(True)))


def search_and_status(df: DataFrame, name: str, text: str, status: str, wanted: str = "all") -> DataFrame:
    out = df.filter(F.lower(F.col(name)).contains(text.lower()))
    return out if wanted == "all" else out.filter(F.col(status) == wanted)


def drop_missing_rows(df: DataFrame, columns=None) -> DataFrame:
    names = as_list(columns) or df.columns
    return df.filter(reduce(lambda a, n: a & ~is_missing(df, n), names, F.lit(True)))


def threshold_flag(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.withColumn("drifted", F.col(score) >= threshold).withColumn("stable", F.col(score) < threshold)


def order_by_mixed(df: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """Numbers by size, other texts by code point, missing lowest."""
    read = F.col(name) if is_numeric(df, name) else number_in(F.col(name).cast("string"))
    if descending:
        return df.orderBy(read.desc_nulls_last(), F.col(name).desc_nulls_last())
    return df.orderBy(read.asc_nulls_first(), F.col(name).asc_nulls_first())


def order_nulls_last(df: DataFrame, name: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(name) if descending else F.asc_nulls_last(name))


def sort_rows(df: DataFrame, columns, ascending: bool = True) -> DataFrame:
    return df.orderBy(*as_list(columns), ascending=ascending)


def favourites_first(df: DataFrame, flag: str, then: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.desc(flag), F.desc(then) if descending else F.asc(then))


def limit_with_total(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows, each carrying how many rows there were in all."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(n).withColumn("total", total)


def top_k(df: DataFrame, by: str, k: int, tie: str | list[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *as_list(tie)).limit(k)


def top_k_per_group(df: DataFrame, group, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Ranked rows 1..k of each group; Spark cuts every task's part to k rows before the shuffle."""
    spec = Window.partitionBy(*as_list(group)).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") <= k)
    return ranked.withColumn(name, F.col("_rn").cast("bigint")).drop("_rn")
