"""Joins, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions.core import as_list, dtype, present


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in ``order``.

    An aggregate with map-side combine, so a hot key costs one row per task in the shuffle.
    """
    keys, order = as_list(keys), as_list(order)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    first = F.min_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*").select(*df.columns)


def join_first(a: DataFrame, b: DataFrame, key_a: str, key_b: str, order_b, how: str = "left") -> DataFrame:
    """Join to the first row of ``b`` per key.

    Keys compare as texts when their types differ, a missing key never matches, the key of ``b`` is dropped
    and its colliding columns get ``_b``. Unmatched cells are NULL.
    """
    b1 = first_per_key(b.filter(present(b, key_b).isNotNull()), key_b, order_b)
    names = {c: (f"{c}_b" if c in a.columns else c) for c in b.columns if c != key_b}
    left, right = present(a, key_a), F.col("_key_b")
    if dtype(a, key_a) != dtype(b, key_b):
        left, right = left.cast("string"), right.cast("string")
    keyed = b1.select(F.col(key_b).alias("_key_b"), *[F.col(c).alias(f"_b_{c}") for c in names])
    joined = a.join(keyed, left == right, how)
    return joined.select(*a.columns, *[F.col(f"_b_{c}").alias(new) for c, new in names.items()])


def join_report(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """How many rows of ``a`` find a partner, and how many rows each kind of join returns."""
    keys = b.filter(present(b, key_b).isNotNull()).select(F.col(key_b).cast("string").alias("_k")).distinct()
    marked = a.select(present(a, key_a).cast("string").alias("_ka")).join(keys, F.col("_ka") == F.col("_k"), "left")
    return marked.agg(
        F.count(F.lit(1)).alias("left_rows"), F.count("_k").alias("matched"), F.count("_k").alias("inner_rows")
    )


def lookup(df: DataFrame, parents: DataFrame, key: str, parent_key: str, columns: dict[str, str]) -> DataFrame:
    """Add columns of the parent row found by id; AQE broadcasts the parents when they are small."""
    cut = parents.select(F.col(parent_key).alias("_pk"), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(cut, F.col(key) == F.col("_pk"), "left").drop("_pk")


def count_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "n") -> DataFrame:
    counts = children.groupBy(F.col(child_key).alias("_ck")).agg(F.count(F.lit(1)).alias("_n"))
    return parents.join(counts, F.col(key) == F.col("_ck"), "left").select(
        *parents.columns, F.coalesce("_n", F.lit(0)).alias(name)
    )


def having_match(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows with at least one partner."""
    return df.join(other.select(F.col(other_key).alias("_ok")), F.col(key) == F.col("_ok"), "left_semi")


def without_match(df: DataFrame, other: DataFrame, key: Column, other_key: str) -> DataFrame:
    """Rows with no partner, such as children left after their removed parents."""
    return df.join(other.select(F.col(other_key).alias("_ok")), key == F.col("_ok"), "left_anti")


def concat_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, columns by name; a column whose types differ becomes text."""
    clash = [c for c in a.columns if c in b.columns and dtype(a, c) != dtype(b, c)]
    as_text = {c: F.col(c).cast("string") for c in clash}
    if clash:
        a, b = a.withColumns(as_text), b.withColumns(as_text)
    return a.unionByName(b, allowMissingColumns=True)


def drop_duplicates(df: DataFrame, columns=None, order=None) -> DataFrame:
    """One row per distinct row, or per listed columns the first in ``order``."""
    if not columns:
        return df.dropDuplicates()
    return first_per_key(df, columns, order) if order else df.dropDuplicates(as_list(columns))


def count_duplicates(df: DataFrame, columns=None) -> DataFrame:
    """Rows beyond the first of each identical row."""
    groups = df.groupBy(*(as_list(columns) or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
    )


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col(name).isNotNull()).select(name).distinct().orderBy(name)
