"""Column helpers shared by all operators: numbers, missing values, rounding, hash buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMBER_PREFIX = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
WHOLE_NUMBER = r"^-?\d+(\.\d+)?$"


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.NumericType)


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def number_in(text: Column) -> Column:
    """The number a text starts with, NULL when it starts with none (``'12abc'`` gives 12)."""
    return F.nullif(F.regexp_extract(F.trim(text), NUMBER_PREFIX, 0), F.lit("")).try_cast("double")


def number(df: DataFrame, name: str) -> Column:
    """``name`` read as a number; columns that are numeric already are only widened to double."""
    kind = dtype(df, name)
    if isinstance(kind, T.DoubleType):
        return F.col(name)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(name).cast("double")
    return number_in(F.col(name).cast("string"))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, a blank text, or NaN."""
    c, kind = F.col(name), dtype(df, name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, T.StringType):
        return c.isNull() | (F.trim(c) == "")
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value with every spelling of missing turned into NULL."""
    c, kind = F.col(name), dtype(df, name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.StringType):
        return F.nullif(F.trim(c), F.lit(""))
    return c


def with_nulls(df: DataFrame) -> DataFrame:
    """One spelling of missing, NULL, in every column."""
    return df.select([present(df, n).alias(n) for n in df.columns])


def bucket(key: Column, buckets: int, seed: int = 0) -> Column:
    """A bucket in ``[0, buckets)`` from the md5 of the key: same answer under any partitioning."""
    keyed = F.concat_ws("~", key.cast("string"), F.lit(str(seed))) if seed else key.cast("string")
    return F.conv(F.substring(F.md5(keyed), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present, 0 without variance (``corr`` fails there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    r = F.nanvl(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0))))


def ordered_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(o) for o in order])


def as_list(names: str | list[str] | tuple[str, ...] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def single(df: DataFrame) -> Column:
    """The one row of an aggregate as a struct column, usable inside another DataFrame (a scalar subquery)."""
    return df.select(F.struct("*").alias("_row")).scalar()


def ladder(steps: list[tuple[Column, str]], otherwise: str) -> Column:
    """First label whose condition holds."""
    out = F.lit(otherwise)
    for condition, label in reversed(steps):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out
