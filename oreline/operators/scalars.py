"""Row-wise columns: formulas, mathematical and date parts, parsing, colour values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions.core import number, number_in, present, single
from oreline.functions.formula import formula

MATH = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b), "**2": lambda a, b: a * a,
    "sqrt": lambda a, b: F.when(a >= 0, F.sqrt(a)), "abs": lambda a, b: F.abs(a),
}
INTERACTIONS = {
    "product": lambda a, b: a * b, "ratio": lambda a, b: F.try_divide(a, b), "difference": lambda a, b: a - b,
    "sum": lambda a, b: a + b, "mean": lambda a, b: (a + b) / 2,
}
LOGS = {"ln": F.ln, "log2": F.log2, "log10": F.log10}
DATE_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour,
    "weekday": lambda c: F.dayofweek(c) - 1, "quarter": F.quarter, "week": F.weekofyear,
    "is_weekend": lambda c: F.dayofweek(c).isin(1, 7),
}


def derive(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.withColumn(name, formula(df, text))


def math_op(df: DataFrame, name: str, a: str, op: str, b=None) -> DataFrame:
    """One operation between a column and a column or value (0 is Sunday for weekdays, as everywhere here)."""
    right = number(df, b) if isinstance(b, str) else F.lit(float(b)) if b is not None else None
    return df.withColumn(name, MATH[op](number(df, a), right))


def log_transform(df: DataFrame, column: str, kind: str = "ln", name: str | None = None) -> DataFrame:
    x = number(df, column)
    return df.withColumn(name or f"{column}_{kind}", F.round(F.when(x > 0, LOGS[kind](x)), 6))


def log1p(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    x = number(df, column)
    return df.withColumn(name or f"{column}_log", F.when(x >= 0, F.round(F.log1p(x), 6)))


def sqrt_transform(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    x = number(df, column)
    return df.withColumn(name or f"{column}_sqrt", F.when(x >= 0, F.round(F.sqrt(x), 6)))


def l2_normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row divided by its Euclidean length; a zero row stays zero."""
    cells = {c: F.coalesce(number(df, c), F.lit(0.0)) for c in columns}
    norm = F.sqrt(sum((x * x for x in cells.values()), F.lit(0.0)))
    return df.select(
        *[c for c in df.columns if c not in columns],
        *[F.coalesce(F.try_divide(x, norm), F.lit(0.0)).alias(c) for c, x in cells.items()],
    )


def interaction(df: DataFrame, a: str, b: str, kind: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{a}_{kind}_{b}", INTERACTIONS[kind](number(df, a), number(df, b)))


def date_extract(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{p}": DATE_PARTS[p](F.col(column)) for p in parts})


def parse_number(text: Column, decimal_comma: bool = True) -> Column:
    return number_in(F.regexp_replace(text, ",", ".") if decimal_comma else text)


def parse_date(text: Column, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def color_scale(df: DataFrame, value: str, name: str = "color") -> DataFrame:
    """``(value - smallest) / (largest - smallest)``, 0 when all are equal."""
    x = number(df, value)
    edge = single(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    return df.withColumn(
        name, F.coalesce(F.try_divide(x - edge["lo"], edge["hi"] - edge["lo"]), F.lit(0.0))
    )


def palette_index(df: DataFrame, category: str, colors: int, name: str = "color") -> DataFrame:
    """Colour number of a category: its place among the sorted categories, cyclic in ``colors``."""
    from oreline.operators.features import label_codes

    codes = label_codes(df, category)
    return df.join(codes, present(df, category) == F.col("_category"), "left").select(
        *df.columns, F.pmod(F.col("_code"), F.lit(colors)).alias(name)
    )
