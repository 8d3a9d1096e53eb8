"""User formulas such as ``a / b + log(c)`` as Spark columns."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions.core import number


def _both(fn):
    """Smallest or largest of two values; unknown when either is."""
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), fn(a, b))


FUNCTIONS = {
    "log": F.log10, "ln": F.ln, "sqrt": F.sqrt, "abs": F.abs, "exp": F.exp,
    "min": _both(F.least), "max": _both(F.greatest),
}
ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b)),
    ast.Mod: lambda a, b: F.try_mod(a, b),
    ast.Pow: lambda a, b: F.pow(a, b),
}


def finite(c: Column) -> Column:
    """NULL in place of NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def formula(df: DataFrame, text: str) -> Column:
    """``+ - * / % ^``, signs, parentheses, numbers, column names and ``log ln sqrt abs exp min max``.

    A cell that is not a number counts as 0, a division by 0 gives 0, a result that is not finite is NULL,
    and the value is rounded to six places.
    """
    holders: dict[str, str] = {}

    def held(found: re.Match) -> str:
        holders[f"col_{len(holders)}_"] = found.group(0)
        return f"col_{len(holders) - 1}_"

    names = sorted(df.columns, key=len, reverse=True)
    pattern = "|".join(rf"(?<![\w.]){re.escape(n)}(?![\w(])" for n in names)
    source = re.sub(pattern, held, text).replace("^", "**")

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=key):
                if key not in holders:
                    return F.lit(0.0)  # a name that is not a column reads as a cell without a number
                return F.coalesce(number(df, holders[key]), F.lit(0.0))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in ARITHMETIC:
                return ARITHMETIC[type(op)](build(a), build(b))
            case ast.Call(func=ast.Name(id=fn), args=args) if fn.lower() in FUNCTIONS:
                return FUNCTIONS[fn.lower()](*[build(x) for x in args])
        raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")

    return F.round(finite(build(ast.parse(source.strip(), mode="eval").body)), 6)
