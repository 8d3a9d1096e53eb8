"""Reading, typing, storing, paging, sampling and writing tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from oreline.functions.core import NUMBER_PREFIX, WHOLE_NUMBER, as_list, present, with_nulls
from oreline.functions.ordered import positions

SEPARATORS = [",", ";", "\t", "|"]
ROW_INDEX = "_row_idx"


def first_lines(spark: SparkSession, path: str, n: int = 1) -> list[str]:
    return [r.value for r in spark.read.text(path).filter(F.trim("value") != "").limit(n).collect()]


def guess_separator(header: str) -> str:
    return max(SEPARATORS, key=header.count)


def looks_binary(lines: list[str]) -> bool:
    text = "".join(lines)
    control = sum(1 for ch in text if ord(ch) < 32 and ch not in "\t\r\n" or ch == "�")
    return text.startswith("PK") or control > 0.05 * max(len(text), 1)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as trimmed texts, missing as NULL; no newline inside quotes, so files split freely.

    Only the header line is looked at to choose the separator.
    """
    head = first_lines(spark, path, 5)
    if not head or looks_binary(head):
        raise ValueError(f"{path} is not a delimited text file")
    sep = sep or guess_separator(head[0])
    raw = spark.read.csv(
        path, header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", enforceSchema=False,
    )
    return with_nulls(raw)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension; what is unknown is tried as delimited text."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".orc":
        return spark.read.orc(path)
    if kind in (".json", ".jsonl"):
        return spark.read.json(path)
    return read_delimited(spark, path)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose present values are all plain numbers become double; one pass over the table."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    tests = []
    for i, n in enumerate(texts):
        x = present(df, n)
        tests += [F.every(x.isNull() | x.rlike(WHOLE_NUMBER)).alias(f"all_{i}"), F.count(x).alias(f"n_{i}")]
    row = df.agg(*tests).first()
    numeric = {n for i, n in enumerate(texts) if row[f"n_{i}"] and row[f"all_{i}"]}
    return df.select([present(df, n).cast("double").alias(n) if n in numeric else F.col(n) for n in df.columns])


def infer_types_sampled(df: DataFrame, rows: int = 200) -> DataFrame:
    """Name and type as judged from the first rows only."""
    head, tests = df.limit(rows), []
    for n in df.columns:
        x = present(df, n).cast("string")
        whole = x.rlike(NUMBER_PREFIX + "$")
        tests.append(
            F.struct(
                F.lit(n).alias("name"),
                F.when(F.coalesce(F.every(x.isNull() | whole), F.lit(False)) & (F.count(x) > 0), "number")
                .otherwise("string").alias("type"),
            )
        )
    return head.agg(F.array(*tests).alias("c")).select(F.inline("c"))


def numeric_columns(df: DataFrame) -> DataFrame:
    """Only numeric columns, only rows where all of them are present."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.select(names).dropna(subset=names)


# --- keyed store ----------------------------------------------------------------------------------


def save_dataset(df: DataFrame, name: str, folder: str | None = None) -> None:
    """Store under a name, as an external table when a folder is given."""
    writer = df.write.mode("overwrite").format("parquet")
    if folder:
        writer = writer.option("path", f"{folder.rstrip('/')}/{name}")
    writer.saveAsTable(name)


def load_dataset(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def has_dataset(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def delete_dataset(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def list_datasets(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").filter(~F.col("isTemporary")).select(F.col("tableName").alias("name"))


# --- row store ------------------------------------------------------------------------------------


def append_rows(df: DataFrame, path: str, order, project: str | None = None) -> None:
    """Append a batch to a row store, numbering on from the highest index stored."""
    spark = df.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max(ROW_INDEX)).first()[0]
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    start = 0 if last is None else last + 1
    rows = positions(df, order, None, ROW_INDEX).withColumn(ROW_INDEX, F.col(ROW_INDEX) + start)
    if project is not None:
        rows = rows.withColumn("project_id", F.lit(project))
    rows.write.mode("append").parquet(path)


def page_rows(df: DataFrame, offset: int, limit: int, dense: bool = False) -> DataFrame:
    """One page by row index. A dense index (0, 1, 2, …) needs no sort: the range is pushed to the scan."""
    if dense:
        return df.filter(F.col(ROW_INDEX).between(offset, offset + limit - 1))
    return df.orderBy(ROW_INDEX).offset(offset).limit(limit)


def without_project(df: DataFrame, project: str) -> DataFrame:
    return df.filter(~F.col("project_id").eqNullSafe(F.lit(project)))


def records_from_json(df: DataFrame, data: str, schema: T.StructType | str) -> DataFrame:
    """Base columns with the fields of the JSON column merged over them."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = df.withColumn("_j", F.from_json(F.col(data), fields))
    base = [c for c in df.columns if c != data and c not in fields.names]
    merged = [
        (F.coalesce(F.col("_j")[n], F.col(n).cast(fields[n].dataType)) if n in df.columns else F.col("_j")[n]).alias(n)
        for n in fields.names
    ]
    return parsed.select(*base, *merged)


# --- sinks ----------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, columns=None, sep: str = ",") -> None:
    df.select(*(as_list(columns) or df.columns)).write.mode("overwrite").csv(
        path, header=True, sep=sep, quote='"', escape='"', emptyValue="", nullValue=""
    )


def write_tsv(df: DataFrame, path: str, columns=None) -> None:
    write_csv(df, path, columns, "\t")


def write_json(df: DataFrame, path: str, columns=None) -> None:
    df.select(*(as_list(columns) or df.columns)).write.mode("overwrite").json(path)


# --- samples --------------------------------------------------------------------------------------


def head_sample(df: DataFrame, order, n: int = 5) -> DataFrame:
    """The first rows by ``order``."""
    return df.orderBy(*as_list(order)).limit(n)


def bounded_sample(df: DataFrame, order, max_rows: int = 1000, max_bytes: int = 600_000, at_least: int = 50) -> DataFrame:
    """The first rows until ``max_rows`` or ``max_bytes`` of JSON, but no fewer than ``at_least``.

    The running sum only ever sees ``max_rows`` rows.
    """
    head = df.orderBy(*as_list(order)).limit(max_rows)
    spec = Window.partitionBy().orderBy(*as_list(order)).rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    sized = head.withColumns({"_bytes": F.sum(size).over(spec), "_rn": F.count(F.lit(1)).over(spec)})
    return sized.filter((F.col("_bytes") <= max_bytes) | (F.col("_rn") <= at_least)).drop("_bytes", "_rn")


def stride_sample(df: DataFrame, cap: int, index: str = ROW_INDEX) -> DataFrame:
    """Every k-th row with ``k = ceil(rows / cap)``."""
    k = F.greatest(F.ceil(df.agg(F.count(F.lit(1))).scalar() / F.lit(cap)), F.lit(1))
    return df.filter(F.pmod(F.col(index), k) == 0)


def random_sample(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order of their key: the same rows under any partitioning."""
    hashed = F.md5(F.concat_ws("~", *[F.col(k).cast("string") for k in as_list(key)], F.lit(str(seed))))
    return df.orderBy(hashed, *as_list(key)).limit(n)
