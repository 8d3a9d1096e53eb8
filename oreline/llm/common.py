"""What the text operators share: table access, the split of labelled rows, bounded samples, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: White space between words, as in every contract: blank and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def schema_with(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and the columns of ``more``, such as ``n bigint, ids array<int>``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5. A null id counts as an empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def hash60(text: Column) -> Column:
    """The first 60 bits of MD5 as a number; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def smallest(df: DataFrame, draw: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest ``draw``, a 60-bit hash in a column of its own.

    Different draws are counted first, and only those under a threshold that lets a little more than ``n`` through are sorted, so the last
    task reads about ``1.2 n`` rows and not ``n`` from every partition. Rows of equal draw count as one: any of them stands for all.
    """
    total = df.agg(F.approx_count_distinct(draw, 0.01)).first()[0]  # a sketch of fixed size, good to a few hundredths
    if total > 2 * n + 200:
        df = df.filter(F.col(draw) < int(2**60 * (1.2 * n + 100) / total))
    rest = [c for c in df.columns if c != draw]
    return df.groupBy(draw).agg(*[F.min(c).alias(c) for c in rest]).orderBy(draw).limit(n).select(*df.columns)


def labelled_sample(labels: DataFrame, label: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """At most ``per_class`` learning ids of each of the labels 0 and 1: ``(key, y)``, those of smallest MD5.

    Held-out, null and contradictory rows are left out; repeated rows count once. The bound makes it safe to broadcast.
    """
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).select(key, F.col(label).cast("int").alias("y"))
    ids = rows.groupBy(key).agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    ids = ids.withColumn("_draw", hash60(F.col(key).cast("string")))
    return smallest(ids.filter("y = 0"), "_draw", per_class).union(smallest(ids.filter("y = 1"), "_draw", per_class)).drop("_draw")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about ``most_bytes`` of text, one row at least, and their texts (null: empty)."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist() if batch.num_rows else []
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start), [t or "" for t in column.slice(start, i - start).to_pylist()]
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start), [t or "" for t in column.slice(start).to_pylist()]


def logistic(features, y, l2: float = 1e-2, rounds: int = 100):
    """Weights and bias (last) of a ridge logistic fit by Newton steps that are halved until they help.

    Columns are scaled to unit spread for the fit, so that the ridge treats them alike; the bias is free of it.
    """
    import numpy as np

    x, y = np.asarray(features, float).reshape(len(y), -1), np.asarray(y, float)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    x = np.column_stack([(x - mean) / spread, np.ones(len(y))])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-9

    def loss(w):
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-8:
            size /= 2
        w -= size * step
        done, now = now - then < 1e-10 * (1 + abs(now)), min(now, then)
        if done:
            break
    w[:-1] /= spread
    w[-1] -= w[:-1] @ mean
    return w
