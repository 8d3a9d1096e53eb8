"""A row store whose appends can be repeated and made at the same time: a log of batches with the index range of each.

``log/`` holds a small file per batch, numbered, which is created only if its number is free; so of two writers who ask at the same time one
gets the number and the other asks again. A batch that is in the log already keeps its range, and writing its rows again replaces
them. Rows lie in ``rows/batch=<id>`` with their index; a batch counts once its rows are written.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from oreline.functions.ordered import positions
from oreline.session import stage
from oreline.sources.tables import ROW_INDEX


@dataclass(frozen=True)
class Batch:
    id: str
    start: int
    rows: int
    written: bool


class _Files:
    """The store's files, through the file system that Spark reads them by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.fs = self._at("log").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def create(self, name: str, text: str) -> bool:
        """Whether the file was new; an existing one stays as it is."""
        try:
            out = self.fs.create(self._at(name), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def log(self) -> list[dict]:
        if not self.fs.exists(self._at("log")):
            return []
        found = self.spark.read.text(f"{self.root}/log", wholetext=True).select(F.input_file_name().alias("file"), "value").collect()  # a line per batch
        return [json.loads(r.value) for r in sorted(found, key=lambda r: r.file.rsplit("/", 1)[-1]) if r.value]

    def written(self) -> set[str]:
        if not self.fs.exists(self._at("rows")):
            return set()
        folders = [f.getPath().getName() for f in self.fs.listStatus(self._at("rows")) if f.isDirectory()]
        return {name.removeprefix("batch=") for name in folders if self.fs.exists(self._at(f"rows/{name}/_SUCCESS"))}


def batches(spark: SparkSession, path: str) -> list[Batch]:
    """The log in order of its index ranges, with what is written and what a writer has left undone."""
    files = _Files(spark, path)
    done = files.written()
    return [Batch(e["id"], e["start"], e["rows"], e["id"] in done) for e in files.log()]


def append_batch(df: DataFrame, path: str, order, batch: str) -> Batch:
    """Append ``df`` as ``batch``, its rows numbered in ``order`` (which must be total) from the range that the log gives it.

    A batch that is appended again, by a retry or a second writer, keeps its range and replaces its own rows; with another number of
    rows it is refused. Names of batches are letters, digits, ``.``, ``_`` and ``-``.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"not a name for a batch: {batch!r}")
    spark, files = df.sparkSession, _Files(df.sparkSession, path)
    placed = stage(positions(df, order, None, ROW_INDEX), "batch")
    n = placed.count()
    while True:
        log = files.log()
        mine = next((e for e in log if e["id"] == batch), None)
        if mine is None:
            start = max((e["start"] + e["rows"] for e in log), default=0)
            mine = {"id": batch, "start": start, "rows": n}
            if not files.create(f"log/{len(log):012}.json", json.dumps(mine)):
                continue  # another writer has taken the number
        if mine["rows"] != n:
            raise ValueError(f"batch {batch} was appended with {mine['rows']} rows, not {n}")
        rows = placed.withColumn(ROW_INDEX, F.col(ROW_INDEX) + mine["start"])
        rows.write.mode("overwrite").parquet(f"{files.root}/rows/batch={batch}")
        return Batch(batch, mine["start"], n, True)


def read_batches(spark: SparkSession, path: str, chosen: list[Batch] | None = None) -> DataFrame:
    """Rows of the written batches, or of the ``chosen`` ones."""
    found = [b for b in (batches(spark, path) if chosen is None else chosen) if b.written]
    if not found:
        raise ValueError("no batch is written")
    parts = [spark.read.parquet(f"{path.rstrip('/')}/rows/batch={b.id}") for b in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def page_batches(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the written batches, in order of their index, without sorting what lies before.

    The log says which batches hold them and which index range is wanted of each; only these files are read, with the range pushed to them.
    """
    before, wanted = 0, []
    done = [b for b in batches(spark, path) if b.written]
    for b in done:
        first, last = max(offset, before), min(offset + limit, before + b.rows)
        if first < last:
            wanted.append((b, b.start + first - before, b.start + last - before - 1))
        before += b.rows
    if not wanted:
        return read_batches(spark, path, done).limit(0)
    parts = [read_batches(spark, path, [b]).filter(F.col(ROW_INDEX).between(low, high)) for b, low, high in wanted]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(ROW_INDEX)
