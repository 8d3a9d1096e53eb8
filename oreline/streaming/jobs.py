"""Structured Streaming jobs: each takes a stream and returns a stream; sinks are at the end of the file.

State is bounded by watermarks: rows later than the watermark are dropped, as Spark does by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oreline.functions.core import as_list
from oreline.operators.learning import Fitted
from oreline.operators.monitoring import batch_drift, summarize_baseline
from oreline.session import scratch_path


def read_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, ts: str) -> DataFrame:
    """The Parquet files of the table ``name`` as they arrive; watermarks need a zoned timestamp.

    A table is a folder of part files, which is watched, or the files in ``folder`` that match ``name``.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    is_folder = files.exists(path) and files.getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    raw = reader.parquet(f"{folder}/{name}") if is_folder else reader.option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def ab_metrics(stream: DataFrame, ts: str, variant: Column, value: Column, error: Column, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, mean value and error rate per window and variant."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), variant.alias("variant")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.avg(error.cast("double")).alias("error_rate")
    ).select(F.col("w.start").alias("start"), "variant", "n", "avg_value", "error_rate")


def recent_points(stream: DataFrame, ts: str, variant: Column, value: Column, size: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The same over sliding windows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), variant.alias("variant")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value")
    ).select(F.col("w.start").alias("start"), "variant", "n", "avg_value")


def feedback_accuracy(stream: DataFrame, ts: str, model: Column, correct: Column, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), model.alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("accuracy")
    ).select(F.col("w.start").alias("start"), "model", "n", "accuracy")


MATCHES = "key string, model string, n long, correct long, corrected long"
#: What waits in a bucket of keys, a place in each array per key.
WAITING = ", ".join(f"{n} array<{t}>" for n, t in (
    ("key", "string"), ("model", "string"), ("predicted", "string"), ("label", "string"), ("label_at", "long"), ("told", "long"), ("until", "long"),
))


def matched_feedback(
    predictions: DataFrame, feedback: DataFrame, ts: str, key: Column, model: Column, predicted: Column, label: Column,
    late: str = "1 hour", keep_seconds: int = 30 * 86_400, buckets: int = 4096,
) -> DataFrame:
    """Changes ``(key, model, n, correct, corrected)`` of the accuracy per model as feedback meets its prediction.

    Feedback may come before its prediction. Of several labels the one of latest ``ts`` counts (then the greatest); one that
    replaces an earlier one takes that one's change back, so sums of the changes are right at any time (``accuracy_of``). Of
    several predictions of a key the first to arrive counts. Each key waits ``keep_seconds`` of event time after its latest row
    and is then forgotten. Rows without key, time, prediction or label are left out.

    Keys lie in ``buckets`` by hash, and the state is one row per bucket: a call costs more than what it does for one key. The
    keys that wait in a bucket must fit in a task, and those of a touched bucket are written again.
    """
    none = F.lit(None).cast("string")
    sides = [
        (predictions, model.cast("string"), predicted.cast("string"), none),
        (feedback, none, none, label.cast("string")),
    ]
    rows = [
        df.select(key.cast("string").alias("key"), F.col(ts).alias("ts"), m.alias("model"), p.alias("predicted"), y.alias("label"))
        for df, m, p, y in sides
    ]
    both = rows[0].unionByName(rows[1]).filter("key IS NOT NULL AND ts IS NOT NULL AND (predicted IS NOT NULL OR label IS NOT NULL)")
    timed = both.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))

    def follow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {key: list(rest) for key, *rest in zip(*state.get)} if state.exists else {}
        before: dict[str, int] = {}
        for rows in frames:
            rows = rows.sort_values("at", kind="stable")
            for key, at, name, guess, truth in zip(*(rows[c].tolist() for c in ("key", "at", "model", "predicted", "label"))):
                seen = waiting.setdefault(key, [None, None, None, 0, -1, 0])
                before.setdefault(key, seen[4])
                if isinstance(guess, str):
                    if seen[1] is None:
                        seen[:2] = (name if isinstance(name, str) else None), guess
                elif seen[2] is None or (at, truth) > (seen[3], seen[2]):
                    seen[2:4] = truth, int(at)
                seen[5] = max(seen[5], int(at) // 1000 + keep_seconds * 1000)
        now = state.getCurrentWatermarkMs()
        changes = []
        for key, was in before.items():
            seen = waiting[key]
            if seen[1] is not None and seen[2] is not None:
                seen[4] = int(seen[1] == seen[2])
            if seen[4] != was:
                changes.append((key, seen[0], int(was < 0), seen[4] if was < 0 else seen[4] - was, int(was >= 0)))
        kept = [(key, *seen) for key, seen in waiting.items() if key in before or seen[5] >= now]
        if kept:
            state.update(tuple(map(list, zip(*kept))))
            state.setTimeoutTimestamp(max(min(x[6] for x in kept), now + 1))
        else:
            state.remove()
        if changes:
            yield pd.DataFrame(changes, columns=["key", "model", "n", "correct", "corrected"])

    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(follow, MATCHES, WAITING, "append", GroupStateTimeout.EventTimeTimeout)


def accuracy_of(changes: DataFrame) -> DataFrame:
    """``(model, n, accuracy, corrected)`` from the changes of ``matched_feedback``."""
    n = F.sum("n")
    return changes.groupBy("model").agg(n.alias("n"), F.try_divide(F.sum("correct"), n).alias("accuracy"), F.sum("corrected").alias("corrected"))


def sessions(stream: DataFrame, ts: str, user: str, item: str, key: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The sequence of items per user, cut where nothing happened for ``gap``; a session is emitted once it is closed.

    Items stand in order of time, then of ``key``.
    """
    seen = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(key).alias("k"), F.col(item).alias("i")))), lambda e: e["i"])
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(user)).agg(
        F.count(F.lit(1)).alias("n"), seen.alias("items")
    ).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "items")


def score_stream(fitted: Fitted, stream: DataFrame) -> DataFrame:
    """Predictions on arriving rows; stateless."""
    return fitted.score(stream)


# --- sinks ----------------------------------------------------------------------------------------


def run_available(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append all that is there now to Parquet, then stop; returns what was written."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, keys, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Write the changed rows of every micro-batch to its own folder (rewritten whole if a batch is retried),
    then stop; returns the newest row per key."""
    spark = stream.sparkSession
    path, keys = path or scratch_path(spark, "updates"), as_list(keys)
    rest = [c for c in stream.columns if c not in keys]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = (
        stream.writeStream.outputMode("update").foreachBatch(put)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    put(spark.createDataFrame([], stream.schema), -1)  # so that there is a table even if nothing came
    seen = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def run_drift(stream: DataFrame, baseline: DataFrame, columns: list[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Compare every micro-batch with the baseline; one report per batch. The baseline is summarised once."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "drift")
    summary = summarize_baseline(baseline, columns)
    kind = batch_drift(summary, baseline.limit(0)).drop("period").schema

    def compare(batch: DataFrame, number: int) -> None:
        batch_drift(summary, batch).drop("period").write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = (
        stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{path}/batch=-1")
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.LongType())])).parquet(path)
