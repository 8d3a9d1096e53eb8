"""Step lists: named operators run in dependency order, with a log of what each did."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce
from graphlib import TopologicalSorter

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from oreline.functions.core import numeric_names
from oreline.operators import clustering as cl, evaluation as ev, explain as ex, features as fe, learning as ml, quality as dq, scalars as sc
from oreline.operators import joins as jn, selection as sl, text as tx, windows as wn
from oreline.session import stage
from oreline.sources import tables as tb


@dataclass
class Step:
    id: str
    type: str
    config: dict = field(default_factory=dict)
    timeout: float | None = None


def _impute(df: DataFrame, strategy: str = "mean", columns=None, value=None, order=None, by=None) -> DataFrame:
    if strategy == "constant":
        return dq.impute_constant(df, {c: value for c in columns})
    if strategy == "drop":
        return sl.drop_missing_rows(df, columns)
    if strategy == "ffill":
        return reduce(lambda d, c: wn.forward_fill(d, c, order, by), columns, df)
    return dq.impute(df, strategy, columns)


def _scale(df: DataFrame, method: str = "standard", columns=None) -> DataFrame:
    columns = columns or numeric_names(df)
    if method in ("log", "sqrt"):
        one = sc.log1p if method == "log" else sc.sqrt_transform
        return reduce(lambda d, c: one(d, c), columns, df)
    if method == "l2":
        return sc.l2_normalize(df, columns)
    return {"standard": fe.scale_zscore, "minmax": fe.scale_minmax, "robust": fe.scale_robust, "maxabs": fe.scale_maxabs}[method](df, columns)


def _encode(df: DataFrame, method: str = "onehot", columns=(), target: str | None = None, order=None) -> DataFrame:
    one = {
        "onehot": fe.one_hot, "label": fe.label_encode, "binary": fe.binary_encode, "frequency": fe.frequency_encode,
        "target": lambda d, c: fe.target_encode(d, c, target), "ordinal": lambda d, c: fe.ordinal_encode(d, c, order),
    }[method]
    return reduce(one, columns, df)


def _cluster(df: DataFrame, algorithm: str = "kmeans", columns=None, k: int = 3, key: str | None = None, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    if algorithm == "dbscan":
        return df.join(cl.dbscan(df, key, columns, eps, min_points), F.col(key) == F.col("id")).drop("id")
    if algorithm == "hierarchical":
        return cl.hierarchical(df, k, columns).drop("features")
    if algorithm == "gaussian_mixture":
        return cl.gaussian_mixture(df, k, columns).drop("features", "probability")
    return cl.kmeans(df, k, columns)[0].drop("features")


def _write(df: DataFrame, path: str, format: str = "parquet", columns=None) -> DataFrame:
    if format == "parquet":
        df.select(*(columns or df.columns)).write.mode("overwrite").parquet(path)
    else:
        {"csv": tb.write_csv, "tsv": tb.write_tsv, "json": tb.write_json}[format](df, path, columns)
    return df


def _derive(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    return reduce(lambda d, kv: sc.derive(d, *kv), formulas.items(), df)


def _model(task: str):
    def run(df: DataFrame, target: str, key: str, models=None, columns=None) -> DataFrame:
        return ml.train_leaderboard(df, target, task, key, models, columns=columns)

    return run


def _evaluate(df: DataFrame, label: str, prediction: str, task: str = "classification") -> DataFrame:
    return (ev.class_metrics if task == "classification" else ev.reg_metrics)(df, label, prediction)


def _explain(df: DataFrame, target: str, task: str, key: str, model: str = "", columns=None) -> DataFrame:
    return ex.shap_values(ml.fit(df, target, task, model, columns), df, key)


def _split(df: DataFrame, key: str, train_percent: int = 80, stratify: str | None = None, order=None) -> DataFrame:
    if order:
        return fe.temporal_split(df, order, train_percent)
    return fe.stratified_split(df, key, stratify, train_percent) if stratify else fe.train_test_split(df, key, train_percent)


def _rolling(df: DataFrame, value: str, order, window: int = 7, by=None) -> DataFrame:
    placed = wn.numbered_series(df, order, by, "_pos")
    lagged = wn.lagged(placed, value, 1, "_pos", by, f"{value}_lag1")
    return wn.rolling_mean(lagged, value, window, "_pos", by, f"{value}_mean{window}").drop("_pos")


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "data_source": lambda df: df,
    "filter": lambda df, condition: sl.filter_rows(df, condition),
    "select_columns": lambda df, columns: sl.select_columns(df, columns),
    "rename": lambda df, names: sl.rename_columns(df, names),
    "sort": lambda df, columns, ascending=True: sl.sort_rows(df, columns, ascending),
    "deduplicate": lambda df, columns=None, order=None: jn.drop_duplicates(df, columns, order),
    "imputer": _impute,
    "scaler": _scale,
    "encoder": _encode,
    "feature_engineering": _derive,
    "lag_features": _rolling,
    "tokenizer": lambda df, column: tx.tokenize(df, column),
    "outlier_removal": lambda df, column, method="iqr", factor=None: dq.remove_outliers(df, column, method, factor),
    "anomaly_detection": lambda df, key, columns, method="zscore", share=0.05: cl.anomaly_scores(df, key, columns, method, share),
    "pca": lambda df, columns=None, n=3: cl.pca(df, columns, n)[0],
    "split": _split,
    "cross_validation": lambda df, target, task, key, model="", k=5, columns=None: ml.cross_validate(df, target, task, key, model, k, columns),
    "classification": _model("classification"),
    "regression": _model("regression"),
    "clustering": _cluster,
    "tuning": lambda df, target, task, key, model, trials=20, k=4, columns=None: ml.hyper_search(df, target, task, key, model, trials, k, columns),
    "evaluator": _evaluate,
    "explain": _explain,
    "output": _write,
}


def _join(tables: list[DataFrame], on, how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), tables)


def _union(tables: list[DataFrame]) -> DataFrame:
    """All rows; columns that a table lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


#: Steps that take all tables before them, in the order of their edges.
SEVERAL: dict[str, Callable[..., DataFrame]] = {"join": _join, "union": _union}


@dataclass
class Run:
    outputs: dict[str, DataFrame]
    log: DataFrame


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Evaluate ``df`` once: its rows are written to the shared folder and read from there. The files know their counts."""
    kept = stage(df, "step")
    return kept, kept.count()


def _within(df: DataFrame, seconds: float | None, action: Callable):
    """Run ``action``; its Spark jobs are cancelled after ``seconds``."""
    if seconds is None:
        return action()
    context, group = df.sparkSession.sparkContext, f"step-{uuid.uuid4().hex}"
    context.setJobGroup(group, "a step with a time limit", interruptOnCancel=True)
    timer = threading.Timer(seconds, context.cancelJobGroup, [group])
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)


def run_steps(df: DataFrame, steps: list[Step], edges: list[tuple[str, str]] | None = None, timeout: float | None = None, at_once: int = 4) -> Run:
    """Run the steps in dependency order (in list order without edges); steps behind a failure are skipped, others go on.

    A step takes the output of the step before it, steps without one take ``df``, ``join`` and ``union`` all tables that lead to them. Steps
    that don't wait for each other run at the same time, ``at_once`` of them, each in a scheduler pool of its own. Every step is run once:
    its output is written to the shared folder, where the steps after it read it, so what fails while rows are made fails the step
    that makes them. A step may take ``Step.timeout`` seconds, all together ``timeout``. The log has a row per step, in dependency
    order: status (``success``, ``failed``, ``timeout``, ``skipped``), rows in and out, columns added and removed, seconds, error.
    """
    by_id = {s.id: s for s in steps}
    edges = edges if edges is not None else list(zip([s.id for s in steps], [s.id for s in steps][1:]))
    before: dict[str, list[str]] = {s.id: [] for s in steps}
    for a, b in edges:
        before[b].append(a)
    names = list(TopologicalSorter(before).static_order())
    started, outputs, counts, rows = time.time(), {}, {}, {}
    if any(not before[n] for n in names):
        counts[None] = df.count()

    def run(name: str) -> tuple:
        step, parents = by_id[name], before[name] or [None]
        limits = [x for x in (step.timeout, None if timeout is None else timeout - (time.time() - started)) if x is not None]
        if any(p is not None and p not in outputs for p in parents) or limits and min(limits) <= 0:
            return (name, step.type, "skipped", None, None, [], [], 0.0, None)
        sources, t0 = [df if p is None else outputs[p] for p in parents], time.time()
        columns, rows_in = list(dict.fromkeys(c for s in sources for c in s.columns)), sum(counts[p] for p in parents)
        context = df.sparkSession.sparkContext
        context.setLocalProperty("spark.scheduler.pool", f"step-{name}")

        def make() -> DataFrame:
            if step.type in SEVERAL:
                return SEVERAL[step.type](sources, **step.config)
            if len(sources) > 1:
                raise ValueError(f"{step.type} takes one table, {len(sources)} lead to it")
            return OPERATORS[step.type](sources[0], **step.config)

        try:
            out, n = _within(df, min(limits) if limits else None, lambda: _counted(make()))
        except Exception as e:
            late = limits and time.time() - t0 >= min(limits)
            return (name, step.type, "timeout" if late else "failed", rows_in, None, [], [], round(time.time() - t0, 3), str(e)[:500])
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
        outputs[name], counts[name] = out, n
        return (name, step.type, "success", rows_in, n, [c for c in out.columns if c not in columns], [c for c in columns if c not in out.columns], round(time.time() - t0, 3), None)

    order = TopologicalSorter(before)
    order.prepare()
    with ThreadPoolExecutor(at_once) as pool:
        running: dict[Future, str] = {}
        while order.is_active():
            running |= {pool.submit(inheritable_thread_target(df.sparkSession)(run), name): name for name in order.get_ready()}
            for future in wait(running, return_when=FIRST_COMPLETED).done:
                name = running.pop(future)
                rows[name] = future.result()
                order.done(name)
    kind = "step string, type string, status string, rows_in bigint, rows_out bigint, added array<string>, removed array<string>, seconds double, error string"
    return Run(outputs, df.sparkSession.createDataFrame([rows[n] for n in names], kind))
