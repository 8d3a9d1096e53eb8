"""Explaining fitted models: importance, dependence, contributions, Shapley values.

Methods build one table of changed rows and score it with a single ``transform``; importance and dependence of a regression
tree change blocks of encoded rows in the tasks instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.functions.core import bucket, dtype, is_numeric, number
from oreline.operators import evaluation as ev
from oreline.operators.features import feature_spec
from oreline.operators.learning import Fitted
from oreline.session import stage
from oreline.sources.tables import random_sample


#: Hex digits of a key's md5 that name its bucket: 65,536 counts of buckets come to the driver.
DIGITS = 4


def _ring_chunks(counts: list[tuple[str, int]], reach: int) -> list[tuple[str, int, int]]:
    """Chunks of consecutive buckets as rows ``(bucket, chunk, turn)``: 0 for a chunk's own rows, 1 for the ``reach`` rows or more that follow them.

    Behind the last bucket follows the first, with turn 2.
    """
    size, start, chunk_of = max(8192, 8 * reach), 0, []
    for _, n in counts:
        chunk_of.append(start // size)
        start += n
    out = [(b, c, 0) for (b, _), c in zip(counts, chunk_of)]
    for i, c in enumerate(chunk_of):
        if i + 1 < len(counts) and chunk_of[i + 1] == c:
            continue
        seen, j = 0, i + 1
        while seen < reach:
            b, n = counts[j % len(counts)]
            out.append((b, c, 1 + j // len(counts)))
            seen, j = seen + n, j + 1
    return out


def permutation_importance(fitted: Fitted, df: DataFrame, key: str, repeats: int = 3) -> DataFrame:
    """Mean drop of accuracy or R² when a column takes the values of other rows.

    A shuffle is a cyclic shift in hash order: chunks of that order, each with the rows that follow it, look ahead. ``key`` is unique;
    ``df`` is read twice. Regression trees score blocks of encoded rows, other models a row per changed copy.
    """
    cols = fitted.encoding.columns
    digest = F.coalesce(F.md5(F.col(key).cast("string")), F.lit("0" * 32))
    base = df.withColumn("_y", fitted.encoding.label(df)).filter("_y IS NOT NULL").select(
        "_y", F.struct(*cols).alias("_own"), F.col(key).alias("_key"), F.unhex(digest).alias("_h"), F.substring(digest, 1, DIGITS).alias("_b"),
    )
    moments = F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), F.coalesce(F.var_pop("_y"), F.lit(0.0)).alias("v")
    buckets = base.groupBy("_b").agg(*moments).orderBy("_b").collect()  # at most 16 ** DIGITS
    n = sum(r.n for r in buckets)
    steps = [(1 + r * 7919) % max(n, 1) or 1 for r in range(repeats)]
    homes = df.sparkSession.createDataFrame(_ring_chunks([(r["_b"], r.n) for r in buckets], max(steps)), "_b string, _chunk int, _turn int")
    order = Window.partitionBy("_chunk").orderBy("_turn", "_h", "_key")
    others = [F.lead("_own", step).over(order).alias(f"_o{r}") for r, step in enumerate(steps)]
    pairs = base.join(F.broadcast(homes), "_b").select("_y", "_own", "_turn", *others).filter("_turn = 0")
    variants = [("", 0), *[(c, r) for c in cols for r in range(repeats)]]
    predict = fitted.on_blocks()
    if predict is not None:
        mean = sum(r.n * r.m for r in buckets) / max(n, 1)
        total = sum(r.n * (r.v + (r.m - mean) ** 2) for r in buckets)
        changes = [(r, fitted.slots(c)) for c, r in variants]
        lost = _encoded_beside(fitted, pairs, ["_own", *[f"_o{r}" for r in range(repeats)]]).mapInArrow(
            partial(_squared_errors, predict, changes, len(fitted.encoding.names)), "variant int, e double"
        )
        named = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(r).alias("repeat")) for c, r in variants])
        out = lost.groupBy("variant").agg(F.sum("e").alias("_e")).select(
            named[F.col("variant")]["feature"].alias("feature"), F.round(1 - F.col("_e") / (total or 1.0), 4).alias("_m")
        )
    else:
        marks = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(r).alias("repeat")) for c, r in variants])
        other = F.array(*[F.col(f"_o{r}") for r in range(repeats)])[F.col("repeat")]
        scored = fitted.score(pairs.select("*", F.inline(marks)).select(
            "_y", "repeat", "feature", *[F.when(F.col("feature") == c, other[c]).otherwise(F.col("_own")[c]).alias(c) for c in cols]
        ))
        by = ["feature", "repeat"]
        if fitted.task == "classification":
            out = ev.class_metrics(scored, "_y", "prediction", by).withColumn("_m", F.col("accuracy"))
        else:
            out = ev.reg_metrics(scored, "_y", "prediction", by).withColumn("_m", F.col("r2"))
    means = stage(out.groupBy("feature").agg(F.avg("_m").alias("_m")), "importance")
    base_score = means.filter("feature = ''").agg(F.max("_m")).scalar()
    return means.filter("feature <> ''").select(
        "feature", F.round(base_score - F.col("_m"), 4).alias("importance"), F.round(base_score, 4).alias("baseline")
    )


def _matrix(batch: pa.RecordBatch, first: int, width: int) -> np.ndarray:
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(width)])


def _encoded_beside(fitted: Fitted, pairs: DataFrame, structs: list[str]) -> DataFrame:
    """``_y`` and the encoded numbers of each struct of raw columns, all as plain columns."""
    for s in structs:
        raw = [F.col(s)[c].alias(c) for c in fitted.encoding.columns]
        kept = [c for c in pairs.columns if c not in fitted.encoding.columns]
        pairs = fitted.encoding.numbers(pairs.select(*kept, *raw), f"{s}_")
    return pairs.select("_y", *[f"{s}_{i}" for s in structs for i in range(len(fitted.encoding.names))])


def _squared_errors(predict, changes: list[tuple[int, list[int]]], width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of squared errors after each change, which names another row and the places taken from it."""
    lost = np.zeros(len(changes))
    for batch in batches:
        y, own = _matrix(batch, 0, 1)[:, 0], _matrix(batch, 1, width)
        rest = [_matrix(batch, at, width) for at in range(1 + width, batch.num_columns, width)]
        for i, (r, slots) in enumerate(changes):
            changed = own.copy()
            changed[:, slots] = rest[r][:, slots]
            lost[i] += np.square(y - predict(changed)).sum()
    yield pa.RecordBatch.from_pydict({"variant": pa.array(range(len(changes)), pa.int32()), "e": pa.array(lost)})


def tree_importance(fitted: Fitted, spark, top: int = 15) -> DataFrame:
    """Share of impurity gain per encoded feature."""
    values = fitted.model.featureImportances.toArray().tolist()
    rows = sorted(zip(fitted.encoding.names, values), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame([(n, round(v, 6)) for n, v in rows], "feature string, importance double")


def _grid(df: DataFrame, feature: str, points: int) -> Column:
    """Array of the values a feature is swept over: an even grid, or its most frequent values."""
    spec = feature_spec(df, feature).first()
    if spec["options"] is not None:
        return F.array(*[F.lit(o) for o in spec["options"]])
    lo, hi = spec["min"], spec["max"]
    return F.array(*[F.lit(round(lo + (hi - lo) * i / (points - 1), 4)) for i in range(points)])


def partial_dependence(fitted: Fitted, df: DataFrame, feature: str, points: int = 20) -> DataFrame:
    """Mean score over all rows with the feature set to each grid value; a regression tree scores blocks of encoded rows."""
    grid = _grid(df, feature, points)
    value = F.col("_x").cast(dtype(df, feature)) if not is_numeric(df, feature) else F.col("_x")
    predict, width = fitted.on_blocks(), len(fitted.encoding.names)
    if predict is not None and feature in fitted.encoding.columns:
        swept = df.sparkSession.range(1).select(*[F.lit(None).cast(dtype(df, c)).alias(c) for c in fitted.encoding.columns if c != feature], F.posexplode(grid).alias("_i", "_x"))
        places = [f"_e{i}" for i in range(width)]
        cells = [(r["_x"], *r[1:]) for r in fitted.encoding.numbers(swept.withColumn(feature, value), "_e").orderBy("_i").select("_x", *places).collect()]
        changed = np.array([c[1:] for c in cells], dtype=float).reshape(len(cells), width)
        rows = fitted.encoding.numbers(df.select(*fitted.encoding.columns), "_e").select(*places)
        sums = rows.mapInArrow(partial(_sums_over_grid, predict, changed, fitted.slots(feature)), "at int, s double, n bigint")
        xs = F.array(*[F.lit(c[0]) for c in cells])
        return sums.groupBy("at").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n")).filter("_n > 0").select(
            xs[F.col("at")].alias("x"), F.round(F.col("_s") / F.col("_n"), 4).alias("y")
        )
    rows = df.select(*fitted.encoding.columns).withColumn("_x", F.explode(grid)).withColumn(feature, value)
    return fitted.scalar(rows).groupBy(F.col("_x").alias("x")).agg(F.round(F.avg("score"), 4).alias("y"))


def _sums_over_grid(predict, changed: np.ndarray, slots: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the scores with the places of one feature set to each row of ``changed``."""
    sums, rows = np.zeros(len(changed)), 0
    for batch in batches:
        x = _matrix(batch, 0, changed.shape[1])
        rows += len(x)
        for i, cells in enumerate(changed):
            x[:, slots] = cells[slots]
            sums[i] += predict(x).sum()
    yield pa.RecordBatch.from_pydict(
        {"at": pa.array(range(len(changed)), pa.int32()), "s": pa.array(sums), "n": pa.array([rows] * len(changed), pa.int64())}
    )


def ice_curves(fitted: Fitted, df: DataFrame, feature: str, key: str, curves: int = 12, points: int = 20) -> DataFrame:
    few = random_sample(df.select(key, *[c for c in fitted.encoding.columns if c != key]), curves, key)
    rows = few.withColumn("_x", F.explode(_grid(df, feature, points)))
    rows = rows.withColumn(feature, F.col("_x"))
    return fitted.scalar(rows).select(F.col(key).alias("curve"), F.col("_x").alias("x"), F.round("score", 4).alias("y"))


def _typical(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Mean of numbers, most frequent value of texts, as constants."""
    spec = {r["name"]: r for r in feature_spec(df, columns, 1).collect()}  # one row per feature
    return {
        c: F.lit(spec[c]["mean"]) if spec[c]["options"] is None else F.lit(spec[c]["options"][0] if spec[c]["options"] else None)
        for c in columns
    }


def local_contribution(fitted: Fitted, df: DataFrame, key: str, background: DataFrame | None = None) -> DataFrame:
    """Per row and feature: the score less the score with the feature at its typical value."""
    cols = fitted.encoding.columns
    typical = _typical(background if background is not None else df, cols)
    rows = df.select(F.col(key).alias("_key"), *cols).withColumn("_f", F.explode(F.array(F.lit(""), *[F.lit(c) for c in cols])))
    changed = rows.select("_key", "_f", *[F.when(F.col("_f") == c, typical[c]).otherwise(F.col(c)).alias(c) for c in cols])
    scored = fitted.scalar(changed).select("_key", "_f", "score")
    wide = scored.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_f", "score"))).alias("_m"))  # one entry per feature
    return wide.select(F.col("_key").alias(key), F.col("_m")[""].alias("_base"), F.explode("_m").alias("feature", "_s")).filter(
        "feature <> ''"
    ).select(key, "feature", F.round(F.col("_base") - F.col("_s"), 4).alias("contribution"))


def what_if(fitted: Fitted, df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Score before and after the changes."""
    before = fitted.scalar(df).select(*df.columns, F.col("score").alias("score_before"))
    kept = {f"_was_{c}": F.col(c) for c in changes}
    after = fitted.scalar(before.withColumns(kept).withColumns(changes))
    return after.withColumns({c: F.col(f"_was_{c}") for c in changes}).select(
        *df.columns, F.round("score_before", 4).alias("score_before"), F.round("score", 4).alias("score_after")
    )


def shap_values(fitted: Fitted, df: DataFrame, key: str, permutations: int = 8, background: int = 50) -> DataFrame:
    """Monte-Carlo Shapley values: features of a row replace those of a background row in random order.

    Each (row, permutation) becomes one row per prefix of the order; the change of score between two
    prefixes belongs to the feature that was added. Orders and background rows come from hashes.
    """
    cols = fitted.encoding.columns
    d = len(cols)
    pool = random_sample(df.select(key, *[c for c in cols if c != key]), background, key).collect()  # bounded by ``background``
    fields = F.array(*[F.struct(*[F.lit(r[c]).cast(dtype(df, c)).alias(c) for c in cols]) for r in pool])
    rows = df.select(F.col(key).alias("_key"), *cols).withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    seed = F.concat_ws("~", F.col("_key").cast("string"), F.col("_perm").cast("string"))
    drawn = rows.withColumn("_bg", F.element_at(fields, (bucket(seed, len(pool)) + 1).cast("int")))
    order = F.array_sort(F.array(*[F.struct(F.md5(F.concat(seed, F.lit(f"~{c}"))).alias("h"), F.lit(c).alias("c")) for c in cols]))
    ranked = drawn.withColumn("_order", F.transform(order, lambda s: s["c"])).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = ranked.select(
        "_key", "_order", "_j",
        *[F.when(F.array_position("_order", F.lit(c)) <= F.col("_j"), F.col(c)).otherwise(F.col("_bg")[c]).alias(c) for c in cols],
    )
    scored = fitted.scalar(mixed).select("_key", "_order", "_j", "score")
    gain = F.struct(F.try_element_at("_order", F.col("_j")).alias("feature"), F.col("score").alias("v"))
    loss = F.struct(F.try_element_at("_order", F.col("_j") + 1).alias("feature"), (-F.col("score")).alias("v"))
    parts = F.when(F.col("_j") == 0, F.array(loss)).when(F.col("_j") == d, F.array(gain)).otherwise(F.array(gain, loss))
    return scored.select("_key", F.inline(parts)).groupBy(F.col("_key").alias(key), "feature").agg(
        F.round(F.sum("v") / permutations, 4).alias("shap")
    )


def decision_grid(fitted: Fitted, df: DataFrame, a: str, b: str, side: int = 36) -> DataFrame:
    """Scores over a square grid of two features, the others at their typical values."""
    cols = fitted.encoding.columns
    typical = _typical(df, cols)
    edge = df.agg(*[f(number(df, c)).alias(f"{n}_{i}") for i, c in enumerate((a, b)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cell = df.sparkSession.range(side * side).select(F.floor(F.col("id") / side).alias("i"), (F.col("id") % side).alias("j"))
    at = {c: edge[f"lo_{k}"] + (edge[f"hi_{k}"] - edge[f"lo_{k}"]) * F.col(x) / (side - 1) for k, (c, x) in enumerate(((a, "i"), (b, "j")))}
    grid = cell.select(*[at.get(c, typical[c]).alias(c) for c in cols])
    return fitted.scalar(grid).select(F.col(a).alias("x"), F.col(b).alias("y"), F.round("score", 4).alias("score"))
