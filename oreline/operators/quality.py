"""Profiling, data-quality reports, repair, outliers, correlation and leakage.

Per-column work runs on a long form ``(name, value)`` of the table, so one shuffle serves all columns
and each of its keys is partially aggregated before it moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions.core import (
    as_list, is_missing, is_numeric, ladder, number, number_in, numeric_names, pearson, present, single,
)
from oreline.functions.ordered import element_at_rank, running_sums
from oreline.operators.joins import count_duplicates
from oreline.operators.scalars import parse_number
from oreline.session import stage


# --- long forms -----------------------------------------------------------------------------------


def _long(df: DataFrame, cells: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in cells.items()])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.name", "_p.value")


def long_texts(df: DataFrame, columns=None, keep=()) -> DataFrame:
    """One row per cell, the value as text, missing as NULL."""
    return _long(df, {n: present(df, n).cast("string") for n in (as_list(columns) or df.columns)}, list(keep))


def long_numbers(df: DataFrame, columns=None, keep=()) -> DataFrame:
    """One row per numeric cell that is present."""
    names = as_list(columns) or numeric_names(df)
    return _long(df, {n: number(df, n) for n in names}, list(keep)).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by=None) -> DataFrame:
    """Exact interpolated quantiles, of the whole or of few groups (one per column)."""
    by = as_list(by)
    ranks = {}
    for n, p in shares.items():
        at = F.lit(p) * (F.col("_n") - 1)
        ranks[f"_lo_{n}"], ranks[f"_hi_{n}"] = F.floor(at), F.ceil(at)
    near = {f"{side}{n}": p for n, p in shares.items() for side in ("_lo_", "_hi_")}
    found = element_at_rank(df, value, ranks, by, near, few_groups=True)
    sizes = df.groupBy(*by).agg(F.count(value).alias("_n"))
    joined = found.join(sizes, by) if by else found.withColumn("_n", sizes.scalar())
    cells = []
    for n, p in shares.items():
        at = F.lit(p) * (F.col("_n") - 1)
        part = at - F.floor(at)
        cells.append((F.col(f"_lo_{n}") + part * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n))
    return joined.select(*by, *cells)


# --- report ---------------------------------------------------------------------------------------


def analyze_quality(df: DataFrame, declared: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """Per column: missing, distinct, and values that contradict a declared numeric type.

    Exact distinct counts shuffle the distinct cells; ``exact=False`` counts them by sketch in one pass.
    """
    numeric = set(numeric_names(df)) | {n for n, k in (declared or {}).items() if k == "numeric"}
    if not exact:
        return _sketched_quality(df, numeric)
    counts = long_texts(df).groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))
    is_num = F.col("name").isin(*numeric) if numeric else F.lit(False)
    odd = is_num & F.col("value").isNotNull() & number_in(F.col("value")).isNull()
    return counts.groupBy("name").agg(
        F.first(is_num).alias("is_numeric"),
        F.sum("c").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(odd, F.col("c"))), F.lit(0)).alias("type_mismatch"),
    ).withColumn("null_pct", F.round(100.0 * F.col("nulls") / F.col("rows"), 1))


def _sketched_quality(df: DataFrame, numeric: set[str]) -> DataFrame:
    cells = []
    for n in df.columns:
        x = present(df, n).cast("string")
        odd = x.isNotNull() & number_in(x).isNull() if n in numeric else F.lit(False)
        cells.append(
            F.struct(
                F.lit(n).alias("name"), F.lit(n in numeric).alias("is_numeric"), F.count(F.lit(1)).alias("rows"),
                F.count_if(x.isNull()).alias("nulls"), F.approx_count_distinct(x).alias("unique_count"), F.count_if(odd).alias("type_mismatch"),
            )
        )
    out = df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
    return out.withColumn("null_pct", F.round(100.0 * F.col("nulls") / F.col("rows"), 1))


def quality_summary(df: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """Rows, duplicates, missing cells and the number of issues of the whole table."""
    columns = analyze_quality(df, declared).agg(
        F.sum("nulls").alias("total_nulls"),
        F.count_if((F.col("nulls") > 0) | (F.col("type_mismatch") > 0)).alias("_bad"),
    )
    whole = single(columns)
    return count_duplicates(df).select(
        "rows", "duplicates", whole["total_nulls"].alias("total_nulls"),
        (whole["_bad"] + F.when(F.col("duplicates") > 0, 1).otherwise(0)).alias("issues"),
    )


def column_profile(df: DataFrame, top: int = 50, samples: int = 5) -> DataFrame:
    """The metadata record of each column: type, distinct, missing percent, samples and value counts."""
    numeric = numeric_names(df)
    counts = long_texts(df).groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("name").agg(
        F.count("value").alias("unique_count"), F.sum("count").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("count"))), F.lit(0)).alias("total_non_null"),
    )
    from oreline.operators.selection import top_k_per_group

    ranked = top_k_per_group(counts.filter("value IS NOT NULL"), "name", [F.desc("count"), F.asc("value")], top, "rn")
    listed = ranked.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rn", "value", "count"))).alias("_v"))
    is_num = F.col("name").isin(*numeric) if numeric else F.lit(False)
    pairs = F.transform("_v", lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count")))
    return totals.join(listed, "name", "left").select(
        "name", F.when(is_num, "numeric").otherwise("categorical").alias("type"), "unique_count",
        F.round(100.0 * (F.col("rows") - F.col("total_non_null")) / F.col("rows"), 0).cast("int").alias("null_percent"),
        F.slice(F.transform("_v", lambda s: s["value"]), 1, samples).alias("sample_values"),
        F.when(~is_num & (F.col("unique_count") <= top), pairs).alias("value_counts"), "total_non_null",
    )


# --- repair ---------------------------------------------------------------------------------------


def fill_values(df: DataFrame, strategy: str = "median", columns=None) -> dict:
    """One fill value per column: mean or median of numbers, most frequent text (ties to the smallest)."""
    columns = as_list(columns) or df.columns
    numbers = [c for c in columns if is_numeric(df, c)]
    texts = [c for c in columns if c not in numbers]
    fills: dict = {}
    if numbers and strategy == "mean":
        row = df.agg(*[F.round(F.avg(F.when(~is_missing(df, c), number(df, c))), 4).alias(c) for c in numbers]).first()
        fills.update({c: row[c] for c in numbers})
    elif numbers:
        q = quantiles(long_numbers(df, numbers), "value", {"m": 0.5}, "name")
        fills.update({r["name"]: r.m for r in q.select("name", F.round("m", 4).alias("m")).collect()})
    if texts:
        counts = long_texts(df, texts).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))
        best = counts.groupBy("name").agg(F.min_by("value", F.struct((-F.col("c")).alias("c"), "value")).alias("v"))
        fills.update({r["name"]: r.v for r in best.collect()})
    return {k: v for k, v in fills.items() if v is not None}


def impute(df: DataFrame, strategy: str = "median", columns=None) -> DataFrame:
    fills = fill_values(df, strategy, columns)
    cells = []
    for n in df.columns:
        if n not in fills:
            cells.append(F.col(n))
        elif is_numeric(df, n):
            cells.append(F.coalesce(present(df, n).cast("double"), F.lit(float(fills[n]))).alias(n))
        else:
            cells.append(F.coalesce(present(df, n), F.lit(fills[n]).cast(df.schema[n].dataType)).alias(n))
    return df.select(cells)


def count_missing(df: DataFrame, columns=None) -> DataFrame:
    names = as_list(columns) or df.columns
    return df.agg(sum((F.count_if(is_missing(df, n)) for n in names), F.lit(0)).alias("missing"))


def impute_constant(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({n: F.coalesce(present(df, n), F.lit(v)) for n, v in values.items()})


def coerce_types(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Texts of columns declared numeric become numbers where they read as one, else stay missing."""
    return df.withColumns({n: parse_number(F.col(n)) for n in numeric if not is_numeric(df, n)})


def count_coerced(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.agg(
        sum((F.count(parse_number(F.col(n))) for n in numeric if not is_numeric(df, n)), F.lit(0)).alias("coerced")
    )


# --- profile --------------------------------------------------------------------------------------


def profile_numbers(df: DataFrame, columns=None) -> DataFrame:
    """Moments, quartiles and IQR outliers of each numeric column."""
    names = as_list(columns) or numeric_names(df)
    cells = long_numbers(df, names)
    base = cells.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
    )
    q = quantiles(cells, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "name")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    # one row per column, whatever the size of the table
    out = cells.join(F.broadcast(q), "name").groupBy("name").agg(
        F.count_if((F.col("value") < F.col("q1") - fence) | (F.col("value") > F.col("q3") + fence)).alias("outliers")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return base.join(q, "name").join(out, "name").withColumn("nulls", total - F.col("n"))


def profile_histograms(df: DataFrame, columns=None, bins: int = 12) -> DataFrame:
    cells = long_numbers(df, as_list(columns) or numeric_names(df))
    edges = cells.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / step), F.lit(bins - 1))
    return cells.join(F.broadcast(edges), "name").groupBy("name", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def profile_texts(df: DataFrame, columns=None, top: int = 8) -> DataFrame:
    """Distinct values, most frequent value, entropy in bits and the head of the distribution."""
    from oreline.operators.selection import top_k_per_group

    names = as_list(columns) or [c for c in df.columns if not is_numeric(df, c)]
    counts = long_texts(df, names).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))
    # H = log2(N) - sum(c * log2(c)) / N needs one pass over the counts
    base = counts.groupBy("name").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum("c").alias("n"),
        F.min_by("value", F.struct((-F.col("c")).alias("c"), "value")).alias("top_value"), F.max("c").alias("top_freq"),
        (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"),
    )
    head = top_k_per_group(counts, "name", [F.desc("c"), F.asc("value")], top, "rn")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "value", "c"))), lambda s: F.concat_ws("=", s["value"], s["c"].cast("string")))
    return base.join(head.groupBy("name").agg(listed.alias("distribution")), "name")


def health_score(outliers: Column, nulls: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 3 * outliers - 2 * nulls)


def column_health(df: DataFrame) -> DataFrame:
    """Score per column from the numbers of outliers and missing cells, and the table's ``100 - mean null %``."""
    nulls = analyze_quality(df).select("name", "nulls", "null_pct")
    out = profile_numbers(df).select("name", "outliers")
    mean_null = nulls.agg(F.avg("null_pct")).scalar()
    return nulls.join(out, "name", "left").select(
        "name", health_score(F.coalesce("outliers", F.lit(0)), F.col("nulls")).alias("health"),
        F.round(100 - mean_null, 1).alias("table_health"),
    )


def dataset_quality(df: DataFrame) -> DataFrame:
    """Two scores of a table from its size and its mean share of missing cells."""
    n = F.count(F.lit(1))
    share = sum((F.count_if(is_missing(df, c)) for c in df.columns), F.lit(0)) / (n * len(df.columns))
    size = F.log10(n + 1)
    general = F.least(F.lit(1.0), size / 5) - share * 0.5 + 0.5
    report = 85 - 0.5 * 100 * share + 0.2 * F.least(F.lit(30.0), 10 * size)
    return df.agg(
        F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.98), general)), 4).alias("quality"),
        F.round(F.greatest(F.lit(30.0), F.least(F.lit(98.0), report)), 4).alias("report_quality"),
    )


def column_flags(df: DataFrame, declared: dict[str, str] | None = None, top: int = 15) -> DataFrame:
    """High missing share, constant, many distinct values, mixed types, and whether among the most missing columns."""
    p = analyze_quality(df, declared)
    most = p.filter("nulls > 0").orderBy(F.desc("nulls"), "name").limit(top).select(F.col("name").alias("_m"))
    return p.join(most, F.col("name") == F.col("_m"), "left").select(
        "name", (F.col("null_pct") > 30).alias("high_null"), (F.col("unique_count") == 1).alias("constant"),
        (F.col("unique_count") > 100).alias("high_cardinality"),
        (F.col("type_mismatch") > 0).alias("mixed"), F.col("_m").isNotNull().alias("among_most_null"),
    )


# --- outliers -------------------------------------------------------------------------------------


def iqr_outliers(df: DataFrame, columns=None, factor: float = 1.5) -> DataFrame:
    """Values outside the fences, quartiles being elements at ``floor(p * n)``."""
    from oreline.operators.aggregates import order_statistic

    cells = long_numbers(df, columns)
    q = order_statistic(cells, "value", {"q1": 0.25, "q3": 0.75}, "name")
    fence = factor * (F.col("q3") - F.col("q1"))
    out = (F.col("value") < F.col("q1") - fence) | (F.col("value") > F.col("q3") + fence)
    return cells.join(F.broadcast(q), "name").groupBy("name", "q1", "q3").agg(
        F.count_if(out).alias("outliers"), F.round(100.0 * F.count_if(out) / F.count(F.lit(1)), 2).alias("pct")
    )


def remove_outliers(df: DataFrame, column: str, method: str = "iqr", factor: float | None = None) -> DataFrame:
    """Keep rows inside the bounds of ``iqr`` (1.5 or 3), ``zscore`` (3 sigma) or ``percentile`` (1 to 99 %)."""
    x = number(df, column)
    values = df.select(x.alias("value"))
    if method == "zscore":
        k = factor or 3.0
        b = values.agg((F.avg("value") - k * F.stddev_pop("value")).alias("lo"), (F.avg("value") + k * F.stddev_pop("value")).alias("hi"))
    elif method == "percentile":
        b = quantiles(values, "value", {"lo": 0.01, "hi": 0.99})
    else:
        k = factor or 1.5
        q = quantiles(values, "value", {"q1": 0.25, "q3": 0.75})
        b = q.select((F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi"))
    edge = single(b)
    return df.filter(x.isNull() | ((x >= edge["lo"]) & (x <= edge["hi"])))


# --- relations ------------------------------------------------------------------------------------


def correlation_matrix(df: DataFrame, columns=None, threshold: float = 0.8, places: int = 3) -> DataFrame:
    """Pearson r of every pair over rows where both are present; no variance gives 0. One pass over the table."""
    names = as_list(columns) or numeric_names(df)
    x = {n: number(df, n) for n in names}
    cells = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(pearson(x[a], x[b]), places).alias("r")))
    long = df.agg(F.array(*cells).alias("_p")).select(F.inline("_p"))
    return long.select("a", "b", "r", (F.abs("r") >= threshold).alias("high"), (F.abs("r") >= 0.9).alias("risk"))


def strength(r: Column) -> Column:
    return ladder([(F.abs(r) >= 0.7, "strong"), (F.abs(r) >= 0.4, "moderate"), (F.abs(r) >= 0.2, "weak")], "negligible")


def bivariate(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(number(df, a).alias("x"), number(df, b).alias("y")).dropna()
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(pearson(F.col("x"), F.col("y")), 4).alias("r")).withColumns(
        {"strength": strength(F.col("r")), "direction": ladder([(F.col("r") > 0, "positive"), (F.col("r") < 0, "negative")], "none")}
    )


def scatter_points(df: DataFrame, a: str, b: str, key, n: int = 200) -> DataFrame:
    """``n`` of the points, those of smallest MD5 of their key, so the same under any layout."""
    hashed = F.md5(F.concat_ws("~", *[F.col(k).cast("string") for k in as_list(key)]))
    points = df.select(number(df, a).alias("x"), number(df, b).alias("y"), hashed.alias("_h")).dropna(subset=["x", "y"])
    return points.orderBy("_h").limit(n).select("x", "y")


def detect_leakage(df: DataFrame, target: str, task: str, columns=None) -> DataFrame:
    """Features that give the target away, judged on all rows.

    A copy of the target, nearly perfect correlation (regression), categories that each belong to one
    class, or one threshold that separates two classes.
    """
    names = [c for c in (as_list(columns) or df.columns) if c != target]
    goal = present(df, target).cast("string")
    cells = [
        F.struct(F.lit(n).alias("feature"), F.avg((present(df, n).cast("string") == goal).cast("double")).alias("copy_rate"))
        for n in names
    ]
    out = df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
    numbers, texts = [c for c in names if is_numeric(df, c)], [c for c in names if not is_numeric(df, c)]
    none = F.lit(None).cast("double")
    if task == "regression":
        y = number(df, target)
        tests = [
            F.struct(F.lit(n).alias("feature"),
                     F.when(F.count_if(number(df, n).isNotNull() & y.isNotNull()) > 5, F.abs(pearson(number(df, n), y))).alias("abs_r"))
            for n in numbers
        ]
        if tests:
            out = out.join(df.agg(F.array(*tests).alias("_c")).select(F.inline("_c")), "feature", "left")
        else:
            out = out.withColumn("abs_r", none)
        out = out.withColumns({"purity": none, "threshold_accuracy": none})
    else:
        out = out.withColumn("abs_r", none)
        labelled = df.withColumn("_y", goal)
        if texts:
            pairs = long_texts(labelled, texts, ["_y"]).filter("value IS NOT NULL AND _y IS NOT NULL")
            by_class = pairs.groupBy("name", "value", "_y").agg(F.count(F.lit(1)).alias("c"))
            by_value = by_class.groupBy("name", "value").agg(F.max("c").alias("best"), F.sum("c").alias("all"))
            purity = by_value.groupBy("name").agg(
                F.when((F.count(F.lit(1)) > 1) & (F.count(F.lit(1)) < 0.5 * F.sum("all")), F.sum("best") / F.sum("all")).alias("purity")
            )
            out = out.join(purity.withColumnRenamed("name", "feature"), "feature", "left")
        else:
            out = out.withColumn("purity", none)
        if numbers:
            sweep = threshold_accuracy(long_numbers(labelled, numbers, ["_y"]).filter("_y IS NOT NULL"))
            out = out.join(sweep.withColumnRenamed("name", "feature"), "feature", "left")
        else:
            out = out.withColumn("threshold_accuracy", none)
    reason = ladder(
        [
            (F.col("copy_rate") >= 0.99, "copy"), (F.coalesce(F.col("abs_r"), F.lit(0.0)) >= 0.98, "correlation"),
            (F.coalesce(F.col("purity"), F.lit(0.0)) >= 0.99, "one class per category"),
            (F.coalesce(F.col("threshold_accuracy"), F.lit(0.0)) >= 0.99, "threshold"),
        ],
        "none",
    )
    severity = ladder([(F.col("reason") == "none", "none"), (F.col("reason") == "threshold", "medium")], "high")
    return out.withColumn("reason", reason).withColumn("severity", severity).withColumn("leak", F.col("reason") != "none")


def threshold_accuracy(cells: DataFrame) -> DataFrame:
    """Best accuracy of one threshold per name, for ``(name, value, _y)`` with two classes.

    Runs over the distinct values with their class counts.
    """
    classes = cells.groupBy("name").agg(F.min("_y").alias("c0"), F.max("_y").alias("c1"), F.count(F.lit(1)).alias("n"))
    two = cells.groupBy("name", "_y").agg(F.count(F.lit(1)).alias("_")).groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    sizes = classes.join(two, "name").filter("k = 2 AND n > 10")
    counted = cells.join(F.broadcast(sizes), "name").groupBy("name", "value").agg(
        F.count_if(F.col("_y") == F.col("c1")).alias("pos"), F.count_if(F.col("_y") == F.col("c0")).alias("neg")
    )
    summed = running_sums(stage(counted, "counted"), ["value"], {"lp": "pos", "ln": "neg"}, ["name"], {"P": "pos", "N": "neg"})
    right = F.greatest(F.col("ln") + F.col("P") - F.col("lp"), F.col("lp") + F.col("N") - F.col("ln")) / (F.col("P") + F.col("N"))
    # the last value has everything on its left, which is no threshold
    return summed.filter(F.col("lp") + F.col("ln") < F.col("P") + F.col("N")).groupBy("name").agg(
        F.max(right).alias("threshold_accuracy")
    )


# --- advice over the profile ----------------------------------------------------------------------


def suggest_prep(df: DataFrame) -> DataFrame:
    """Preparation steps that the profile calls for."""
    p = analyze_quality(df)
    numbers = p.agg(F.count_if("is_numeric")).scalar()
    num, pct, unique = F.col("is_numeric"), F.col("null_pct"), F.col("unique_count")
    steps = F.array(
        F.when(num & (F.col("nulls") > 0) & (pct <= 20), F.lit("impute_mean")),
        F.when(~num & (F.col("nulls") > 0) & (pct <= 20), F.lit("impute_mode")),
        F.when(pct > 20, F.lit("drop_column")),
        F.when(num & (numbers > 1), F.lit("scale")),
        F.when(~num & unique.between(2, 19), F.lit("one_hot")),
        F.when(~num & (unique >= 20), F.lit("label_encode")),
    )
    return p.select("name", F.explode(F.array_compact(steps)).alias("step"))


def diagnose(df: DataFrame) -> DataFrame:
    """What the table could be used for, with the confidence of the advice."""
    p = analyze_quality(df).agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("cols"), F.count_if("is_numeric").alias("num"),
        F.count_if(~F.col("is_numeric")).alias("cat"), F.count_if(F.col("null_pct") > 20).alias("null_columns"),
    )
    good = dataset_quality(df).select("quality").scalar()
    tasks = F.array(
        F.when(F.col("num") >= 2, F.struct(F.lit("classification").alias("task"), F.when(good > 0.7, "high").otherwise("medium").alias("confidence"))),
        F.when(F.col("num") >= 3, F.struct(F.lit("regression").alias("task"), F.lit("medium").alias("confidence"))),
        F.when(F.col("rows") > 200, F.struct(F.lit("clustering").alias("task"), F.lit("high").alias("confidence"))),
        F.when(F.col("cols") > 10, F.struct(F.lit("dimensionality_reduction").alias("task"), F.lit("medium").alias("confidence"))),
        F.when(F.col("cat") > 2, F.struct(F.lit("association_rules").alias("task"), F.lit("medium").alias("confidence"))),
    )
    return p.select("rows", "cols", "num", "cat", "null_columns", F.explode(F.array_compact(tasks)).alias("_t")).select(
        "rows", "cols", "num", "cat", "null_columns", "_t.task", "_t.confidence"
    )


def eda_report(df: DataFrame) -> DataFrame:
    """Findings as rows ``(section, name, detail)``."""
    p = analyze_quality(df)
    found = F.array(
        F.struct(F.lit("structure").alias("section"), F.when(F.col("is_numeric"), "numeric").otherwise("categorical").alias("detail")),
        F.when(F.col("nulls") > 0, F.struct(F.lit("missing").alias("section"), F.concat(F.col("null_pct").cast("string"), F.lit("%")).alias("detail"))),
        F.when(F.col("unique_count") == 1, F.struct(F.lit("constant").alias("section"), F.lit("one value").alias("detail"))),
        F.when(~F.col("is_numeric") & (F.col("unique_count") > 100), F.struct(F.lit("high cardinality").alias("section"), F.col("unique_count").cast("string").alias("detail"))),
        F.when(F.col("unique_count").between(2, 10), F.struct(F.lit("target candidate").alias("section"), F.col("unique_count").cast("string").alias("detail"))),
    )
    return p.select("name", F.explode(F.array_compact(found)).alias("_f")).select("_f.section", "name", "_f.detail")
