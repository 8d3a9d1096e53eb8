"""Feature engineering: bins, encodings, scalings, splits, balancing, registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.functions.core import as_list, bucket, dtype, is_missing, number, present, single
from oreline.functions.ordered import positions
from oreline.operators.aggregates import order_statistic
from oreline.session import stage


# --- bins -----------------------------------------------------------------------------------------


def _band(x: Column, edges: list[Column]) -> Column:
    """``faixa_1 … faixa_k``, closed on the right; missing stays missing."""
    over = sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(1))
    return F.when(x.isNotNull(), F.concat(F.lit("faixa_"), over.cast("string")))


def bin_width(df: DataFrame, column: str, k: int = 4, name: str | None = None) -> DataFrame:
    x = number(df, column)
    edge = single(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    step = F.when(edge["hi"] > edge["lo"], (edge["hi"] - edge["lo"]) / k).otherwise(F.lit(1.0))
    return df.withColumn(name or f"{column}_faixa", _band(x, [edge["lo"] + i * step for i in range(1, k)]))


def bin_freq(df: DataFrame, column: str, k: int = 4, name: str | None = None) -> DataFrame:
    """Edges are the elements at ``floor(i * n / k)`` of the sorted values."""
    x = number(df, column)
    values = df.select(x.alias("_x"))
    edge = single(order_statistic(values, "_x", {f"e{i}": i / k for i in range(1, k)}))
    return df.withColumn(name or f"{column}_faixa", _band(x, [edge[f"e{i}"] for i in range(1, k)]))


def bin_quartiles(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return bin_freq(df, column, 4, name)


def bin_custom(df: DataFrame, column: str, edges: list[float], labels: list[str], name: str | None = None) -> DataFrame:
    """``labels`` has one more entry than ``edges``."""
    x = number(df, column)
    out = F.lit(labels[-1])
    for e, label in reversed(list(zip(edges, labels))):
        out = F.when(x <= e, label).otherwise(out)
    return df.withColumn(name or f"{column}_faixa", F.when(x.isNotNull(), out))


# --- encodings ------------------------------------------------------------------------------------


def top_categories(df: DataFrame, column: str, k: int) -> list[str]:
    """The k most frequent values (ties by value); k names are all that reaches the driver."""
    x = present(df, column).cast("string").alias("v")
    counts = df.select(x).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return [r.v for r in counts.orderBy(F.desc("n"), "v").limit(k).collect()]


def one_hot(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """``column=value`` flags for the most frequent values; all others are all-zero."""
    value = present(df, column).cast("string")
    return df.withColumns(
        {f"{column}={c}": F.when(value == c, 1).otherwise(0) for c in top_categories(df, column, top)}
    )


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 0."""
    categories = df.select(present(df, column).alias("_category")).filter(F.col("_category").isNotNull()).distinct()
    return positions(stage(categories, "categories"), "_category", None, "_code")


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    codes = label_codes(df, column)
    return df.join(codes, present(df, column) == F.col("_category"), "left").select(
        *df.columns, F.col("_code").alias(name or f"{column}_cod")
    )


def ordinal_encode(df: DataFrame, column: str, order: list[str], name: str | None = None) -> DataFrame:
    """Place of the value in the given order, blanks around either aside; a value outside it is NULL."""
    place = F.array_position(F.array(*[F.lit(str(o).strip()) for o in order]), present(df, column).cast("string")) - 1
    return df.withColumn(name or f"{column}_ord", F.when(place >= 0, place))


def binary_encode(df: DataFrame, column: str) -> DataFrame:
    """Bits of the label code, lowest first."""
    coded = label_encode(df, column, "_c")
    top = coded.agg(F.max("_c")).first()[0] or 0
    bits = max(1, int(top).bit_length())
    return coded.withColumns({f"{column}_b{i}": F.shiftright("_c", i).bitwiseAND(F.lit(1)) for i in range(bits)}).drop("_c")


def target_encode(df: DataFrame, column: str, target: str, name: str | None = None) -> DataFrame:
    """Mean of the target per category, blanks around it aside; NULL where the category is missing."""
    means = df.groupBy(present(df, column).alias("_k")).agg(F.avg(number(df, target)).alias("_m"))
    return df.join(means, present(df, column) == F.col("_k"), "left").select(*df.columns, F.col("_m").alias(name or f"{column}_te"))


def frequency_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Share of the rows that carry the value, blanks around it aside; NULL where it is missing."""
    counts = df.groupBy(present(df, column).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.join(counts, present(df, column) == F.col("_k"), "left").select(
        *df.columns, (F.col("_n") / total).alias(name or f"{column}_freq")
    )


# --- scalings -------------------------------------------------------------------------------------


def scale_zscore(df: DataFrame, columns, suffix: str = "_norm") -> DataFrame:
    """Population deviation, zero deviation counts as one; one aggregate serves all columns."""
    columns = as_list(columns)
    stats = []
    for i, c in enumerate(columns):
        stats += [F.avg(number(df, c)).alias(f"m{i}"), F.stddev_pop(number(df, c)).alias(f"s{i}")]
    one = single(df.agg(*stats))
    return df.withColumns(
        {
            c + suffix: F.round((number(df, c) - one[f"m{i}"]) / F.when(one[f"s{i}"] == 0, 1.0).otherwise(one[f"s{i}"]), 6)
            for i, c in enumerate(columns)
        }
    )


def _scaled(df: DataFrame, columns, low: str, high: str, suffix: str) -> DataFrame:
    columns = as_list(columns)
    fns = {"min": F.min, "max": F.max, "zero": lambda c: F.lit(0.0), "maxabs": lambda c: F.max(F.abs(c))}
    stats = []
    for i, c in enumerate(columns):
        stats += [fns[low](number(df, c)).alias(f"a{i}"), fns[high](number(df, c)).alias(f"b{i}")]
    one = single(df.agg(F.count(F.lit(1)).alias("_n"), *stats))

    def cell(i: int, c: str) -> Column:
        span = one[f"b{i}"] - one[f"a{i}"]
        return F.round((number(df, c) - one[f"a{i}"]) / F.when(span == 0, 1.0).otherwise(span), 6)

    return df.withColumns({c + suffix: cell(i, c) for i, c in enumerate(columns)})


def scale_minmax(df: DataFrame, columns, suffix: str = "_norm") -> DataFrame:
    return _scaled(df, columns, "min", "max", suffix)


def scale_maxabs(df: DataFrame, columns, suffix: str = "_norm") -> DataFrame:
    return _scaled(df, columns, "zero", "maxabs", suffix)


def scale_robust(df: DataFrame, columns, suffix: str = "_norm") -> DataFrame:
    """``(x - median) / (q3 - q1)`` with exact interpolated quartiles."""
    from oreline.operators.quality import long_numbers, quantiles

    columns = as_list(columns)
    q = quantiles(long_numbers(df, columns), "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, "name")
    found = {r["name"]: r for r in q.collect()}  # one row per column

    def cell(c: str) -> Column:
        r = found[c]
        return F.round((number(df, c) - r.q2) / ((r.q3 - r.q1) or 1.0), 6)

    return df.withColumns({c + suffix: cell(c) for c in columns})


# --- summaries of features ------------------------------------------------------------------------


def feature_spec(df: DataFrame, columns=None, options: int = 15) -> DataFrame:
    """Per feature its range and mean, or its most frequent values."""
    from oreline.operators.quality import long_numbers, long_texts

    columns = as_list(columns) or df.columns
    numbers = [c for c in columns if c in set(_numbers(df))]
    texts = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        parts.append(
            long_numbers(df, numbers).groupBy("name").agg(
                F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
            ).withColumn("options", F.lit(None).cast("array<string>"))
        )
    if texts:
        counts = long_texts(df, texts).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        spec = Window.partitionBy("name").orderBy(F.desc("n"), "value")
        top = counts.withColumn("rn", F.row_number().over(spec)).filter(F.col("rn") <= options)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"])
        nothing = F.lit(None).cast("double")
        parts.append(
            top.groupBy("name").agg(listed.alias("options")).select(
                "name", nothing.alias("min"), nothing.alias("max"), nothing.alias("mean"), "options"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _numbers(df: DataFrame) -> list[str]:
    from oreline.functions.core import numeric_names

    return numeric_names(df)


def register_feature(registry: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Add feature rows ``(name, feature_type, formula, source_columns)`` as the next version of their name."""
    known = registry.groupBy("name").agg(F.max("version").alias("_v")) if registry is not None else None
    new = rows.join(known, "name", "left") if known is not None else rows.withColumn("_v", F.lit(None).cast("bigint"))
    out = new.select(
        "name", (F.coalesce("_v", F.lit(0)) + 1).cast("bigint").alias("version"), "feature_type", "formula",
        "source_columns", F.transform("source_columns", lambda c: F.concat(c, F.lit(" -> "), F.col("name"))).alias("lineage"),
        F.lit(0).cast("bigint").alias("usage_count"),
    )
    return registry.unionByName(out) if registry is not None else out


def latest_feature(registry: DataFrame) -> DataFrame:
    rest = [c for c in registry.columns if c != "name"]
    return registry.groupBy("name").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("name", "_r.*")


# --- splits ---------------------------------------------------------------------------------------


def train_test_split(df: DataFrame, key: str, train_percent: int = 80, seed: int = 0) -> DataFrame:
    """Add ``is_train`` from a hash of the key; needs no shuffle and never changes."""
    return df.withColumn("is_train", bucket(F.col(key), 100, seed) < train_percent)


def stratified_split(df: DataFrame, key: str, label: str, train_percent: int = 80, seed: int = 0) -> DataFrame:
    """Within each class exactly ``floor(n * percent / 100)`` rows train, chosen in hash order."""
    hashed = F.md5(F.concat_ws("~", F.col(key).cast("string"), F.lit(str(seed))))
    placed = positions(df.withColumn("_h", hashed), ["_h", key], label, "_p")
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.floor(F.count(F.lit(1)) * train_percent / 100).alias("_cut"))
    joined = placed.join(sizes, F.col(label).eqNullSafe(F.col("_l")))
    return joined.select(*df.columns, (F.col("_p") < F.col("_cut")).alias("is_train"))


def temporal_split(df: DataFrame, order: list[str], train_percent: int = 80) -> DataFrame:
    """The earliest rows train."""
    placed = positions(df, order, None, "_p")
    cut = F.floor(df.agg(F.count(F.lit(1))).scalar() * train_percent / 100)
    return placed.select(*df.columns, (F.col("_p") < cut).alias("is_train"))


# --- balancing ------------------------------------------------------------------------------------


def _beside_class(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``_n``, the rows of its class, and ``_least`` and ``_most`` of all classes; NULL labels are no class and get none."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    ends = single(sizes.agg(F.min("_n").alias("least"), F.max("_n").alias("most")))
    sizes = sizes.select("_l", "_n", ends["least"].alias("_least"), ends["most"].alias("_most"))
    return df.join(sizes, F.col(label) == F.col("_l"), "left").drop("_l")


def random_over(df: DataFrame, label: str, key: str) -> DataFrame:
    """Repeat rows until each class has the size of the largest; which rows get one extra copy is hashed. Rows without a label stay once."""
    whole = F.floor(F.col("_most") / F.col("_n"))
    lucky = bucket(F.col(key), 1_000_000, 7) < F.floor(1_000_000 * (F.col("_most") - whole * F.col("_n")) / F.col("_n"))
    copies = F.coalesce(whole + lucky.cast("int"), F.lit(1)).cast("int")
    return _beside_class(df, label).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(*df.columns, "copy")


def random_under(df: DataFrame, label: str, key: str) -> DataFrame:
    """Thin every class to about the size of the smallest; a hash of the key decides. Rows without a label stay."""
    keep = bucket(F.col(key), 1_000_000, 11) < F.floor(1_000_000 * F.col("_least") / F.col("_n"))
    return _beside_class(df, label).filter(F.coalesce(keep, F.lit(True))).select(*df.columns)


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """``n / (classes * size of the class)`` over the rows with a label; NULL for the others."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    whole = single(sizes.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")))
    weights = sizes.select("_l", (whole["n"] / (whole["k"] * F.col("_n"))).alias(name))
    return df.join(weights, F.col(label) == F.col("_l"), "left").drop("_l")


def smote(df: DataFrame, label: str, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """New rows between a row of a smaller class and one of its k nearest of the same class.

    Every class is filled up to about the size of the largest. Neighbours come from the exact kNN join.
    """
    from oreline.operators.neighbours import knn_join

    base = df.select(key, label, *[number(df, c).alias(c) for c in columns])
    # Rows that lack a number or a label stay, but have no neighbours.
    usable = F.col(label).isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns])
    sizes = {r[0]: r[1] for r in base.filter(usable).groupBy(label).count().collect()}  # one row per class
    made = base.withColumn("synthetic", F.lit(False))
    top = max(sizes.values(), default=0)
    for c, n in sizes.items():
        if n == top or n <= 1:
            continue
        small = base.filter(usable & (F.col(label) == c))
        pairs = knn_join(small, small, key, columns, k, skip_same_key=True)
        whole, extra = divmod(top - n, n)
        lucky = bucket(F.col("query_id"), 1_000_000, 13) < int(1_000_000 * extra / n)
        wanted = F.lit(whole) + lucky.cast("int")
        per_row = min(k, n - 1)
        repeats = pairs.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit((whole + 1) // per_row + 1)))).withColumn(
            "_slot", F.col("_j") * per_row + F.col("rank") - 1
        ).filter(F.col("_slot") < wanted)
        a = small.select(F.col(key).alias("query_id"), *[F.col(x).alias(f"_a{i}") for i, x in enumerate(columns)])
        b = small.select(F.col(key).alias("neighbour_id"), *[F.col(x).alias(f"_b{i}") for i, x in enumerate(columns)])
        share = bucket(F.concat_ws("-", "query_id", "neighbour_id", "_slot"), 10_000, 17) / 10_000
        made = made.unionByName(
            repeats.join(a, "query_id").join(b, "neighbour_id").select(
                F.col("query_id").alias(key), F.lit(c).cast(dtype(df, label)).alias(label),
                *[(F.col(f"_a{i}") + share * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(x) for i, x in enumerate(columns)],
                F.lit(True).alias("synthetic"),
            )
        )
    return made


def smoteenn(df: DataFrame, label: str, key: str, columns: list[str], k: int = 5, votes: int = 3) -> DataFrame:
    """SMOTE, then drop the rows that most of their nearest neighbours contradict."""
    from oreline.operators.neighbours import knn_join

    grown = positions(stage(smote(df, label, key, columns, k), "smote-rows"), [label, key, "synthetic", *columns], None, "_id")
    grown = stage(grown, "smote")
    pairs = knn_join(grown, grown, "_id", columns, votes, skip_same_key=True)
    own = grown.select(F.col("_id").alias("query_id"), F.col(label).alias("_own"))
    other = grown.select(F.col("_id").alias("neighbour_id"), F.col(label).alias("_other"))
    agree = pairs.join(own, "query_id").join(other, "neighbour_id").groupBy("query_id").agg(
        F.count_if(F.col("_own") == F.col("_other")).alias("_same"), F.count(F.lit(1)).alias("_all")
    )
    bad = agree.filter(F.col("_same") * 2 < F.col("_all")).select(F.col("query_id").alias("_bad"))
    return grown.join(bad, F.col("_id") == F.col("_bad"), "left_anti").drop("_id")
