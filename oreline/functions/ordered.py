"""Order-dependent work that does not send a whole group to one task.

One plan for every size. Cut points of (group, order), quantiles of a sample drawn by hash, are written once as a table of
one row, and a row's range is found among them by binary search, so it depends on the row alone and a recomputed task
finds it again. Every range is handled on its own. Only the groups of the cut points reach over a border; their sums per
range make a carry table of at most two rows per range, which is broadcast. A group that holds a third of the rows is
spread over a third of the ranges.

There are as many ranges as ``spark.sql.shuffle.partitions``. The keys are read twice for the cut points (to know the share
to draw, and to draw), then the values of groups at borders and the rows themselves, so the input must be the same each
time: ``stage`` what is costly or random.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from oreline.functions.core import as_list, dtype
from oreline.session import stage

RUN, CUTS = "__run", "__cuts"
PER_RANGE = 32  # sampled keys per range


def _key(columns: list[str]) -> Column:
    """Keys in the order of windows: structs compare field by field, NULL first."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])


def cut_points(df: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """One row with a sorted array of at most ``ranges - 1`` keys that cut the rows into ranges of about equal size."""
    wanted = float(PER_RANGE * ranges)
    rows = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    hashed = F.shiftrightunsigned(F.xxhash64(*keys), 11) / float(1 << 53)
    drawn = df.filter(hashed * rows < wanted).agg(F.sort_array(F.collect_set(_key(keys))).alias("_drawn"))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(1, ranges - 1))), lambda i: F.get("_drawn", F.floor(i * F.size("_drawn") / ranges).cast("int")))
    return drawn.select(F.when(F.size("_drawn") > 0, F.array_distinct(at)).otherwise(F.col("_drawn")).alias(CUTS))


def in_ranges(df: DataFrame, order: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their range, and the groups that may reach over a border as rows ``(_krun, _k0, _k1, ...)``."""
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = stage(cut_points(df, [*by, *order], ranges), "cuts")
    bits = F.array(*[F.lit(1 << b) for b in reversed(range(ranges.bit_length()))])
    # the cut points are used once, so the optimizer puts the subquery in place and no row carries them
    search = F.aggregate(bits, F.lit(0), lambda s, b: F.when(F.get(CUTS, s + b - 1) <= _key([*by, *order]), s + b).otherwise(s))
    rows = df.withColumn(CUTS, cuts.scalar()).select(*df.columns, F.coalesce(search, F.lit(0)).alias(RUN))
    fields = [F.col(f"_cut.k{i}").alias(f"_k{i}") for i in range(len(by))]
    borders = cuts.select(F.posexplode(CUTS).alias("_at", "_cut")).select(F.explode(F.array("_at", F.col("_at") + 1)).alias("_krun"), *fields)
    return rows, borders.distinct()


def _at_borders(laid: DataFrame, borders: DataFrame, by: list[str]) -> DataFrame:
    return laid.join(F.broadcast(borders), _meets(by), "left_semi") if by else laid


def _meets(by: list[str]) -> Column:
    """The same range and the same group; NULL is a group, too."""
    return reduce(and_, [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)], F.col(RUN) == F.col("_krun"))


def _beside_carry(laid: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside the carry of their group and range: at most two rows per range, so it is broadcast."""
    return laid.join(F.broadcast(carry), _meets(by), "left")


def running_sums(
    df: DataFrame, order: str | list[str], sums: dict[str, str], by: str | list[str] | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums: ``sums`` maps a new column to the column it sums. ``order`` must be total.

    ``totals`` maps further new columns to columns summed over the whole group. An empty sum is 0, an empty total NULL.
    """
    order, by, totals = as_list(order), as_list(by), totals or {}
    laid, borders = in_ranges(df, order, by)
    per_run = _at_borders(laid, borders, by).groupBy(*by, RUN).agg(
        *[F.sum(c).alias(f"_carry_{n}") for n, c in sums.items()], *[F.sum(c).alias(f"_whole_{n}") for n, c in totals.items()]
    )
    earlier = Window.partitionBy(*by).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    carry = per_run.select(
        *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col(RUN).alias("_krun"),
        *[F.sum(f"_carry_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.sum(f"_whole_{n}").over(group).alias(f"_whole_{n}") for n in totals],
    )
    inside = Window.partitionBy(*by, RUN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, RUN)
    kinds = df.agg(*[F.sum(c).alias(n) for n, c in {**sums, **totals}.items()]).schema
    parts = laid.select(
        *df.columns, RUN, *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()],
        *[F.sum(c).over(whole).alias(f"_all_{n}") for n, c in totals.items()],
    )
    return _beside_carry(parts, carry, by).select(
        *df.columns,
        *[(F.col(f"_in_{n}") + F.coalesce(f"_carry_{n}", F.lit(0))).cast(kinds[n].dataType).alias(n) for n in sums],
        *[F.coalesce(f"_whole_{n}", f"_all_{n}").alias(n) for n in totals],
    )


def positions(
    df: DataFrame, order: str | list[str], by: str | list[str] | None = None, name: str = "position"
) -> DataFrame:
    """Number the rows of each group from 0 in ``order`` (which must be total)."""
    keep = [c for c in df.columns if c != name]
    counted = running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), order, {"_place": "_one"}, by)
    return counted.select(*keep, (F.col("_place") - 1).alias(name))


def forward_filled(df: DataFrame, value: str, order: str | list[str], by=None, name: str | None = None) -> DataFrame:
    """The last present value at or before each row."""
    order, by = as_list(order), as_list(by)
    name = name or value
    keep = [c for c in df.columns if c != name]
    laid, borders = in_ranges(df, order, by)
    per_run = _at_borders(laid, borders, by).groupBy(*by, RUN).agg(
        F.max_by(F.struct(value), F.when(F.col(value).isNotNull(), F.struct(*order)))[value].alias("_last")
    )
    earlier = Window.partitionBy(*by).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_run.select(
        *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)],
        F.col(RUN).alias("_krun"),
        F.last("_last", ignorenulls=True).over(earlier).alias("_carried"),
    )
    inside = Window.partitionBy(*by, RUN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = laid.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
    return _beside_carry(parts, carry, by).select(*keep, F.coalesce("_in", "_carried").alias(name))


def with_history(
    df: DataFrame,
    position: str,
    history: int,
    columns: dict[str, "callable"],
    by: str | list[str] | None = None,
    chunk: int = 8192,
) -> DataFrame:
    """Window expressions that look back at most ``history`` rows, without one task per group.

    A group is cut by position into chunks; the last ``history`` rows of a chunk are also given to the
    next one. ``columns`` maps a new name to a function from the chunk's window spec to a Column.
    """
    by = as_list(by)
    chunk = max(chunk, history + 1)
    home = F.floor(F.col(position) / chunk)
    lends = F.pmod(F.col(position), F.lit(chunk)) >= chunk - history
    copies = df.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(lends, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    spec = Window.partitionBy(*by, "_chunk").orderBy(position)
    return (
        copies.select("*", *[make(spec).alias(n) for n, make in columns.items()])
        .filter(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk")
    )


ACCURACY = 10_000


def element_at_rank(
    df: DataFrame, value: str, ranks: dict[str, Column], by=None, near: dict[str, float] | None = None, few_groups: bool = False
) -> DataFrame:
    """Exact order statistics: for each name the smallest value whose running count exceeds the 0-based rank.

    ``ranks`` are expressions over ``_n``, the number of present values of the group. The work is on distinct
    values with their counts, so equal values never pile up in one task.

    Where ``near`` gives the share of the way each rank lies at, and there is one group or ``few_groups`` (one per
    column, say, so that a row per group can sit in every task), the table is not sorted: a quantile sketch fences every
    rank in, values below a fence are only counted, and just the few values between fences are shuffled one by one.
    Counts show whether a fence holds its rank; if one does not, the whole table is used.
    """
    by = as_list(by)
    present = df.filter(F.col(value).isNotNull()).select(*by, value)
    if near is not None and set(near) >= set(ranks) and (few_groups or not by) and isinstance(dtype(df, value), (NumericType, DateType, TimestampType)):
        found = _fenced(present, value, ranks, by, near)
        if found is not None:
            return found
    counted = stage(present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), "counted")
    summed = running_sums(counted, [value], {"_upto": "_c"}, by, {"_n": "_c"})
    return summed.groupBy(*by).agg(
        *[F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(n) for n, rank in ranks.items()]
    )


def _fenced(present: DataFrame, value: str, ranks: dict[str, Column], by: list[str], near: dict[str, float]):
    """Order statistics between sketch fences, or None when a fence misses its rank."""
    names = list(ranks)
    width = 4 / ACCURACY
    sides = {(i, e): min(1.0, max(0.0, near[n] + side * width)) for i, n in enumerate(names) for e, side in (("lo", -1), ("hi", 1))}
    at = sorted(set(sides.values()))
    sketch = present.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, at, ACCURACY).alias("_q"))
    fences = stage(sketch.select(*by, "_n", *[F.col("_q")[at.index(p)].alias(f"_{e}{i}") for (i, e), p in sides.items()]), "fences")
    x = F.col(value)
    # ranks with the same fences share one; below it a row is only counted, under NULL
    pairs = sorted({(sides[i, "lo"], sides[i, "hi"]) for i in range(len(names))})
    which = {i: pairs.index((sides[i, "lo"], sides[i, "hi"])) for i in range(len(names))}
    of = {w: i for i, w in which.items()}
    marks = F.array(*[
        F.when(x <= F.col(f"_hi{of[w]}"), F.struct(F.lit(w).alias("_which"), F.when(x >= F.col(f"_lo{of[w]}"), x).alias("_v")))
        for w in range(len(pairs))
    ])
    met = _beside(present, fences, by).select(*by, "_n", F.inline(F.array_compact(marks)))
    few = stage(met.groupBy(*by, "_which", "_v").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n")), "few")
    wide = few.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        *[F.coalesce(F.sum(F.when((F.col("_which") == w) & F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias(f"_b{w}") for w in range(len(pairs))],
        *[F.coalesce(F.sum(F.when(F.col("_which") == w, F.col("_c"))), F.lit(0)).alias(f"_t{w}") for w in range(len(pairs))],
    )
    missed = [(F.col(f"_b{which[i]}") > ranks[n]) | (ranks[n] >= F.col(f"_t{which[i]}")) for i, n in enumerate(names)]
    if wide.filter(F.array_contains(F.array(*missed), True)).limit(1).count():
        return None
    # NULL comes first, so running counts begin with what lies below the fence
    summed = running_sums(few, ["_v"], {"_upto": "_c"}, [*by, "_which"])
    return summed.groupBy(*by).agg(
        *[F.min(F.when((F.col("_which") == which[i]) & (F.col("_upto") > ranks[n]), F.col("_v"))).alias(n) for i, n in enumerate(names)]
    )


def _beside(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Columns of a table of few groups beside the rows of its group; a NULL group meets itself."""
    if by:
        kept = small.withColumnsRenamed({b: f"_k{i}" for i, b in enumerate(by)})
        cond = F.lit(True)
        for i, b in enumerate(by):
            cond = cond & F.col(b).eqNullSafe(F.col(f"_k{i}"))
        return df.join(F.broadcast(kept), cond).drop(*[f"_k{i}" for i in range(len(by))])
    one = small.select(F.struct("*").alias("_s")).scalar()
    return df.withColumn("_s", one).select(*df.columns, "_s.*")
