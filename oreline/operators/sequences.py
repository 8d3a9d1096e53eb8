"""Frequent ordered patterns: which items follow which, counted once per sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oreline.functions.core import as_list, is_missing
from oreline.functions.ordered import positions
from oreline.session import stage

SALTS = 16


def build_sequences(df: DataFrame, group: str, item: str, order) -> DataFrame:
    """Rows ``(group, position, item)``; missing groups and items are skipped."""
    clean = df.filter(~is_missing(df, group) & ~is_missing(df, item))
    cut = clean.select(F.col(group).alias("grp"), F.col(item).cast("string").alias("item"), *as_list(order))
    return positions(cut, as_list(order), "grp").select("grp", "position", "item")


def _events(df: DataFrame, group: str, item: str, order) -> DataFrame:
    clean = df.filter(~is_missing(df, group) & ~is_missing(df, item))
    order = as_list(order)
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return clean.select(F.col(group).alias("grp"), F.col(item).cast("string").alias("item"), at.alias("at"))


def _spans(events: DataFrame) -> DataFrame:
    """First and last place and number of each item in each sequence: the one pass over the events.

    Written once, as all that follows (sizes, frequent items, pairs) reads it again and it is much smaller.
    """
    spans = events.groupBy("grp", "item").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    return stage(spans, "spans")


def _sizes(spans: DataFrame) -> DataFrame:
    return spans.groupBy("grp").agg(F.sum("n").alias("n")).filter("n >= 2")


def _least_count(spans: DataFrame, min_support: float) -> Column:
    """``max(2, ceil(min_support * sequences))``; with fewer than three sequences nothing is frequent."""
    n = _sizes(spans).agg(F.count(F.lit(1))).scalar()
    return F.when(n >= 3, F.greatest(F.lit(2), F.ceil(F.lit(min_support) * n)))


def _frequent(spans: DataFrame, least: Column) -> DataFrame:
    """Spans of frequent items only.

    An item that is rare by itself cannot be in a frequent pattern, so dropping it changes no result;
    it bounds how many rows one sequence can have here.
    """
    often = spans.groupBy("item").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= least).select("item")
    return spans.join(often, "item")


def _counted(found: DataFrame, keys: list[str], spans: DataFrame, least: Column) -> DataFrame:
    n = _sizes(spans).agg(F.count(F.lit(1))).scalar()
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)
    return counts.withColumn("support", F.round(F.col("count") / n, 4))


def _pair_places(spans: DataFrame) -> DataFrame:
    a = spans.select("grp", F.col("item").alias("a"), "first")
    b = spans.select("grp", F.col("item").alias("b"), "last")
    return a.join(b, "grp").filter(F.col("first") < F.col("last"))


def _pairs(spans: DataFrame, min_support: float) -> DataFrame:
    least = _least_count(spans, min_support)
    return _counted(_pair_places(_frequent(spans, least)), ["a", "b"], spans, least)


def _triples(events: DataFrame, spans: DataFrame, min_support: float) -> DataFrame:
    least = _least_count(spans, min_support)
    kept = _frequent(spans, least)
    pairs = stage(_pairs(spans, min_support).select("a", "b"), "pairs")
    # a sequence's first places in their order: a row per sequence, as long as there are frequent items in it
    firsts = kept.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct(F.col("first").alias("at"), F.col("item").alias("a")))).alias("firsts"))
    salted = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spots = events.select("grp", F.col("item").alias("b"), "at").withColumn(
        "_salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")
    )
    behind = F.size(F.filter("firsts", lambda f: f["at"] < F.col("at")))
    spots = spots.join(salted, ["grp", "_salt"]).select("grp", "b", "at", behind.alias("behind")).filter("behind > 0")
    earliest = spots.groupBy("grp", "b", "behind").agg(F.min("at").alias("at"))
    after = earliest.join(firsts, "grp").select("grp", "b", "at", F.explode(F.slice("firsts", 1, F.col("behind"))).alias("_f"))
    after = after.groupBy("grp", F.col("_f.a").alias("a"), "b").agg(F.min("at").alias("at")).join(pairs, ["a", "b"])
    lasts = kept.select("grp", F.col("item").alias("c"), "last")
    grown = after.join(lasts, "grp").filter(F.col("at") < F.col("last"))
    tails = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return _counted(grown.join(tails, ["b", "c"]), ["a", "b", "c"], spans, least)


def sequence_pairs(df: DataFrame, group: str, item: str, order, min_support: float = 0.05) -> DataFrame:
    """``a`` somewhere before ``b``: the first ``a`` lies before the last ``b``."""
    return _pairs(_spans(_events(df, group, item, order)), min_support)


def sequence_triples(df: DataFrame, group: str, item: str, order, min_support: float = 0.05) -> DataFrame:
    """``a``, then ``b``, then ``c``: the first ``b`` after the first ``a`` lies before the last ``c``.

    Only frequent pairs are extended. The occurrences of a long sequence are spread over salts, each met by
    a copy of that sequence's (few) first places. An occurrence stays one row, with how many of the first places lie before it;
    only the earliest ones per item and that number are spread over the items before them.
    """
    events = _events(df, group, item, order)
    return _triples(events, _spans(events), min_support)


#: Places of an item in a sequence that one row holds.
PLACES = 4096


def _places(events: DataFrame) -> DataFrame:
    """``(grp, item, before, last, places)``: runs of at most ``PLACES`` places of an item, in order, and the last place of the run before."""
    numbered = positions(events, ["at"], ["grp", "item"], "_n").withColumn("_run", F.floor(F.col("_n") / PLACES))
    cut = numbered.groupBy("grp", "item", "_run").agg(F.array_sort(F.collect_list("at")).alias("places"), F.max("at").alias("last"))
    order = Window.partitionBy("grp", "item").orderBy("_run")  # a row for every PLACES events
    return stage(cut.withColumn("before", F.lag("last").over(order)).select("grp", "item", "before", "last", "places"), "places")


def sequence_patterns(df: DataFrame, group: str, item: str, order, min_support: float = 0.05, longest: int = 5) -> DataFrame:
    """``(pattern, size, count, support)``: frequent patterns of 2 to ``longest`` items, each an array of items in their order.

    Patterns grow by one item at a time. Of a sequence that holds a pattern only a pointer is kept, to the earliest place where the pattern is
    complete; the next item's first place after it completes the longer one. A pattern grows only by pairs that are frequent themselves.
    An item's places in a sequence lie in runs of bounded size, of which a pointer meets just one. ``order`` must be total.
    """
    if longest < 2:
        raise ValueError("a pattern has two items at least")
    events = _events(df, group, item, order)
    spans = _spans(events)
    least = _least_count(spans, min_support)
    kept = stage(_frequent(spans, least), "frequent-spans")
    often = kept.select("item").distinct()
    places = _places(events.join(often, "item").select("grp", "item", "at"))
    pairs = stage(_counted(_pair_places(kept), ["a", "b"], spans, least).select(F.col("a").alias("tail"), F.col("b").alias("item")), "frequent-pairs")
    state = kept.select("grp", F.array("item").alias("pattern"), F.col("item").alias("tail"), F.col("first").alias("at"))
    found = None
    for size in range(2, longest + 1):
        wanted = state.join(pairs, "tail").select("grp", "pattern", "item", "at")
        met = wanted.join(places, ["grp", "item"]).filter((F.col("last") > F.col("at")) & (F.col("before").isNull() | (F.col("before") <= F.col("at"))))
        grown = met.select(
            "grp", F.array_append("pattern", F.col("item")).alias("pattern"), F.col("item").alias("tail"), F.col("places")[_first_after("places", "at")].alias("at")
        )
        grown = stage(grown, "grown")
        counts = stage(_counted(grown, ["pattern"], spans, least).withColumn("size", F.lit(size)).select("pattern", "size", "count", "support"), "patterns")
        found = counts if found is None else found.union(counts)
        if size == longest or not counts.limit(1).count():
            break
        state = grown.join(counts.select("pattern"), "pattern").select("grp", "pattern", "tail", "at")
    return found


def _first_after(places: str, at: str) -> Column:
    """The index of the first of the sorted ``places`` behind ``at``, by halving."""
    bounds = F.struct(F.lit(0).alias("low"), F.size(places).alias("high"))
    middle = lambda b: F.floor((b["low"] + b["high"]) / 2).cast("int")
    behind = lambda b: F.get(F.col(places), middle(b)) > F.col(at)
    halve = lambda b, _: F.when(
        b["low"] < b["high"],
        F.when(behind(b), F.struct(b["low"].alias("low"), middle(b).alias("high"))).otherwise(F.struct((middle(b) + 1).alias("low"), b["high"].alias("high"))),
    ).otherwise(b)
    return F.aggregate(F.sequence(F.lit(0), F.lit(PLACES.bit_length())), bounds, halve, lambda b: b["low"])


def top_pairs(df: DataFrame, group: str, item: str, order, min_support: float = 0.05, k: int = 15) -> DataFrame:
    """The ``k`` pairs that most sequences hold; ties in order of their items."""
    pairs = sequence_pairs(df, group, item, order, min_support)
    return pairs.select(F.concat_ws(" → ", "a", "b").alias("pattern"), "count", "support").orderBy(F.desc("count"), "pattern").limit(k)


def top_patterns(df: DataFrame, group: str, item: str, order, min_support: float = 0.05, k: int = 40) -> DataFrame:
    arrow = " → "
    events = _events(df, group, item, order)
    spans = _spans(events)
    two = _pairs(spans, min_support).select(F.concat_ws(arrow, "a", "b").alias("pattern"), F.lit(2).alias("size"), "count", "support")
    three = _triples(events, spans, min_support).select(
        F.concat_ws(arrow, "a", "b", "c").alias("pattern"), F.lit(3).alias("size"), "count", "support"
    )
    return two.unionByName(three).orderBy(F.desc("support"), "size", "pattern").limit(k)


def sequence_summary(df: DataFrame, group: str, item: str, order, min_support: float = 0.05) -> DataFrame:
    sizes = _events(df, group, item, order).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return sizes.agg(
        F.count(F.lit(1)).alias("sequences"), F.round(F.avg("n"), 2).alias("avg_length"),
        F.greatest(F.lit(2), F.ceil(F.lit(min_support) * F.count(F.lit(1)))).cast("bigint").alias("min_count"),
    )
