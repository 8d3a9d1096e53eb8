"""Frequent itemsets and association rules (``pyspark.ml.fpm`` does the mining)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions.core import is_missing, ladder, present, single, text_names
from oreline.operators.quality import analyze_quality
from oreline.session import stage


def to_transactions(df: DataFrame, columns=None, most: int | None = None) -> DataFrame:
    """One row, one transaction: items ``column=value`` of all text columns, or of the first ``most``."""
    names = (columns or text_names(df))[:most]
    items = [F.when(~is_missing(df, c), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in names]
    return df.select(F.array_compact(F.array(*items)).alias("items"))


def baskets(df: DataFrame, basket: str, item: str, min_support: float) -> DataFrame:
    """One row per basket with its items.

    Items that are rare by themselves are left out first: they cannot be in a frequent itemset, and what
    is left bounds the length of any basket. Baskets without a frequent item stay, as they count for support.
    """
    rows = df.select(F.col(basket).alias("basket"), present(df, item).cast("string").alias("item")).filter(
        "basket IS NOT NULL"
    )
    rows = stage(rows.distinct(), "basket-items")
    n = rows.agg(F.countDistinct("basket")).scalar()
    often = rows.filter("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    often = often.filter(F.col("c") >= F.ceil(F.lit(min_support) * n)).select("item", F.col("item").alias("kept"))
    return stage(rows.join(often, "item", "left").groupBy("basket").agg(F.collect_list("kept").alias("items")), "baskets")


def _mined(transactions: DataFrame, min_support: float, min_confidence: float = 0.0):
    return FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(transactions)


def frequent_itemsets(transactions: DataFrame, min_support: float = 0.05, longest: int = 4) -> DataFrame:
    n = transactions.agg(F.count(F.lit(1))).scalar()
    found = _mined(transactions, min_support).freqItemsets.filter(F.size("items") <= longest)
    return found.select(F.array_sort("items").alias("items"), F.col("freq"), F.round(F.col("freq") / n, 4).alias("support"))


def quality_of(lift: Column) -> Column:
    return ladder([(lift >= 3, "high"), (lift >= 2, "medium")], "low")


def association_rules(
    transactions: DataFrame, min_support: float = 0.05, min_confidence: float = 0.3, min_lift: float = 1.0, longest: int = 4
) -> DataFrame:
    """Rules with one consequent item, their measures, and whether a shorter rule already says as much."""
    raw = _mined(transactions, min_support, min_confidence).associationRules
    c = F.col("confidence") / F.col("lift")  # support of the consequent
    a = F.col("support") / F.col("confidence")  # support of the antecedent
    rules = raw.filter((F.size("antecedent") < longest) & (F.col("lift") >= min_lift)).select(
        F.array_sort("antecedent").alias("antecedent"), F.col("consequent")[0].alias("consequent"), "support", "confidence",
        "lift", (F.col("support") - a * c).alias("leverage"),
        F.try_divide(1 - c, F.when(F.col("confidence") < 1 - 1e-12, 1 - F.col("confidence"))).alias("conviction"),
        (F.size("antecedent") + 1).alias("length"), quality_of(F.col("lift")).alias("quality"),
    )
    return mark_redundant(rules)


def mark_redundant(rules: DataFrame) -> DataFrame:
    """A rule is redundant when a part of its antecedent gives the same consequent with no less confidence.

    Parts are enumerated from the (at most three) antecedent items and met by an equi-join.
    """
    size = F.size("antecedent")
    masks = F.when(size > 1, F.sequence(F.lit(1), (F.pow(F.lit(2), size) - 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = rules.select("antecedent", "consequent", "confidence", F.explode(masks).alias("_mask")).withColumn(
        "_part", F.filter("antecedent", lambda x, i: F.col("_mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0)
    )
    shorter = rules.select(F.col("antecedent").alias("_part"), F.col("consequent").alias("_c"), F.col("confidence").alias("_conf"))
    hit = parts.join(shorter, (parts["_part"] == shorter["_part"]) & (F.col("consequent") == F.col("_c")))
    hit = hit.filter(F.col("_conf") >= F.col("confidence")).select("antecedent", "consequent").distinct()
    return rules.join(hit.withColumn("_r", F.lit(True)), ["antecedent", "consequent"], "left").withColumn(
        "is_redundant", F.coalesce("_r", F.lit(False))
    ).drop("_r")


def closed_itemsets(itemsets: DataFrame, longest: int | None = None) -> DataFrame:
    """Itemsets without a superset of equal frequency, of at most ``longest`` items.

    Support never grows with length, so supersets with one more item are enough to look at: ``itemsets`` must either be all
    there are or reach one item beyond ``longest``, or the longest ones pass for closed.
    """
    larger = itemsets.filter(F.size("items") > 1).select(F.col("freq").alias("_f"), "items", F.explode("items").alias("_x"))
    subs = larger.select("_f", F.array_except("items", F.array("_x")).alias("_sub")).distinct()
    asked = itemsets if longest is None else itemsets.filter(F.size("items") <= longest)
    return asked.join(subs, (F.col("items") == F.col("_sub")) & (F.col("freq") == F.col("_f")), "left_anti")


def rule_filter(
    rules: DataFrame, text: str = "", hide_redundant: bool = False, min_support=0.0, min_confidence=0.0, min_lift=0.0,
    sort_by: str = "lift",
) -> DataFrame:
    out = rules.filter(
        (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)
    )
    if text:
        out = out.filter(
            F.exists("antecedent", lambda x: F.lower(x).contains(text.lower())) | F.lower("consequent").contains(text.lower())
        )
    if hide_redundant:
        out = out.filter(~F.col("is_redundant"))
    return out.orderBy(F.desc(sort_by), "antecedent", "consequent")


def rule_clusters(rules: DataFrame) -> DataFrame:
    band = ladder([(F.col("lift") >= 3, "strong"), (F.col("lift") >= 1.5, "moderate")], "weak")
    return rules.groupBy(band.alias("cluster")).agg(F.count(F.lit(1)).alias("rules"), F.round(F.avg("lift"), 4).alias("avg_lift"))


def rule_averages(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("total_rules"), F.round(F.avg("support"), 4).alias("avg_support"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.round(F.avg("lift"), 4).alias("avg_lift"),
        F.count_if(F.col("quality") == "high").alias("high_quality"),
        F.round(F.avg((~F.col("is_redundant")).cast("double")), 4).alias("share_not_redundant"),
    )


def suitability(df: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """Five weighted checks of whether a table suits rule mining."""
    p = analyze_quality(df, declared)
    cat = ~F.col("is_numeric")
    s = p.agg(
        F.max("rows").alias("rows"), F.count_if(cat).alias("cat_cols"), F.count_if(F.col("is_numeric")).alias("num_cols"),
        F.coalesce(F.avg(F.when(cat & (F.col("unique_count") > 0), F.col("unique_count"))), F.lit(0.0)).alias("avg_cardinality"),
        F.count_if(cat & (F.col("unique_count") > 100)).alias("high_card_cols"), F.avg("null_pct").alias("avg_nulls"),
    )
    checks = [
        (F.col("cat_cols") >= 2, 30), (F.col("rows") >= 50, 20),
        ((F.col("avg_cardinality") > 0) & (F.col("avg_cardinality") <= 50), 20), (F.col("high_card_cols") == 0, 15),
        (F.col("avg_nulls") < 25, 15),
    ]
    score = sum((F.when(c, w).otherwise(0) for c, w in checks), F.lit(0))
    out = s.withColumn("score", score).withColumn("apt", (F.col("score") >= 60) & (F.col("cat_cols") >= 2))
    return out.withColumn(
        "verdict",
        ladder(
            [(F.col("apt") & (F.col("score") >= 80), "suitable"), (F.col("apt"), "suitable with care"),
             ((F.col("cat_cols") >= 1) & (F.col("num_cols") > 0), "needs transformation")], "unsuitable",
        ),
    ).withColumns({"avg_cardinality": F.round("avg_cardinality", 2), "avg_nulls": F.round("avg_nulls", 2)})
