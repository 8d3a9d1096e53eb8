"""Quality, repair and feature queries."""

from pyspark.sql import functions as F

from oreline.operators import features as fe, quality as dq, sketches as sk
from oreline.plans.catalog import query


def long_sql(table: str, columns: list[str]) -> str:
    parts = [f"SELECT '{c}' AS name, {e}::VARCHAR AS value FROM {table}" for c, e in (x if isinstance(x, tuple) else (x, x) for x in columns)]
    return "(" + " UNION ALL ".join(parts) + ")"


def holed(t):
    """lineitem cells with missing values: a discount or tax of 0 counts as missing."""
    return t.lineitem.select(
        "l_orderkey", "l_quantity", "l_returnflag",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"),
    )


HOLED = """(SELECT l_orderkey, l_quantity, l_returnflag, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem)"""
HOLED_LONG = long_sql(HOLED, ["l_orderkey", "l_quantity", "l_returnflag", "discount", "tax"])


@query(
    "analyze_quality",
    f"""SELECT name, name <> 'l_returnflag' AS is_numeric, count(*) AS rows, (count(*) - count(value))::BIGINT AS nulls,
               count(DISTINCT value) AS unique_count, 0::BIGINT AS type_mismatch,
               round(100.0::DOUBLE * (count(*) - count(value)) / count(*), 1) AS null_pct FROM {HOLED_LONG} GROUP BY name""",
)
def analyze_quality(t):
    return dq.analyze_quality(holed(t))


@query(
    "quality_summary",
    f"""WITH c AS (SELECT name, count(*) - count(value) AS nulls FROM {HOLED_LONG} GROUP BY 1),
        d AS (SELECT count(*) AS n FROM {HOLED} GROUP BY l_orderkey, l_quantity, l_returnflag, discount, tax)
        SELECT (SELECT sum(n)::BIGINT FROM d) AS rows, (SELECT sum(n - 1)::BIGINT FROM d) AS duplicates, sum(nulls)::BIGINT AS total_nulls,
               (count_if(nulls > 0) + CASE WHEN (SELECT sum(n - 1) FROM d) > 0 THEN 1 ELSE 0 END)::BIGINT AS issues FROM c""",
)
def quality_summary(t):
    return dq.quality_summary(holed(t))


@query("column_profile")
def column_profile(t):
    return dq.column_profile(t.part)


@query(
    "impute_median",
    f"""SELECT l_orderkey::DOUBLE AS l_orderkey, l_quantity, l_returnflag,
               coalesce(discount, (SELECT round(quantile_cont(discount, 0.5), 4) FROM {HOLED})) AS discount,
               coalesce(tax, (SELECT round(quantile_cont(tax, 0.5), 4) FROM {HOLED})) AS tax FROM {HOLED}""",
)
def impute_median(t):
    return dq.impute(holed(t), "median")


@query(
    "impute_mean",
    f"""SELECT l_orderkey::DOUBLE AS l_orderkey, l_quantity, l_returnflag,
               coalesce(discount, (SELECT round(avg(discount), 4) FROM {HOLED})) AS discount,
               coalesce(tax, (SELECT round(avg(tax), 4) FROM {HOLED})) AS tax FROM {HOLED}""",
)
def impute_mean(t):
    return dq.impute(holed(t), "mean")


@query(
    "impute_mode",
    """WITH e AS (SELECT event_id, nullif(event_type, 'error') AS state FROM events)
       SELECT event_id::DOUBLE AS event_id, coalesce(state, (SELECT state FROM e WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS state FROM e""",
)
def impute_mode(t):
    return dq.impute(t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("state")))


@query("impute_constant", f"SELECT l_orderkey, coalesce(tax, -1.0::DOUBLE) AS tax FROM {HOLED}")
def impute_constant(t):
    return dq.impute_constant(holed(t).select("l_orderkey", "tax"), {"tax": -1.0})


@query("count_missing", f"SELECT (count(*) * 5 - count(l_orderkey) - count(l_quantity) - count(l_returnflag) - count(discount) - count(tax))::BIGINT AS missing FROM {HOLED}")
def count_missing(t):
    return dq.count_missing(holed(t))


@query("coerce_types", "SELECT p_partkey, p_retailprice AS price, TRY_CAST(NULL AS DOUBLE) AS word FROM part")
def coerce(t):
    rows = t.part.select(
        "p_partkey", F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ",").alias("price"), F.col("p_type").alias("word")
    )
    return dq.coerce_types(rows, ["price", "word"])


PART_NUM = long_sql("part", ["p_size", "p_retailprice"]).replace("::VARCHAR", "::DOUBLE")
CUST_NUM = long_sql("customer", ["c_nationkey", "c_acctbal"]).replace("::VARCHAR", "::DOUBLE")


@query(
    "profile_numbers",
    f"""WITH q AS (SELECT name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
                   FROM {CUST_NUM} GROUP BY 1),
        m AS (SELECT name, avg(value) AS mu FROM {CUST_NUM} GROUP BY 1)
        SELECT name, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max,
               round(avg((value - mu) ^ 3) / avg((value - mu) ^ 2) ^ 1.5, 4) AS skewness, round(kurtosis_pop(value), 4) AS kurtosis,
               round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
               count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers, 0::BIGINT AS nulls
        FROM {CUST_NUM} JOIN q USING (name) JOIN m USING (name) GROUP BY 1""",
)
def profile_numbers(t):
    out = dq.profile_numbers(t.customer, ["c_nationkey", "c_acctbal"])
    rounded = {c: F.round(c, 4) for c in ("mean", "std", "skewness", "kurtosis", "q1", "median", "q3")}
    return out.withColumns(rounded)


@query(
    "profile_histograms",
    f"""WITH e AS (SELECT name, min(value) AS lo, max(value) AS hi FROM {CUST_NUM} GROUP BY 1)
        SELECT name, least(floor((value - lo) / ((hi - lo) / 12)), 11)::BIGINT AS bin, count(*) AS n
        FROM {CUST_NUM} JOIN e USING (name) GROUP BY 1, 2""",
)
def profile_histograms(t):
    return dq.profile_histograms(t.customer, ["c_nationkey", "c_acctbal"])


PART_TEXT = long_sql("part", ["p_brand", "p_type"])


@query(
    "profile_texts",
    f"""WITH c AS (SELECT name, value, count(*) AS c FROM {PART_TEXT} GROUP BY 1, 2)
        SELECT name, count(*) AS unique_count, sum(c)::BIGINT AS n, arg_max(value, (c, -hash_rank)) AS top_value, max(c)::BIGINT AS top_freq,
               round(-sum(p * log2(p)), 4) AS entropy
        FROM (SELECT *, c / sum(c) OVER (PARTITION BY name) AS p, row_number() OVER (PARTITION BY name ORDER BY value) AS hash_rank FROM c) GROUP BY 1""",
)
def profile_texts(t):
    return dq.profile_texts(t.part, ["p_brand", "p_type"]).drop("distribution").withColumn("entropy", F.round("entropy", 4))


@query("profile_text_heads")
def profile_heads(t):
    return dq.profile_texts(t.part, ["p_brand", "p_type"])


@query(
    "column_health",
    f"""WITH q AS (SELECT name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {PART_NUM} GROUP BY 1),
        o AS (SELECT name, count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
              FROM {PART_NUM} JOIN q USING (name) GROUP BY 1)
        SELECT name, greatest(0, 100 - 3 * outliers)::BIGINT AS health, 100.0::DOUBLE AS table_health FROM o""",
)
def column_health(t):
    return dq.column_health(t.part.select("p_size", "p_retailprice"))


@query(
    "dataset_quality",
    f"""WITH s AS (SELECT count(*) AS n, (count(*) * 5 - count(l_orderkey) - count(l_quantity) - count(l_returnflag) - count(discount) - count(tax))
                   / (count(*) * 5)::DOUBLE AS f FROM {HOLED})
        SELECT round(greatest(0.3::DOUBLE, least(0.98::DOUBLE, least(1.0::DOUBLE, log10(n + 1) / 5) - f * 0.5 + 0.5)), 4) AS quality,
               round(greatest(30.0::DOUBLE, least(98.0::DOUBLE, 85 - 50 * f + 0.2 * least(30.0::DOUBLE, 10 * log10(n + 1)))), 4) AS report_quality FROM s""",
)
def dataset_quality(t):
    return dq.dataset_quality(holed(t))


@query(
    "column_flags",
    """SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS name, false AS high_null, false AS constant,
              unnest([(SELECT count(DISTINCT c_custkey) > 100 FROM customer), (SELECT count(DISTINCT c_name) > 100 FROM customer),
                      (SELECT count(DISTINCT c_nationkey) > 100 FROM customer), (SELECT count(DISTINCT c_acctbal) > 100 FROM customer),
                      (SELECT count(DISTINCT c_mktsegment) > 100 FROM customer)]) AS high_cardinality, false AS mixed, false AS among_most_null""",
)
def column_flags(t):
    return dq.column_flags(t.customer)


@query(
    "iqr_outliers",
    """WITH s AS (SELECT c_acctbal AS value, row_number() OVER (ORDER BY c_acctbal) - 1 AS rn, count(*) OVER () AS n FROM customer),
       q AS (SELECT max(CASE WHEN rn = floor(0.25 * n) THEN value END) AS q1, max(CASE WHEN rn = floor(0.75 * n) THEN value END) AS q3 FROM s)
       SELECT 'c_acctbal' AS name, any_value(q1) AS q1, any_value(q3) AS q3,
              count_if(value < q1 - 0.5 * (q3 - q1) OR value > q3 + 0.5 * (q3 - q1))::BIGINT AS outliers,
              round(100.0::DOUBLE * count_if(value < q1 - 0.5 * (q3 - q1) OR value > q3 + 0.5 * (q3 - q1)) / count(*), 2) AS pct FROM s, q""",
)
def iqr_outliers(t):
    return dq.iqr_outliers(t.customer, "c_acctbal", 0.5)


@query(
    "remove_outliers_iqr",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
       SELECT o_orderkey FROM orders, q WHERE o_totalprice BETWEEN q1 - 0.2 * (q3 - q1) AND q3 + 0.2 * (q3 - q1)""",
)
def remove_iqr(t):
    return dq.remove_outliers(t.orders, "o_totalprice", "iqr", 0.2).select("o_orderkey")


@query(
    "remove_outliers_zscore",
    """WITH q AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)
       SELECT o_orderkey FROM orders, q WHERE o_totalprice BETWEEN m - 1.5 * s AND m + 1.5 * s""",
)
def remove_zscore(t):
    return dq.remove_outliers(t.orders, "o_totalprice", "zscore", 1.5).select("o_orderkey")


@query(
    "remove_outliers_percentile",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)
       SELECT o_orderkey FROM orders, q WHERE o_totalprice BETWEEN lo AND hi""",
)
def remove_percentile(t):
    return dq.remove_outliers(t.orders, "o_totalprice", "percentile").select("o_orderkey")


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix",
    "SELECT a, b, r, abs(r) >= 0.6 AS high, abs(r) >= 0.9 AS risk FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS r FROM lineitem" for i, a in enumerate(CORR) for b in CORR[i + 1:]
    )
    + ")",
)
def correlation_matrix(t):
    return dq.correlation_matrix(t.lineitem, CORR, 0.6)


@query(
    "bivariate",
    """SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 4) AS r,
              CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.7 THEN 'strong' WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.4 THEN 'moderate'
                   WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength,
              CASE WHEN corr(l_quantity, l_extendedprice) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM lineitem""",
)
def bivariate(t):
    return dq.bivariate(t.lineitem, "l_quantity", "l_extendedprice")


@query(
    "scatter_points",
    "SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem ORDER BY md5(l_orderkey || '~' || l_linenumber) LIMIT 200",
)
def scatter(t):
    return dq.scatter_points(t.lineitem, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query(
    "leakage_classification",
    """WITH d AS (SELECT l_linestatus AS y, l_linestatus AS copy, l_returnflag AS flag, l_quantity + 100 * (l_linestatus = 'O')::INT AS near, l_tax AS tax
                  FROM lineitem),
       v AS (SELECT 'near' AS name, near AS value, y FROM d UNION ALL SELECT 'tax', tax, y FROM d),
       g AS (SELECT name, value, count_if(y = 'O') AS pos, count_if(y = 'F') AS neg FROM v GROUP BY 1, 2),
       s AS (SELECT *, sum(pos) OVER w AS lp, sum(neg) OVER w AS ln, sum(pos) OVER (PARTITION BY name) AS P, sum(neg) OVER (PARTITION BY name) AS N,
                    max(value) OVER (PARTITION BY name) AS last FROM g WINDOW w AS (PARTITION BY name ORDER BY value)),
       b AS (SELECT name, max(greatest(ln + P - lp, lp + N - ln) / (P + N)) AS acc FROM s WHERE value < last GROUP BY 1),
       u AS (SELECT sum(m) / sum(a) AS p FROM (SELECT max(n) AS m, sum(n) AS a FROM (SELECT flag, y, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY flag))
       SELECT 'copy' AS feature, 1.0::DOUBLE AS copy_rate, 1.0::DOUBLE AS purity, NULL::DOUBLE AS threshold_accuracy, 'copy' AS reason, 'high' AS severity, true AS leak
       UNION ALL SELECT 'flag', 0.0, round(p, 4), NULL, 'none', 'none', false FROM u
       UNION ALL SELECT name, 0.0, NULL, round(acc, 4), CASE WHEN acc >= 0.99 THEN 'threshold' ELSE 'none' END,
                        CASE WHEN acc >= 0.99 THEN 'medium' ELSE 'none' END, acc >= 0.99 FROM b""",
)
def leakage_class(t):
    rows = t.lineitem.select(
        F.col("l_linestatus").alias("y"), F.col("l_linestatus").alias("copy"), F.col("l_returnflag").alias("flag"),
        (F.col("l_quantity") + 100 * (F.col("l_linestatus") == "O").cast("int")).alias("near"), F.col("l_tax").alias("tax"),
    )
    return dq.detect_leakage(rows, "y", "classification").drop("abs_r").withColumns(
        {"purity": F.round("purity", 4), "threshold_accuracy": F.round("threshold_accuracy", 4)}
    )


@query(
    "leakage_regression",
    """WITH d AS (SELECT o_totalprice AS y, o_totalprice * 3 + 5 AS triple, o_custkey::DOUBLE AS cust FROM orders)
       SELECT 'triple' AS feature, round(abs(corr(triple, y)), 4) AS abs_r, 'correlation' AS reason, true AS leak FROM d
       UNION ALL SELECT 'cust', round(abs(corr(cust, y)), 4), 'none', false FROM d""",
)
def leakage_regression(t):
    rows = t.orders.select(
        F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 3 + 5).alias("triple"), F.col("o_custkey").cast("double").alias("cust")
    )
    return dq.detect_leakage(rows, "y", "regression").select("feature", F.round("abs_r", 4).alias("abs_r"), "reason", "leak")


@query(
    "suggest_prep",
    f"""WITH p AS (SELECT name, name <> 'l_returnflag' AS num, count(*) - count(value) AS nulls, 100.0 * (count(*) - count(value)) / count(*) AS pct,
                          count(DISTINCT value) AS u FROM {HOLED_LONG} GROUP BY 1)
        SELECT name, 'impute_mean' AS step FROM p WHERE num AND nulls > 0 AND pct <= 20 UNION ALL
        SELECT name, 'drop_column' FROM p WHERE pct > 20 UNION ALL SELECT name, 'scale' FROM p WHERE num UNION ALL
        SELECT name, 'one_hot' FROM p WHERE NOT num AND u BETWEEN 2 AND 19""",
)
def suggest_prep(t):
    return dq.suggest_prep(holed(t))


@query(
    "diagnose",
    """SELECT count(*) AS rows, 6::BIGINT AS cols, 3::BIGINT AS num, 3::BIGINT AS cat, 0::BIGINT AS null_columns,
              unnest(['classification', 'regression', 'clustering', 'association_rules']) AS task,
              unnest(['high', 'medium', 'high', 'medium']) AS confidence FROM part""",
)
def diagnose(t):
    return dq.diagnose(t.part)


@query(
    "eda_report",
    f"""WITH p AS (SELECT name, name <> 'l_returnflag' AS num, count(*) - count(value) AS nulls, round(100.0::DOUBLE * (count(*) - count(value)) / count(*), 1) AS pct,
                          count(DISTINCT value) AS u FROM {HOLED_LONG} GROUP BY 1)
        SELECT 'structure' AS section, name, CASE WHEN num THEN 'numeric' ELSE 'categorical' END AS detail FROM p UNION ALL
        SELECT 'missing', name, pct || '%' FROM p WHERE nulls > 0 UNION ALL
        SELECT 'constant', name, 'one value' FROM p WHERE u = 1 UNION ALL
        SELECT 'target candidate', name, u::VARCHAR FROM p WHERE u BETWEEN 2 AND 10""",
)
def eda_report(t):
    return dq.eda_report(holed(t))


# --- features -------------------------------------------------------------------------------------

BAND = "'faixa_' || (1 + {})"


@query(
    "bin_width",
    """WITH e AS (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 4 AS s FROM part)
       SELECT p_partkey, 'faixa_' || (1 + (p_retailprice > lo + s)::INT + (p_retailprice > lo + 2 * s)::INT + (p_retailprice > lo + 3 * s)::INT) AS band
       FROM part, e""",
)
def bin_width(t):
    return fe.bin_width(t.part, "p_retailprice", 4, "band").select("p_partkey", "band")


FREQ = """WITH s AS (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS rn, count(*) OVER () AS n FROM part),
       e AS (SELECT max(CASE WHEN rn = n // 4 THEN p_size END) AS e1, max(CASE WHEN rn = n // 2 THEN p_size END) AS e2,
                    max(CASE WHEN rn = 3 * n // 4 THEN p_size END) AS e3 FROM s)
       SELECT p_partkey, 'faixa_' || (1 + (p_size > e1)::INT + (p_size > e2)::INT + (p_size > e3)::INT) AS band FROM part, e"""


@query("bin_freq", FREQ)
def bin_freq(t):
    return fe.bin_freq(t.part, "p_size", 4, "band").select("p_partkey", "band")


@query("bin_quartiles", FREQ)
def bin_quartiles(t):
    return fe.bin_quartiles(t.part, "p_size", "band").select("p_partkey", "band")


@query(
    "bin_custom",
    "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' ELSE 'large' END AS band FROM part",
)
def bin_custom(t):
    return fe.bin_custom(t.part, "p_size", [10, 30], ["small", "middle", "large"], "band").select("p_partkey", "band")


@query(
    "one_hot",
    """SELECT o_orderkey, """
    + ", ".join(f"(o_orderpriority = '{p}')::INT AS \"o_orderpriority={p}\"" for p in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    + " FROM orders",
)
def one_hot(t):
    return fe.one_hot(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority").drop("o_orderpriority")


@query("label_encode", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def label_encode(t):
    return fe.label_encode(t.part, "p_brand", "code").select("p_partkey", "code")


@query(
    "ordinal_encode",
    """SELECT o_orderkey, nullif(list_position(['5-LOW', '3-MEDIUM', '1-URGENT'], o_orderpriority), 0)::BIGINT - 1 AS place FROM orders""",
)
def ordinal_encode(t):
    return fe.ordinal_encode(t.orders, "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"], "place").select(
        "o_orderkey", F.col("place").cast("bigint").alias("place")
    )


@query(
    "binary_encode",
    """WITH c AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS c FROM part)
       SELECT p_partkey, c & 1 AS p_type_b0, (c >> 1) & 1 AS p_type_b1, (c >> 2) & 1 AS p_type_b2 FROM c""",
)
def binary_encode(t):
    return fe.binary_encode(t.part.select("p_partkey", "p_type"), "p_type").drop("p_type")


@query("target_encode", "SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 4) AS te FROM part")
def target_encode(t):
    return fe.target_encode(t.part, "p_brand", "p_retailprice", "te").select("p_partkey", F.round("te", 4).alias("te"))


@query("frequency_encode", "SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / count(*) OVER (), 6) AS freq FROM part")
def frequency_encode(t):
    return fe.frequency_encode(t.part, "p_brand", "freq").select("p_partkey", F.round("freq", 6).alias("freq"))


@query(
    "scale_zscore",
    """SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size_norm,
              round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice_norm FROM part""",
)
def zscore(t):
    return fe.scale_zscore(t.part, ["p_size", "p_retailprice"]).select("p_partkey", "p_size_norm", "p_retailprice_norm")


@query(
    "scale_minmax",
    """SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice_norm
       FROM part""",
)
def minmax(t):
    return fe.scale_minmax(t.part, "p_retailprice").select("p_partkey", "p_retailprice_norm")


@query("scale_maxabs", "SELECT c_custkey, round(c_acctbal / max(abs(c_acctbal)) OVER (), 6) AS c_acctbal_norm FROM customer")
def maxabs(t):
    return fe.scale_maxabs(t.customer, "c_acctbal").select("c_custkey", "c_acctbal_norm")


@query(
    "scale_robust",
    """WITH q AS (SELECT quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS r FROM customer)
       SELECT c_custkey, round((c_acctbal - m) / r, 6) AS c_acctbal_norm FROM customer, q""",
)
def robust(t):
    return fe.scale_robust(t.customer, "c_acctbal").select("c_custkey", "c_acctbal_norm")


def _options_sql(column: str) -> str:
    return f"""SELECT '{column}' AS name, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, string_agg(v, '|' ORDER BY n DESC, v) AS options
       FROM (SELECT {column} AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 15)"""


@query(
    "feature_spec",
    " UNION ALL ".join([f"SELECT '{c}' AS name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, NULL AS options FROM part" for c in ("p_size", "p_retailprice")] + [_options_sql(c) for c in ("p_brand", "p_type")]),
)
def feature_spec(t):
    found = fe.feature_spec(t.part, ["p_brand", "p_type", "p_size", "p_retailprice"])
    return found.withColumns({"options": F.array_join("options", "|"), "mean": F.round("mean", 6)})


@query("feature_registry", "SELECT 'brand_' || substr(p_brand, 7) AS name, 2::BIGINT AS version FROM part GROUP BY 1")
def registry(t):
    rows = t.part.select(
        F.concat(F.lit("brand_"), F.substring("p_brand", 7, 9)).alias("name"), F.lit("numeric").alias("feature_type"),
        F.lit("p_size * 2").alias("formula"), F.array(F.lit("p_size")).alias("source_columns"),
    ).distinct()
    log = fe.register_feature(fe.register_feature(None, rows), rows)
    return fe.latest_feature(log).select("name", "version")


HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("train_test_split", f"SELECT o_orderkey, {HASH.format('o_orderkey::VARCHAR')} % 100 < 80 AS is_train FROM orders")
def split(t):
    return fe.train_test_split(t.orders, "o_orderkey", 80).select("o_orderkey", "is_train")


@query(
    "stratified_split",
    """SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '~0'), o_orderkey) - 1
              < floor(count(*) OVER (PARTITION BY o_orderstatus) * 70 / 100) AS is_train FROM orders""",
)
def stratified(t):
    return fe.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 70)


@query(
    "temporal_split",
    """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 < floor(count(*) OVER () * 75 / 100) AS is_train FROM events""",
)
def temporal(t):
    return fe.temporal_split(t.events.select("event_id", "ts"), ["ts", "event_id"], 75).drop("ts")


@query(
    "class_weights",
    """SELECT event_id, round((SELECT count(*) FROM events) / ((SELECT count(DISTINCT event_type) FROM events) * count(*) OVER (PARTITION BY event_type))::DOUBLE, 6)
       AS weight FROM events""",
)
def class_weights(t):
    return fe.class_weights(t.events, "event_type").select("event_id", F.round("weight", 6).alias("weight"))


RAND = "('0x' || substr(md5({0} || '~{1}'), 1, 8))::BIGINT % 1000000"


@query(
    "random_over",
    f"""WITH s AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT max(n) AS top FROM s)
        SELECT doc_id, toxic, unnest(range(1, 1 + (top // n + ({RAND.format('doc_id', 7)} < floor(1000000 * (top % n) / n))::INT)::INT))::INT AS copy
        FROM labels JOIN s USING (toxic), m""",
)
def random_over(t):
    return fe.random_over(t.labels.select("doc_id", "toxic"), "toxic", "doc_id")


@query(
    "random_under",
    f"""WITH s AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT min(n) AS low FROM s)
        SELECT doc_id, toxic FROM labels JOIN s USING (toxic), m WHERE {RAND.format('doc_id', 11)} < floor(1000000 * low / n)""",
)
def random_under(t):
    return fe.random_under(t.labels.select("doc_id", "toxic"), "toxic", "doc_id")


# --- profiles from sketches of parts -----------------------------------------------------------------

SKETCHED = ["l_quantity", "l_extendedprice", "l_returnflag"]


@query(
    "sketched_profile",
    """WITH l AS (SELECT 'l_quantity' AS name, l_quantity::VARCHAR AS v, l_quantity::DOUBLE AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice::VARCHAR, l_extendedprice FROM lineitem
         UNION ALL SELECT 'l_returnflag', l_returnflag, NULL FROM lineitem)
       SELECT name, count(*) AS n, count_if(v IS NULL)::BIGINT AS missing, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean,
         count(DISTINCT v) AS distinct_values, quantile_disc(x, 0.5) AS median, true AS near FROM l GROUP BY 1""",
)
def sketched_profile(t):
    """The profile from sketches by year of shipment, beside exact counts; ``near`` says that both are as close as the sketches promise."""
    parts = sk.column_sketches(t.lineitem.select(*SKETCHED, F.year("l_shipdate").alias("year")), SKETCHED, "year")
    found = sk.sketched_profile(parts).withColumnsRenamed({"distinct_values": "_d", "median": "_m"})
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v"), (F.col(c).cast("double") if c != "l_returnflag" else F.lit(None).cast("double")).alias("x")) for c in SKETCHED]))
    long = t.lineitem.select(cells.alias("c")).select("c.*").join(F.broadcast(found.select("name", "_m")), "name")
    exact = long.groupBy("name").agg(
        F.countDistinct("v").alias("distinct_values"), F.expr("percentile_disc(0.5) within group (order by x)").alias("median"),
        F.avg(F.when(F.col("x") < F.col("_m"), 1.0).otherwise(0.0)).alias("_below"), F.avg(F.when(F.col("x") <= F.col("_m"), 1.0).otherwise(0.0)).alias("_upto"),
    )
    near = (F.abs(F.col("_d") / F.col("distinct_values") - 1) < 0.065) & (F.col("_m").isNull() | (F.col("_below") <= 0.51) & (F.col("_upto") >= 0.49))
    return found.join(exact, "name").select("name", "n", "missing", "min", "max", F.round("mean", 6).alias("mean"), "distinct_values", "median", near.alias("near"))
