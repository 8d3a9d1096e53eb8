"""Selections, joins, aggregates, windows, ordering and unions on the star-schema tables."""

from pyspark.sql import functions as F

from oreline.operators import aggregates as ag, joins as jn, selection as sl, windows as wn
from oreline.plans.catalog import query


# --- projections and predicates -------------------------------------------------------------------


@query(
    "flagship_group_by",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty,
              round(avg(l_extendedprice), 4) AS avg_price, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty
       FROM lineitem WHERE l_quantity >= 10 GROUP BY ALL""",
)
def flagship(t):
    rows = sl.where_chain(t.lineitem, [("and", "l_quantity", ">=", 10)])
    return sl.order_by_mixed(
        ag.group_by(
            rows, ["l_returnflag", "l_linestatus"],
            {"n": ("count", "*"), "sum_qty": ("sum", "l_quantity"), "avg_price": ("avg", "l_extendedprice"),
             "min_qty": ("min", "l_quantity"), "max_qty": ("max", "l_quantity")},
        ),
        "l_returnflag",
    )


@query("select_star_with_alias", "SELECT *, o_custkey AS customer FROM orders WHERE o_totalprice > 450000")
def select_star(t):
    return t.orders.filter(F.col("o_totalprice") > 450000).select("*", F.col("o_custkey").alias("customer"))


@query("select_columns", "SELECT p_partkey, p_brand AS brand, p_size FROM part")
def select_columns(t):
    return sl.select_columns(t.part, ["p_partkey", ("p_brand", "brand"), "p_size"])


@query("rename_columns", "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal, c_mktsegment AS segment FROM customer")
def rename(t):
    return sl.rename_columns(t.customer, {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"})


@query(
    "filter_compare",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity >= 45 AND l_returnflag <> 'A' AND l_tax < 0.05""",
)
def compare(t):
    return sl.where_chain(
        t.lineitem,
        [("and", "l_quantity", ">=", 45), ("and", "l_returnflag", "<>", "A"), ("and", "l_tax", "<", 0.05)],
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_is_null", "SELECT count(*) AS n FROM lineitem WHERE nullif(l_discount, 0) IS NULL")
def is_null(t):
    rows = t.lineitem.withColumn("d", F.nullif("l_discount", F.lit(0.0)))
    return sl.where_chain(rows, [("and", "d", "is null")]).agg(F.count(F.lit(1)).alias("n"))


@query("filter_is_not_null", "SELECT count(*) AS n FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL")
def is_not_null(t):
    rows = t.lineitem.withColumn("d", F.nullif("l_discount", F.lit(0.0)))
    return sl.where_chain(rows, [("and", "d", "is not null")]).agg(F.count(F.lit(1)).alias("n"))


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET'")
def like(t):
    return sl.where_chain(t.part, [("and", "p_name", "like", "%WIDGET")]).select("p_partkey", "p_name")


@query(
    "filter_where_chain",
    """SELECT o_orderkey FROM orders
       WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND o_orderpriority = '1-URGENT'""",
)
def where_chain(t):
    return sl.where_chain(
        t.orders,
        [("and", "o_orderstatus", "=", "F"), ("or", "o_totalprice", ">", 400000),
         ("and", "o_orderpriority", "=", "1-URGENT")],
    ).select("o_orderkey")


@query("filter_rows_condition", "SELECT c_custkey FROM customer WHERE c_acctbal > 3000 AND c_mktsegment IS NOT NULL")
def filter_rows(t):
    return sl.filter_rows(t.customer, "c_acctbal > 3000 and c_mktsegment != null").select("c_custkey")


@query("filter_match_equal", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW'")
def match_equal(t):
    return sl.match_equal(t.orders, {"o_orderstatus": "O", "o_orderpriority": "5-LOW"}).select("o_orderkey")


@query(
    "filter_search_terms",
    """SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red')
       AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')""",
)
def search_terms(t):
    return sl.search_terms(t.part, ["p_name", "p_brand", "p_type"], "red  Brand#1").select("p_partkey")


@query(
    "filter_search_and_status",
    "SELECT event_id FROM events WHERE contains(lower(props), '7') AND event_type = 'purchase'",
)
def search_status(t):
    return sl.search_and_status(t.events, "props", "7", "event_type", "purchase").select("event_id")


@query("drop_missing_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")
def drop_missing(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("x"),
    )
    return sl.drop_missing_rows(rows, ["d", "x"]).select("l_orderkey", "l_linenumber")


@query(
    "threshold_flag",
    """SELECT p_brand, round(avg(p_size) / 50, 4) AS score, round(avg(p_size) / 50, 4) >= 0.5 AS drifted,
              round(avg(p_size) / 50, 4) < 0.5 AS stable FROM part GROUP BY p_brand""",
)
def flag(t):
    scores = t.part.groupBy("p_brand").agg(F.round(F.avg("p_size") / 50, 4).alias("score"))
    return sl.threshold_flag(scores, "score", 0.5)


# --- joins ----------------------------------------------------------------------------------------

FIRST_ORDER = "(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)"


@query(
    "join_first_inner",
    f"""SELECT c.*, b.o_orderkey, b.o_orderstatus, b.o_totalprice, b.o_orderpriority FROM customer c
        JOIN {FIRST_ORDER} b ON c.c_custkey = b.o_custkey""",
)
def join_inner(t):
    return jn.join_first(t.customer, t.orders.drop("o_orderdate"), "c_custkey", "o_custkey", "o_orderkey", "inner")


@query(
    "join_first_left",
    f"""SELECT c.*, b.o_orderkey, b.o_orderstatus, b.o_totalprice, b.o_orderpriority FROM customer c
        LEFT JOIN {FIRST_ORDER} b ON c.c_custkey = b.o_custkey""",
)
def join_left(t):
    return jn.join_first(t.customer, t.orders.drop("o_orderdate"), "c_custkey", "o_custkey", "o_orderkey", "left")


@query(
    "join_first_collision",
    """SELECT s.s_suppkey AS id, s.s_name AS name, s.s_nationkey AS nationkey, n.n_name AS name_b FROM supplier s
       LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""",
)
def join_collision(t):
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    b = t.nation.select("n_nationkey", F.col("n_name").alias("name"))
    return jn.join_first(a, b, "nationkey", "n_nationkey", "name", "left")


@query(
    "join_report",
    """SELECT count(*) AS left_rows, count_if(c_custkey IN (SELECT o_custkey FROM orders))::BIGINT AS matched,
              count_if(c_custkey IN (SELECT o_custkey FROM orders))::BIGINT AS inner_rows FROM customer""",
)
def join_report(t):
    return jn.join_report(t.customer, t.orders, "c_custkey", "o_custkey")


@query("lookup_name", "SELECT c.*, n_name AS nation FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup(t):
    return jn.lookup(t.customer, t.nation, "c_nationkey", "n_nationkey", {"n_name": "nation"})


@query(
    "count_children",
    """SELECT c.c_custkey, c.c_name, coalesce(o.n, 0) AS n FROM customer c
       LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""",
)
def count_children(t):
    return jn.count_children(t.customer.select("c_custkey", "c_name"), t.orders, "c_custkey", "o_custkey")


@query(
    "has_approved",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def has_approved(t):
    return jn.having_match(
        t.customer, t.orders.filter("o_orderstatus = 'F'"), "c_custkey", "o_custkey"
    ).select("c_custkey")


@query(
    "cascade_exclude",
    """SELECT event_id FROM events
       WHERE (props->>'$.k')::BIGINT NOT IN (SELECT p_size FROM part WHERE p_type = 'ECONOMY')""",
)
def cascade(t):
    return jn.without_match(
        t.events, t.part.filter("p_type = 'ECONOMY'"), F.get_json_object("props", "$.k").cast("int"), "p_size"
    ).select("event_id")


# --- aggregates -----------------------------------------------------------------------------------


@query(
    "aggregate_functions",
    """SELECT count(*) AS n, count(nullif(l_discount, 0)) AS with_discount, round(sum(l_extendedprice), 4) AS s,
              round(avg(nullif(l_discount, 0)), 4) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem""",
)
def aggregate_functions(t):
    rows = t.lineitem.select("l_extendedprice", "l_tax", F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return ag.group_by(
        rows, None,
        {"n": ("count", "*"), "with_discount": ("count", "d"), "s": ("sum", "l_extendedprice"), "a": ("avg", "d"),
         "lo": ("min", "l_tax"), "hi": ("max", "l_tax")},
    )


@query(
    "group_by_missing_key",
    """SELECT nullif(l_discount, 0) AS d, l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS q
       FROM lineitem GROUP BY ALL""",
)
def group_missing(t):
    rows = t.lineitem.withColumn("d", F.nullif("l_discount", F.lit(0.0)))
    return ag.group_by(rows, ["d", "l_returnflag"], {"n": ("count", "*"), "q": ("sum", "l_quantity")})


@query(
    "group_first",
    """SELECT o_custkey, count(*) AS n, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority
       FROM orders GROUP BY 1""",
)
def group_first(t):
    return ag.group_by(t.orders, "o_custkey", {"n": ("count", "*")}, "o_orderpriority", "o_orderkey")


@query(
    "global_aggregate_empty",
    "SELECT count(*) AS n, round(sum(o_totalprice), 4) AS s FROM orders WHERE o_totalprice < 0",
)
def global_empty(t):
    return ag.group_by(t.orders.filter("o_totalprice < 0"), None, {"n": ("count", "*"), "s": ("sum", "o_totalprice")})


@query(
    "count_distinct",
    """SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts,
              count(DISTINCT nullif(l_discount, 0)) AS discounts FROM lineitem""",
)
def count_distinct(t):
    return t.lineitem.agg(
        F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"),
        F.countDistinct(F.nullif("l_discount", F.lit(0.0))).alias("discounts"),
    )


@query(
    "value_counts",
    "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
)
def value_counts(t):
    return ag.value_counts(t.part, "p_brand")


@query(
    "null_percent",
    """SELECT count_if(nullif(l_discount, 0) IS NULL)::BIGINT AS nulls,
              round(100.0::DOUBLE * count_if(nullif(l_discount, 0) IS NULL) / count(*), 1) AS null_percent FROM lineitem""",
)
def null_percent(t):
    rows = t.lineitem.select(F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return rows.agg(*ag.null_share(rows, "d", 1))


@query(
    "median_mode_mean",
    """SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, quantile_cont(l_quantity, 0.5) AS median,
              (SELECT l_quantity FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY 1
               ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, count(*)::BIGINT AS n
       FROM lineitem o GROUP BY 1""",
)
def median_mode(t):
    return ag.central(t.lineitem, "l_quantity", "l_returnflag").withColumn("mean", F.round("mean", 4))


@query(
    "variance_conventions",
    """SELECT c_mktsegment, round(var_pop(c_acctbal), 2) AS var_pop, round(var_samp(c_acctbal), 2) AS var_samp,
              round(stddev_pop(c_acctbal), 4) AS std_pop, round(stddev_samp(c_acctbal), 4) AS std_samp
       FROM customer GROUP BY 1""",
)
def variances(t):
    return ag.spread(t.customer, "c_acctbal", "c_mktsegment").select(
        "c_mktsegment", F.round("var_pop", 2).alias("var_pop"), F.round("var_samp", 2).alias("var_samp"),
        F.round("std_pop", 4).alias("std_pop"), F.round("std_samp", 4).alias("std_samp"),
    )


@query(
    "order_statistic",
    """SELECT o_orderpriority, max(CASE WHEN rn = least(floor(0.25 * n), n - 1) THEN o_totalprice END) AS q1,
              max(CASE WHEN rn = least(floor(0.75 * n), n - 1) THEN o_totalprice END) AS q3
       FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS rn,
                    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY 1""",
)
def order_statistic(t):
    return ag.order_statistic(t.orders, "o_totalprice", {"q1": 0.25, "q3": 0.75}, "o_orderpriority")


HIST = """WITH e AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
 b AS (SELECT least(floor(({c} - lo) / ((hi - lo) / {k})), {k} - 1)::BIGINT AS bin, count(*) AS n FROM {t}, e GROUP BY 1)
 SELECT r.bin, round(e.lo + r.bin * ((e.hi - e.lo) / {k}), 4) AS start, coalesce(b.n, 0) AS n
 FROM (SELECT unnest(range({k})) AS bin) r LEFT JOIN b USING (bin), e"""


@query("histogram", HIST.format(c="o_totalprice", t="orders", k=12))
def histogram(t):
    return ag.histogram(t.orders, "o_totalprice", 12).withColumn("start", F.round("start", 4))


@query("crosstab", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2")
def crosstab(t):
    return ag.crosstab(t.orders, "o_orderstatus", "o_orderpriority")


@query(
    "group_means",
    """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd
       FROM customer GROUP BY 1""",
)
def group_means(t):
    return ag.group_means(t.customer, "c_acctbal", "c_mktsegment").select(
        "c_mktsegment", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd")
    )


@query(
    "class_balance",
    """WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1),
       w AS (SELECT sum(n)::DOUBLE AS t, min(n) AS lo, max(n) AS hi FROM c)
       SELECT label, n AS count, round(100.0 * n / t, 1) AS pct, round(hi / lo, 2) AS ratio,
              round(100.0 * lo / t, 1) AS minority_pct, (hi / lo >= 3 OR 100.0 * lo / t < 15) AS imbalanced,
              CASE WHEN hi / lo >= 10 OR 100.0 * lo / t < 5 THEN 'severe'
                   WHEN hi / lo >= 3 OR 100.0 * lo / t < 15 THEN 'moderate' ELSE 'balanced' END AS severity FROM c, w""",
)
def class_balance(t):
    return ag.class_balance(t.events, "event_type")


@query(
    "balance_verdict",
    """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
       SELECT count(*) AS classes, round(max(n) / min(n), 4) AS ratio,
              CASE WHEN max(n) / min(n) < 1.5 THEN 'balanced' WHEN max(n) / min(n) < 3 THEN 'slightly imbalanced'
                   WHEN max(n) / min(n) <= 10 THEN 'imbalanced' ELSE 'severely imbalanced' END AS verdict FROM c""",
)
def balance_verdict(t):
    return ag.balance_verdict(t.labels, "toxic")


@query(
    "kpi_counts",
    """SELECT o_orderpriority, count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS finished,
              count_if(o_orderstatus = 'O')::BIGINT AS open, round(sum(o_totalprice), 2) AS value
       FROM orders GROUP BY 1""",
)
def kpi(t):
    status = F.col("o_orderstatus")
    return ag.kpi_counts(
        t.orders, {"finished": status == "F", "open": status == "O"}, {"value": "o_totalprice"}, "o_orderpriority"
    )


@query(
    "weekly_buckets",
    """SELECT floor(epoch_us(TIMESTAMP '2024-01-31' - ts) / 604800000000)::BIGINT AS weeks_ago, count(*) AS total,
              count_if(event_type = 'purchase')::BIGINT AS completed FROM events
       WHERE floor(epoch_us(TIMESTAMP '2024-01-31' - ts) / 604800000000) BETWEEN 0 AND 7 GROUP BY 1""",
)
def weekly(t):
    return ag.weekly_buckets(t.events, "ts", F.lit("2024-01-31"), F.col("event_type") == "purchase")


@query(
    "bucket_distribution",
    """SELECT CASE WHEN s >= 0.5 AND s < 0.6 THEN '50-60' WHEN s >= 0.6 AND s < 0.7 THEN '60-70'
                   WHEN s >= 0.7 AND s < 0.8 THEN '70-80' WHEN s >= 0.8 AND s < 0.9 THEN '80-90'
                   ELSE '90-100' END AS bucket, count(*) AS n
       FROM (SELECT p_size / 50 AS s FROM part) WHERE s >= 0.5 AND s <= 1.0 GROUP BY 1""",
)
def buckets(t):
    return ag.bucket_distribution(
        t.part.select((F.col("p_size") / 50).alias("s")), "s", [0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
        ["50-60", "60-70", "70-80", "80-90", "90-100"],
    )


@query(
    "metric_pivot",
    """SELECT metric, max(CASE WHEN l_returnflag = 'A' THEN v END) AS "A", max(CASE WHEN l_returnflag = 'N' THEN v END) AS "N",
              max(CASE WHEN l_returnflag = 'R' THEN v END) AS "R"
       FROM (SELECT l_returnflag, 'avg_qty' AS metric, round(avg(l_quantity), 4) AS v FROM lineitem GROUP BY 1 UNION ALL
             SELECT l_returnflag, 'avg_tax', round(avg(l_tax), 4) FROM lineitem GROUP BY 1) GROUP BY 1""",
)
def metric_pivot(t):
    wide = t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_tax"), 4).alias("avg_tax")
    )
    long = wide.unpivot(["l_returnflag"], ["avg_qty", "avg_tax"], "metric", "v")
    return ag.metric_pivot(long, "metric", "l_returnflag", "v", ["A", "N", "R"])


# --- windows --------------------------------------------------------------------------------------

MONTHLY = """(SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) - 1 AS position FROM
 (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS m, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2))"""


def monthly(t):
    sums = t.orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("v")
    )
    return wn.numbered_series(sums, "m", "o_orderpriority")


@query("series_positions", f"SELECT o_orderpriority, m, v, position FROM {MONTHLY}")
def series_positions(t):
    return monthly(t)


OVER = "OVER (PARTITION BY o_orderpriority ORDER BY position ROWS BETWEEN {} AND {})"


@query(
    "moving_average",
    f"SELECT o_orderpriority, m, round(avg(v) {OVER.format('6 PRECEDING', 'CURRENT ROW')}, 2) AS moving_avg FROM {MONTHLY}",
)
def moving_average(t):
    return wn.moving_average(monthly(t), "v", 7, "position", "o_orderpriority").select(
        "o_orderpriority", "m", F.round("moving_avg", 2).alias("moving_avg")
    )


@query(
    "lagged_moving_average",
    f"SELECT o_orderpriority, m, round(avg(v) {OVER.format('7 PRECEDING', '1 PRECEDING')}, 2) AS lagged_avg FROM {MONTHLY}",
)
def lagged_average(t):
    return wn.lagged_moving_average(monthly(t), "v", 7, "position", "o_orderpriority").select(
        "o_orderpriority", "m", F.round("lagged_avg", 2).alias("lagged_avg")
    )


@query("lag", f"SELECT o_orderpriority, m, lag(v, 1) OVER (PARTITION BY o_orderpriority ORDER BY position) AS lag FROM {MONTHLY}")
def lag(t):
    return wn.lagged(monthly(t), "v", 1, "position", "o_orderpriority").select("o_orderpriority", "m", "lag")


@query(
    "rolling_mean",
    f"""SELECT o_orderpriority, m, CASE WHEN count(v) {OVER.format('6 PRECEDING', 'CURRENT ROW')} = 7
        THEN round(avg(v) {OVER.format('6 PRECEDING', 'CURRENT ROW')}, 2) END AS rolling_mean FROM {MONTHLY}""",
)
def rolling_mean(t):
    return wn.rolling_mean(monthly(t), "v", 7, "position", "o_orderpriority").select(
        "o_orderpriority", "m", F.round("rolling_mean", 2).alias("rolling_mean")
    )


@query(
    "forward_fill",
    """SELECT event_id, user_id, last_value(nullif(event_type, 'error') IGNORE NULLS) OVER
              (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events""",
)
def forward_fill(t):
    rows = t.events.select("event_id", "user_id", "ts", F.nullif("event_type", F.lit("error")).alias("state"))
    return wn.forward_fill(rows, "state", ["ts", "event_id"], "user_id").drop("ts")


@query(
    "first_per_key",
    """SELECT user_id, event_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
)
def first_per_key(t):
    return jn.first_per_key(t.events.drop("props"), "user_id", ["ts", "event_id"]).drop("ts")


@query(
    "rank_rows",
    """SELECT p_brand, round(avg(p_retailprice), 2) AS price, row_number() OVER (ORDER BY round(avg(p_retailprice), 2) DESC, p_brand)
       AS rank FROM part GROUP BY 1""",
)
def rank_rows(t):
    board = t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("price"))
    return wn.rank_rows(board, [F.desc("price"), F.asc("p_brand")])


@query(
    "running_best",
    """SELECT o_orderpriority, m, v, max(v) OVER (PARTITION BY o_orderpriority ORDER BY m ROWS UNBOUNDED PRECEDING) AS best_so_far
       FROM """ + MONTHLY,
)
def running_best(t):
    return wn.running_best(monthly(t).drop("position"), "v", "m", "o_orderpriority")


@query(
    "running_total",
    """SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
       ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM orders""",
)
def running_total(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return wn.running_total(rows, "o_totalprice", "o_orderkey", "o_custkey").select(
        "o_orderkey", "o_custkey", F.round("running_total", 2).alias("running_total")
    )


@query(
    "last_n_average",
    """SELECT event_type, round(avg(value), 4) AS recent_avg, count(*) AS n FROM
       (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50)
       GROUP BY 1""",
)
def last_n(t):
    return wn.last_n_average(t.events, "value", ["ts", "event_id"], 50, "event_type").withColumn(
        "recent_avg", F.round("recent_avg", 4)
    )


@query(
    "share_of_total",
    """SELECT p_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM part), 1) AS share
       FROM part GROUP BY 1""",
)
def share_of_total(t):
    return wn.share_of_total(t.part, "p_type")


@query(
    "half_means",
    f"""SELECT o_orderpriority, round(avg(CASE WHEN position < n // 2 THEN v END), 2) AS first_half,
               round(avg(CASE WHEN position >= n // 2 THEN v END), 2) AS second_half
        FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM {MONTHLY}) GROUP BY 1""",
)
def half_means(t):
    return wn.half_means(monthly(t), "v", "position", "o_orderpriority").select(
        "o_orderpriority", F.round("first_half", 2).alias("first_half"), F.round("second_half", 2).alias("second_half")
    )


@query(
    "position_in_cycle",
    f"SELECT o_orderpriority, position % 12 AS cycle, count(*) AS n FROM {MONTHLY} GROUP BY 1, 2",
)
def cycle(t):
    return (
        wn.position_in_cycle(monthly(t), "position", 12)
        .groupBy("o_orderpriority", "cycle").agg(F.count(F.lit(1)).alias("n"))
    )


# --- ordering, limits, sets -----------------------------------------------------------------------


@query("order_by_mixed", "SELECT event_id, props->>'$.k' AS k FROM events ORDER BY k DESC")
def order_mixed(t):
    return sl.order_by_mixed(t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")), "k", True)


@query(
    "order_nulls_last",
    "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS d FROM lineitem ORDER BY d NULLS LAST, 1, 2",
)
def nulls_last(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return sl.order_nulls_last(rows, "d")


@query(
    "limit_with_total",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
)
def limit_total(t):
    return sl.limit_with_total(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@query(
    "favourites_first",
    "SELECT c_custkey, c_name, c_acctbal > 0 AS fav FROM customer ORDER BY fav DESC, c_name",
)
def favourites(t):
    return sl.favourites_first(t.customer.select("c_custkey", "c_name", (F.col("c_acctbal") > 0).alias("fav")), "fav", "c_name")


@query("sort_rows", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal")
def sort_rows(t):
    return sl.sort_rows(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal")


@query(
    "top_k",
    """SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1
       ORDER BY revenue DESC, l_partkey LIMIT 40""",
)
def top_k(t):
    revenue = t.lineitem.groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return sl.top_k(revenue, "revenue", 40, "l_partkey")


@query(
    "top_k_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
       AS rank FROM orders QUALIFY rank <= 3""",
)
def top_k_per_group(t):
    return sl.top_k_per_group(
        t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey",
        [F.desc("o_totalprice"), F.asc("o_orderkey")], 3,
    )


@query(
    "concat_union",
    """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::BIGINT AS supplier FROM customer
       UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier""",
)
def union(t):
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("supplier"))
    return jn.concat_union(a, b)


@query(
    "drop_duplicates_first",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1""",
)
def dedup_first(t):
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return jn.drop_duplicates(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("drop_duplicates_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem")
def dedup_rows(t):
    return jn.drop_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_discount", "l_tax"))


@query(
    "count_duplicates",
    """SELECT (sum(n - 1))::BIGINT AS duplicates, sum(n)::BIGINT AS rows FROM
       (SELECT count(*) AS n FROM documents GROUP BY text)""",
)
def count_duplicates(t):
    return jn.count_duplicates(t.documents, "text")


@query("distinct_values", "SELECT DISTINCT lang FROM documents")
def distinct_values(t):
    return jn.distinct_values(t.documents, "lang")
