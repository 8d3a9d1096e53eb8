"""Tests, text, sequences, rules and time series."""

from pyspark.sql import functions as F

from oreline.operators import hypothesis as hy, rules as ru, sequences as sq, series as ts, text as tx
from oreline.plans.catalog import query

# --- hypothesis tests: statistics against SQL; tail probabilities against textbook values in tests ----


@query(
    "t_test_welch",
    """WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1
                 ORDER BY n DESC, g LIMIT 2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, g) AS r FROM g),
       w AS (SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb
             FROM r a, r b WHERE a.r = 1 AND b.r = 2)
       SELECT group_a, group_b, n_a, n_b, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(sqrt(va), 4) AS sd_a, round(sqrt(vb), 4) AS sd_b,
              round((ma - mb) / sqrt(va / n_a + vb / n_b), 4) AS statistic,
              round((va / n_a + vb / n_b) ^ 2 / ((va / n_a) ^ 2 / (n_a - 1) + (vb / n_b) ^ 2 / (n_b - 1)), 4) AS df FROM w""",
)
def t_test(t):
    return hy.t_test_welch(t.customer, "c_acctbal", "c_mktsegment").drop("p_value", "significant", "significance")


@query(
    "anova_oneway",
    """WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1),
       a AS (SELECT avg(c_acctbal) AS grand, count(*) AS n FROM customer)
       SELECT round((sum(g.n * (m - grand) ^ 2) / (count(*) - 1)) / (sum((g.n - 1) * v) / (any_value(a.n) - count(*))), 4) AS statistic,
              count(*) - 1 AS df1, any_value(a.n) - count(*) AS df2 FROM g, a""",
)
def anova(t):
    return hy.anova_oneway(t.customer, "c_acctbal", "c_mktsegment").drop("p_value", "significant", "significance")


@query(
    "chi2_independence",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
       r AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS k FROM c GROUP BY 1), n AS (SELECT sum(o)::BIGINT AS n FROM c),
       x AS (SELECT coalesce(o, 0) AS o, r * k / n AS e, n FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c USING (a, b))
       SELECT any_value(n) AS n, round(sum((o - e) ^ 2 / e), 4) AS statistic, 2::BIGINT AS df,
              round(sqrt(sum((o - e) ^ 2 / e) / any_value(n)), 4) AS cramers_v, round(exp(-sum((o - e) ^ 2 / e) / 2), 4) AS p_value FROM x""",
)
def chi2(t):
    return hy.chi2_independence(t.lineitem, "l_returnflag", "l_linestatus").drop("significant", "significance")


@query(
    "jarque_bera",
    """WITH m AS (SELECT avg(c_acctbal) AS m FROM customer),
       s AS (SELECT count(*) AS n, avg((c_acctbal - m) ^ 3) / avg((c_acctbal - m) ^ 2) ^ 1.5 AS g, avg((c_acctbal - m) ^ 4) / avg((c_acctbal - m) ^ 2) ^ 2 AS k
             FROM customer, m)
       SELECT n, round(g, 4) AS skewness, round(k, 4) AS kurtosis, round(n / 6.0 * (g ^ 2 + (k - 3) ^ 2 / 4), 4) AS statistic,
              round(exp(-n / 12.0 * (g ^ 2 + (k - 3) ^ 2 / 4)), 4) AS p_value FROM s""",
)
def jarque_bera(t):
    return hy.jarque_bera(t.customer, "c_acctbal").drop("significant", "significance")


@query(
    "correlation_test",
    """WITH r AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
       SELECT n, round(r, 4) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS statistic, n - 2 AS df,
              CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength FROM r""",
)
def correlation_test(t):
    return hy.correlation_test(t.lineitem, "l_quantity", "l_extendedprice").drop("p_value", "significant", "significance")


# --- text -----------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS_PT + tx.STOPWORDS_EN)
TOKENS = f"""(SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(nfc_normalize(text)), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'),
   lambda w: length(w) >= 3 AND w NOT IN ({STOP}) AND NOT regexp_full_match(w, '[0-9]+')) AS tokens FROM documents WHERE trim(text) <> '')"""
TERMS = f"""(SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df, round(count(*) * ln((SELECT count(*) FROM documents) / count(DISTINCT doc_id)), 3) AS tfidf
   FROM (SELECT doc_id, unnest(tokens) AS term FROM {TOKENS}) GROUP BY 1)"""


def docs(t):
    return tx.tokenize(t.documents.select("doc_id", "text"), "text")


@query("tokenize", f"SELECT doc_id, array_to_string(tokens, ' ') AS words, len(tokens)::INT AS n FROM {TOKENS}")
def tokenize(t):
    return docs(t).select("doc_id", F.array_join("tokens", " ").alias("words"), F.size("tokens").alias("n"))


@query("term_counts", f"SELECT term, tf, df FROM {TERMS}")
def term_counts(t):
    return tx.term_counts(docs(t))


@query("tfidf", f"SELECT * FROM {TERMS}")
def tfidf(t):
    return tx.tfidf(docs(t))


@query("top_terms", f"SELECT * FROM {TERMS} ORDER BY tf DESC, term LIMIT 40")
def top_terms(t):
    return tx.top_terms(tx.tfidf(docs(t)))


@query("top_tfidf", f"SELECT * FROM {TERMS} ORDER BY tfidf DESC, term LIMIT 40")
def top_tfidf(t):
    return tx.top_terms(tx.tfidf(docs(t)), "tfidf")


@query(
    "cloud_size",
    f"SELECT term, tf, round(12 + 32 * (tf / max(tf) OVER ()))::BIGINT AS size FROM (SELECT * FROM {TERMS} ORDER BY tf DESC, term LIMIT 40)",
)
def cloud(t):
    return tx.cloud(tx.term_counts(docs(t)))


@query(
    "corpus_stats",
    f"""SELECT count(*) AS documents, sum(len(tokens))::BIGINT AS total_tokens, round(avg(len(tokens)), 1) AS avg_tokens_per_doc,
               (SELECT count(*) FROM {TERMS}) AS vocabulary FROM {TOKENS}""",
)
def corpus_stats(t):
    return tx.corpus_stats(docs(t))


@query(
    "length_histogram",
    f"""WITH l AS (SELECT len(tokens) AS n FROM {TOKENS}), e AS (SELECT min(n) AS lo, (max(n) - min(n)) / 12 AS step FROM l),
        b AS (SELECT least(floor((n - lo) / step), 11)::BIGINT AS bin, count(*) AS n FROM l, e GROUP BY 1)
        SELECT r.bin, round(lo + r.bin * step, 4) AS start, coalesce(b.n, 0) AS n FROM (SELECT unnest(range(12)) AS bin) r LEFT JOIN b USING (bin), e""",
)
def length_histogram(t):
    return tx.length_histogram(docs(t)).withColumn("start", F.round("start", 4))


GOOD, BAD = (", ".join(f"'{w}'" for w in ws) for ws in ([*tx.POSITIVE, "und", "ing"], [*tx.NEGATIVE, "der", "les"]))
MOOD = f"""(SELECT doc_id, len(list_filter(tokens, lambda w: w IN ({GOOD})))::INT AS p, len(list_filter(tokens, lambda w: w IN ({BAD})))::INT AS n FROM {TOKENS})"""


@query(
    "lexicon_sentiment",
    f"""SELECT doc_id, p AS n_positive, n AS n_negative, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM {MOOD}""",
)
def lexicon_sentiment(t):
    return tx.sentiment(docs(t), positive=[*tx.POSITIVE, "und", "ing"], negative=[*tx.NEGATIVE, "der", "les"]).select(
        "doc_id", "n_positive", "n_negative", "sentiment"
    )


@query(
    "lexicon_table_sentiment",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
            l AS (SELECT term, CASE WHEN count(*) % 2 = 0 THEN 1 ELSE -1 END AS p FROM w WHERE length(term) > 3 GROUP BY 1),
            c AS (SELECT doc_id, count_if(p > 0) AS g, count_if(p < 0) AS b FROM w JOIN l USING (term) GROUP BY 1)
       SELECT doc_id, coalesce(g, 0)::INT AS n_positive, coalesce(b, 0)::INT AS n_negative,
              CASE WHEN coalesce(g, 0) > coalesce(b, 0) THEN 'positive' WHEN coalesce(b, 0) > coalesce(g, 0) THEN 'negative' ELSE 'neutral' END AS sentiment
       FROM documents LEFT JOIN c USING (doc_id)""",
)
def lexicon_table(t):
    words = t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("tokens"))
    each = words.select(F.explode_outer("tokens").alias("term")).filter("length(term) > 3").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    lexicon = each.select("term", F.when(F.col("n") % 2 == 0, 1).otherwise(-1).alias("polarity"))
    return tx.lexicon_sentiment(words, lexicon, "doc_id").drop("tokens")


@query(
    "sentiment_summary",
    f"""SELECT count_if(p > n)::BIGINT AS positive, count_if(n > p)::BIGINT AS negative, count_if(n = p)::BIGINT AS neutral,
               round(100.0::DOUBLE * count_if(p > n) / count(*), 1) AS positive_pct, round(100.0::DOUBLE * count_if(n > p) / count(*), 1) AS negative_pct FROM {MOOD}""",
)
def sentiment_summary(t):
    return tx.sentiment_summary(docs(t), positive=[*tx.POSITIVE, "und", "ing"], negative=[*tx.NEGATIVE, "der", "les"])


# --- sequences ------------------------------------------------------------------------------------

SEQ = "(SELECT user_id, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events)"
LEAST = f"(SELECT greatest(2, ceil(0.05 * count(*))) FROM (SELECT user_id FROM {SEQ} GROUP BY 1 HAVING count(*) >= 2))"
NSEQ = f"(SELECT count(*) FROM (SELECT user_id FROM {SEQ} GROUP BY 1 HAVING count(*) >= 2))"


@query("build_sequences", f"SELECT user_id AS grp, position, item FROM {SEQ}")
def build_sequences(t):
    return sq.build_sequences(t.events, "user_id", "event_type", ["ts", "event_id"])


PAIRS = f"""(SELECT a, b, count(*) AS count, round(count(*) / {NSEQ}, 4) AS support FROM
  (SELECT DISTINCT x.user_id, x.item AS a, y.item AS b FROM {SEQ} x JOIN {SEQ} y ON x.user_id = y.user_id AND x.position < y.position)
  GROUP BY 1, 2 HAVING count(*) >= {LEAST})"""
TRIPLES = f"""(SELECT a, b, c, count(*) AS count, round(count(*) / {NSEQ}, 4) AS support FROM
  (SELECT DISTINCT x.user_id, x.item AS a, y.item AS b, z.item AS c FROM {SEQ} x JOIN {SEQ} y ON x.user_id = y.user_id AND x.position < y.position
   JOIN {SEQ} z ON y.user_id = z.user_id AND y.position < z.position) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST})"""


@query("sequence_pairs", f"SELECT * FROM {PAIRS}")
def sequence_pairs(t):
    return sq.sequence_pairs(t.events, "user_id", "event_type", ["ts", "event_id"])


@query("sequence_triples", f"SELECT * FROM {TRIPLES}")
def sequence_triples(t):
    return sq.sequence_triples(t.events, "user_id", "event_type", ["ts", "event_id"])


def longer_sql(longest: int) -> str:
    """Patterns of every size: earliest complete place per sequence, one more item at a time."""
    grown = ["g1 AS (SELECT user_id, [item] AS pattern, min(position) AS place FROM s GROUP BY 1, 2)"]
    for n in range(2, longest + 1):
        grown.append(f"""g{n} AS (SELECT g.user_id, list_append(pattern, item) AS pattern, min(position) AS place FROM g{n - 1} g JOIN s ON g.user_id = s.user_id AND position > place GROUP BY 1, 2
          QUALIFY count(*) OVER (PARTITION BY list_append(pattern, item)) >= (SELECT * FROM l))""")
    sizes = " UNION ALL ".join(f"SELECT pattern, {n}::INT AS size, count(*) AS count, round(count(*) / (SELECT * FROM q), 4) AS support FROM g{n} GROUP BY 1" for n in range(2, longest + 1))
    return f"WITH s AS {SEQ}, l AS {LEAST}, q AS {NSEQ}, {', '.join(grown)} {sizes}"


@query("sequence_patterns", f"SELECT array_to_string(pattern, ' → ') AS pattern, size, count, support FROM ({longer_sql(4)})")
def sequence_patterns(t):
    found = sq.sequence_patterns(t.events, "user_id", "event_type", ["ts", "event_id"], longest=4)
    return found.withColumn("pattern", F.array_join("pattern", " → "))


@query("top_pairs", f"SELECT a || ' → ' || b AS pattern, count, support FROM {PAIRS} ORDER BY count DESC, pattern LIMIT 15")
def top_pairs(t):
    return sq.top_pairs(t.events, "user_id", "event_type", ["ts", "event_id"])


@query(
    "top_patterns",
    f"""SELECT pattern, size::INT AS size, count, support FROM (SELECT a || ' → ' || b AS pattern, 2 AS size, count, support FROM {PAIRS} UNION ALL
        SELECT a || ' → ' || b || ' → ' || c, 3, count, support FROM {TRIPLES}) ORDER BY support DESC, size, pattern LIMIT 40""",
)
def top_patterns(t):
    return sq.top_patterns(t.events, "user_id", "event_type", ["ts", "event_id"])


@query(
    "sequence_summary",
    f"""SELECT count(*) AS sequences, round(avg(n), 2) AS avg_length, greatest(2, ceil(0.05::DOUBLE * count(*)))::BIGINT AS min_count
        FROM (SELECT count(*) AS n FROM {SEQ} GROUP BY user_id HAVING count(*) >= 2)""",
)
def sequence_summary(t):
    return sq.sequence_summary(t.events, "user_id", "event_type", ["ts", "event_id"])


# --- association rules ----------------------------------------------------------------------------

ITEMS = """(SELECT o_orderkey, unnest(['o_orderstatus=' || o_orderstatus, 'o_orderpriority=' || o_orderpriority, 'y=' || year(o_orderdate)]) AS item FROM orders)"""
SETS = f"""(SELECT [item] AS items, count(*) AS freq FROM {ITEMS} GROUP BY item UNION ALL
  SELECT [a.item, b.item], count(*) FROM {ITEMS} a JOIN {ITEMS} b ON a.o_orderkey = b.o_orderkey AND a.item < b.item GROUP BY a.item, b.item UNION ALL
  SELECT [a.item, b.item, c.item], count(*) FROM {ITEMS} a JOIN {ITEMS} b ON a.o_orderkey = b.o_orderkey AND a.item < b.item
   JOIN {ITEMS} c ON b.o_orderkey = c.o_orderkey AND b.item < c.item GROUP BY a.item, b.item, c.item)"""


def order_items(t):
    rows = t.orders.select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("string").alias("y"))
    return ru.to_transactions(rows)


@query(
    "to_transactions",
    "SELECT 'o_orderstatus=' || o_orderstatus || ',o_orderpriority=' || o_orderpriority || ',y=' || year(o_orderdate) AS items FROM orders",
)
def to_transactions(t):
    return order_items(t).select(F.array_join("items", ",").alias("items"))


@query(
    "frequent_itemsets",
    f"""SELECT array_to_string(items, ',') AS items, freq, round(freq / (SELECT count(*) FROM orders), 4) AS support FROM {SETS}
        WHERE freq >= ceil(0.02 * (SELECT count(*) FROM orders))""",
)
def frequent_itemsets(t):
    return ru.frequent_itemsets(order_items(t), 0.02).withColumn("items", F.array_join("items", ","))


FREQ = f"(SELECT items, freq::DOUBLE / (SELECT count(*) FROM orders) AS s FROM {SETS} WHERE freq >= ceil(0.01 * (SELECT count(*) FROM orders)))"
RULES = f"""(SELECT list_sort(list_filter(w.items, lambda i: i <> c.items[1])) AS antecedent, c.items[1] AS consequent, w.s AS support, w.s / a.s AS confidence,
   w.s / a.s / c.s AS lift, w.s - a.s * c.s AS leverage, (1 - c.s) / (1 - w.s / a.s) AS conviction, len(w.items)::INT AS length
  FROM {FREQ} w JOIN {FREQ} c ON len(c.items) = 1 AND len(w.items) > 1 AND list_contains(w.items, c.items[1])
  JOIN {FREQ} a ON a.items = list_sort(list_filter(w.items, lambda i: i <> c.items[1])))"""
GOOD_RULES = f"(SELECT * FROM {RULES} WHERE confidence >= 0.15 AND lift >= 1.0 AND len(antecedent) < 4)"
MARKED = f"""(SELECT r.*, CASE WHEN lift >= 3 THEN 'high' WHEN lift >= 2 THEN 'medium' ELSE 'low' END AS quality,
   EXISTS (SELECT 1 FROM {GOOD_RULES} s WHERE s.consequent = r.consequent AND len(s.antecedent) < len(r.antecedent)
           AND list_has_all(r.antecedent, s.antecedent) AND s.confidence >= r.confidence) AS is_redundant FROM {GOOD_RULES} r)"""


def rules(t):
    return ru.association_rules(order_items(t), 0.01, 0.15)


@query(
    "association_rules",
    f"""SELECT array_to_string(antecedent, ',') AS antecedent, consequent, round(support, 4) AS support, round(confidence, 4) AS confidence, round(lift, 4) AS lift,
               round(leverage, 6) AS leverage, round(conviction, 4) AS conviction, length, quality, is_redundant FROM {MARKED}""",
)
def association_rules(t):
    return rules(t).withColumns(
        {"antecedent": F.array_join("antecedent", ","), "leverage": F.round("leverage", 6),
         **{c: F.round(c, 4) for c in ("support", "confidence", "lift", "conviction")}}
    )


@query(
    "basket_itemsets",
    """WITH b AS (SELECT DISTINCT l_orderkey AS k, p_type AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT k) AS n FROM b)
       SELECT i AS items, count(*) AS freq, round(count(*) / any_value(n), 4) AS support FROM b, n GROUP BY i UNION ALL
       SELECT x.i || ',' || y.i, count(*), round(count(*) / any_value(n), 4) FROM b x JOIN b y ON x.k = y.k AND x.i < y.i, n GROUP BY x.i, y.i""",
)
def basket_itemsets(t):
    typed = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    found = ru.frequent_itemsets(ru.baskets(typed, "l_orderkey", "p_type", 0.05), 0.05, 2)
    return found.withColumn("items", F.array_join("items", ","))


@query(
    "closed_itemsets",
    """WITH o AS (SELECT n_name AS n, r_name AS r, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
       i AS (SELECT ['n=' || n] AS items, count(*) AS freq FROM o GROUP BY n UNION ALL SELECT ['r=' || r], count(*) FROM o GROUP BY r UNION ALL
             SELECT ['s=' || s], count(*) FROM o GROUP BY s UNION ALL SELECT ['n=' || n, 'r=' || r], count(*) FROM o GROUP BY n, r UNION ALL
             SELECT ['n=' || n, 's=' || s], count(*) FROM o GROUP BY n, s UNION ALL SELECT ['r=' || r, 's=' || s], count(*) FROM o GROUP BY r, s UNION ALL
             SELECT ['n=' || n, 'r=' || r, 's=' || s], count(*) FROM o GROUP BY n, r, s),
       f AS (SELECT * FROM i WHERE freq >= ceil(0.005 * (SELECT count(*) FROM customer)))
       SELECT array_to_string(items, ',') AS items, freq FROM f a
       WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.freq = a.freq AND len(b.items) > len(a.items) AND list_has_all(b.items, a.items))""",
)
def closed_itemsets(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    items = ru.to_transactions(rows.select(F.col("n_name").alias("n"), F.col("r_name").alias("r"), F.col("c_mktsegment").alias("s")))
    return ru.closed_itemsets(ru.frequent_itemsets(items, 0.005)).select(F.array_join("items", ",").alias("items"), "freq")


@query("rule_filter", f"""SELECT array_to_string(antecedent, ',') AS antecedent, consequent, round(lift, 4) AS lift FROM {MARKED}
                         WHERE NOT is_redundant AND confidence >= 0.2 AND (len(list_filter(antecedent, lambda i: contains(lower(i), 'urgent'))) > 0 OR contains(lower(consequent), 'urgent'))""")
def rule_filter(t):
    return ru.rule_filter(rules(t), "urgent", True, 0.0, 0.2).select(
        F.array_join("antecedent", ",").alias("antecedent"), "consequent", F.round("lift", 4).alias("lift")
    )


@query(
    "rule_clusters",
    f"""SELECT CASE WHEN lift >= 3 THEN 'strong' WHEN lift >= 1.5 THEN 'moderate' ELSE 'weak' END AS cluster, count(*) AS rules, round(avg(lift), 4) AS avg_lift
        FROM {MARKED} GROUP BY 1""",
)
def rule_clusters(t):
    return ru.rule_clusters(rules(t))


@query(
    "rule_averages",
    f"""SELECT count(*) AS total_rules, round(avg(support), 4) AS avg_support, round(avg(confidence), 4) AS avg_confidence, round(avg(lift), 4) AS avg_lift,
               count_if(quality = 'high')::BIGINT AS high_quality, round(avg((NOT is_redundant)::INT), 4) AS share_not_redundant FROM {MARKED}""",
)
def rule_averages(t):
    return ru.rule_averages(rules(t))


@query(
    "rule_suitability",
    """SELECT count(*) AS rows, 3::BIGINT AS cat_cols, 3::BIGINT AS num_cols,
              round((count(DISTINCT p_name) + count(DISTINCT p_brand) + count(DISTINCT p_type)) / 3, 2) AS avg_cardinality, 0::BIGINT AS high_card_cols,
              0.0::DOUBLE AS avg_nulls, 100::INT AS score, true AS apt, 'suitable' AS verdict FROM part""",
)
def suitability(t):
    return ru.suitability(t.part)


# --- time series ----------------------------------------------------------------------------------

S = """(SELECT o_orderpriority AS series, m AS period, v AS value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) - 1 AS position,
        count(*) OVER (PARTITION BY o_orderpriority) AS n
 FROM (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2))"""
LINE = f"(SELECT series, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, regr_slope(value, position) AS b, regr_intercept(value, position) AS a FROM {S} GROUP BY 1)"


def monthly(t):
    sums = t.orders.groupBy("o_orderpriority", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("m")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("v")
    )
    return ts.prepare_series(sums, "v", "m", "o_orderpriority")


@query("prepare_series", f"SELECT series, strftime(period, '%Y-%m-%d') AS period, value, position FROM {S}")
def prepare(t):
    return monthly(t).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


AC = f"""(SELECT x.series, x.n, k AS lag, sum((x.value - l.mean) * (y.value - l.mean)) / any_value(d.den) AS ac
  FROM {S} x CROSS JOIN (SELECT unnest([1, 4, 6, 7, 12, 24, 52]) AS k) JOIN {S} y ON x.series = y.series AND y.position = x.position + k
  JOIN {LINE} l ON l.series = x.series JOIN (SELECT s.series, sum((value - mean) ^ 2) AS den FROM {S} s JOIN {LINE} m ON s.series = m.series GROUP BY 1) d ON d.series = x.series
  GROUP BY 1, 2, 3)"""
SEASON = f"""(SELECT series, coalesce(max(ac) FILTER (WHERE lag > 1 AND lag < n / 2 AND ac > 0), 0) AS strength,
   coalesce(arg_max(lag, ac) FILTER (WHERE lag > 1 AND lag < n / 2 AND ac > 0), 0) AS lag FROM {AC} GROUP BY 1)"""


@query("autocorrelation", f"SELECT series, round(max(CASE WHEN lag = 1 THEN ac END), 4) AS ac_1, round(max(CASE WHEN lag = 12 THEN ac END), 4) AS ac_12 FROM {AC} GROUP BY 1")
def autocorrelation(t):
    return ts.autocorrelations(monthly(t), [1, 12]).select("series", F.round("ac_1", 4).alias("ac_1"), F.round("ac_12", 4).alias("ac_12"))


@query(
    "seasonality",
    f"""SELECT series, strength > 0.35 AS detected, CASE WHEN strength > 0.35 THEN lag ELSE 0 END::INT AS period,
               CASE WHEN strength <= 0.35 THEN 'none' ELSE CASE lag WHEN 4 THEN 'quarterly' WHEN 6 THEN 'semestral' WHEN 7 THEN 'weekly' WHEN 12 THEN 'monthly'
               WHEN 24 THEN 'daily' ELSE 'annual' END END AS type, round(strength, 3) AS strength FROM {SEASON}""",
)
def seasonality(t):
    return ts.seasonality(monthly(t))


@query(
    "trend",
    f"""SELECT l.series, l.n, round(b, 4) AS slope, round(a, 4) AS intercept,
               CASE WHEN abs(b * (n - 1)) < 0.5 * sd THEN CASE WHEN strength > 0.35 THEN 'cyclical' ELSE 'stable' END WHEN b > 0 THEN 'ascending' ELSE 'descending' END AS trend
        FROM {LINE} l JOIN {SEASON} s ON l.series = s.series""",
)
def trend(t):
    return ts.trend(monthly(t))


@query(
    "stationarity",
    f"""SELECT series, any_value(n) AS n, abs(avg(value) FILTER (WHERE position >= n // 2) - avg(value) FILTER (WHERE position < n // 2)) < 0.5 * stddev_samp(value) AS stationary
        FROM {S} GROUP BY 1""",
)
def stationarity(t):
    return ts.stationarity(monthly(t))


PARTS = f"""(WITH p AS (SELECT s.*, strength > 0.35 AS detected, CASE WHEN strength > 0.35 THEN lag ELSE 7 END AS p FROM {S} s JOIN {SEASON} z ON s.series = z.series),
 tr AS (SELECT p.*, (SELECT avg(q.value) FROM p q WHERE q.series = p.series AND q.position BETWEEN p.position - greatest(p.p, 7) + 1 AND p.position) AS trend FROM p),
 c AS (SELECT series, position % p AS cycle, avg(value - trend) AS s FROM tr GROUP BY 1, 2)
 SELECT tr.series, period, position, value, trend, CASE WHEN detected THEN s ELSE 0 END AS seasonal, value - trend - CASE WHEN detected THEN s ELSE 0 END AS residual, tr.n
 FROM tr JOIN c ON tr.series = c.series AND tr.position % tr.p = c.cycle)"""


@query(
    "decompose",
    f"SELECT series, position, value, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(residual, 3) AS residual FROM {PARTS}",
)
def decompose(t):
    return ts.decompose(monthly(t)).select("series", "position", "value", *[F.round(c, 3).alias(c) for c in ("trend", "seasonal", "residual")])


@query(
    "series_anomalies",
    f"""WITH d AS (SELECT *, residual / stddev_samp(residual) OVER (PARTITION BY series) AS z FROM {PARTS})
        SELECT series, position, round(value, 3) AS value, round(trend + seasonal, 3) AS expected, round(z, 2) AS z_score,
               CASE WHEN abs(z) > 3 THEN 'high' WHEN abs(z) > 2.5 THEN 'medium' ELSE 'low' END AS severity FROM d WHERE abs(z) > 2""",
)
def series_anomalies(t):
    return ts.anomalies(ts.decompose(monthly(t))).drop("period")


HOLT = f"""(WITH RECURSIVE h AS (SELECT s.series, 0::BIGINT AS position, s.value, s.value AS fitted, s.value AS level, t.value - s.value AS tr
   FROM {S} s JOIN {S} t ON s.series = t.series AND s.position = 0 AND t.position = 1
  UNION ALL SELECT h.series, s.position, s.value, h.level + 0.15::DOUBLE * ((0.4::DOUBLE * s.value + 0.6::DOUBLE * (h.level + h.tr)) - h.level) + 0.85::DOUBLE * h.tr,
   0.4::DOUBLE * s.value + 0.6::DOUBLE * (h.level + h.tr), 0.15::DOUBLE * ((0.4::DOUBLE * s.value + 0.6::DOUBLE * (h.level + h.tr)) - h.level) + 0.85::DOUBLE * h.tr
   FROM h JOIN {S} s ON s.series = h.series AND s.position = h.position + 1) SELECT * FROM h)"""


@query("fit_holt", f"SELECT series, position, round(fitted, 3) AS fitted, round(level, 3) AS level, round(tr, 3) AS slope FROM {HOLT}")
def fit_holt(t):
    return ts.holt(monthly(t)).select("series", "position", *[F.round(c, 3).alias(c) for c in ("fitted", "level", "slope")])


STEPS = "(SELECT unnest(range(12))::INT AS h)"


@query("forecast_linear", f"SELECT series, h, round(a + b * (n + h), 3) AS forecast FROM {LINE}, {STEPS}")
def forecast_linear(t):
    return ts.forecast_values(monthly(t), "linear_trend").withColumn("forecast", F.round("forecast", 3))


@query(
    "forecast_moving_avg",
    f"SELECT series, h, round(avg(value), 3) AS forecast FROM {S}, {STEPS} WHERE position >= n - 7 GROUP BY 1, 2",
)
def forecast_moving_avg(t):
    return ts.forecast_values(monthly(t), "moving_avg").withColumn("forecast", F.round("forecast", 3))


@query("forecast_holt", f"SELECT series, h, round(arg_max(level + (h + 1) * tr, position), 3) AS forecast FROM {HOLT}, {STEPS} GROUP BY 1, 2")
def forecast_holt(t):
    return ts.forecast_values(monthly(t)).withColumn("forecast", F.round("forecast", 3))


# a season of one week: mean value of each hour-quarter per event type repeats by construction of the sum with the weekday
WEEK = """(SELECT *, row_number() OVER (PARTITION BY series ORDER BY period) - 1 AS position, count(*) OVER (PARTITION BY series) AS n FROM
 (SELECT event_type AS series, date_trunc('day', ts) AS period, round(sum(value), 2) + 100000 * dayofweek(date_trunc('day', ts)) AS value FROM events GROUP BY 1, 2))"""


def weekly(t):
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    sums = t.events.groupBy("event_type", day.alias("d")).agg(
        (F.round(F.sum("value"), 2) + 100000 * (F.dayofweek(F.first(day)) - 1)).alias("v")
    )
    return ts.prepare_series(sums, "v", "d", "event_type")


@query(
    "forecast_seasonal_naive",
    f"SELECT s.series, h, round(value, 3) AS forecast FROM {WEEK} s JOIN {STEPS} ON s.position = s.n - 7 + h % 7",
)
def forecast_seasonal(t):
    return ts.forecast_values(weekly(t), "seasonal_naive").withColumn("forecast", F.round("forecast", 3))


@query(
    "forecast_errors",
    f"""SELECT series, round(avg(abs(value - fitted)), 3) AS mae, round(sqrt(avg((value - fitted) ^ 2)), 3) AS rmse, round(100 * avg(abs((value - fitted) / value)), 2) AS mape
        FROM {HOLT} WHERE position >= 1 GROUP BY 1""",
)
def forecast_errors(t):
    return ts.forecast_errors(ts.fitted(monthly(t))).select(
        "series", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("mape", 2).alias("mape")
    )


@query(
    "next_periods",
    f"""WITH l AS (SELECT series, max(period) AS b, min(period) AS a FROM {S} WHERE position >= n - 2 GROUP BY 1)
        SELECT series, h, strftime(b + (h + 1) * (b - a), '%Y-%m-%d') AS next_period FROM l, {STEPS}""",
)
def next_periods(t):
    return ts.next_periods(monthly(t))


@query(
    "forecast_bands",
    f"""WITH r AS (SELECT series, 1.96::DOUBLE * stddev_samp(residual) AS band FROM {PARTS} GROUP BY 1)
        SELECT l.series, h, round(a + b * (n + h), 3) AS value, round(a + b * (n + h) - band * sqrt(h + 1), 3) AS lower_bound,
               round(a + b * (n + h) + band * sqrt(h + 1), 3) AS upper_bound, round(greatest(0.5::DOUBLE, 0.95::DOUBLE - 0.03::DOUBLE * h), 2) AS confidence
        FROM {LINE} l JOIN r ON l.series = r.series, {STEPS}""",
)
def forecast_bands(t):
    return ts.forecast(monthly(t), "linear_trend").drop("next_period")


@query(
    "significance_label",
    """SELECT o_orderkey, CASE WHEN p < 0.001 THEN 'very high' WHEN p < 0.01 THEN 'high' WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS label
       FROM (SELECT o_orderkey, (o_orderkey % 2000) / 20000.0::DOUBLE AS p FROM orders)""",
)
def significance_label(t):
    return t.orders.select("o_orderkey", hy.significance_label((F.col("o_orderkey") % 2000) / 20000.0).alias("label"))
