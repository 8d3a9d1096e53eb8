"""Monitoring, survival, effects, maps, step lists and streams."""

from pyspark.sql import functions as F

from oreline.operators import causal as ca, clustering as cl, geo, learning as ml, monitoring as mo, series_models as sm, survival as su
from oreline.plans.catalog import query
from oreline.plans.mining_queries import monthly
from oreline.plans.model_queries import DOC, NUMBERS, priced, rated
from oreline.plans.steps import Step, run_steps
from oreline.plans.templates import TEMPLATES
from oreline.streaming import jobs

# --- drift: shipments before 1998 against those after -----------------------------------------------

COLS = ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus"]


def sides(t):
    rows = t.lineitem.select(*COLS, "l_shipdate")
    return rows.filter("l_shipdate < '1998-01-01'"), rows.filter("l_shipdate >= '1998-01-01'")


NUM = "(" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, {c} AS value, (l_shipdate >= TIMESTAMP '1998-01-01')::INT AS side FROM lineitem" for c in COLS[:3]
) + ")"
TXT = "(" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, {c} AS value, (l_shipdate >= TIMESTAMP '1998-01-01')::INT AS side FROM lineitem" for c in COLS[3:]
) + ")"
DRIFT = f"""(WITH k AS (SELECT name, value, count_if(side = 0) AS a, count_if(side = 1) AS b FROM {NUM} GROUP BY 1, 2),
 w AS (SELECT name, sum(a) OVER (PARTITION BY name ORDER BY value) / sum(a) OVER (PARTITION BY name) AS fa, sum(b) OVER (PARTITION BY name ORDER BY value) / sum(b) OVER (PARTITION BY name) AS fb FROM k),
 d AS (SELECT name, max(abs(fa - fb)) AS d FROM w GROUP BY 1),
 m AS (SELECT name, round(avg(CASE WHEN side = 0 THEN value END), 3) AS original_mean, round(avg(CASE WHEN side = 1 THEN value END), 3) AS batch_mean,
   round(stddev_samp(CASE WHEN side = 0 THEN value END), 3) AS original_std, round(stddev_samp(CASE WHEN side = 1 THEN value END), 3) AS batch_std FROM {NUM} GROUP BY 1),
 c AS (SELECT name, value, count_if(side = 0) AS a, count_if(side = 1) AS b FROM {TXT} GROUP BY 1, 2),
 s AS (SELECT name, sum(a) AS na, sum(b) AS nb FROM c GROUP BY 1)
 SELECT d.name AS column, round(d, 4) AS drift_score, 'KS' AS method, original_mean, batch_mean, original_std, batch_std FROM d JOIN m ON d.name = m.name
 UNION ALL SELECT c.name, round(sum(abs(a / na - b / nb)) / 2, 4), 'chi-square', NULL, NULL, NULL, NULL FROM c JOIN s ON c.name = s.name GROUP BY 1)"""


@query(
    "drift_report",
    f"SELECT *, drift_score > 0.15 AS drifted, CASE WHEN drift_score > 0.4 THEN 'high' WHEN drift_score > 0.15 THEN 'medium' ELSE 'low' END AS impact FROM {DRIFT}",
)
def drift_report(t):
    return mo.drift_report(*sides(t), COLS).drop("p_value")


@query(
    "drift_summary",
    f"""SELECT round(avg(drift_score), 3) AS overall_score, CASE WHEN avg(drift_score) > 0.4 THEN 'critical' WHEN avg(drift_score) > 0.2 THEN 'moderate'
               WHEN avg(drift_score) > 0.08 THEN 'light' ELSE 'none' END AS severity, count_if(drift_score > 0.15)::BIGINT AS columns_with_drift,
               count_if(drift_score <= 0.15)::BIGINT AS columns_stable FROM {DRIFT}""",
)
def drift_summary(t):
    return mo.drift_summary(mo.drift_report(*sides(t), COLS))


@query(
    "psi",
    f"""WITH e AS (SELECT name, min(value) AS lo, (max(value) - min(value)) / 10 AS s FROM {NUM} WHERE side = 0 GROUP BY 1),
        b AS (SELECT n.name, least(greatest(floor((value - lo) / s), 0), 9) AS bin, count_if(side = 0) AS a, count_if(side = 1) AS b FROM {NUM} n JOIN e ON n.name = e.name GROUP BY 1, 2),
        p AS (SELECT name, greatest(a / sum(a) OVER (PARTITION BY name), 0.0001) AS pa, greatest(b / sum(b) OVER (PARTITION BY name), 0.0001) AS pb FROM b)
        SELECT name AS column, round(sum((pb - pa) * ln(pb / pa)), 4) AS psi FROM p GROUP BY 1""",
)
def psi(t):
    return mo.psi(*sides(t), COLS[:3])


@query(
    "drift_timeline",
    """WITH l AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'base' ELSE strftime(l_shipdate, '%Y') END AS period, l_quantity,
                    l_extendedprice * CASE WHEN l_quantity = 7 THEN 1000 ELSE 1 END AS price FROM lineitem),
       r AS (SELECT period, 'q' AS name, l_quantity::DOUBLE AS v FROM l UNION ALL SELECT period, 'p', price FROM l),
       p AS (SELECT DISTINCT period FROM r WHERE period <> 'base'),
       c AS (SELECT p.period, name, v, count_if(r.period = 'base') AS a, count_if(r.period = p.period) AS b FROM p, r GROUP BY 1, 2, 3),
       f AS (SELECT period, name, sum(a) OVER w / sum(a) OVER g AS fa, sum(b) OVER w / sum(b) OVER g AS fb FROM c
             WINDOW w AS (PARTITION BY period, name ORDER BY v), g AS (PARTITION BY period, name)),
       d AS (SELECT period, name, round(max(abs(fa - fb)), 4) AS d FROM f GROUP BY 1, 2)
       SELECT period, round(avg(d), 4) AS drift_score FROM d GROUP BY 1""",
)
def drift_timeline(t):
    """One column has outliers, which steps of equal width could not tell from the rest."""
    price = F.col("l_extendedprice") * F.when(F.col("l_quantity") == 7, 1000).otherwise(1)
    base, batch = (x.withColumn("price", price) for x in sides(t))
    return mo.drift_timeline(base, batch, ["l_quantity", "price"], F.date_format("l_shipdate", "yyyy"))


@query(
    "retrain_trigger",
    f"""WITH s AS (SELECT round(avg(drift_score), 3) AS overall_score, CASE WHEN avg(drift_score) > 0.4 THEN 'critical' WHEN avg(drift_score) > 0.2 THEN 'moderate'
                   WHEN avg(drift_score) > 0.08 THEN 'light' ELSE 'none' END AS severity, count_if(drift_score > 0.15)::BIGINT AS columns_with_drift,
                   count_if(drift_score <= 0.15)::BIGINT AS columns_stable FROM {DRIFT}),
        a AS (SELECT avg((l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1998-01-01')::INT) FILTER (WHERE l_shipdate < TIMESTAMP '1998-01-01') AS x,
                     avg((l_quantity > 30 AND l_shipdate >= TIMESTAMP '1998-01-01')::INT) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-01-01') AS y FROM lineitem)
        SELECT s.*, round(x - y, 4) AS accuracy_drop, overall_score > 0.2 OR x - y > 0.1 AS retrain,
               CASE WHEN overall_score > 0.2 THEN 'drift' WHEN x - y > 0.1 THEN 'accuracy' ELSE 'none' END AS reason FROM s, a""",
)
def retrain_trigger(t):
    base, batch = sides(t)
    before = base.agg(F.avg((F.col("l_returnflag") == "R").cast("double"))).scalar()
    now = batch.agg(F.avg((F.col("l_quantity") > 30).cast("double"))).scalar()
    return mo.retrain_trigger(mo.drift_summary(mo.drift_report(base, batch, COLS)), before, now)


@query(
    "champion_challenger",
    """WITH p AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_quantity > 15 THEN 'A' ELSE 'N' END AS champion,
                         CASE WHEN l_quantity > 25 THEN l_returnflag ELSE 'N' END AS challenger FROM lineitem),
       l AS (SELECT 'champion' AS model, y, champion AS p FROM p UNION ALL SELECT 'challenger', y, challenger FROM p),
       r AS (SELECT model, y, count(*) AS s, count_if(y = p) AS tp FROM l GROUP BY 1, 2), q AS (SELECT model, p AS y, count(*) AS said FROM l GROUP BY 1, 2),
       k AS (SELECT r.model, s, tp, coalesce(tp / said, 0) AS pr, tp / s AS re FROM r LEFT JOIN q ON r.model = q.model AND r.y = q.y),
       m AS (SELECT model, round(sum(tp) / sum(s), 4) AS accuracy, round(avg(pr), 4) AS precision, round(avg(re), 4) AS recall,
                    round(avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END), 4) AS f1 FROM k GROUP BY 1),
       u AS (UNPIVOT m ON accuracy, precision, recall, f1 INTO NAME metric VALUE v),
       w AS (SELECT metric, max(CASE WHEN model = 'champion' THEN v END) AS champion, max(CASE WHEN model = 'challenger' THEN v END) AS challenger FROM u GROUP BY 1),
       g AS (SELECT round(challenger - champion, 4) AS gain FROM w WHERE metric = 'accuracy')
       SELECT metric, champion, challenger, CASE WHEN abs(challenger - champion) < 0.005 THEN 'tie' WHEN challenger > champion THEN 'challenger' ELSE 'champion' END AS better,
              round(100 * (challenger - champion) / champion, 1) AS delta_pct, CASE WHEN abs(gain) < 0.01 THEN 'tie' WHEN gain > 0 THEN 'challenger' ELSE 'champion' END AS winner,
              CASE WHEN abs(gain) > 0.05 THEN 'high' WHEN abs(gain) > 0.02 THEN 'medium' ELSE 'low' END AS confidence,
              CASE WHEN gain > 0.02 THEN 'promote_challenger' WHEN gain < -0.02 THEN 'keep_champion' ELSE 'more_testing' END AS recommendation FROM w, g""",
)
def champion_challenger(t):
    q = F.col("l_quantity")
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("y"), F.when(q > 30, "R").when(q > 15, "A").otherwise("N").alias("champion"),
        F.when(q > 25, F.col("l_returnflag")).otherwise("N").alias("challenger"),
    )
    return mo.champion_challenger(rows, "y", "champion", "challenger").drop("z", "p_value")


AB = """(SELECT strftime(ts, '%Y-%m-%d') AS step, user_id % 2 AS variant, count(*) AS n, avg((event_type = 'purchase')::INT) AS accuracy, avg(value) AS latency,
  avg((event_type = 'error')::INT) AS error_rate FROM events GROUP BY 1, 2)"""


def ab_steps(t):
    rows = t.events.withColumn("variant", F.col("user_id") % 2)
    kind = F.col("event_type")
    return mo.ab_test(rows, F.date_format("ts", "yyyy-MM-dd"), "variant", kind == "purchase", F.col("value"), kind == "error")


@query(
    "ab_test",
    f"SELECT step, variant, n, round(accuracy, 4) AS accuracy, round(latency, 4) AS latency, round(error_rate, 4) AS error_rate, round(accuracy - latency / 1000, 4) AS score FROM {AB}",
)
def ab_test(t):
    return ab_steps(t).withColumns({c: F.round(c, 4) for c in ("accuracy", "latency", "error_rate", "score")})


@query(
    "ab_winner",
    f"""WITH v AS (SELECT variant, sum(n)::BIGINT AS n, sum(accuracy * n) / sum(n) AS a, sum(latency * n) / sum(n) AS l, sum(error_rate * n) / sum(n) AS e FROM {AB} GROUP BY 1)
        SELECT variant, n, round(a, 4) AS accuracy, round(l, 4) AS latency, round(e, 4) AS error_rate, round(a - l / 1000, 4) AS score,
               a - l / 1000 = (SELECT max(a - l / 1000) FROM v) AS winner FROM v""",
)
def ab_winner(t):
    return mo.ab_winner(ab_steps(t))


DEPLOY = """(SELECT count(*) AS total_calls, avg(value) AS avg_latency_ms, avg((event_type = 'error')::INT) AS error_rate, avg((event_type = 'purchase')::INT) AS accuracy
  FROM events WHERE user_id % 2 = {})"""


@query(
    "compare_deployments",
    f"""WITH a AS {DEPLOY.format(0)}, b AS {DEPLOY.format(1)},
        m AS (SELECT 'accuracy' AS metric, a.accuracy AS a, b.accuracy AS b, sign(a.accuracy - b.accuracy) AS s FROM a, b UNION ALL
              SELECT 'avg_latency_ms', a.avg_latency_ms, b.avg_latency_ms, sign(b.avg_latency_ms - a.avg_latency_ms) FROM a, b UNION ALL
              SELECT 'error_rate', a.error_rate, b.error_rate, sign(b.error_rate - a.error_rate) FROM a, b)
        SELECT metric, round(m.a, 6) AS a, round(m.b, 6) AS b, CASE WHEN s > 0 THEN 'a' WHEN s < 0 THEN 'b' ELSE 'tie' END AS better,
               CASE WHEN (SELECT sum(s) FROM m) > 0 THEN 'a' WHEN (SELECT sum(s) FROM m) < 0 THEN 'b' ELSE 'tie' END AS overall,
               round(a.total_calls * a.avg_latency_ms / 1000 * 5e-5, 6) AS cost_a, round(b.total_calls * b.avg_latency_ms / 1000 * 5e-5, 6) AS cost_b FROM m, a, b""",
)
def compare_deployments(t):
    def one(v):
        kind = F.col("event_type")
        return t.events.filter(F.col("user_id") % 2 == v).agg(
            F.count(F.lit(1)).alias("total_calls"), F.avg("value").alias("avg_latency_ms"), F.avg((kind == "error").cast("double")).alias("error_rate"),
            F.avg((kind == "purchase").cast("double")).alias("accuracy"),
        )

    out = mo.compare_deployments(one(0), one(1), ["accuracy"], ["avg_latency_ms", "error_rate"])
    return out.withColumns({"a": F.round("a", 6), "b": F.round("b", 6)})


@query(
    "feedback_accuracy",
    """SELECT event_type AS model, count(*) AS n, count_if(value >= 5)::BIGINT AS confirmed, count_if(value < 2)::BIGINT AS corrected, round(avg((value >= 5)::INT), 4) AS accuracy
       FROM events GROUP BY 1""",
)
def feedback(t):
    v = F.col("value")
    status = F.when(v >= 5, "confirmed").when(v < 2, "corrected").otherwise("pending")
    return mo.feedback_accuracy(t.events, "event_type", v >= 5, status)


def line_logs(t):
    """An order is a run, its lines are the log of the nodes."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("node"), F.when(F.col("l_tax") > 0.06, "failed").otherwise("success").alias("status"),
        F.col("l_quantity").cast("bigint").alias("rows_in"), F.floor(F.col("l_quantity") / 2).alias("rows_out"), F.col("l_extendedprice").alias("duration_ms"),
    )


@query(
    "run_history",
    """SELECT o_orderstatus AS status, count(*) AS runs, round(avg(o_totalprice), 2) AS avg_duration_ms, coalesce(sum(r), 0)::BIGINT AS rows_out FROM orders
       LEFT JOIN (SELECT l_orderkey, sum(floor(l_quantity / 2)) AS r FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""",
)
def run_history(t):
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("duration_ms"))
    return mo.run_history(runs, line_logs(t))


@query(
    "node_history",
    """SELECT l_returnflag AS node, count(*) AS runs, count_if(l_tax > 0.06)::BIGINT AS failed, sum(l_quantity)::BIGINT AS rows_in, sum(floor(l_quantity / 2))::BIGINT AS rows_out,
              round(avg(l_extendedprice), 2) AS avg_duration_ms FROM lineitem GROUP BY 1""",
)
def node_history(t):
    return mo.node_history(line_logs(t))


# --- survival: days from a user's first event to the first purchase ---------------------------------


def durations(t):
    end = t.events.agg(F.max("ts")).scalar()
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("b"), F.avg("value").alias("v"), F.count(F.lit(1)).alias("k"))
    day = lambda c: F.unix_micros(c.cast("timestamp"))
    return first.select(
        "user_id", (F.col("user_id") % 2).alias("arm"), F.floor((day(F.coalesce(F.col("b"), end)) - day(F.col("a"))) / 7_200_000_000).alias("days"),
        F.when(F.col("b").isNotNull() & (F.col("k") % 5 != 0), 1).otherwise(0).alias("died"), "v", F.col("k").cast("double").alias("k"),
    )


DUR = """(SELECT user_id, user_id % 2 AS arm, floor((epoch_us(coalesce(b, (SELECT max(ts) FROM events))) - epoch_us(a)) / 7200000000)::BIGINT AS days,
   CASE WHEN b IS NOT NULL AND k % 5 <> 0 THEN 1 ELSE 0 END AS died FROM
  (SELECT user_id, min(ts) AS a, min(CASE WHEN event_type = 'purchase' THEN ts END) AS b, count(*) AS k FROM events GROUP BY 1))"""
KM = f"""(WITH t AS (SELECT arm, days AS time, count_if(died = 1)::BIGINT AS events, count_if(died = 0)::BIGINT AS censored FROM {DUR} GROUP BY 1, 2),
  r AS (SELECT *, sum(events + censored) OVER (PARTITION BY arm ORDER BY time DESC)::BIGINT AS at_risk FROM t)
 SELECT arm, time, at_risk, events, censored, product(1 - events / at_risk) OVER (PARTITION BY arm ORDER BY time) AS survival FROM r)"""


@query("kaplan_meier", f"SELECT arm, time, at_risk, events, censored, round(survival, 6) AS survival FROM {KM}")
def kaplan_meier(t):
    return su.kaplan_meier(durations(t), "days", "died", "arm").withColumn("survival", F.round("survival", 6))


@query("median_survival", f"SELECT arm, min(CASE WHEN survival <= 0.5 + 1e-12 THEN time END) AS median FROM {KM} GROUP BY 1")
def median_survival(t):
    return su.median_survival(su.kaplan_meier(durations(t), "days", "died", "arm"), "arm")


@query(
    "log_rank",
    f"""WITH t AS (SELECT days, count_if(died = 1) AS d, count_if(died = 1 AND arm = 0) AS da, count(*) AS g, count_if(arm = 0) AS ga FROM {DUR} GROUP BY 1),
        r AS (SELECT *, sum(g) OVER (ORDER BY days DESC) AS n, sum(ga) OVER (ORDER BY days DESC) AS na FROM t)
        SELECT sum(da)::BIGINT AS observed, round(sum(d * na / n), 4) AS expected,
               round((sum(da) - sum(d * na / n)) ^ 2 / sum(CASE WHEN n > 1 THEN d * (na / n) * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END), 4) AS statistic FROM r""",
)
def log_rank(t):
    return su.log_rank(durations(t), "days", "died", "arm").drop("p_value")


@query("aft_regression")
def aft(t):
    return su.aft_regression(durations(t), "days", "died", ["v", "k"])


def cox_sql(rounds: int = 9) -> str:
    """Newton steps for two features, spelt out; ties as Efron has them."""
    steps = [
        f"""WITH raw AS (SELECT d.days, d.died, e.v, e.k FROM {DUR} d JOIN (SELECT user_id, avg(value) AS v, count(*)::DOUBLE AS k FROM events GROUP BY 1) e USING (user_id) WHERE e.v IS NOT NULL),
        m AS (SELECT avg(v) AS mv, stddev_pop(v) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM raw),
        x AS (SELECT days, died = 1 AS died, (v - mv) / sv AS a, (k - mk) / sk AS b FROM raw, m),
        b0 AS (SELECT 0::DOUBLE AS p, 0::DOUBLE AS q, 0::DOUBLE AS i11, 0::DOUBLE AS i12, 0::DOUBLE AS i22)"""
    ]
    names = {"w": "w", "a": "w * a", "b": "w * b", "aa": "w * a * a", "ab": "w * a * b", "bb": "w * b * b"}
    for n in range(1, rounds + 1):
        sums = ", ".join(f"sum({v}) AS s{k}, coalesce(sum({v}) FILTER (died), 0) AS f{k}" for k, v in names.items())
        over = ", ".join(f"sum(s{k}) OVER (ORDER BY days DESC) AS r{k}, f{k}" for k in names)
        left = ", ".join(f"r{k} - l / d * f{k} AS {k}" for k in names)
        steps.append(
            f"""t{n} AS (SELECT days, count_if(died) AS d, coalesce(sum(a) FILTER (died), 0) AS xa, coalesce(sum(b) FILTER (died), 0) AS xb, {sums}
              FROM (SELECT x.*, exp(p * a + q * b) AS w FROM x, b{n - 1}) GROUP BY 1),
            r{n} AS (SELECT days, d, xa, xb, {over} FROM t{n}),
            l{n} AS (SELECT l, xa, xb, {left} FROM (SELECT *, unnest(range(d::BIGINT)) AS l FROM r{n} WHERE d > 0)),
            u{n} AS (SELECT sum(CASE WHEN l = 0 THEN xa ELSE 0 END - a / w) AS ua, sum(CASE WHEN l = 0 THEN xb ELSE 0 END - b / w) AS ub,
              sum(aa / w - (a / w) ^ 2) AS i11, sum(ab / w - a * b / w ^ 2) AS i12, sum(bb / w - (b / w) ^ 2) AS i22 FROM l{n}),
            b{n} AS (SELECT p + (u.i22 * ua - u.i12 * ub) / (u.i11 * u.i22 - u.i12 ^ 2) AS p, q + (u.i11 * ub - u.i12 * ua) / (u.i11 * u.i22 - u.i12 ^ 2) AS q, u.i11, u.i12, u.i22 FROM u{n} u, b{n - 1})"""
        )
    steps[-1] += f""", o AS (SELECT 'v' AS feature, p / sv AS c, sqrt(i22 / (i11 * i22 - i12 ^ 2)) / sv AS e FROM b{rounds}, m UNION ALL SELECT 'k', q / sk, sqrt(i11 / (i11 * i22 - i12 ^ 2)) / sk FROM b{rounds}, m)
        SELECT feature, round(c, 6) AS coefficient, round(e, 6) AS std_error, round(exp(c), 6) AS hazard_ratio, round(exp(c - 1.959963984540054 * e), 6) AS lower, round(exp(c + 1.959963984540054 * e), 6) AS upper FROM o"""
    return ", ".join(steps)


@query("cox_regression", cox_sql())
def cox(t):
    found = su.cox_regression(durations(t), "days", "died", ["v", "k"])
    return found.select("feature", *[F.round(c, 6).alias(c) for c in ("coefficient", "std_error", "hazard_ratio", "lower", "upper")])


@query(
    "concordance",
    f"""WITH d AS (SELECT user_id, days, died, user_id * 7919 % 1009 + CASE WHEN user_id % 97 = 0 THEN 1000000 ELSE 0 END AS risk FROM {DUR})
        SELECT round(sum(CASE WHEN a.risk > b.risk THEN 1 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / count(*)::DOUBLE, 6) AS c_index
        FROM d a JOIN d b ON a.died = 1 AND a.days < b.days""",
)
def concordance(t):
    rows = durations(t).withColumn("risk", F.col("user_id") * 7919 % 1009 + F.when(F.col("user_id") % 97 == 0, 1_000_000).otherwise(0))
    return su.concordance(rows, "days", "died", "risk").withColumn("c_index", F.round("c_index", 6))


# --- effects: odd users are treated -----------------------------------------------------------------


def treated(t):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        F.round(F.sum("value"), 2).alias("spent"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "click").alias("clicks"),
    ).select("user_id", (F.col("user_id") % 2).alias("treated"), "spent", "views", "clicks", (0.3 + 0.4 * F.col("views") / (F.col("views") + F.col("clicks") + 1)).alias("p"))


TREATED = """(SELECT user_id, user_id % 2 AS treated, round(sum(value), 2) AS spent, count_if(event_type = 'view')::BIGINT AS views, count_if(event_type = 'click')::BIGINT AS clicks,
  0.3::DOUBLE + 0.4::DOUBLE * count_if(event_type = 'view') / (count_if(event_type = 'view') + count_if(event_type = 'click') + 1) AS p FROM events GROUP BY 1)"""


@query(
    "ipw_ate",
    f"""WITH w AS (SELECT *, CASE WHEN treated = 1 THEN 1 / p ELSE 0 END AS w1, CASE WHEN treated = 0 THEN 1 / (1 - p) ELSE 0 END AS w0 FROM {TREATED}),
        m AS (SELECT sum(w1 * spent) / sum(w1) AS m1, sum(w0 * spent) / sum(w0) AS m0 FROM w),
        e AS (SELECT any_value(m1) - any_value(m0) AS ate, sqrt(avg((w1 * (spent - m1) - w0 * (spent - m0)) ^ 2) / count(*)) AS se FROM w, m)
        SELECT 'IPW' AS method, round(ate, 4) AS ate, round(se, 4) AS se, round(ate - 1.96 * se, 4) AS ci_lower, round(ate + 1.96 * se, 4) AS ci_upper FROM e""",
)
def ipw(t):
    return ca.ipw_ate(treated(t), "treated", "spent", "p").drop("p_value")


@query("propensity")
def propensity(t):
    return ca.propensity(treated(t), "treated", ["views", "clicks"])


@query(
    "matching_ate",
    f"""WITH r AS (SELECT a.user_id, CASE WHEN a.treated = 1 THEN 1 ELSE -1 END * (a.spent - arg_min(b.spent, ((a.p - b.p) ^ 2, b.user_id))) AS g
                   FROM {TREATED} a JOIN {TREATED} b ON a.treated <> b.treated GROUP BY a.user_id, a.treated, a.spent, a.p),
        e AS (SELECT avg(g) AS ate, stddev_samp(g) / sqrt(count(*)) AS se FROM r)
        SELECT 'matching' AS method, round(ate, 4) AS ate, round(se, 4) AS se, round(ate - 1.96 * se, 4) AS ci_lower, round(ate + 1.96 * se, 4) AS ci_upper FROM e""",
)
def matching(t):
    return ca.matching_ate(treated(t), "user_id", "treated", "spent", "p").drop("p_value")


@query("learner_s")
def learner_s(t):
    return ca.learner_ate(ca.learner_effects(treated(t), "user_id", "treated", "spent", ["views", "clicks"], "S", "tree"), "S")


@query("learner_t")
def learner_t(t):
    return ca.learner_ate(ca.learner_effects(treated(t), "user_id", "treated", "spent", ["views", "clicks"], "T", "tree"), "T")


@query("cate_distribution")
def cate(t):
    return ca.cate_distribution(ca.learner_effects(treated(t), "user_id", "treated", "spent", ["views", "clicks"], "T", "tree"))


@query("double_ml")
def double_ml(t):
    return ca.double_ml(treated(t), "user_id", "treated", "spent", ["views", "clicks"], 2, "tree")


@query(
    "covariate_balance",
    f"""WITH w AS (SELECT *, CASE WHEN treated = 1 THEN 1 / p ELSE 1 / (1 - p) END AS w FROM {TREATED}),
        l AS (SELECT 'views' AS covariate, views AS x, treated, w FROM w UNION ALL SELECT 'clicks', clicks, treated, w FROM w),
        s AS (SELECT covariate, treated, avg(x) AS m, var_samp(x) AS v, sum(w * x) / sum(w) AS a FROM l GROUP BY 1, 2)
        SELECT t.covariate, round(abs(t.m - c.m) / sqrt((t.v + c.v) / 2), 4) AS smd_before, round(abs(t.a - c.a) / sqrt((t.v + c.v) / 2), 4) AS smd_after,
               abs(t.a - c.a) / sqrt((t.v + c.v) / 2) < 0.1 AS balanced FROM s t JOIN s c ON t.covariate = c.covariate AND t.treated = 1 AND c.treated = 0""",
)
def covariate_balance(t):
    return ca.covariate_balance(treated(t), "treated", ["views", "clicks"], "p")


@query(
    "propensity_histogram",
    f"SELECT least(floor(p * 20), 19)::BIGINT AS bin, count_if(treated = 1)::BIGINT AS treated, count_if(treated = 0)::BIGINT AS control FROM {TREATED} GROUP BY 1",
)
def propensity_histogram(t):
    return ca.propensity_histogram(treated(t), "treated", "p")


@query("calibrate_platt")
def platt(t):
    rows = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p"))
    return ca.calibrate(rows, "y", "p")


@query("calibrate_isotonic")
def isotonic(t):
    rows = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p"))
    return ca.calibrate(rows, "y", "p", "isotonic")


@query("multilabel_relevance")
def relevance(t):
    return ca.multilabel_predict(rated(t), "doc_id", ["quality", "toxic"], DOC)


@query("multilabel_chain")
def chain(t):
    return ca.multilabel_predict(rated(t), "doc_id", ["quality", "toxic"], DOC, "chain")


@query("multilabel_powerset")
def powerset(t):
    return ca.multilabel_predict(rated(t), "doc_id", ["quality", "toxic"], DOC, "powerset")


@query("walk_forward_models")
def walk_forward(t):
    return sm.walk_forward_models(monthly(t))


# --- maps -----------------------------------------------------------------------------------------


def places(t):
    return t.customer.select(
        "c_custkey", (F.col("c_custkey") % 187 - 93).cast("string").alias("lat"), (F.col("c_custkey") % 371 - 185).cast("string").alias("lon"), "c_acctbal"
    )


GEO = """(SELECT c_custkey, (c_custkey % 187 - 93)::DOUBLE AS lat, (c_custkey % 371 - 185)::DOUBLE AS lon, c_acctbal FROM customer
  WHERE abs(c_custkey % 187 - 93) <= 90 AND abs(c_custkey % 371 - 185) <= 180)"""


@query("valid_geo", f"SELECT * FROM {GEO}")
def valid_geo(t):
    return geo.valid_geo(places(t))


@query(
    "geo_points",
    f"""WITH p AS (SELECT * FROM {GEO} WHERE c_custkey % (SELECT ceil(count(*) / 300)::BIGINT FROM {GEO}) = 0)
        SELECT *, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS color FROM p""",
)
def geo_points(t):
    return geo.geo_points(places(t), "lat", "lon", "c_acctbal", "c_custkey", 300).withColumn("color", F.round("color", 6))


@query("geo_center", f"SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM {GEO}")
def geo_center(t):
    return geo.geo_center(places(t), "lat", "lon").withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


# --- step lists -----------------------------------------------------------------------------------


@query(
    "run_steps",
    """WITH a AS (SELECT count(*) AS n FROM orders), f AS (SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000),
            d AS (SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_totalprice > 100000)
       SELECT 'big' AS step, 'success' AS status, a.n AS rows_in, f.n AS rows_out FROM a, f UNION ALL
       SELECT 'log', 'success', f.n, f.n FROM f UNION ALL SELECT 'customers', 'success', f.n, d.n FROM f, d UNION ALL
       SELECT 'oops', 'failed', d.n, NULL FROM d UNION ALL SELECT 'never', 'skipped', NULL, NULL""",
)
def steps(t):
    chain = [
        Step("big", "filter", {"condition": "o_totalprice > 100000"}),
        Step("log", "feature_engineering", {"formulas": {"size": "log(o_totalprice)"}}),
        Step("customers", "deduplicate", {"columns": ["o_custkey"], "order": ["o_orderkey"]}),
        Step("oops", "scaler", {"method": "no such method"}),
        Step("never", "sort", {"columns": ["size"]}),
    ]
    return run_steps(t.orders, chain).log.select("step", "status", "rows_in", "rows_out")


@query(
    "run_step_graph",
    """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), small AS (SELECT * FROM orders WHERE o_totalprice < 50000),
            u AS (SELECT * FROM big UNION ALL SELECT * FROM small), f AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
            g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) = 1)
       SELECT o_custkey, u.o_orderkey, u.o_orderstatus, u.o_totalprice, g.o_totalprice AS cheapest FROM u JOIN g USING (o_custkey)""",
)
def step_graph(t):
    chain = [
        Step("big", "filter", {"condition": "o_totalprice > 200000"}),
        Step("small", "filter", {"condition": "o_totalprice < 50000"}),
        Step("both", "union"),
        Step("done", "filter", {"condition": "o_orderstatus = 'F'"}),
        Step("price", "select_columns", {"columns": ["o_custkey", "o_totalprice"]}),
        Step("one", "deduplicate", {"columns": ["o_custkey"], "order": ["o_totalprice"]}),
        Step("named", "rename", {"names": {"o_totalprice": "cheapest"}}),
        Step("met", "join", {"on": "o_custkey"}),
    ]
    edges = [("big", "both"), ("small", "both"), ("done", "price"), ("price", "one"), ("one", "named"), ("both", "met"), ("named", "met")]
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return run_steps(rows, chain, edges).outputs["met"]


def _template(name: str, source, *args, sql: str | None = None):
    """What the last step of a ready list gives; vectors are left out, lists and numbers are written out."""

    @query(f"template_{name}", sql)
    def run(t):
        made = TEMPLATES[name](*args)
        chain, edges = made if isinstance(made, tuple) else (made, None)
        done = run_steps(source(t), chain, edges)
        if chain[-1].id not in done.outputs:
            raise RuntimeError(f"template {name}: {done.log.filter('error is not null').collect()}")
        out = done.outputs[chain[-1].id]
        return out.select(*[c for c, kind in out.dtypes if kind != "vector"])


PART_NUMBERS = ["p_size", "p_retailprice"]
_template("classification", rated, "quality", "doc_id", DOC[1:], DOC[:1])
_template("regression", priced, "l_extendedprice", "line", NUMBERS[:3], NUMBERS[3:])
_template("clustering", lambda t: t.part, PART_NUMBERS)
_template("anomaly", lambda t: t.part, "p_partkey", PART_NUMBERS)
_template("feature_work", lambda t: t.part, {"unit": "p_retailprice / p_size"}, PART_NUMBERS, ["p_type"])
_template("components", lambda t: t.part, PART_NUMBERS)
_template("credit", rated, "quality", "doc_id", DOC[1:], DOC[:1])
_template("text_classification", lambda t: t.documents.join(t.labels, "doc_id"), "quality", "doc_id", "text")
_template("churn", rated, "quality", "doc_id", DOC[1:], DOC[:1], "n_chars > 50 and lang != null")
_template("series", lambda t: t.events.select("event_id", "ts", "event_type", "value"), "value", ["ts", "event_id"], "event_type")
_template("tuning", rated, "quality", "doc_id", DOC[1:], DOC[:1])
_template("cleaning", lambda t: t.part, "p_partkey", PART_NUMBERS, ["p_type"])


# --- streams: the events table as arriving files ----------------------------------------------------


def arriving(t):
    return jobs.read_stream(t.spark, t.folder, "events.parquet", t.events.schema, "ts")


@query(
    "stream_ab_metrics",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, user_id % 2 AS variant, count(*) AS n, round(avg(value), 4) AS avg_value,
              round(avg((event_type = 'error')::INT), 4) AS error_rate FROM events GROUP BY 1, 2""",
)
def stream_ab(t):
    s = jobs.ab_metrics(arriving(t), "ts", F.col("user_id") % 2, F.col("value"), F.col("event_type") == "error")
    out = jobs.run_updates(s, ["start", "variant"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "variant", "n", F.round("avg_value", 4).alias("avg_value"), F.round("error_rate", 4).alias("error_rate"))


@query(
    "stream_recent_points",
    """SELECT strftime(date_trunc('day', ts) - d * INTERVAL 1 DAY, '%Y-%m-%d') AS start, user_id % 2 AS variant, count(*) AS n, round(avg(value), 4) AS avg_value
       FROM events, (SELECT unnest([0, 1]) AS d) GROUP BY 1, 2""",
)
def stream_recent(t):
    out = jobs.run_updates(jobs.recent_points(arriving(t), "ts", F.col("user_id") % 2, F.col("value")), ["start", "variant"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "variant", "n", F.round("avg_value", 4).alias("avg_value"))


@query(
    "stream_feedback_accuracy",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type AS model, count(*) AS n, round(avg((value >= 5)::INT), 4) AS accuracy FROM events GROUP BY 1, 2""",
)
def stream_feedback(t):
    out = jobs.run_updates(jobs.feedback_accuracy(arriving(t), "ts", F.col("event_type"), F.col("value") >= 5), ["start", "model"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "model", "n", F.round("accuracy", 4).alias("accuracy"))


@query(
    "stream_matched_feedback",
    """WITH p AS (SELECT event_id AS k, event_type AS model, value >= 5 AS guess FROM events WHERE event_id % 3 = 0),
       f AS (SELECT event_id - event_id % 3 AS k, arg_max(value >= 8, ts) AS truth FROM events WHERE event_id % 3 <> 0 GROUP BY 1)
       SELECT model, count(*) AS n, round(avg((guess = truth)::INT), 4) AS accuracy FROM p JOIN f USING (k) GROUP BY 1""",
)
def stream_matched(t):
    k = F.col("event_id") % 3
    changes = jobs.matched_feedback(
        arriving(t).filter(k == 0), arriving(t).filter(k != 0), "ts", F.col("event_id") - k, F.col("event_type"), F.col("value") >= 5, F.col("value") >= 8,
    )
    out = jobs.accuracy_of(jobs.run_available(changes))
    return out.select("model", "n", F.round("accuracy", 4).alias("accuracy"))


@query(
    "stream_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
       r AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 1 HOUR AS b, count(*) AS n, string_agg(event_type, ' ' ORDER BY ts, event_id) AS items FROM s GROUP BY user_id, k)
       SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS "end", n, items FROM r
       WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_sessions(t):
    out = jobs.run_available(jobs.sessions(arriving(t), "ts", "user_id", "event_type", "event_id"))
    text = "yyyy-MM-dd HH:mm:ss"
    return out.select("user_id", F.date_format("start", text).alias("start"), F.date_format("end", text).alias("end"), "n", F.array_join("items", " ").alias("items"))


@query("stream_score")
def stream_score(t):
    rows = t.events.withColumn("hour", F.hour("ts"))
    model = ml.fit(rows, "value", "regression", "tree", ["event_type", "hour"])
    return jobs.run_available(jobs.score_stream(model, arriving(t).withColumn("hour", F.hour("ts"))).select("event_id", "prediction"))


@query(
    "stream_drift",
    """WITH r AS (SELECT value AS v, event_type AS k, ts < TIMESTAMP '2024-01-10' AS base FROM events),
       e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 10 AS s, avg(v) AS m FROM r WHERE base),
       c AS (SELECT v, count_if(base) AS a, count(*) AS b FROM r WHERE v IS NOT NULL GROUP BY 1),
       d AS (SELECT max(abs(fa - fb)) AS d FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM c)),
       s AS (SELECT unnest(range(10)) AS bin), x AS (SELECT least(greatest(floor((v - lo) / s), 0), 9)::BIGINT AS bin, base FROM r, e WHERE v IS NOT NULL),
       p AS (SELECT greatest((SELECT count_if(base) FROM x WHERE x.bin = s.bin) / (SELECT count_if(base) FROM x), 0.0001) AS pa,
                    greatest((SELECT count(*) FROM x WHERE x.bin = s.bin) / (SELECT count(*) FROM x), 0.0001) AS pb FROM s),
       t AS (SELECT k, count_if(base) / (SELECT count_if(base) FROM r WHERE k IS NOT NULL) AS pa, count(*) / (SELECT count(*) FROM r WHERE k IS NOT NULL) AS pb FROM r WHERE k IS NOT NULL GROUP BY 1),
       o AS (SELECT 'value' AS column, (SELECT count(v) FROM r) AS n, round((SELECT d FROM d), 4) AS drift_score, round((SELECT sum((pb - pa) * ln(pb / pa)) FROM p), 4) AS psi,
                    round((SELECT m FROM e), 3) AS original_mean, round((SELECT avg(v) FROM r), 3) AS batch_mean
             UNION ALL SELECT 'event_type', (SELECT count(k) FROM r), round((SELECT sum(abs(pa - pb)) / 2 FROM t), 4), NULL, NULL, NULL)
       SELECT *, drift_score > 0.15 AS drifted, CASE WHEN drift_score > 0.4 THEN 'high' WHEN drift_score > 0.15 THEN 'medium' ELSE 'low' END AS impact FROM o""",
)
def stream_drift(t):
    return jobs.run_drift(arriving(t), t.events.filter("ts < '2024-01-10'"), ["value", "event_type"]).drop("batch")
