from itertools import combinations

import pytest
from pyspark.sql import functions as F

from oreline.operators import rules as ru, sequences as sq, series as ts, text as tx


def test_text(spark):
    lines = ["O produto é ótimo e excelente", "Adorei o produto, recomendo!", "Produto bom mas entrega lenta", "Produto péssimo", "123 produto 45"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(9, "  ")], "i int, t string")
    docs = tx.tokenize(df, "t")
    assert docs.count() == 5
    top = tx.top_terms(tx.tfidf(docs)).first()
    assert top.term == "produto" and top.tf == 5 and top.df == 5 and top.tfidf == 0.0
    s = tx.sentiment_summary(docs).first()
    assert s.positive > s.negative and s.positive + s.negative + s.neutral == 5
    words = {w for r in docs.collect() for w in r.tokens}
    assert "123" not in words and "mas" not in words and "ótimo" in words


def test_composed_letters(spark):
    df = spark.createDataFrame([("ótimo",), ("ótimo",)], "t string")
    assert [r.tokens for r in tx.tokenize(df, "t").collect()] == [["ótimo"]] * 2


def test_journeys(spark):
    walks = {"a": ["home", "busca", "produto"], "b": ["home", "produto", "compra"], "c": ["home", "produto"], "d": ["home", "busca", "produto", "home"]}
    rows = [(c, i, p) for c, ps in walks.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "cliente string, ordem int, pagina string")
    pairs = {(r.a, r.b): r.support for r in sq.sequence_pairs(df, "cliente", "pagina", "ordem").collect()}
    assert pairs[("home", "produto")] == 1.0
    want = {}
    for ps in walks.values():
        for t in set(combinations(ps, 3)):
            want[t] = want.get(t, 0) + 1
    got = {(r.a, r.b, r.c): r["count"] for r in sq.sequence_triples(df, "cliente", "pagina", "ordem").collect()}
    assert got == {t: c for t, c in want.items() if c >= 2}
    assert sq.sequence_summary(df, "cliente", "pagina", "ordem").first().sequences == 4


def test_rules(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)] * 6 + [(["a", "b"],)] * 2 + [(["c"],)] * 2, "items array<string>")
    r = {(tuple(x.antecedent), x.consequent): x for x in ru.association_rules(df, 0.1, 0.3, 0.0).collect()}
    ab = r[(("a",), "b")]
    assert ab.confidence == 1.0 and ab.support == 0.8 and ab.lift == pytest.approx(1.25) and ab.leverage == pytest.approx(0.16) and ab.conviction is None
    assert r[(("a", "c"), "b")].is_redundant and not ab.is_redundant
    closed = {tuple(x["items"]) for x in ru.closed_itemsets(ru.frequent_itemsets(df, 0.1)).collect()}
    assert closed == {("c",), ("a", "b"), ("a", "b", "c")}
    short = ru.closed_itemsets(ru.frequent_itemsets(df, 0.1, longest=3), 2)  # a,c and b,c have a superset of equal frequency
    assert {tuple(x["items"]) for x in short.collect()} == {("c",), ("a", "b")}


@pytest.fixture(scope="module")
def wave(spark):
    rows = [("s", i, 10 + 0.5 * i + [0, 5, 9, 5, 0, -5, -9][i % 7]) for i in range(60)]
    return ts.prepare_series(spark.createDataFrame(rows, "k string, t int, v double").repartition(5), "v", "t", "k")


def test_series(wave):
    season = ts.seasonality(wave).first()
    assert ts.trend(wave).first().trend == "ascending"
    flat = wave.withColumn("value", F.col("value") - 0.5 * F.col("position"))
    season = ts.seasonality(flat).first()
    assert season.detected and season.period == 7 and season.type == "weekly"
    assert ts.trend(flat).first().trend == "cyclical" and ts.stationarity(flat).first().stationary
    naive = {r.h: r.forecast for r in ts.forecast_values(flat, "seasonal_naive", 9).collect()}
    last = {r.position: r.value for r in flat.collect()}
    assert all(naive[h] == pytest.approx(last[60 - 7 + h % 7]) for h in range(9))
    assert [float(r.next_period) for r in ts.next_periods(wave, 2).orderBy("h").collect()] == [60.0, 61.0]


def plain_holt(v, alpha=0.4, beta=0.15):
    level, tr, fit = v[0], v[1] - v[0], [v[0]]
    for x in v[1:]:
        before = level
        level = alpha * x + (1 - alpha) * (level + tr)
        tr = beta * (level - before) + (1 - beta) * tr
        fit.append(before + tr)
    return fit, level, tr


def test_holt_in_chunks_equals_one_run(spark):
    v = [float((i * 37) % 101) + i * 0.1 for i in range(3000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "t int, v double")
    s = ts.prepare_series(df, "v", "t")
    fit, level, tr = plain_holt(v)
    got = {r.position: r for r in ts.holt(s, chunk=500).collect()}
    assert len(got) == 3000
    assert max(abs(got[i].fitted - fit[i]) for i in range(3000)) < 1e-9
    assert got[2999].level == pytest.approx(level, abs=1e-9) and got[2999].slope == pytest.approx(tr, abs=1e-9)


def test_triples_do_not_multiply_events(spark):
    """An event stays one row however many items its sequence began with; times that are alike, and items before any other."""
    import itertools
    import random

    draw = random.Random(5)
    rows = [(g, draw.choice("abcdef"), draw.randrange(40), n) for g in range(12) for n in range(60)]
    df = spark.createDataFrame(rows, "g int, i string, t int, n int")
    want = {}
    for g in range(12):
        line = [r[1] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[3]))]
        for p in set(itertools.combinations(line, 3)):
            want[p] = want.get(p, 0) + 1
    found = sq.sequence_triples(df, "g", "i", ["t", "n"], 0.5)
    assert {(r.a, r.b, r.c): r["count"] for r in found.collect()} == {p: c for p, c in want.items() if c >= 6}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(firsts" in plan


def test_baskets_read_their_rows_once(spark):
    """What feeds the baskets is made once and written, however often the mining reads them."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = spark.createDataFrame([(i, "abc"[j]) for i in range(40) for j in range(1 + i % 3)], "k int, i string")
    counted = rows.withColumn("i", F.udf(seen, "string")("i"))
    found = ru.frequent_itemsets(ru.baskets(counted, "k", "i", 0.05), 0.05, 2)
    assert {tuple(r["items"]): r.freq for r in found.collect()} == {("a",): 40, ("b",): 26, ("c",): 13, ("a", "b"): 26, ("a", "c"): 13, ("b", "c"): 13}
    assert made.value <= rows.count() * 2  # the filter on items may look at a row once more
