"""Profiles from merged sketches, and sentiment with a lexicon of one's own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from oreline.operators import sketches as sk, text as tx


def test_parts_merge_to_the_whole(spark):
    draw = random.Random(2)
    rows = [(i, i % 4, draw.gauss(50, 20) if i % 9 else None, f"v{draw.randrange(3000)}" if i % 7 else " ") for i in range(20_000)]
    df = spark.createDataFrame(rows, "id bigint, file int, x double, c string")
    whole = {r.name: r for r in sk.sketched_profile(sk.column_sketches(df, ["x", "c"])).collect()}
    parts = sk.column_sketches(df.filter("file < 3"), ["x", "c"], "file")
    grown = parts.unionByName(sk.column_sketches(df.filter("file = 3"), ["x", "c"], "file"))  # an append: only its own rows are read
    merged = {r.name: r for r in sk.sketched_profile(grown).collect()}
    for name in ("x", "c"):
        assert [merged[name][k] for k in ("n", "missing", "distinct_values", "min", "max")] == [whole[name][k] for k in ("n", "missing", "distinct_values", "min", "max")]
    again = {r.name: r for r in sk.sketched_profile(sk.merged_sketches(grown)).collect()}
    assert again["c"] == merged["c"] and again["x"].n == merged["x"].n
    x = sorted(r[2] for r in rows if r[2] is not None)
    assert merged["x"].mean == pytest.approx(sum(x) / len(x)) and (merged["x"].n, merged["x"].missing) == (20_000, 20_000 - len(x))
    for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        assert abs(sum(v <= merged["x"][name] for v in x) / len(x) - q) < 0.01
    exact = len({r[3] for r in rows if r[3].strip()})
    assert abs(merged["c"].distinct_values / exact - 1) < 4 * 1.04 / 2 ** (sk.BITS / 2)
    assert merged["c"].missing == sum(not r[3].strip() for r in rows) and merged["c"].median is None


def test_nothing_to_profile(spark):
    df = spark.createDataFrame([], "x double, c string")
    assert sk.sketched_profile(sk.column_sketches(df)).collect() == []
    none = spark.createDataFrame([(None, None), (float("nan"), "")], "x double, c string")
    assert all(r.missing == r.n == 2 and r["min"] is None for r in sk.sketched_profile(sk.column_sketches(none)).collect())


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_lexicon_of_any_size(spark, monkeypatch, limit):
    """A hundred thousand terms, broadcast or not, with terms that contradict themselves, blanks, capitals and NULLs."""
    monkeypatch.setattr(tx, "LEXICON_BYTES", limit)
    draw = random.Random(4)
    terms = [(f" T{i}", 1.0 if i % 3 else -2.0) for i in range(100_000)] + [("both", 1.0), ("both", -1.0), (None, 1.0), ("none", None)]
    docs = [(i, [f"t{draw.randrange(120_000)}" for _ in range(draw.randrange(30))] + ["both", "none", "t1", "t1"][: i % 5]) for i in range(200)] + [(None, ["t3"]), (900, None), (901, [])]
    found = {r.id: (r.n_positive, r.n_negative, r.sentiment) for r in tx.lexicon_sentiment(spark.createDataFrame(docs, "id int, tokens array<string>"), spark.createDataFrame(terms, "term string, polarity double"), "id").collect()}
    assert len(found) == len(docs)
    for i, words in docs:
        numbers = [int(w[1:]) for w in words or [] if w[1:].isdigit()]
        g, b = sum(n < 100_000 and n % 3 != 0 for n in numbers), sum(n < 100_000 and n % 3 == 0 for n in numbers)
        assert found[i] == (g, b, "positive" if g > b else "negative" if b > g else "neutral")


def test_same_rows_as_with_the_words_at_hand(spark):
    docs = spark.createDataFrame([(1, ["bom", "bom", "ruim"]), (2, ["good", "awful", "sad"]), (3, ["x"])], "id int, tokens array<string>")
    lexicon = spark.createDataFrame([(w, 1) for w in tx.POSITIVE] + [(w, -1) for w in tx.NEGATIVE], "term string, polarity int")
    rows = lambda df: sorted(tuple(r) for r in df.drop("tokens").collect())
    assert rows(tx.lexicon_sentiment(docs, lexicon, "id")) == rows(tx.sentiment(docs))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_words_move_at_most_once_to_the_lexicon(spark, monkeypatch, capsys, limit):
    """Words never move by document and term; beside a broadcast lexicon they don't move at all."""
    monkeypatch.setattr(tx, "LEXICON_BYTES", limit)
    docs = spark.createDataFrame([(1, ["a", "b", "a", None]), (1, ["a"]), (2, None), (3, [])], "id int, tokens array<string>")
    out = tx.lexicon_sentiment(docs, spark.createDataFrame([("a", 1), ("b", -1)], "term string, polarity int"), "id")
    assert sorted((r.id, r.n_positive, r.n_negative) for r in out.collect()) == [(1, 3, 1), (1, 3, 1), (2, 0, 0), (3, 0, 0)]
    out.explain()
    plan = capsys.readouterr().out
    moves = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert not any("_key" in m and "_term" in m for m in moves) and any("_term" in m for m in moves) == (limit == 0)
