"""Sharding and mixing, held against DuckDB and against plain Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

from oreline.llm.mixing import mixed_documents, mixed_sizes, mixing_sql, plan_mix, shard_quotas, source_targets
from oreline.llm.sharding import extendible_shards, extendible_sql

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def twin(sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    return sorted(con.execute(sql).fetchall(), key=str)


@pytest.mark.parametrize("limit", [20_000, 1 << 18])
def test_shards_match_sql(spark, limit):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = rows_of(extendible_shards(docs, "doc_id", "text", limit))
    assert found == twin(extendible_sql(limit)) and len({r[2] for r in found}) > 1


def test_shards_of_one_key_and_of_equal_rows(spark):
    """A key, and rows alike in everything, are split until they fit; a single row over the limit stays alone."""
    rows = [(1, "x" * 10)] * 300 + [(2, f"{i:010d}") for i in range(300)] + [(3, "y" * 500), (None, None), (None, "z")]
    found = extendible_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 100).collect()
    assert len(found) == len(rows)
    sizes = {}
    for r in found:
        sizes.setdefault(r["shard"], []).append(r["bytes"])
    for r in found:
        assert r["shard_bytes"] == sum(sizes[r["shard"]]) and r["shard_rows"] == len(sizes[r["shard"]]) and r["depth"] == len(r["shard"])
    assert all(sum(b) <= 100 or len(b) == 1 for b in sizes.values())
    # No bucket lies inside another one.
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_shards_of_nothing_and_clashing_columns(spark):
    assert extendible_shards(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
    clash = spark.createDataFrame([(1, "ab", "q", 7, 8)], "doc_id bigint, text string, shard string, bytes int, depth int")
    assert [tuple(r) for r in extendible_shards(clash, "doc_id", "text").collect()] == [(1, 2, "", 0, 2, 1)]


@pytest.mark.parametrize("shard_words", [4 << 20, 3000])
def test_mix_matches_sql(spark, shard_words):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert rows_of(mixed_sizes(docs, shard_words=shard_words).drop("source")) == twin(mixing_sql(shard_words=shard_words))


def brute_targets(sizes):
    """The excess of sources above three times their size is shared again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and w and rest * weight[s] / w > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 20}, {"x": 0, "y": 3}, {"k": 5}, {"a": 1, "b": 1, "c": 1, "d": 900, "e": 2, "f": 40}])
def test_targets_by_brute_force(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    found = {r.source: r.target for r in source_targets(df).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def brute_seats(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        won[max(votes, key=lambda s: (votes[s] / (2 * won[s] + 1), -s))] += 1
    return won


def test_quotas_are_the_highest_quotients(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = plan_mix(docs)
    rows = plan.selectExpr("source", "source_size s", "target t", "_blocks n", "_rounds * _blocks + _extra q").distinct().collect()
    order = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    votes = {i: r.t / r.s * r.n for i, r in enumerate(order)}
    seats = brute_seats(votes, round(sum(votes.values())))
    assert [r.q for r in order] == [min(seats[i], 3 * r.n) for i, r in enumerate(order)]


def test_mix_takes_near_targets_and_reruns_agree(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(i, words(40 + i % 7), None, ("hot" if i % 3 else f"s{i % 4}") if i % 11 else None, 0) for i in range(400)] + [(900, None, None, "empty", 0), (901, "", None, "s1", 0), (902, " \t ", None, "s1", 0)]
    rows += [(903, words(30), None, "s2", 0)] * 3  # a repeated row
    docs = spark.createDataFrame(rows, SCHEMA)
    first = mixed_sizes(docs)
    found = rows_of(first)
    assert found == rows_of(mixed_sizes(docs.repartition(7))) and len(found) == len(rows)
    taken, target = {}, {}
    for doc_id, source, size, source_size, t, k in found:
        assert 0 <= k <= 3 * size
        taken[source] = taken.get(source, 0) + k
        target[source] = t
    for s, t in target.items():
        assert abs(taken[s] - t) <= 32
    mix = mixed_documents(docs)
    assert mix.columns == docs.columns
    got = {}
    for r in mix.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {s: k for s, k in taken.items() if k}
    whole = {(r[0], r[1]) for r in rows}
    assert any((r.doc_id, r.text) in whole for r in mix.collect())


def test_mix_takes_whole_documents(spark):
    """Beyond whole rounds, documents are taken whole but for one of each source; before, parts had holes of 16 words."""
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(150 + i % 90)), None, f"s{i % 6}", 0) for i in range(300)]
    text = {r[0]: r[1] for r in rows}
    mix = mixed_documents(spark.createDataFrame(rows, SCHEMA), length="n_chars").collect()
    cut = [r for r in mix if r.text != text[r.doc_id]]
    assert len(cut) <= 6 and len({r.source for r in cut}) == len(cut) < 0.05 * len(mix)
    assert all(text[r.doc_id].startswith(r.text.strip()) for r in cut) and all(r.n_chars == len(r.text) for r in mix)


@pytest.mark.parametrize("shard_words", [30, 700, 4 << 20])
def test_mix_of_thin_sources_in_many_shards(spark, shard_words):
    """A source of about one short document per shard gets its target; before, all streams were rounded the same way."""
    text = lambda i, n: " ".join(f"d{i}w{j}" for j in range(n))
    rows = [(i, text(i, 400), None, "ab"[i % 2], 0) for i in range(12)] + [(100 + i, text(i, 10), None, "c", 0) for i in range(240)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = {r.source: r.target for r in mixed_sizes(docs).collect()}
    got = dict.fromkeys(target, 0)
    for r in mixed_documents(docs, shard_words=shard_words).collect():
        got[r.source] += len(r.text.split())
    assert target["c"] == 900 and all(abs(got[s] - t) < 16 for s, t in target.items())


@pytest.mark.parametrize("shard_words", [2000, 80, 4 << 20])
def test_blocks_of_thin_sources_in_many_shards(spark, shard_words):
    """Two hundred sources of forty short documents: every target is met to a block at 1, 40 and 1,000 shards, with whole quotas."""
    rows = [(s * 40 + i, " ".join(f"w{j}" for j in range(10)), None, f"s{s:03}", 0) for s in range(200) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixed_sizes(docs, shard_words=shard_words).groupBy("source", "target").agg(F.sum("taken").alias("k"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert len(got) == 200 and all(abs(r.k - r.target) <= 16 and r.most <= 3 for r in got)
    plan = plan_mix(docs, shard_words=shard_words)
    whole = {r.source: r.q for r in plan.selectExpr("source", "_rounds * _blocks + _extra q").distinct().collect()}
    quotas = shard_quotas(plan).groupBy("source").agg(F.sum("quota").alias("q")).collect()
    assert {r.source: r.q for r in quotas} == whole


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixed_sizes(docs).count() == 0 and mixed_documents(docs).count() == 0
