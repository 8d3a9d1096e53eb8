"""Language, toxicity, quality and personal data: held-out accuracy, definitions by brute force, and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from oreline.llm import language, personal, quality, toxicity
from oreline.llm.common import held_out, labelled_sample, logistic
from oreline.llm.language import fit_language, gram_counts, predict_language, temperature
from oreline.llm.personal import KINDS, base_spans, beliefs, find_spans, fit_field, mask_personal, personal_digests
from oreline.llm.quality import fit_quality, score_quality
from oreline.llm.queries import QUERIES
from oreline.llm.toxicity import fit_toxicity, score_toxicity, segments, toxic_passages

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", None), (4, "word " * 30_000, "en"), (4, "word " * 30_000, "en"), (None, "some text", "de")]


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_held_out_is_crc32_modulo_5(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_labelled_sample(spark):
    rows = [(i, i % 2) for i in range(100)] + [(101, None), (None, 1), (102, 0), (102, 1), (103, 7)]
    sample = labelled_sample(spark.createDataFrame(rows, "doc_id bigint, toxic int"), "toxic", 10).collect()
    assert len(sample) == 20 and not {102, 103, None} & {r.doc_id for r in sample}
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)


def test_logistic_fits_separable_and_plain_data():
    draw = np.random.RandomState(0)
    x = draw.randn(500, 2) * [1, 1000] + [0, 5000]
    y = (x[:, 0] + draw.randn(500) > 0).astype(int)
    w = logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert abs(p.mean() - y.mean()) < 1e-6 and 1 < w[0] < 3
    assert np.isfinite(logistic([[0.0], [1.0]], [0, 1])).all()


def test_language_held_out_accuracy(spark):
    docs = read(spark, "documents")
    found = QUERIES["op2_language"](spark, FOLDER)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_with_a_hot_id(spark):
    """An id that a third of all rows share, of all languages, and that comes first in the sample, counts once for each language."""
    docs = read(spark, "documents").select("doc_id", "text", "lang")
    hot = docs.filter(~held_out()).orderBy(F.md5(F.col("doc_id").cast("string"))).first().doc_id
    mixed = docs.withColumn("doc_id", F.when((F.xxhash64("text") % 3 == 0) & ~held_out(), F.lit(hot)).otherwise(F.col("doc_id")))
    model = fit_language(mixed)
    rows = predict_language(docs.filter(held_out() & F.col("lang").isNotNull()), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_never_reads_labels_of_what_it_predicts(spark):
    docs = read(spark, "documents").limit(300)
    other = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    run = lambda d: sorted(map(tuple, predict_language(d, fit_language(d)).select("doc_id", "lang_pred", "score").collect()))
    assert run(docs) == run(other)


def test_language_edges(spark):
    docs = read(spark, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs, per_language=60)
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    found = {(r.doc_id, r.lang): (r.lang_pred, r.score) for r in predict_language(odd, model).collect()}
    assert found[1, "en"] == found[2, "en"] == found[3, None] == ("und", 0.0) and found[None, "de"][0] in model["names"]
    empty = fit_language(docs.limit(0))
    assert {r.lang_pred for r in predict_language(odd, empty).collect()} == {"und"}
    assert predict_language(odd.limit(0), model).count() == 0
    assert fit_language(odd)["names"] in ([], ["en"])


def test_grams_of_parts_and_whole(monkeypatch):
    text = "Grüße aus dem Norden " * 40
    whole = gram_counts(text)
    monkeypatch.setattr(language, "_PART", 50)
    parts = gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert whole[1].sum() == 3 * (len(text) + 2) - 3


def test_temperature_recovers_overconfidence():
    draw = np.random.RandomState(3)
    truth = draw.randn(4000, 3) * 2
    p = np.exp(truth) / np.exp(truth).sum(axis=1, keepdims=True)
    y = np.array([draw.choice(3, p=q) for q in p])
    assert temperature(truth * 4, y) == pytest.approx(4, rel=0.15)


def brute_segments(scores):
    """All maximal segments by their definition: the best segment, then those left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[a : b + 1]), -(b - a), -a) for a in range(len(scores)) for b in range(a, len(scores))))
    a = -best[2]
    b = a - best[1]
    left, right = brute_segments(scores[:a]), brute_segments(scores[b + 1 :])
    return left + [(a, b, best[0])] + [(x + b + 1, y + b + 1, s) for x, y, s in right]


@given(st.lists(st.sampled_from([None, None, 0.75, 1.5, 3.0]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_segments_by_definition(words):
    drift = 0.703125  # no sums tie
    scores = [-drift if w is None else w for w in words]
    found = segments([(i, w) for i, w in enumerate(words) if w is not None], drift)
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in brute_segments(scores)]
    assert [s for *_, s in found] == pytest.approx([s for *_, s in brute_segments(scores)])


def test_toxicity_held_out_accuracy(spark):
    found = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [[r for r in rows if r.toxic == y] for y in (1, 0)]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_edges_and_passages(spark):
    rows = [(i, ("calm words of every day " * 6) + ("vile horrid vile " if i % 3 == 0 else "") + f"end{i % 9}") for i in range(300)]
    docs = spark.createDataFrame(rows + [r[:2] for r in ODD], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(10, 300)] + [(7, None), (None, 1)], "doc_id bigint, toxic int")
    model = fit_toxicity(docs, labels)
    found = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert found[9] > 0.5 > found[8] and 0 <= found[2] < 0.5
    text = "calm words of every day " * 4 + "vile horrid vile and calm words of every day"
    (passage,) = toxic_passages(text, model)
    assert set(text.split()[passage[0] : passage[1] + 1]) <= {"vile", "horrid"} and toxic_passages("", model) == []
    none = fit_toxicity(docs, labels.limit(0))
    assert {r.score for r in score_toxicity(docs, none).collect()} == {0.5}
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_quality_held_out_accuracy(spark):
    found = QUERIES["op10_quality"](spark, "/root/testdata/sf0.1")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [[r for r in rows if r.quality == y] for y in (1, 0)]
    assert sum(r.predicted for r in good) >= 0.99 * len(good) and sum(r.predicted for r in bad) <= 0.08 * len(bad)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark):
    docs = read(spark, "documents").select("doc_id", "text")
    labels = read(spark, "labels")
    model = fit_quality(docs, labels)
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    found = score_quality(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found) and found[0].lang == "en"
    assert {r.score for r in score_quality(odd, fit_quality(docs, labels.filter("quality = 1"))).collect()} != set()
    assert {r.score for r in score_quality(odd, fit_quality(docs.limit(0), labels.limit(0))).collect()} == {0.5}
    few = fit_quality(docs, labels, per_class=4)  # too few to train a dictionary on
    assert all(0 <= r.score <= 1 for r in score_quality(odd, few).collect())
    assert quality._shuffled("a b c " * 500, 3) == quality._shuffled("a b c " * 500, 3) and len(quality._shuffled("x" * 9000, 3)) == 3


# The patterns as the contract states them.
PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 13 <= len(d) <= 19 and personal.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((k, *m.span()))
    return out


@given(st.text(alphabet="a.b@c-d+1 23(4)5.6_%\n7890é", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_of_any_text(text):
    assert base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1.2." * 50_000, "a@" * 60_000, "+1" + " " * 200_000, "1 " * 100_000])
def test_base_spans_of_long_runs(text):
    assert isinstance(base_spans(text), list) and isinstance(personal.tokens(text), list)


def test_personal_digests(spark):
    docs = read(spark, "documents")
    model = fit_field(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in personal_digests(docs, model).collect():
        spans = plain_spans(texts[r.doc_id])
        spelt = [f"{KINDS[k]}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(spelt).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert set(spelt) <= set(filter(None, r.spans.split(",")))
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string, base string")
    assert {r.spans for r in personal_digests(odd, model).collect()} == {""}
    assert personal_digests(docs.limit(0), fit_field(docs.limit(0))).count() == 0


def test_field_finds_what_the_patterns_swallow(spark):
    """A phone number right before a card number: both patterns run over their length, and the field gives both back."""
    model = fit_field(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    text = "the call +1 (555) 555-0142 4539578763621486 and more text"
    base, added = find_spans(text, model)
    assert base == [] and {(KINDS[k], text[a:b]) for k, a, b in added} == {("phone", "+1 (555) 555-0142"), ("card", "4539578763621486")}
    clean = "In 1987 the 3 houses cost 120 or 1,250.75 each, version 2.0 of page 12-14, build a3f9c2."
    assert find_spans(clean, model) == ([], [])


def test_tokens_of_runs_without_blanks():
    """Runs are cut at signs that no kind uses and at base spans; before, a run was one token, held if any base span touched it."""
    text = "x" * 300 + ',"1987",a.b@c.de;电话13800138000号，4539578763621486/77'
    base = base_spans(text)
    found = personal.tokens(text, base)
    assert [text[a:b] for a, b, *_ in found] == ["1987", "a.b@c.de", "13800138000", "4539578763621486", "77"]
    assert personal.base_labels(found, base) == [0, 1, 0, 3, 0]
    assert [(a, b) for a, b, *_ in personal.tokens("1.2.3.4.555", [(1, 0, 7)])] == [(0, 7), (8, 11)]
    far = personal.token_features("9" * 200 + "7", [(0, 201, "", "")]), personal.token_features("9" * 200 + "a", [(0, 201, "", "")])
    assert far[0] != far[1]


def test_field_reads_runs_without_blanks(spark):
    """A swallowed pair of numbers after a base span of the same run is found and masked."""
    model = fit_field(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    text = "a.b@c.de," + "field," * 50 + "+1 (555) 555-0142 4539578763621486,end"
    base, added = find_spans(text, model)
    assert len(base) == 1 and {(KINDS[k], text[a:b]) for k, a, b in added} == {("phone", "+1 (555) 555-0142"), ("card", "4539578763621486")}


def test_fit_spreads_over_long_texts(spark):
    """The field learns from the end of a long text too; before, only its first thousand tokens counted."""
    links = [(i, i + 1, 0) for i in range(4999)] + [(3, 4997, 1)]
    few = personal.spread(5000, links, 1000)
    assert len(few) <= 1000 and few[-1] > 4900 and len({i // 500 for i in few}) == 10 and personal.spread(9, [], 10) == list(range(9))
    assert {0, 3} <= set(personal.spread(5000, [(0, 3, 1)], 1000))
    text = "7 " * 3000 + "a.b@c.de " * 1000
    assert fit_field(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))["pair"].any()


def test_beliefs_match_enumeration_on_a_tree():
    draw = np.random.RandomState(5)
    node, pair = draw.randn(4, 5), draw.randn(2, 5, 5)
    links, fixed = [(0, 1, 0), (1, 2, 1), (1, 3, 0)], [0, 0, 2, 0]
    total = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        if labels[2] == 2:
            score = sum(node[i, y] for i, y in enumerate(labels) if i != 2) + sum(pair[k, labels[i], labels[j]] for i, j, k in links)
            for i, y in enumerate(labels):
                total[i, y] += np.exp(score)
    assert beliefs(node, pair, links, fixed) == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=2e-3)


def test_skip_links_join_distant_tokens_alike():
    text = "A7-1 " + "word " * 60 + "a71. " + "word " * 60 + "0049123456789 and 123456789"
    found = personal.tokens(text)
    assert {(i, j) for i, j, kind in personal.edges(text, found) if kind == 1} == {(0, 1), (2, 3)}


def test_mask(spark):
    model = fit_field(read(spark, "documents"))
    rows = [(1, "write to a.b@c.de or 10.0.0.1", 0), (2, None, 5), (3, "", 0), (4, "nothing here", 0)]
    out = {r.doc_id: (r.text, r.n_chars) for r in mask_personal(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint"), model, length="n_chars").collect()}
    assert out == {1: ("write to <email> or <ip>", 24), 2: (None, None), 3: ("", 0), 4: ("nothing here", 12)}


def test_queries_are_registered_once():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
    assert toxicity.terms("abcdef") == ["abcdef", "abcd*", "abcde*"]


def test_smallest_draws(spark):
    from oreline.llm.common import hash60, smallest

    rows = spark.range(5000).select(hash60(F.col("id").cast("string")).alias("draw"), "id")
    every = sorted(map(tuple, rows.collect()))
    for n in (5, 300, 4000, 9000):
        assert sorted(map(tuple, smallest(rows.unionByName(rows), "draw", n).collect())) == every[:n]
    assert smallest(rows.limit(0), "draw", 5).count() == 0
