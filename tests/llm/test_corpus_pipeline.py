"""The pipeline, stage by stage, on rows with planted cases."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from oreline.llm.mixing import mixed_sizes

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with copies, personal data, nulls and repeated rows; after each stage its rows are written and read again."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    draw = random.Random(9)
    words = [w for r in docs.filter("lang = 'en'").orderBy("doc_id").limit(40).collect() for w in r.text.split()]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base = text(200)
    rows = [(9000, base, "en", "src1", 1), (9001, base, "en", "src2", 1), (9002, base + " " + text(3), "en", "src1", 1), (9003, text(80) + " mail me.too@example.org now", "en", "src3", 1)]
    rows += [(9004, None, "en", None, None), (9005, "", None, "src1", 0), (9006, "short", "en", "src9", 5), (9003, rows[3][1], "en", "src3", 1), (None, text(30), "en", "src1", 3)]
    whole = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("n", F.lit(1)).drop("n")
    out, folder = [whole], tmp_path_factory.mktemp("stages")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def test_stages_keep_the_columns(planted):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal", "mixing", "bpe"]
    assert all(df.columns == planted[0].columns for df in planted[:-1])


def test_quality_keeps_clean_documents(spark, planted):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    seen, kept = planted[0].join(labels, "doc_id"), planted[1].join(labels, "doc_id")
    count = lambda df, y: df.filter(F.col("quality") == y).count()
    assert count(kept, 1) >= 0.98 * count(seen, 1) and count(kept, 0) <= 0.3 * count(seen, 0)


def test_one_of_each_group_stays(planted):
    before, after = ({r.doc_id for r in df.collect()} for df in planted[1:3])
    assert {9000, 9001, 9002} & after == {9000} or not {9000, 9001, 9002} & before
    assert planted[2].groupBy("doc_id").count().filter("count > 1").count() == 0 and (None in before) == (None in after)


def test_rows_that_share_an_id_stay(spark):
    """Unlike texts of one id all stay; before, only the smallest one did, and a shared id chained its copies' groups."""
    text = lambda k, n=40: " ".join(f"t{k}w{j}" for j in range(n))
    rows = [(7, text(k)) for k in range(5)] + [(7, text(0)), (7, None), (7, ""), (8, text(1) + " more"), (9, text(2)), (3, text(3)), (None, text(4)), (None, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()), key=str)
    assert found == sorted([(7, text(k)) for k in (0, 1, 2, 4)] + [(7, None), (7, ""), (3, text(3)), (None, text(4)), (None, text(6))], key=str)


def test_personal_data_is_gone(planted):
    texts = [r.text for r in planted[3].collect() if r.text]
    assert not any("me.too@example.org" in t for t in texts) and planted[3].count() == planted[2].count()
    assert planted[3].filter("n_chars != length(text)").count() == 0


def test_mix_and_tokens(planted):
    taken = {r.source: r.k for r in mixed_sizes(planted[3]).groupBy("source").agg(F.sum("taken").alias("k")).collect() if r.k}
    got = {}
    for r in planted[4].collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert set(got) == set(taken) and sum(got.values()) == pytest.approx(sum(taken.values()), rel=0.01)
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted((r.doc_id or -1, r.text) for r in planted[4].collect())
    tokens = sorted((r.doc_id or -1, theirs.decode(r.ids)) for r in planted[5].collect())
    assert texts == tokens and planted[5].filter("n_tokens != size(ids)").count() == 0


def test_run_over_the_smallest_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").filter("n_tokens > 0").count() > 50
