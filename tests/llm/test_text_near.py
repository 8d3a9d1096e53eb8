"""Near-duplicate documents and vectors, components and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from oreline.llm import dedup, embeddings
from oreline.llm.components import connected_components
from oreline.llm.dedup import near_duplicates, shingle_sets, super_minhash, word_hashes
from oreline.llm.embeddings import near_vectors
from oreline.llm.fingerprint import KMER, SIGNS, edited_fingerprints, fingerprint, signs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute(rows, percent=85):
    sets = [(i, plain_set(t)) for i, t in rows if i is not None]
    linked = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 100 * len(a & b) >= percent * len(a | b)]
    return groups({i for i, _ in sets}, linked)


def checked(spark, rows, percent=85):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute(rows, percent)
    found = near_duplicates(docs, percent=percent).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == (expected[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    sizes = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles) for r in found)
    assert sizes == sorted((i if i is not None else -1, len(plain_set(t))) for i, t in rows)


def family(draw, size, words, edits):
    """Near copies of a text, with up to ``edits`` words changed each."""
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(draw.randint(0, edits)):
            copy[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_groups_by_brute_force(spark, monkeypatch):
    """Families near the limit, chains, exact copies, and blocks small enough that large buckets are compared in blocks."""
    monkeypatch.setattr(dedup, "SMALL", 4)
    monkeypatch.setattr(dedup, "BLOCK", 8)
    draw = random.Random(3)
    texts = family(draw, 60, 90, 4) + family(draw, 30, 40, 2) + family(draw, 12, 300, 12)
    texts += [" ".join(f"v{draw.randrange(10**6)}" for _ in range(draw.randint(1, 60))) for _ in range(40)]
    texts += ["One two"] * 3 + ["one TWO", "ONE\ttwo\n", "a b c d e", "A b c d e", "", " \n", "é É", "É é"]
    texts += ["same words here and there again"] * 30
    draw.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(10_000, None), (None, texts[0]), (None, None), (6, texts[2]), (9, texts[20])]
    checked(spark, rows)


def test_other_limit_and_nothing(spark):
    draw = random.Random(4)
    checked(spark, [(i, t) for i, t in enumerate(family(draw, 30, 60, 4))], 80)
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).filter("kept").count() == 2


def test_word_hashes_in_parts():
    text = ("Ab cd\tÉf  " * 50 + "x" * 700 + " " + "y" * 3000).encode()
    whole, parts = word_hashes(text), word_hashes(text, 64)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0]) == 152
    assert len(set(word_hashes(("z" * 600).encode())[0]) | set(word_hashes(("z" * 599 + "q").encode())[0])) == 2


def test_super_minhash_estimates_likeness():
    draw = np.random.RandomState(1)
    a = draw.randint(0, 2**62, 600).astype(np.uint64)
    for share in (0, 150, 450, 600):
        b = np.concatenate([a[:share], draw.randint(0, 2**62, 600 - share).astype(np.uint64)])
        truth = share / (1200 - share)
        assert abs((super_minhash(a, 512) == super_minhash(b, 512)).mean() - truth) < 0.08
    for n in (1, 3, 40, 9000):  # every position gets a rank, whatever the size
        assert super_minhash(draw.randint(0, 2**62, n).astype(np.uint64), 216).max() < np.iinfo(np.uint64).max


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(120)], [(0, i) for i in range(1, 90)], [(5, 9), (9, 5), (7, 9), (2, 3)]])
def test_components(spark, links):
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert found == groups(ids, [p for p in links if p[0] != p[1]])


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    draw = np.random.RandomState(2)
    centres = draw.randn(6, 24)
    x = [centres[i % 6] + draw.randn(24) * (0.05 + 0.3 * (i % 5 == 0)) for i in range(150)] + [draw.randn(24) for _ in range(60)]
    x += [x[0]] * 40 + [x[0] * 3.0, -x[0], np.zeros(24), np.full(24, np.nan), np.full(24, np.inf)]
    rows = [(i * 2, [float(np.float32(v)) for v in e]) for i, e in enumerate(x)]
    rows += [(2001, None), (2002, []), (2003, [1.0, None] + [0.0] * 22), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = {r.vec_id: r for r in near_vectors(df).collect()}
    assert found == {r.vec_id: r for r in near_vectors(df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding")).collect()}
    good = [(i, np.array(e)) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    linked = [(i, j) for k, (i, a) in enumerate(good) for j, b in good[:k] if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95]
    expected = groups({i for i, _ in rows if i is not None}, linked)
    assert len(found) == len(rows)
    for i, _ in rows:
        n = sum(i in p for p in linked) if i is not None else 0
        assert (found[i].n_links, found[i].component_id) == (n, expected.get(i)), i
        assert found[i].kept == (i is None or expected[i] == i)
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_fingerprints_by_brute_force(spark):
    rows = [(i * 2, "".join(random.Random(i).choice("abc de") for _ in range(i * 7 % 90))) for i in range(60)]
    rows += [(3, None), (5, ""), (7, "x" * 10_000), (9, "same"), (11, "same"), (13, "é😀" * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = sorted((i, t or "") for i, t in rows)
    for per_range in (4000, 7):
        found = {r.doc_id: r for r in edited_fingerprints(df, rows_per_range=per_range).collect()}
        assert len(found) == len(rows)
        for k, (i, t) in enumerate(order):
            after, r = order[(k + 1) % len(order)][1], found[i]
            edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited))
            assert r.near_edited == (signs(t) == signs(edited)).mean() and r.near_next == (signs(t) == signs(after)).mean()


def test_fingerprint_edges(spark):
    """One document, repeated keys, null keys, and nothing."""
    run = lambda rows: edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"))
    one = run([(4, "abcdefgh")]).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    assert run([]).count() == 0 and run([(None, "ab"), (None, "abcd")]).count() == 2 and run([(1, "a"), (1, "a"), (1, "b"), (None, "c")]).count() == 4


def test_signs_keep_text_order():
    """The same k-mers in another order are less alike to an order-sensitive sketch, and more alike than other text."""
    draw = random.Random(6)
    a, b, c = ("".join(draw.choice("abcdefgh ") for _ in range(600)) for _ in range(3))
    swapped = (signs(a + b) == signs(b + a)).mean()
    assert (signs(a + b) == signs(a + b)).all() and swapped < 0.95 and swapped > (signs(a + b) == signs(c + c[::-1])).mean()
    assert len(fingerprint("a" * (KMER - 1))) == 8 * SIGNS and fingerprint(None) == fingerprint("")


def test_block_links_join_groups():
    sets = shingle_sets(["a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s t u", "q w e r t y"])
    part = pd.DataFrame({"id": [1, 2, 3], "grp": [1, 2, 3], "shingles": [s.tobytes() for s in sets]})
    assert dedup._joins_groups(part, part, 85) in ([(1, 2)], [(2, 1)])


def test_cosine_just_at_the_limit_and_clashing_columns(spark):
    """19 / 20 is the limit itself and links; a little less doesn't. Other columns may be called as the operator's own."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 0.0]), (2, [19.0, 5.0, 3.0, 2.0, 1.0]), (3, [-19.0, 5.0, 3.0, 2.0, 1.000001]), (4, [-1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id bigint, embedding array<double>, rep string, bucket int, t int")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert found == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]
