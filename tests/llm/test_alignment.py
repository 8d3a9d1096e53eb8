"""Cross-tokenizer alignment against a plain walk over the tokens of the public libraries."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from oreline.llm import alignment
from oreline.llm.alignment import Aligner, align_documents, alignment_digests, read_vocabularies, share_both
from oreline.llm.bpe import byte_letters

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

HARD = [
    None, "", " ", "a", "a  b", "  x\n\ny\t z ", "<s> </s> <|endoftext|> <unk> <0x41>", "▁ is a sign", "日本語のテキスト と English", "naïve café — “quoted”… ½ ﬁ", "　wide blank",
    "aaaa" * 900, " " * 2500 + "x", "é combining ​ zero", "😀😀 emoji\r\nline", "12345 678.90 don't we'll I'M", "x" * 40 + "\x00nul", "repeat me", "repeat me",
]


@pytest.fixture(scope="module")
def sides():
    side_a = Tokenizer.from_file(BYTES)
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = byte_letters()

    def tokens(text):
        if not text:
            return [], []
        spaced = " " + text
        a = [(i, bytes(letters[c] for c in side_a.id_to_token(i))) for i in side_a.encode(spaced, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if side_b.is_byte(i) else p.replace("▁", " ").encode()) for i in side_b.encode(text) for p in [side_b.id_to_piece(i)]]
        same = b"".join(x for _, x in a) == b"".join(x for _, x in b) == spaced.encode()
        return (a, b) if same else ([], [])

    return tokens


def plain(tokens, texts):
    """Per text: figures and groups, from all token pairs of which the byte ranges overlap."""
    found, counts = [], Counter()
    for t in texts:
        a, b = tokens(t)
        spans = []
        for side in (a, b):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            spans.append([(i, e - len(x), e) for (i, x), e in zip(side, ends)])
        links, k = [], 0
        for i, s, e in spans[0]:
            while k and spans[1][k - 1][2] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] < e:
                if spans[1][k][2] > s:
                    links.append((i, spans[1][k][0]))
                k += 1
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[[], []] for _ in cuts]
        for at, side in enumerate(spans):
            for i, _, e in side:
                groups[bisect_left(cuts, e)][at].append(i)
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    rows = []
    for n_a, n_b, groups, links in found:
        spelt = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""))
    return rows, [g for _, _, g, _ in found]


def words(draw, n):
    some = ["the", "The", "tokenization", "x1y2", "naïve", "日本", "don't", "…", "running\n", "", "  ", "ﬂow", "Zürich,", "🙂", "antidis", "<s>"]
    return " ".join(draw.choice(some) + draw.choice(["", "ing", "42", "é"]) for _ in range(n))


def checked(spark, sides, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    shared = share_both(spark, BYTES, PIECES)
    expected, groups = plain(sides, texts)
    found = {r[0]: tuple(r)[1:] for r in alignment_digests(docs, shared).collect()}
    assert len(found) == len(texts)
    for i in range(len(texts)):
        assert found[i] == expected[i], (i, texts[i])
    for r in align_documents(docs, shared).collect():
        assert [[list(g.a), list(g.b)] for g in r.groups] == groups[r.doc_id]


def test_equals_a_plain_walk(spark, sides):
    draw = random.Random(5)
    checked(spark, sides, HARD + [words(draw, draw.randrange(1, 60)) for _ in range(150)])


def test_blocks_windows_and_memory_dont_show(spark, sides, monkeypatch):
    """Small blocks, a memory that is cleared all the time, and windows that all share a hash give the same rows."""
    draw = random.Random(6)
    texts = HARD + [words(draw, draw.randrange(1, 40)) for _ in range(60)]
    tables = read_vocabularies(BYTES, PIECES)
    expected, _ = plain(sides, texts)
    whole = alignment._block(Aligner(tables), [t or "" for t in texts])
    assert [tuple(map(int, x)) for x in zip(whole["n_a"], whole["n_b"], whole["n_groups"], whole["n_links"])] == [e[:4] for e in expected]
    monkeypatch.setattr(alignment, "LONG", 0)
    monkeypatch.setattr(alignment, "LONG_WORD", 3)
    monkeypatch.setattr(alignment, "MOST_KEPT", 0)
    monkeypatch.setattr(alignment, "_hashes", lambda ids, start, end, seed: (np.zeros(len(start), np.uint64), np.arange(len(ids)) - np.repeat(start, end - start)))
    alike = Aligner(tables)
    alike.apart = False  # whole texts
    for at in range(0, len(texts), 7):
        part = alignment._block(alike, [t or "" for t in texts[at : at + 7]])
        assert part["sha"] == whole["sha"][at : at + 7]
        assert part["n_links"].tolist() == whole["n_links"][at : at + 7].tolist()


def test_very_long_text(spark, sides):
    draw = random.Random(7)
    checked(spark, sides, [words(draw, 30_000), "ab" * 3_000, None, words(draw, 5)])


def test_empty_table_nulls_and_clashing_columns(spark):
    shared = share_both(spark, BYTES, PIECES)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment_digests(none, shared).collect() == [] and align_documents(none, shared).collect() == []
    rows = [(None, None, 1, 2, "x"), (None, "some text", 1, 2, "x"), (3, "some text", 1, 2, "x"), (3, "some text", 1, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, block int, n_a int, groups string")
    found = sorted(tuple(r) for r in alignment_digests(docs, shared).collect() if r.doc_id)
    assert len(found) == 2 and found[0] == found[1] and found[0][1] == 2
    assert alignment_digests(docs, shared).count() == 4
    aligned = align_documents(docs, shared)
    assert aligned.columns == ["doc_id", "block", "n_a", "groups"] and aligned.count() == 4


def test_packed_lists():
    lists = [np.array([0, 1, 2**31 - 1, 300]), np.zeros(0, np.int64), np.arange(70_000)]
    assert all((a == b).all() for a, b in zip(alignment.unpack_lists(alignment.pack_lists(lists), 3), lists))
