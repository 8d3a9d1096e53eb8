"""Toxic passages by maximum-scoring segments.

Words score the log-odds of being in a toxic document, with a Dirichlet prior that adds the same few documents of every word, dealt
to the classes by their sizes; a drift is taken off, so that ordinary text scores below 0. The linear-time scan of Ruzzo and Tompa finds all
maximal segments. For clean text the best of n words follows an extreme-value law, ``E = K n exp(-lambda S)``, where lambda solves
``E[exp(lambda s)] = 1`` over clean words and K comes from the mean of the best scores. Segments count by ``-ln E``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oreline.llm.common import held_out, labelled_sample, logistic, schema_with, slices
from oreline.session import stage

WORDS = re.compile(r"[^\W\d_]+").findall
EULER = 0.5772156649015329
_TRIED = np.geomspace(0.02, 40, 100)
#: Letters of the stems that stand beside a word, for languages that join words.
STEMS = range(4, 9)
#: Words whose score a task remembers.
MOST_KEPT = 500_000


def segments(positive: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """Maximal scoring segments ``(first, last, score)`` of a row of words that score ``-drift``, but for those in ``positive``.

    Each kept segment knows the last one before it that begins lower, so that every search passes a segment once.
    """
    first, last, low, high, back = [], [], [], [], []
    gained, seen = 0.0, 0
    for at, score in positive:
        start = gained - drift * (at - seen)
        begin, total = start, start + score
        head, k = at, len(low) - 1
        while True:
            while k >= 0 and low[k] >= begin:
                k = back[k]
            if k < 0 or high[k] >= total:
                break
            begin, head = low[k], first[k]
            for x in (first, last, low, high, back):
                del x[k + 1 :]
            before = back[k]
            for x in (first, last, low, high, back):
                x.pop()
            k = before
        first.append(head)
        last.append(at)
        low.append(begin)
        high.append(total)
        back.append(k)
        gained, seen = start + score, at + 1
    return [(f, e, h - b) for f, e, b, h in zip(first, last, low, high)]


def terms(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


class Lexicon(dict):
    """Scores by word: that of the worst of its terms, remembered. Words that score below 0 have None."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float | None:
        if len(self) >= MOST_KEPT:
            self.clear()
        get = self.scores.get
        self[word] = found = max((s for t in terms(word) if (s := get(t)) is not None), default=None)
        return found


def scored_words(text: str, lexicon: Lexicon) -> tuple[list[tuple[int, float]], int]:
    """Places and scores of the words that score above 0, and the number of words. A word right after itself tells nothing new."""
    words = WORDS(text.lower())
    found = [(i, s) for i, s in enumerate(map(lexicon.__getitem__, words)) if s is not None]
    return [(i, s) for i, s in found if not i or words[i] != words[i - 1]], len(words)


def _evidence(found: list[tuple[int, int, float]], n: int, law: tuple[float, float]) -> list[float]:
    """``-ln E`` of each segment."""
    rate, k = law
    return [rate * s - math.log(k * max(n, 1)) for *_, s in found]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", per_class: int = 20_000, prior: float = 20.0, drift: float = 0.4, most_words: int = 100_000) -> dict:
    """Lexicon, extreme-value law and weights from at most ``per_class`` labelled documents of each class, learning rows only.

    Half of them give the word counts, the other half the law and the logistic fit, so that words met once can't count as
    evidence for the document they come from. Without both classes every score is the share of label 1.
    """
    sample = labelled_sample(labels, label, per_class, key)
    counts = dict(labels.filter(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(F.col(label).cast("int")).count().collect())
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text")).join(F.broadcast(sample), key)
    for_words = F.pmod(F.xxhash64(F.lit("half"), F.col(key)), F.lit(2)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for y, t in zip(part.column("y").to_pylist(), texts):
                seen[y].update({x for w in {*WORDS(t.lower())} for x in terms(w)} | {""})  # the empty word counts documents
            words = [*seen[0].keys() | seen[1].keys()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], names=["word", "clean", "toxic"])

    half = rows.filter(for_words).select("y", "text")
    words = stage(half.mapInArrow(count, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-words")
    whole = words.filter("word = ''").first()
    model = {"share": share}
    if whole is None or not whole.clean or not whole.toxic:
        return model
    # The prior: as many more documents of every word, dealt to the classes as all documents are.
    part = whole.toxic / (whole.toxic + whole.clean)
    odds = lambda n, of, share: (F.col(n) + prior * share) / (of + prior * share)
    score = F.log(odds("toxic", whole.toxic, part) / odds("clean", whole.clean, 1 - part)) - drift
    scored = words.filter("word != ''").select("word", score.alias("s"))
    lexicon = {r.word: r.s for r in scored.filter("s > 0").orderBy(F.desc("s"), "word").limit(most_words).collect()}
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, drift))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, drift = shared.value
        lexicon = Lexicon(scores)
        for part, texts in slices(batches):
            best, sizes, sums, scores = [], [], [], []
            for t in texts:
                positive, n = scored_words(t, lexicon)
                found = segments(positive, drift)
                best.append(max((s for *_, s in found), default=0.0))
                sizes.append(n)
                sums.append(np.exp(np.outer(_TRIED, [s for _, s in positive])).sum(axis=1) + (n - len(positive)) * np.exp(-_TRIED * drift))
                scores.append([s for *_, s in found])
            yield pa.RecordBatch.from_arrays([part.column("draw"), part.column("y"), pa.array(best, pa.float64()), pa.array(sizes, pa.int64()), pa.array([list(x) for x in sums], pa.list_(pa.float64())), pa.array(scores, pa.list_(pa.float64()))], names=["draw", "y", "best", "n", "sums", "scores"])

    # Measured where the texts are; a repeated id can't make the sample larger than its bound.
    measured = rows.filter(~for_words).select(F.md5(F.col(key).cast("string")).alias("draw"), "y", "text").mapInArrow(measure, "draw string, y int, best double, n bigint, sums array<double>, scores array<double>")
    other = stage(measured.orderBy("draw").limit(2 * per_class), "toxic-sample")
    per_size = F.array(*[F.sum(F.col("sums")[i]) for i in range(len(_TRIED))])
    sums = other.filter("y = 0").agg(per_size.alias("sums"), F.sum("n").alias("n")).first()
    if not sums.n:
        return model
    means = np.array(sums.sums) / sums.n
    over = np.flatnonzero(means > 1)
    rate = float(_TRIED[over[0]] if len(over) else _TRIED[-1])
    seen = other.select("y", "best", "n", "scores").collect()
    clean = [rate * r.best - math.log(r.n) for r in seen if not r.y and r.n]
    law = (rate, math.exp(float(np.mean(clean)) - EULER))
    model |= {"lexicon": lexicon, "drift": drift, "law": law}
    y = np.array([r.y for r in seen])
    if len(set(y.tolist())) < 2:
        return {"share": share}
    x = []
    for r in seen:
        worth = [e for e in _evidence([(0, 0, s) for s in r.scores], r.n, law) if e > 0]
        x.append((math.log1p(max(worth)), math.log1p(sum(worth))) if worth else (0.0, 0.0))
    weights = logistic(x, y)
    weights[-1] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return model | {"weights": weights.tolist()}


def toxic_passages(text: str, model: dict, least: float = 0.0) -> list[tuple[int, int, float]]:
    """Significant passages ``(first word, last word, -ln E)`` of a text, in order."""
    if not text or "weights" not in model:
        return []
    positive, n = scored_words(text, Lexicon(model["lexicon"]))
    found = segments(positive, model["drift"])
    return [(a, b, e) for (a, b, _), e in zip(found, _evidence(found, n, model["law"])) if e > least]


def score_toxicity(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the chance of label 1, from the whole text (null: empty), and the number of its toxic ``passages``.

    Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (name, "passages")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lexicon = Lexicon(model.get("lexicon", {}))
        for part, texts in slices(batches, text):
            scores, passages = [], []
            for t in texts:
                if "weights" not in model:
                    scores.append(model["share"])
                    passages.append(0)
                    continue
                positive, n = scored_words(t, lexicon)
                worth = [e for e in _evidence(segments(positive, model["drift"]), n, model["law"]) if e > 0]
                a, b, c = model["weights"]
                z = a * math.log1p(max(worth, default=0.0)) + b * math.log1p(sum(worth)) + c
                scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
                passages.append(len(worth))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(passages, pa.int32())], names=[*keep, name, "passages"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema_with(docs.select(*keep), f"`{name}` double, passages int"))
