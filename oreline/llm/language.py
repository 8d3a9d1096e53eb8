"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

One to three letters are hashed to ``BUCKETS`` places. Document frequencies are counted over all learning documents; the weights
are fitted to a bounded sample per language by follow-the-regularised-leader with elastic-net penalties, one step per
document and a rate of its own for every weight, which leaves most weights at 0. A part of the sample is kept from the fit
and sets the temperature of the chances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from oreline.llm.common import held_out, schema_with, slices

BUCKETS = 1 << 16
UNKNOWN = "und"
_PART = 1 << 20


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the n-grams of a whole text, read in parts that overlap by two letters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    total = None
    for at in range(0, len(codes), _PART):
        c = codes[max(0, at - 2) : at + _PART]
        new = min(at, 2)
        found = []
        for n, key in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
            if len(c) < n:
                continue
            h = c[: len(c) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ c[k : len(c) - n + 1 + k]
            h = h[max(0, new - n + 1) :] * np.uint32(key)
            h ^= h >> np.uint32(15)
            found.append((h * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64))
        counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
        total = counts if total is None else total + counts
    places = np.flatnonzero(total)
    return places, total[places]


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and TF-IDF values of length 1."""
    places, counts = gram_counts(text)
    values = (1 + np.log(counts)) * idf[places]
    size = math.sqrt(float(values @ values))
    return places, values / size if size else values


def fit_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, rounds: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 0) -> np.ndarray:
    """Weights ``(BUCKETS + 1, classes)`` by FTRL-proximal; the last row is the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    draw = np.random.RandomState(seed)
    for _ in range(rounds):
        for i in draw.permutation(len(rows)):
            places, values, y = rows[i]
            places, values = np.append(places, BUCKETS), np.append(values, 1.0)
            zi, ni = z[places], n[places]
            w = weights(zi, ni)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = values[:, None] * p
            z[places] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[places] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits that makes the labels likeliest, by golden section on its logarithm."""

    def loss(t):
        x = logits / math.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]))

    low, high, g = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit_language(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", per_language: int = 500) -> dict:
    """Names, document frequencies, weights and temperature.

    Learning documents are those not held out with label and text. Frequencies cover all of them; the fit, at most
    ``per_language`` different ids of each language, those of smallest MD5; an id with many rows counts once, by its smallest text, however
    many rows it has. Without any, there are no names.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("id"), F.col(label).alias("lang"), F.col(text).alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for _, texts in slices(batches):
            for t in texts:
                seen[gram_counts(t)[0]] += 1
                n += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], names=["place", "n"])

    found = rows.select("text").mapInArrow(frequencies, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    count = {r.place: r.n for r in found}
    total = count.pop(-1, 0)
    if not total:
        return {"names": []}
    idf = np.full(BUCKETS, math.log(1 + total) + 1)
    for place, n in count.items():
        idf[place] = math.log((1 + total) / (1 + n)) + 1
    draw = W.partitionBy("lang").orderBy(F.md5(F.col("id").cast("string")), "id")
    ids = rows.select("id", "lang").distinct().withColumn("r", F.row_number().over(draw)).filter(F.col("r") <= per_language).select("id", "lang", "r")
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            both = [weighted(t, shared.value) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("r"), pa.array([p for p, _ in both], pa.list_(pa.int64())), pa.array([v for _, v in both], pa.list_(pa.float64()))], names=["lang", "r", "places", "values"])

    # A repeated id with several texts gives a row for each; one of them is enough.
    # The ids are fewer than the weights, which every task gets too, so they are sent to the texts and not the texts to them.
    chosen = rows.join(F.broadcast(ids), ["id", "lang"]).groupBy("lang", "r").agg(F.min("text").alias("text"))
    sample = chosen.mapInArrow(vectors, "lang string, r int, places array<bigint>, values array<double>").collect()
    sample.sort(key=lambda r: (r.lang, r.r))
    names = sorted({r.lang for r in sample})
    at = {x: i for i, x in enumerate(names)}
    data = [(np.array(r.places), np.array(r["values"]), at[r.lang]) for r in sample]
    # The first of each language is always fitted; every fifth is kept for the temperature.
    kept = [r.r % 5 == 0 for r in sample]
    weights = fit_leader([d for d, k in zip(data, kept) if not k], len(names))
    aside = [d for d, k in zip(data, kept) if k]
    heat = 1.0
    if aside and len(names) > 1:
        logits = np.array([np.append(v, 1.0) @ weights[np.append(p, BUCKETS)] for p, v, _ in aside])
        heat = temperature(logits, np.array([y for *_, y in aside]))
    return {"names": names, "idf": idf, "weights": weights, "temperature": heat}


def predict_language(docs: DataFrame, model: dict, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the likeliest language of the whole text and its calibrated chance; ``und`` and 0 for texts that are null or
    have no letter, and for all if nothing was learned. Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (name, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in slices(batches, text):
            names, scores = [], []
            for t in texts:
                if not model["names"] or not any(map(str.isalpha, t)):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                places, values = weighted(t, model["idf"])
                logits = (values @ model["weights"][places] + model["weights"][BUCKETS]) / model["temperature"]
                p = np.exp(logits - logits.max())
                best = int(p.argmax())
                names.append(model["names"][best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, name, score])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema_with(docs.select(*keep), f"`{name}` string, `{score}` double"))
