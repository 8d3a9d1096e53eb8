"""Quality by compression: a text is good if a dictionary of good texts packs it better than one of bad texts.

Two Zstandard dictionaries are trained on labelled texts with their words shuffled, so that they hold habits of writing and not
passages, which good and bad texts may share. Every piece of a text is packed with both; the difference of the packed
sizes over their sum, and how well the text packs at all, go through a logistic fit on other labelled texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from oreline.llm.common import held_out, labelled_sample, logistic, schema_with, slices

#: Bytes of a piece, so that a dictionary counts throughout a long text.
PIECE = 2048
LEVEL = 3
#: Bytes of a sample for a dictionary.
SAMPLE = 512
WORDS = re.compile(r"\S+\s*").findall


def _pieces(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def _shuffled(text: str, most: int) -> list[bytes]:
    """At most ``most`` pieces of a whole text with its words in an order drawn from its checksum."""
    words = WORDS(text)
    order = np.random.RandomState(zlib.crc32(text.encode())).permutation(len(words))
    data = "".join([words[i] for i in order]).encode()
    return [data[i : i + SAMPLE] for i in range(0, len(data), SAMPLE)][:most]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Packer:
    """Sizes under the good and the bad dictionary."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        trained = lambda d: zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        kinds = [zstandard.ZstdCompressionDict(d, dict_type=trained(d)) for d in dictionaries]
        for k in kinds:
            k.precompute_compress(level=LEVEL)
        self.pack = [zstandard.ZstdCompressor(level=LEVEL, dict_data=k, write_content_size=False, write_dict_id=False).compress for k in kinds]

    def features(self, text: str) -> tuple[float, ...]:
        """Normalised difference and log packing rate, and their squares and product; an empty text has none of either."""
        n = bad = good = 0
        for p in _pieces(text):
            bad, good, n = bad + len(self.pack[0](p)), good + len(self.pack[1](p)), n + len(p)
        if not n:
            return (0.0,) * 5
        d, r = (bad - good) / (bad + good), math.log((bad + good) / 2 / n)
        return d, r, d * d, r * r, d * r


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = 4000, pieces: int = 6000, per_text: int = 3, dictionary_bytes: int = 112_640) -> dict:
    """Dictionaries and weights from at most ``per_class`` labelled documents of each class, learning rows only.

    Half of them give the dictionaries (``pieces`` different samples of each class, ``per_text`` of a text), the other half the logistic fit. The share of
    the classes is counted over all labels. Without both classes every score is the share of label 1.
    """
    sample = labelled_sample(labels, label, per_class, key)
    counts = dict(labels.filter(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(F.col(label).cast("int")).count().collect())
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text")).join(F.broadcast(sample), key)
    for_pieces = F.pmod(F.xxhash64(F.lit("half"), F.col(key)), F.lit(2)) == 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = [(y, p) for y, t in zip(part.column("y").to_pylist(), texts) for p in _shuffled(t, per_text)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], names=["y", "piece"])

    each = rows.filter(for_pieces).select("y", "text").mapInArrow(cut, "y int, piece binary")
    each = each.groupBy("y", F.md5("piece").alias("draw")).agg(F.any_value("piece").alias("piece"))
    samples = [[bytes(r.piece) for r in each.filter(F.col("y") == y).orderBy("draw").limit(pieces).collect()] for y in (0, 1)]
    if not all(samples):
        return {"share": share}
    dictionaries = tuple(_dictionary(s, dictionary_bytes) for s in samples)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(dictionaries)
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([packer.features(t) for t in texts], pa.list_(pa.float64()))], names=["y", "x"])

    other = rows.filter(~for_pieces).orderBy(F.md5(F.col(key).cast("string"))).limit(2 * per_class).select("y", "text").mapInArrow(measure, "y int, x array<double>").collect()
    y, x = np.array([r.y for r in other]), np.array([r.x for r in other], float).reshape(-1, 5)
    if len(set(y.tolist())) < 2:
        return {"share": share}
    weights = logistic(x, y)
    # The sample holds as many of either class; the corpus doesn't.
    weights[-1] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return {"share": share, "dictionaries": dictionaries, "weights": weights.tolist()}


def score_quality(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the chance of label 1, from the whole text (null: empty). A column called ``name`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        packer = Packer(model["dictionaries"]) if "weights" in model else None
        for part, texts in slices(batches, text):
            if packer:
                x = np.array([packer.features(t) for t in texts])
                scores = 1 / (1 + np.exp(-np.clip(x @ np.array(model["weights"][:-1]) + model["weights"][-1], -35, 35)))
            else:
                scores = np.full(len(texts), model["share"])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores)], names=[*keep, name])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema_with(docs.select(*keep), f"`{name}` double"))
