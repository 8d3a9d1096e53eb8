"""Tokens of two vocabularies side by side: whitespace anchors cut a document into windows, and windows are aligned once.

Both tokenizers run over the whole text. An end of a token that both share, before tokens that begin with a space, is an
anchor; what lies between two anchors is a window, known by the ids in it. A worker aligns a window once and remembers it,
so most of a corpus is looked up. Within a window a group ends where tokens of both ends, and tokens are linked where bytes overlap.

Documents are worked on in blocks of a few megabytes. A block keeps its distinct windows and id pairs once, and its documents
refer to them by place; the corpus-wide counts of the pairs meet blocks, and not documents.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from oreline.llm.bpe import AT_BLANK, Codec, read_vocabulary
from oreline.llm.common import schema_with, slices
from oreline.session import stage

#: Bytes of text in a block, windows and words that a worker remembers, and tokens of a window that is worth remembering.
BLOCK_BYTES, MOST_KEPT, LONG = 1 << 20, 100_000, 64
#: Longer words go through the linear encoder, as the fast one may run out of stack in them, and are not remembered.
LONG_WORD = 1000
#: A blank between two signs that are none. Neither side has tokens across its left end.
BETWEEN = re.compile(r"(?<=\S) (?=\S)").split


def read_vocabularies(byte_path: str, piece_path: str) -> dict:
    """Both vocabularies, read on the driver: a byte-level one of the tokenizers library (A) and a sentencepiece model (B); a few MB."""
    with open(piece_path, "rb") as f:
        model = f.read()
    tables = read_vocabulary(byte_path)
    return {"name": tables["name"] + hashlib.sha256(model).hexdigest(), "bytes": tables, "pieces": model}


def share_both(spark: SparkSession, byte_path: str, piece_path: str):
    """The vocabularies as a broadcast value; its size is theirs."""
    return spark.sparkContext.broadcast(read_vocabularies(byte_path, piece_path))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Aligner:
    """Tokenizes texts twice and aligns the windows; a worker makes it once."""

    def __init__(self, tables: dict):
        both = tables["bytes"]
        self.tables, self.codec = both, None
        special = set(both["added"].values())
        self.a_bytes = both["tokens"]
        # The fast encoder merges in order of ids, so it serves where ids are in order of merges.
        wholes = [whole for _, _, whole in both["merges"]]
        ranks = {t: i for i, t in enumerate(both["tokens"]) if i not in special}
        in_order = all(x < y for x, y in zip(wholes, wholes[1:])) and sum(len(t) == 1 for t in ranks) == 256
        self.fast = tiktoken.Encoding(both["name"], pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={}) if in_order else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=tables["pieces"])
        spelt = lambda i: bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [spelt(i) for i in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_marked, self.b_marked = (np.array([t[:1] == b" " for t in side]) for side in (self.a_bytes, self.b_bytes))
        # No piece of B goes on beyond a sign into a space, so no merge crosses the left end of a blank between signs.
        self.apart = not any("▁" in self.pieces.id_to_piece(i).lstrip("▁") for i in range(self.pieces.get_piece_size()))
        self.words: tuple[dict, dict] = {}, {}
        self.forget()

    def forget(self) -> None:
        """Start with no remembered windows."""
        self.known: dict[bytes, int] = {}
        self.spelt: list[str] = []
        self.groups = self.first = self.size = self.links = np.zeros(0, np.int64)

    def _linear(self, spaced: str) -> list[int]:
        """The linear encoder, whose tables are made when a long word asks for them."""
        self.codec = self.codec or Codec(self.tables)
        return np.frombuffer(self.codec._plain(spaced), "<u4").tolist()

    def _learn(self, words: list[str]) -> list[tuple[bytes, bytes] | bool]:
        """Packed ids of each word, with a space before it, on both sides; False where the bytes of a side are others."""
        out = []
        for word, b in zip(words, self.pieces.encode(words, num_threads=1)):
            spaced = " " + word
            a = self.fast.encode_ordinary(spaced) if self.fast and len(word) < LONG_WORD else self._linear(spaced)
            fine = b"".join([self.a_bytes[i] for i in a]) == spaced.encode() == b"".join([self.b_bytes[i] for i in b])
            out.append(fine and (array("I", a).tobytes(), array("I", b).tobytes()))
        return out

    def _words(self, text: str) -> list[str]:
        """What is encoded by itself: a blank between two other signs begins a token on both sides, where the vocabulary allows it."""
        if not self.apart:
            return [text] if text else []
        if AT_BLANK(text) or text[:1].isspace() or text[-1:].isspace():
            return BETWEEN(text)
        return text.split(" ") if text else []

    def tokens(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of both sides of each text; none where it is empty or a side's bytes differ from a space and the text."""
        split = [self._words(t) for t in texts]
        young, old = self.words
        known = {w: young.get(w) or old.get(w) for w in set().union(*split)}
        missing = [w for w, found in known.items() if found is None]
        known.update(zip(missing, self._learn(missing)))
        if len(young) > MOST_KEPT:  # the words met since then come in place of those before
            self.words = young, old = {}, young
        young.update((w, found) for w, found in known.items() if found and len(w) < LONG_WORD)
        out = []
        for words in split:
            found = [known[w] for w in words]
            out.append((b"", b"") if False in found else (b"".join([f[0] for f in found]), b"".join([f[1] for f in found])))
        return out

    def windows(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Figures of a block of texts and its windows.

        ``n_a``, ``n_b`` and ``n_windows`` of each text; for all windows in order their place among the block's ``different`` ones; for these, their numbers.
        """
        pairs = self.tokens(texts)
        n_a, n_b = (np.array([len(p[side]) // 4 for p in pairs], np.int64) for side in (0, 1))
        a, b = (np.frombuffer(b"".join([p[side] for p in pairs]), "<u4").astype(np.int64) for side in (0, 1))
        if not len(a):
            none = np.zeros(0, np.int64)
            return {"n_a": n_a, "n_b": n_b, "n_windows": np.zeros(len(texts), np.int64), "place": none, "different": none}
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # Anchors: ends that both sides share before marked tokens. The end of a text is one, as every text begins with a space.
        marked = np.zeros(a_end[-1] + 1, bool)
        marked[a_end[np.append(self.a_marked[a[1:]], True)]] = True
        shared = np.append(self.b_marked[b[1:]], True) & marked[b_end]
        b_to = np.flatnonzero(shared) + 1
        marked[:] = False
        marked[b_end[shared]] = True
        a_to = np.flatnonzero(marked[a_end]) + 1
        a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
        n_windows = np.diff(np.searchsorted(a_to, np.cumsum(n_a), "right"), prepend=0)
        # Windows of one hash are the same if their ids are, which is looked at; if not, each stays by itself.
        a_hash, a_place = _hashes(a, a_from, a_to, 1)
        b_hash, b_place = _hashes(b, b_from, b_to, 2)
        _, first, place = np.unique(a_hash * np.uint64(0x9E3779B97F4A7C15) + b_hash, return_index=True, return_inverse=True)
        like = first[place]
        unlike = (a_to - a_from != (a_to - a_from)[like]) | (b_to - b_from != (b_to - b_from)[like])
        for ids, start, end, at in ((a, a_from, a_to, a_place), (b, b_from, b_to, b_place)):
            of = np.repeat(np.arange(len(like)), end - start)
            other = np.minimum(start[like][of] + at, len(ids) - 1)
            np.logical_or.at(unlike, of[ids != ids[other]], True)
        if unlike.any():
            place[unlike] = len(first) + np.arange(unlike.sum())
            first = np.concatenate([first, np.flatnonzero(unlike)])
        return {"n_a": n_a, "n_b": n_b, "n_windows": n_windows, "place": place, "different": self._numbers(a, b, a_from[first], a_to[first], b_from[first], b_to[first])}

    def _numbers(self, a: np.ndarray, b: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
        """The numbers of windows, known ones by their ids, new ones after they are aligned."""
        # The two sides of a key can't be taken for each other, as ids of B have the top bit set.
        a_key, b_key = a.astype("<u4").tobytes(), (b | 1 << 31).astype("<u4").tobytes()
        keys = [a_key[p:q] + b_key[r:s] for p, q, r, s in zip(*((v * 4).tolist() for v in (a_from, a_to, b_from, b_to)))]
        numbers = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self.spelt) + np.arange(len(new))
            a_size, b_size = (a_to - a_from)[new], (b_to - b_from)[new]
            self._align(a[_runs(a_from[new], a_size)], b[_runs(b_from[new], b_size)], a_size, b_size)
            for i, n, size in zip(new.tolist(), numbers[new].tolist(), (a_size + b_size).tolist()):
                if size <= LONG:
                    self.known[keys[i]] = n
        return numbers

    def _align(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> None:
        """Align windows that lie one after the other, and append their groups and links.

        Between two ends of either side, one after the other, lies one overlap: of the tokens that end there or next.
        """
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = a_end[np.cumsum(a_size) - 1]
        in_a, in_b = np.zeros(a_end[-1] + 1, bool), np.zeros(a_end[-1] + 1, bool)
        in_a[a_end], in_b[b_end] = True, True
        every, both = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        links = a[np.searchsorted(a_end, every)] << 32 | b[np.searchsorted(b_end, every)]
        size = np.diff(np.searchsorted(every, ends, "right"), prepend=0)
        groups = np.diff(np.searchsorted(both, ends, "right"), prepend=0)
        self.first = np.concatenate([self.first, len(self.links) + np.cumsum(size) - size])
        self.links, self.size, self.groups = np.concatenate([self.links, links]), np.concatenate([self.size, size]), np.concatenate([self.groups, groups])
        a_ids, b_ids = list(map(str, a.tolist())), list(map(str, b.tolist()))
        i, j = (np.searchsorted(end, both) + 1 for end in (a_end, b_end))
        i, j = [0, *i.tolist()], [0, *j.tolist()]
        spelt = [
            a_ids[p] + "|" + b_ids[r] if q - p == 1 == s - r else ",".join(a_ids[p:q]) + "|" + ",".join(b_ids[r:s])
            for p, q, r, s in zip(i, i[1:], j, j[1:])
        ]
        at = 0
        for n in groups.tolist():
            self.spelt.append(spelt[at] if n == 1 else ";".join(spelt[at : at + n]))
            at += n

    def texts_groups(self, found: dict[str, np.ndarray]) -> list[str]:
        """Each text's groups, spelt ``a1,a2|b1;a3|b2``."""
        spelt = [self.spelt[n] for n in found["different"].tolist()]
        place, out, at = found["place"].tolist(), [], 0
        for n in found["n_windows"].tolist():
            out.append(";".join([spelt[i] for i in place[at : at + n]]))
            at += n
        return out


def _hashes(ids: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the ids of each run, and each id's place in its run."""
    at = np.arange(len(ids)) - np.repeat(start, end - start)
    mixed = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    powers = np.full(int((end - start).max()), 0x94D049BB133111EB + 2 * seed, np.uint64)
    mixed *= np.multiply.accumulate(powers)[at]
    return np.add.reduceat(mixed, start), at


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``start`` to ``start + size`` of each run, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


_MADE: dict[str, Aligner] = {}


def _aligner(shared) -> Aligner:
    name = shared.value["name"]
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Aligner(shared.value)
    return _MADE[name]


def align_documents(docs: DataFrame, shared, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``groups``: ``array<struct<a: array<int>, b: array<int>>>``, the ids of either side of each group in order.

    Null and empty texts, and those that a tokenizer does not give back byte for byte, have no groups. Rows stay as they are, repeated
    ones too; a column called ``groups`` is replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "groups")]
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def read(spelt: str) -> list[dict]:
        sides = [[list(map(int, side.split(","))) for side in group.split("|")] for group in spelt.split(";")]
        return [{"a": a, "b": b} for a, b in sides]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for part, texts in slices(batches, text):
            if len(aligner.spelt) > MOST_KEPT:
                aligner.forget()
            rows = [read(t) if t else [] for t in aligner.texts_groups(aligner.windows(texts))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(rows, kind)], names=[*keep, "groups"])

    return docs.select(*keep, text).mapInArrow(run, schema_with(docs.select(*keep), "groups array<struct<a: array<int>, b: array<int>>>"))


def _block(aligner: Aligner, texts: list[str]) -> dict[str, list]:
    """What a block of texts keeps: figures and window references per text, its windows' pairs, and its distinct pairs with their counts."""
    if len(aligner.spelt) > MOST_KEPT:
        aligner.forget()
    found = aligner.windows(texts)
    spelt = aligner.texts_groups(found)
    different, place, n_windows = found["different"], found["place"], found["n_windows"]
    # A text refers once to each of its windows, with the times that it has it.
    of = np.repeat(np.arange(len(texts)), n_windows)
    refs, times = np.unique(of * max(1, len(different)) + place, return_counts=True)
    ends = np.searchsorted(refs, (np.arange(len(texts)) + 1) * max(1, len(different)))
    refs %= max(1, len(different))
    sizes, groups = aligner.size[different], aligner.groups[different]
    codes, code_place = np.unique(aligner.links[_runs(aligner.first[different], sizes)], return_inverse=True)
    per_window = np.bincount(place, minlength=len(different))
    totals = np.bincount(code_place, np.repeat(per_window, sizes), len(codes)).astype(np.int64)
    return {
        "n_a": found["n_a"], "n_b": found["n_b"], "n_groups": _sums(groups[refs] * times, ends), "n_links": _sums(sizes[refs] * times, ends),
        "sha": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in spelt],
        "packed": pack_lists([np.diff(ends, prepend=0), refs, times, sizes, code_place]), "pairs": codes, "totals": totals,
    }


def pack_lists(lists: list[np.ndarray]) -> bytes:
    """Lists of numbers below 2**31, byte planes apart so that they pack well."""
    head = np.array([len(v) for v in lists], "<i4").tobytes()
    planes = [np.ascontiguousarray(np.asarray(v).astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for v in lists]
    return zstandard.compress(head + b"".join(planes))


def unpack_lists(packed: bytes, lists: int) -> list[np.ndarray]:
    data = zstandard.decompress(packed)
    sizes, at, out = np.frombuffer(data[: 4 * lists], "<i4").tolist(), 4 * lists, []
    for n in sizes:
        planes = np.frombuffer(data[at : at + 4 * n], np.uint8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view("<i4").astype(np.int64))
        at += 4 * n
    return out


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that end before ``ends``; runs may be empty."""
    running = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
    return np.diff(running[ends], prepend=0)


_LISTS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "sha": "string", "pairs": "bigint", "totals": "bigint"}


def alignment_digests(docs: DataFrame, shared, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A pair of ids counts once for each of its links in the whole corpus; ``n_best`` are the links whose pair has its B id's highest
    count, ``count_sum`` adds the counts up over the row's links. Null and empty texts, and those that a tokenizer does not give back byte
    for byte, have zeros and an empty digest. Repeated rows are rows of their own, and a null key is a key like any other.
    """
    kind = schema_with(docs.select(F.col(key).alias("keys")), "")
    kind = f"block bigint, keys array<{kind.fields[0].dataType.simpleString()}>, packed binary, " + ", ".join(f"{c} array<{t}>" for c, t in _LISTS.items())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, first = _aligner(shared), TaskContext.get().partitionId() << 32
        for n, (part, texts) in enumerate(_gathered(slices(batches, "_text", BLOCK_BYTES))):
            block = _block(aligner, texts)
            lists = [pa.array([block[c]], pa.list_(pa.string() if t == "string" else pa.int64())) for c, t in _LISTS.items()]
            keys = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), part)
            yield pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), keys, pa.array([block["packed"]], pa.binary()), *lists], names=["block", "keys", "packed", *_LISTS])

    blocks = stage(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(align, kind), "alignment-blocks")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("pos", "e")).select("block", "pos", F.col("e.pairs").alias("pair"), F.col("e.totals").alias("n"))
    counts = stage(entries.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    marked = counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    values = entries.select("block", "pos", "pair").join(marked, "pair").groupBy("block").agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"), F.collect_list("best").alias("best"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].values for c in batch.schema.names if c not in ("block", "packed")}
                pos, n, is_best = (row[c].to_numpy(zero_copy_only=False) if row[c] is not None else np.zeros(0, np.int64) for c in ("pos", "n", "best"))
                per_text, refs, times, sizes, pairs = unpack_lists(batch.column("packed")[r].as_py(), 5)
                out = []
                for of in (is_best, n):
                    value = np.zeros(len(pos), np.int64)
                    value[pos] = of
                    per_window = _sums(value[pairs], np.cumsum(sizes))
                    out.append(pa.array(_sums(per_window[refs] * times, np.cumsum(per_text))))
                yield pa.RecordBatch.from_arrays([row["keys"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *out, row["sha"]], names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    joined = blocks.drop("pairs", "totals").join(values, "block", "left")
    schema = schema_with(docs.select(key), "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return joined.mapInArrow(finish, schema)


def _gathered(parts: Iterator[tuple[pa.RecordBatch, list[str]]]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Small parts put together to blocks of about ``BLOCK_BYTES``: their keys and texts."""
    keys, texts, size = [], [], 0
    for part, more in parts:
        n = part.column("_text").nbytes
        if texts and size + n > BLOCK_BYTES:
            yield pa.concat_arrays(keys), texts
            keys, texts, size = [], [], 0
        keys.append(part.column("_key"))
        texts = texts + more
        size += n
    if texts:
        yield pa.concat_arrays(keys), texts
