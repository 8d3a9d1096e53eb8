"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token at every place of a piece in one pass. The encoder
takes the longest one that is compatible with the token before it, and steps back to a shorter prefix where it must.
Two neighbours are compatible if the merges, undone from the latest to the first, never show a pair across their border
that would have been merged earlier; answers are kept in a table. A place once found dead is never entered again, so
the work is linear, and the one token row whose neighbours are all compatible is the one that the merges give.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from oreline.llm.common import schema_with, slices

#: Entries that a worker's tables of known answers hold. They only save time.
MOST_KEPT = 300_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself where printable, else the next letter from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_pattern() -> str:
    """The split before the merges, with letters, numbers and blanks spelt out, as the fast ``re`` module knows no categories."""

    def spelt(category: str) -> str:
        inside = regex.compile(category)
        found = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and inside.match(chr(c))]
        runs, begin = [], None
        for c, after in zip(found, [*found[1:], -1]):
            begin = c if begin is None else begin
            if after != c + 1:
                runs.append(f"\\U{begin:08x}-\\U{c:08x}")
                begin = None
        return "".join(runs)

    letter, number, blank = spelt(r"\p{L}"), spelt(r"\p{N}"), spelt(r"\s")
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


def read_vocabulary(path: str) -> dict:
    """Tables of a byte-level vocabulary file of the tokenizers library, read on the driver; about 2 MB."""
    with open(path, "rb") as f:
        data = f.read()
    whole = json.loads(data)
    letters, vocab = byte_letters(), whole["model"]["vocab"]
    spelt = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
    added = {t["content"]: t["id"] for t in whole["added_tokens"]}
    spelt |= {i: t.encode() for t, i in added.items()}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
    return {
        "name": hashlib.sha256(data).hexdigest(),
        "tokens": [spelt[i] for i in range(max(spelt) + 1)],
        "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges],
        "added": added,
        "pattern": split_pattern(),
    }


#: Finds a blank beside other white space.
AT_BLANK = re.compile(r" (?:(?=\s)|(?<=\s ))").search


class Recent:
    """What was met lately: a young and an old table; a full young one becomes the old one."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= MOST_KEPT // 2:
            self.old = dict(self.young)
            self.young.clear()
        self.young[key] = value


class Codec:
    """Encoder and decoder of one vocabulary; a worker makes it once."""

    def __init__(self, tables: dict):
        tokens, n = tables["tokens"], len(tables["tokens"])
        self.size, self.rank, self.left, self.right = [len(t) for t in tokens], [-1] * n, [0] * n, [0] * n
        self.pairs: dict[tuple[int, int], int] = {}
        for place, (a, b, whole) in enumerate(tables["merges"]):
            self.pairs[a, b] = place
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = place, a, b
        self.added = tables["added"]
        plain = {t.decode("latin-1"): i for i, t in enumerate(tokens) if i not in self.added.values()}
        self.shorter = [-1] * n
        self.automaton = ahocorasick.Automaton()
        for t, i in plain.items():
            self.automaton.add_word(t, (i, len(t)))
            self.shorter[i] = next((plain[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in plain), -1)
        self.automaton.make_automaton()
        self.split = re.compile(tables["pattern"]).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.packed = [i.to_bytes(4, "little") for i in range(n)]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array(self.size, np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.known: dict[int, bool] = {}
        self.known_units = Recent()

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between ``a`` and ``b`` alone."""
        key = a << 32 | b
        answer = self.known.get(key)
        if answer is None:
            rank, limit, answer = self.rank, len(self.pairs) + 1, True
            while True:
                place = self.pairs.get((a, b))
                if place is not None and place < limit:
                    answer = False
                    break
                if rank[a] > rank[b]:
                    limit, a = rank[a], self.right[a]
                elif rank[b] >= 0:
                    limit, b = rank[b] + 1, self.left[b]
                else:
                    break
            if len(self.known) >= MOST_KEPT:
                self.known.clear()
            self.known[key] = answer
        return answer

    def encode_piece(self, piece: str) -> list[int]:
        """Tokens of a piece that the split gave."""
        s = piece if piece.isascii() else piece.encode().decode("latin-1")
        longest = [0] * len(s)
        for end, (token, n) in self.automaton.iter(s):
            longest[end - n + 1] = token
        size, shorter, compatible = self.size, self.shorter, self.compatible
        row: list[int] = []
        dead, at, token = bytearray(len(s) + 1), 0, longest[0]
        while True:
            end = at + size[token]
            if not dead[end] and (not row or compatible(row[-1], token)):
                row.append(token)
                if end == len(s):
                    return row
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                last = row.pop()
                at, token = at - size[last], shorter[last]

    def _unit(self, unit: str) -> bytes:
        found = self.known_units.get(unit)
        if found is None:
            pieces = self.split(unit)
            if len(pieces) > 1:
                found = b"".join(map(self._unit, pieces))
            else:
                found = b"".join([self.packed[t] for t in self.encode_piece(unit)])
            if len(unit) < 64:
                self.known_units.put(unit, found)
        return found

    def _plain(self, text: str) -> bytes:
        # A blank between two non-blanks always begins a piece, so what lies between such blanks can be encoded by itself.
        words = text.split(" ")
        if AT_BLANK(text):
            joined, run = [], words[:1]
            for w in words[1:]:
                if not w or w[0].isspace() or not run[-1] or run[-1][-1].isspace():
                    run.append(w)
                else:
                    joined.append(" ".join(run))
                    run = [w]
            words = [*joined, " ".join(run)]
        out = [self._unit(words[0])] if words[0] else []
        known, unit_of = self.known_units.young, self._unit
        for w in words[1:]:
            w = " " + w
            out.append(known.get(w) or unit_of(w))
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """Tokens as little-endian unsigned 32-bit numbers."""
        if not self.cut or not any(t in text for t in self.added):
            return self._plain(text) if text else b""
        return b"".join(self.packed[self.added[part]] if part in self.added else self._plain(part) for part in self.cut(text) if part)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, tokens: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered through the offset table."""
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.blob[np.repeat(self.offsets[tokens] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, tokens) -> str:
        return self.decode_bytes(np.asarray(tokens, np.int64)).decode("utf-8", "replace")


_MADE: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The codec of a worker, which keeps it for its next tasks."""
    name = shared.value["name"]
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Codec(shared.value)
    return _MADE[name]


def share(spark: SparkSession, path: str):
    """The vocabulary as a broadcast value; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode_documents(docs: DataFrame, shared, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and ``ids``. Null and empty texts have none. Rows and their order stay as they
    are, repeated ones too; columns called ``n_tokens`` or ``ids`` are replaced."""
    keep = [c for c in docs.columns if c not in (text, "n_tokens", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for part, texts in slices(batches, text):
            rows = [np.frombuffer(codec.encode_packed(t), "<u4").astype(np.int32) for t in texts]
            sizes = np.array([len(r) for r in rows], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(sizes), ids], names=[*keep, "n_tokens", "ids"])

    schema = schema_with(docs.select(*keep), "n_tokens bigint, ids array<int>")
    return docs.select(*keep, text).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, shared, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the tokens of ``ids`` turned back into ``text``; null counts as no token."""
    keep = [c for c in encoded.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [codec.decode(x or []) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text])

    return encoded.select(*keep, ids).mapInArrow(run, schema_with(encoded.select(*keep), f"`{text}` string"))


def digests(docs: DataFrame, shared, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, n_tokens``, SHA-256 of the tokens as little-endian 32-bit numbers, and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for part, texts in slices(batches, text):
            counts, ids, back = [], [], []
            for t in texts:
                packed = codec.encode_packed(t)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(codec.decode(np.frombuffer(packed, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(counts, pa.int64()), pa.array(ids), pa.array(back)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = schema_with(docs.select(key), "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return docs.select(key, text).mapInArrow(run, schema)
