"""Personal data by a skip-chain conditional random field.

Plain patterns give base spans. The field labels the tokens of a document that hold a digit or an ``@`` (the others can't be personal
data of these kinds and only serve as context): ``none, email, ip, card, phone``. Its factors are

* a token's shape, length, edge signs, borders and neighbours' shapes,
* a chain factor between tokens that stand side by side,
* a skip factor between tokens, however far apart, whose digits or letters are the same or nearly so.

Weights are fitted to the base spans of a bounded sample by pseudo-likelihood, where each label is predicted from the
token's features and the labels around it. Tokens in matches that ran over their kind's length are left out of the fit. In a document, loopy belief propagation passes messages along chain and skip edges until
beliefs settle; base labels are held fixed. Tokens whose belief in a kind is high enough become added spans of that kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oreline.llm.common import hash60, schema_with, slices, smallest

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
BUCKETS = 1 << 12
#: Least belief of an added span.
SURE = 0.9
ROUNDS, DAMPING = 12, 0.3

# The base patterns. Possessive parts and the digit before an address change no match, but no text can make them slow.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"[0-9@]")
#: Signs of a token: letters, digits and what the kinds use, but not the letters of scripts without blanks.
_PART = re.compile(r"(?:(?![\u0e00-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])[\w.%+@()-])+")
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each ``@`` outwards, so that a long run without one costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if done <= start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of all base matches, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def swallowed(text: str) -> list[tuple[int, int]]:
    """Matches that fail because they run over the most digits of their kind: what they hold is unknown, not clean."""
    found = [m.span() for p, most in ((_CARD, 19), (_PHONE, 15)) for m in p.finditer(text) if len(_digits(m[0])) > most]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def tokens(text: str, spans: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, str, str]]:
    """Tokens with a digit or ``@``: ``(start, end, word before, word after)``, without signs at their edges.

    Runs are cut at blanks, at signs that no kind uses and at letters of scripts without blanks, and where one of ``spans`` starts or ends.
    """
    cuts = sorted({x for _, a, b in spans for x in (a, b)})
    places, done = [], 0
    for m in _TOKEN.finditer(text):
        at = m.start()
        if at < done:
            continue
        start = at
        while start > done and _PART.match(text[start - 1]):
            start -= 1
        end = done = _PART.match(text, at).end()
        inner = cuts[bisect_right(cuts, start) : bisect_left(cuts, end)]
        for start, end in zip([start, *inner], [*inner, end]):
            digit = _TOKEN.search(text, start, end)
            if not digit:
                continue
            a, b, at = start, end, digit.start()
            while a < at and text[a] in _EDGE:
                a += 1
            while b > at + 1 and text[b - 1] in _EDGE and text[b - 1] != ")":
                b -= 1
            if text[b - 1] == ")" and "(" not in text[start:b]:
                b -= 1
            if "(" in text[start:a]:
                a = start + text[start:a].rindex("(")
            places.append((a, b))
    out = []
    for i, (a, b) in enumerate(places):
        # Between the tokens beside it, so that a long text is read twice at most.
        before = text[places[i - 1][0] if i else 0 : a].rsplit(None, 1)
        after = text[b : places[i + 1][1] if i + 1 < len(places) else len(text)].split(None, 1)
        out.append((a, b, before[-1] if before else "", after[0] if after else ""))
    return out


def _shape(s: str) -> str:
    """Letters as ``a`` and digits as ``9``; runs of over two signs alike are shortened, with the length of digit runs kept."""
    s = re.sub(r"[^\W\d_]+", "a", s)
    return re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}" if len(m[0]) > 4 else "9" * len(m[0]), s)


@lru_cache(200_000)
def _place(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=4).digest(), "little") % BUCKETS


def _border(text: str, at: int) -> str:
    """The sign at a token's border: a blank at blanks and ends, one letter for all letters."""
    c = text[at : at + 1] if at >= 0 else ""
    return " " if not c or c.isspace() else "a" if c.isalnum() else c


def token_features(text: str, found: list[tuple[int, int, str, str]]) -> list[list[int]]:
    """Hashed features of each token."""
    shapes = [_shape(text[a:b]) for a, b, *_ in found]
    out = []
    for i, (a, b, before, after) in enumerate(found):
        s, n = text[a:b], len(_digits(text[a:b]))
        left = shapes[i - 1] if i and a - found[i - 1][1] <= 1 else ""
        right = shapes[i + 1] if i + 1 < len(found) and found[i + 1][0] - b <= 1 else ""
        names = [f"s={shapes[i]}", f"n={n if n < 20 else 20}", f"@={'@' in s}", f".={min(s.count('.'), 4)}", f"+={s[0] == '+'}", f"l={_shape(before)[-8:]}", f"r={_shape(after)[:8]}", f"L={left}", f"R={right}", f"a={any(c.isalpha() for c in s)}", f"luhn={13 <= n <= 19 and luhn(_digits(s))}", f"w={before.lower()[-8:]}", f"b={_border(text, a - 1)}", f"e={_border(text, b)}"]
        out.append([_place(x) for x in names])
    return out


def edges(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, int]]:
    """``(i, j, type)``: 0 between tokens side by side, 1 between tokens alike, each linked with the last one like it.

    Alike are tokens with the same letters and digits, or with the same last seven digits, signs and case aside.
    """
    out = [(i, i + 1, 0) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= 2]
    last: dict[str, int] = {}
    for i, (a, b, *_) in enumerate(found):
        s = text[a:b]
        digits = _digits(s)
        keys = {"w" + "".join(c for c in s.lower() if c.isalnum())}
        if len(digits) >= 7:
            keys.add("d" + digits[-7:])
        linked = {last[k] for k in keys if k in last}
        out += [(j, i, 1) for j in sorted(linked)]
        last.update(dict.fromkeys(keys, i))
    return out


def base_labels(found: list[tuple[int, int, str, str]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Label of each token by the base span that it shares signs with, the first kind if several; 0 if there is none."""
    out, starts, ends = [0] * len(found), [f[0] for f in found], [f[1] for f in found]
    for k, a, b in spans:
        for i in range(bisect_right(ends, a), bisect_left(starts, b)):
            out[i] = out[i] or k + 1
    return out


def spread(n: int, links: list[tuple[int, int, int]], most: int) -> list[int]:
    """At most ``most`` of ``n`` tokens: some at even distances over the whole text, and with each up to three that it is linked with."""
    if n <= most:
        return list(range(n))
    beside: dict[int, list[int]] = {}
    for i, j, _ in links:
        beside.setdefault(i, []).append(j)
        beside.setdefault(j, []).append(i)
    seeds = max(1, most // 4)
    chosen = {k * n // seeds for k in range(seeds)}
    # Far ones first: they are the repeats, of which a token has few.
    more = {j for i in list(chosen) for j in sorted(beside.get(i, ()), key=lambda j: (-abs(j - i), j))[:3]}
    return sorted(chosen | more)[:most]


def fit_field(docs: DataFrame, key: str = "doc_id", text: str = "text", documents: int = 4000, rounds: int = 40, most_tokens: int = 1000) -> dict:
    """Weights of the field from at most ``documents`` documents with digits or ``@``, those of smallest MD5 of id and text.

    Of a document with more than ``most_tokens`` tokens, so many that are spread over the whole text count, with the edges between them.

    ``node``: features x labels; ``pair``: edge type x label x label. Nothing to learn from gives weights that add no span.
    """
    name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.md5(text))
    rows = docs.filter(F.col(text).rlike("[0-9@]")).select(hash60(name).alias("draw"), F.col(text).alias("text"))
    drawn = smallest(rows, "draw", documents).select("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            for t in texts:
                base = base_spans(t)
                found = tokens(t, base)
                links = edges(t, found)
                few = spread(len(found), links, most_tokens)
                labels = base_labels(found, base)
                unknown = base_labels(found, [(0, a, b) for a, b in swallowed(t)])
                labels = [-1 if u and not y else y for y, u in zip(labels, unknown)]
                features, at = token_features(t, found), {i: k for k, i in enumerate(few)}
                labels, features = [labels[i] for i in few], [features[i] for i in few]
                links = [(at[i], at[j], kind) for i, j, kind in links if i in at and j in at]
                parts = [np.array(v, np.int32).tobytes() for v in (labels, features, links)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in parts], names=["labels", "features", "edges"])

    # As bytes: lists of numbers would take more of the driver's memory.
    seen = drawn.mapInArrow(read, "labels binary, features binary, edges binary").collect()
    y, x, around, at = [], [], [], 0
    for r in seen:
        labels, e = np.frombuffer(r.labels, np.int32), np.frombuffer(r.edges, np.int32).reshape(-1, 3)
        i, j, kind, zero = at + e[:, 0], at + e[:, 1], e[:, 2], np.zeros(len(e), int)
        y.append(labels)
        if len(labels):
            x.append(np.frombuffer(r.features, np.int32).reshape(len(labels), -1))
        around += [np.column_stack([i, j, kind, zero]), np.column_stack([j, i, kind, zero + 1])]
        at += len(labels)
    y = np.concatenate(y) if y else np.zeros(0, int)
    node, pair = np.zeros((BUCKETS, LABELS)), np.zeros((2, LABELS, LABELS))
    if not (y > 0).any():
        node[:, 0] = 1.0
        return {"node": node, "pair": pair}
    x, around = np.concatenate(x), np.concatenate(around)
    around = around[(y[around[:, 0]] >= 0) & (y[around[:, 1]] >= 0)]
    i, j, kind, back = around.T
    known = y >= 0
    target = np.eye(LABELS)[np.maximum(y, 0)]
    g_node, g_pair = np.full(node.shape, 1e-8), np.full(pair.shape, 1e-8)
    sides = [(k, back_, (kind == k) & (back == back_)) for k in (0, 1) for back_ in (0, 1)]
    for _ in range(rounds):
        logits = node[x].sum(axis=1)
        for k, later, on in sides:
            np.add.at(logits, i[on], (pair[k] if later else pair[k].T)[y[j[on]]])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        err = (p / p.sum(axis=1, keepdims=True) - target) * known[:, None]
        grad, grad_pair = np.zeros_like(node), np.zeros_like(pair)
        np.add.at(grad, x.ravel(), np.repeat(err, x.shape[1], axis=0))
        for k, later, on in sides:
            np.add.at(grad_pair[k] if later else grad_pair[k].T, y[j[on]], err[i[on]])
        for w, g, seen_g in ((node, grad / len(y) + 1e-5 * node, g_node), (pair, grad_pair / len(y) + 1e-5 * pair, g_pair)):
            seen_g += g * g
            w -= 0.5 * g / np.sqrt(seen_g)
    return {"node": node, "pair": pair}


def beliefs(node: np.ndarray, pair: np.ndarray, links: list[tuple[int, int, int]], fixed: list[int]) -> np.ndarray:
    """Marginals by damped loopy sum-product. ``fixed``: labels above 0 are held."""
    own = node - np.log(np.exp(node - node.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - node.max(axis=1, keepdims=True)
    held = np.flatnonzero(fixed)
    own[held] = -50.0
    own[held, np.array(fixed)[held]] = 0.0
    if links:
        i, j, kind = np.array(links).T
        source, goal = np.concatenate([i, j]), np.concatenate([j, i])
        factor = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])  # from the source's label to the goal's
        twin = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        message = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, goal, message)
            inner = (total[source] - message[twin])[:, :, None] + factor
            top = inner.max(axis=1, keepdims=True)
            new = np.log(np.exp(inner - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            step = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if step < 1e-4:
                break
        np.add.at(own, goal, message)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find_spans(text: str, model: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a whole text; added ones share no sign with a base span."""
    base = base_spans(text)
    found = tokens(text, base)
    fixed = base_labels(found, base)
    if not found or all(fixed):
        return base, []
    node = model["node"][np.array(token_features(text, found))].sum(axis=1)
    p = beliefs(node, model["pair"], edges(text, found), fixed)
    added: list[tuple[int, int, int]] = []
    for at, (a, b, *_) in enumerate(found):
        k = int(p[at].argmax()) - 1
        if fixed[at] or k < 0 or p[at, k + 1] < SURE:
            continue
        # Tokens of one number, side by side, make one span.
        if added and added[-1][0] == k and k >= 2 and a - added[-1][2] <= 1 and text[added[-1][2] : a] in ("", " ", "-", ".", "(", ")") and at and not fixed[at - 1] and text[a] != "+" and len(_digits(text[added[-1][1] : b])) <= (19 if k == 2 else 15):
            added[-1] = (k, added[-1][1], b)
        else:
            added.append((k, a, b))
    return base, added


def find_personal(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base, spans)`` per row, as lists of ``(kind, start, end)`` in code points, by kind and start; null texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            both = [find_spans(t, shared.value) if _TOKEN.search(t) else ([], []) for t in texts]
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans)]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array([as_rows(b) for b, _ in both], kind), pa.array([as_rows(b + m) for b, m in both], kind)], names=[key, "base", "spans"])

    spans = "array<struct<kind: int, start: bigint, end: bigint>>"
    return docs.select(*dict.fromkeys([key, text])).mapInArrow(run, schema_with(docs.select(key), f"base {spans}, spans {spans}"))


def personal_digests(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the number of base spans of each kind, SHA-256 of the base spans as text, and all spans as text."""
    spelt = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
    rows = find_personal(docs, model, key, text)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(key, *counts, F.sha2(spelt("base"), 256).alias("base_sha256"), spelt("spans").alias("spans"))


def mask_personal(docs: DataFrame, model: dict, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind, as ``<email>``; overlapping spans go together under the first one's kind.

    Null texts stay null. ``length`` names a column that gets the new number of code points.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def masked(t: str) -> str:
        base, added = find_spans(t, shared.value)
        out, done = [], 0
        for k, a, b in sorted(base + added, key=lambda s: (s[1], s[0])):
            if a >= done:
                out += [t[done:a], f"<{KINDS[k]}>"]
            done = max(done, b)
        return "".join(out) + t[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            missing = part.column(text).is_null().to_pylist()
            new = [None if m else masked(t) if _TOKEN.search(t) else t for m, t in zip(missing, texts)]
            columns = {c: part.column(c) for c in names} | {text: pa.array(new, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out
