"""Personal data by weak supervision.

Patterns propose spans.  Labelers vote on every proposed span of the added kinds: patterns with checks, gazetteers of the words that
stand before such data, and context rules on what touches the span.  Expectation-maximisation estimates each
labeler's reliability per kind from the votes alone, and its posteriors train a final logistic span classifier over
the span's features.  Spans of the four base kinds are always reported; the classifier decides on the added kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in the order in which they are reported after the base kinds.
ADDED = ("secret", "nationalid", "contact", "coordinates")
KINDS = BASE + ADDED
#: Distinct vote patterns of a kind that come to the driver: one of three votes per labeler bounds them.
EM_ROUNDS = 50

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Proposals of the added kinds and the words of their gazetteers.
_SECRET = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)\b\s{0,4}[:=]\s{0,4}([\"']?)([A-Za-z0-9+/_=-]{8,})\1")
_NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CONTACT = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-]?[0-9])")
_COORDINATES = re.compile(r"-?[0-9]{1,2}\.[0-9]{4,8}, ?-?[0-9]{1,3}\.[0-9]{4,8}(?![0-9.])")
GAZETTEER = {
    "secret": ("api", "key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"),
    "nationalid": ("ssn", "social", "security", "tax", "id", "number"),
    "contact": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "contact"),
    "coordinates": ("lat", "latitude", "lon", "longitude", "gps", "location", "coordinates", "at"),
}
_WORD = re.compile(r"[^\W\d_]+")
#: Code points on each side of a span that labelers and features look at.
CONTEXT = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches.  The local part is the run before an @, so only the @ signs are visited."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Numbers joined by dots, four at a time from the left; kept if no part is over 255."""
    for m in _NUMBERS.finditer(text):
        begin, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield begin, end
            begin = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {"email": list(emails(text)), "ip": list(addresses(text)), "card": list(cards(text)), "phone": list(phones(text))}


def proposals(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """Spans of the added kinds that touch no base span and no earlier proposal."""
    taken = sorted(s for spans in base.values() for s in spans)
    lower = text.lower()
    found: list[tuple[str, int, int]] = []
    if any(w in lower for w in ("key", "token", "secret", "passw", "pwd")):
        found += [("secret", m.start(2), m.end(2)) for m in _SECRET.finditer(text)]
    if "-" in text:
        found += [("nationalid", *m.span()) for m in _NATIONAL.finditer(text)]
    found += [("contact", *m.span()) for m in _CONTACT.finditer(text)]
    if "." in text and "," in text:
        found += [("coordinates", *m.span()) for m in _COORDINATES.finditer(text)]
    for kind, a, b in found:
        if kind != "secret" and a and (text[a - 1].isalnum() or text[a - 1] in "+.@-_"):
            continue  # the end of something longer
        if not any(a < y and x < b for x, y in taken):
            taken.append((a, b))
            yield kind, a, b


# Labelers: each votes 1 (personal), -1 (not) or 0 (abstains) on a span.


def _around(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]


def vote_pattern(kind: str, text: str, a: int, b: int) -> int:
    s = text[a:b]
    if kind == "secret":
        return 1 if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) else -1
    if kind == "nationalid":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind == "contact":
        d = [c for c in s if c.isdigit()]
        return -1 if d[0] in "01" or len(set(d)) < 3 else 1
    if kind == "coordinates":
        lat, lon = (float(x) for x in s.split(","))
        return 1 if abs(lat) <= 90 and abs(lon) <= 180 else -1
    return 1


def vote_gazetteer(kind: str, text: str, a: int, b: int) -> int:
    before = {w.lower() for w in _WORD.findall(_around(text, a, b)[0])[-4:]}
    return 1 if before & set(GAZETTEER[kind]) else 0


def vote_context(kind: str, text: str, a: int, b: int) -> int:
    left, right = _around(text, a, b)
    if left[-1:].isalnum() or right[:1].isalnum():
        return -1
    return 1 if left.rstrip(" ")[-1:] in ('"', "'", ":", "=", "#", "<") else 0


def vote_shape(kind: str, text: str, a: int, b: int) -> int:
    s = text[a:b]
    if kind == "secret":
        return 1 if len(set(s)) >= min(10, len(s) // 2) else -1
    digits = [c for c in s if c.isdigit()]
    return -1 if len(set(digits)) <= 2 else 0


LABELERS = (vote_pattern, vote_gazetteer, vote_context, vote_shape)


def votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    return tuple(f(kind, text, a, b) for f in LABELERS)


def features(kind: str, text: str, a: int, b: int) -> np.ndarray:
    """What the span classifier sees; the kind gives each feature a weight of its own."""
    s = text[a:b]
    left, right = _around(text, a, b)
    n = max(1, len(s))
    own = np.array(
        [1.0, min(n, 64) / 64, sum(c.isdigit() for c in s) / n, len(set(s)) / n, vote_pattern(kind, text, a, b), vote_gazetteer(kind, text, a, b), float(left[-1:].isspace()), float(right[:1].isspace() or not right), vote_shape(kind, text, a, b)]
    )
    out = np.zeros(len(ADDED) * len(own))
    i = ADDED.index(kind)
    out[i * len(own) : (i + 1) * len(own)] = own
    return out


@dataclass
class SpanModel:
    """Reliability per kind and labeler (chance of a right vote) and the classifier's weights."""

    reliability: dict[str, np.ndarray]
    weights: np.ndarray

    def probability(self, kind: str, text: str, a: int, b: int) -> float:
        z = float(features(kind, text, a, b) @ self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Reliabilities of the labelers and the posterior of each vote pattern (rows of -1, 0, 1) with its count."""
    right, prior = np.full(patterns.shape[1], 0.8), 0.7
    for _ in range(rounds):
        like = lambda y: np.where(patterns == 0, 1.0, np.where(patterns == y, right, 1 - right)).prod(axis=1)  # noqa: E731, B023
        yes, no = prior * like(1), (1 - prior) * like(-1)
        post = yes / (yes + no)
        w = post[:, None] * counts[:, None], (1 - post)[:, None] * counts[:, None]
        cast = ((patterns != 0) * counts[:, None]).sum(axis=0)
        hits = ((patterns == 1) * w[0] + (patterns == -1) * w[1]).sum(axis=0)
        right = np.clip((hits + 4) / (cast + 5), 0.55, 0.99)  # smoothed toward a fair labeler
        prior = np.clip((post * counts).sum() / counts.sum(), 0.05, 0.95)
    return right, post


def train(rows: list[tuple[np.ndarray, float, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels, each row with its weight."""
    x = np.array([r[0] for r in rows])
    y, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    w /= w.sum()
    out = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        out -= rate * (x.T @ (w * (p - y)) * 10 + decay * out)
    return out


def proposed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, votes, features, n): proposals of all texts, equal ones summed in the workers and then over the cluster.

    Features are rounded to one digit, so the groups stay few at any size of input.
    """
    source = small_batches(docs.select(F.col(text_col).alias("text")).where("text is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in batches:
            for text in b.column("text").to_pylist():
                for kind, i, j in proposals(text, base_spans(text)):
                    key = kind, votes(kind, text, i, j), tuple(np.round(features(kind, text, i, j), 1).tolist())
                    seen[key] = seen.get(key, 0) + 1
        if seen:
            yield pa.RecordBatch.from_pydict({"kind": [k[0] for k in seen], "votes": [list(k[1]) for k in seen], "features": [list(k[2]) for k in seen], "n": list(seen.values())}, schema=schema)

    schema = pa.schema([("kind", pa.string()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.float64())), ("n", pa.int64())])
    return source.mapInArrow(run, "kind string, votes array<int>, features array<double>, n bigint").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Reliabilities and classifier from the proposals of all rows; no labels are needed.

    Null and empty texts propose nothing, repeated rows count each time, very long texts are read whole; without any
    proposal (an empty table) reliabilities are 0.8 and the classifier accepts what is proposed.
    """
    groups = proposed(docs, text_col).collect()  # a few hundred: kinds x votes x rounded features
    reliability = {k: np.full(len(LABELERS), 0.8) for k in ADDED}
    rows: list[tuple[np.ndarray, float, int]] = []
    for kind in ADDED:
        own = [g for g in groups if g.kind == kind]
        if own:
            reliability[kind], post = em(np.array([g.votes for g in own]), np.array([g.n for g in own], dtype=float))
            rows += [(np.array(g.features), float(p), g.n) for g, p in zip(own, post)]
    width = len(features(ADDED[0], "x", 0, 1))
    return SpanModel(reliability, train(rows) if rows else np.zeros(width))


def all_spans(text: str | None, model: SpanModel) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in a text, in code points with an exclusive end; null and empty texts have none."""
    if not text:
        return {k: [] for k in KINDS}
    base = base_spans(text)
    out = base | {k: [] for k in ADDED}
    for kind, a, b in proposals(text, base):
        if model.probability(kind, text, a, b) >= 0.5:
            out[kind].append((a, b))
    return out


def _joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans[k]))


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_<base kind>..., base, spans) of every whole text.

    Null and empty texts have no spans and empty strings; very long ones are read whole.  Repeated rows and rows with a
    null id stay; an empty table gives no rows; extra columns are ignored.
    """
    source = small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [all_spans(t, shared.value) for t in b.column("text").to_pylist()]
            counts = [pa.array([len(s[k]) for s in each], pa.int64()) for k in BASE]
            strings = [pa.array([_joined(s, kinds) for s in each], pa.string()) for kinds in (BASE, KINDS)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, *strings], names=["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"])

    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base string, spans string")


def mask_text(text: str | None, model: SpanModel) -> str | None:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first is named."""
    if not text:
        return text
    marked = sorted((a, b, k) for k, spans in all_spans(text, model).items() for a, b in spans)
    out, upto = [], 0
    for a, b, k in marked:
        if a >= upto:
            out += [text[upto:a], f"[{k.upper()}]"]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def mask(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """All rows and columns of `docs` with personal data masked in the text; null texts stay null, repeated rows stay.

    n_chars, where there is such an integer column, is set to the length of the new text.
    """
    model = model or fit(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            texts = [mask_text(t, shared.value) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names and pa.types.is_integer(columns[k := names.index("n_chars")].type):
                columns[k] = pa.array([None if t is None else len(t) for t in texts], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(docs).mapInArrow(run, docs.schema)
