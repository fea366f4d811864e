"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

The CGK random walk copies a string symbol by symbol and decides with a random bit per step and symbol whether to
move on, so strings at a small edit distance get copies at a small Hamming distance.  Items and all item-sized windows
of the texts (words are symbols) are embedded; each repetition samples some positions of the copies, and windows whose
samples equal an item's are candidates.  The number of repetitions follows from the measured chance that an item and
a copy of it at the largest allowed distance collide.  Candidates are verified by exact edit distance.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, splitmix

SIMILARITY = 0.8
RECALL = 0.99
#: Sampled positions per repetition, and tries per item for measuring the chance of a collision.
SAMPLES = 2
TRIES = 24
#: Beyond so many repetitions the sampling is given up for a size, and all windows that share enough word pairs are verified.
MAX_REPETITIONS = 256
#: Bytes of benchmark text whose index is sent to the workers at a time; a larger benchmark takes more passes.
BLOCK_BYTES = 4 << 20
#: Pairs of a window and an item that are verified together.
VERIFIED = 50_000

_TABLE = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


#: characters of scripts that are written without spaces, each a word of its own (Thai, Lao, Burmese, Khmer, kana, Han)
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters and digits; everything else parts words, and so do characters of unspaced scripts."""
    text = text or ""
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def allowed(n: int, similarity: float) -> int:
    """Largest edit distance of n words at which the similarity 1 - distance / n still holds."""
    return int(n * (1 - similarity) + 1e-9)


class SizeIndex:
    """Items of one size: the walks' random factors, sampled steps and sorted keys.

    Whether a walk moves on is the top bit of a product of the step's factor and the symbol's code, so no table of bits
    has to be kept: the index grows with the items and repetitions alone.
    """

    def __init__(self, n: int, items: np.ndarray, numbers: np.ndarray, similarity: float, recall: float, codes: np.ndarray):
        self.n, self.items, self.numbers, self.distance = n, items, numbers, allowed(n, similarity)
        #: neighbouring words that a window within the distance shares with its item at least (q-gram lemma, q = 2)
        self.shared = n - 1 - 2 * self.distance
        self.pairs = np.empty(0, dtype=np.int64)  # the word pairs of the whole index that are in items of this size
        rng = np.random.default_rng(n)
        near = self._perturbed(rng)
        steps, missed = 2 * n, np.ones(len(near))
        self.sampled, self.factors = np.empty((0, min(SAMPLES, steps)), np.int64), np.empty((0, steps), np.uint64)
        self.sorted_keys: list[tuple[np.ndarray, np.ndarray]] = []
        lot = 8 if self.distance else 1
        while len(self.sampled) < MAX_REPETITIONS and missed.mean() > 1 - recall:
            new = np.array([np.sort(rng.choice(steps, min(SAMPLES, steps), replace=False)) for _ in range(lot)])
            factors = rng.integers(0, 2**63, (lot, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            own = self._walks(items, new, factors, codes)
            same = self._walks(near, new, factors, codes) == np.repeat(own, len(near) // len(items), axis=1)
            missed[same.any(axis=0)] = 0
            self.sampled, self.factors = np.concatenate([self.sampled, new]), np.concatenate([self.factors, factors])
            self.sorted_keys += [(k[o], o) for k in own for o in [np.argsort(k, kind="stable")]]
            if not self.distance:
                break
        self.exhaustive = bool(self.distance and missed.mean() > 1 - recall)

    def _perturbed(self, rng: np.random.Generator) -> np.ndarray:
        """Copies of the items after `distance` random substitutions, insertions and deletions by strange words."""
        out = []
        tries = max(1, min(TRIES, 6000 // len(self.items)))
        for item in self.items:
            for _ in range(tries):
                row = item.tolist()
                for _ in range(self.distance):
                    at, kind = int(rng.integers(len(row))), int(rng.integers(3))
                    row[at : at + (kind != 1)] = [] if kind == 2 and len(row) > 1 else [0]
                out.append((row + [0] * self.n)[: self.n])
        return np.array(out, dtype=np.int64).reshape(-1, self.n)

    def _walks(self, windows: np.ndarray, sampled: np.ndarray, factors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(repetitions, windows): hash of the sampled symbols of each window's walk."""
        # behind the last word comes a symbol whose code is 0, where a walk stays
        rows = np.concatenate([codes[windows], np.zeros((len(windows), 1), np.uint64)], axis=1).ravel()
        at = np.tile(np.arange(len(windows)) * (self.n + 1), (len(factors), 1))
        key = np.zeros(at.shape, dtype=np.uint64)
        top = np.uint64(63)
        for j in range(int(sampled.max()) + 1):
            code = rows[at]
            here = np.flatnonzero((sampled == j).any(axis=1))
            if len(here):
                key[here] = splitmix(key[here] * np.uint64(3) + code[here])
            at += ((code * factors[:, j : j + 1]) >> top).astype(np.int64)
        return key

    def starts(self, places: np.ndarray) -> np.ndarray:
        """First words of all windows with enough of these word pairs; no window within the distance is left out."""
        r = max(1, self.shared)
        if len(places) < r:
            return np.empty(0, np.int64)
        first, last = places[: len(places) - r + 1], places[r - 1 :]
        ok = last - first <= self.n - 2
        lo, hi = np.maximum(last[ok] - (self.n - 2), 0), first[ok]
        n = hi - lo + 1
        return np.unique(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))

    def candidates(self, windows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) that collide in a repetition; all pairs where the sampling was given up."""
        if self.exhaustive:
            return np.repeat(np.arange(len(windows)), len(self.items)), np.tile(np.arange(len(self.items)), len(windows))
        found = []
        for own, (keys, order) in zip(self._walks(windows, self.sampled, self.factors, codes), self.sorted_keys):
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            w = np.repeat(np.arange(len(own)), hi - lo)
            nth = np.arange(len(w)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            found.append(w * len(self.items) + order[np.repeat(lo, hi - lo) + nth])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.items), pairs % len(self.items)


def edit_distances(a: np.ndarray, lengths: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least Levenshtein distance of the row of b to a beginning of the row a[:length] beside it, and where that ends."""
    n = b.shape[1]
    row = np.tile(np.arange(n + 1), (len(b), 1))
    out, ends = np.full(len(b), n), np.zeros(len(b), dtype=np.int64)
    for i in range(int(lengths.max(initial=0))):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        change = row[:, :-1] + (a[:, i : i + 1] != b)
        best = np.minimum(change, row[:, 1:] + 1)
        # insertions: new[k] = min over j <= k of best[j] + (k - j)
        shifted = np.concatenate([new[:, :1], best], axis=1) - np.arange(n + 1)
        row = np.minimum.accumulate(shifted, axis=1) + np.arange(n + 1)
        nearer = (lengths > i) & (row[:, n] < out)
        out[nearer], ends[nearer] = row[nearer, n], i + 1
    return out, ends


class BenchmarkIndex:
    def __init__(self, rows: list[tuple[object, str | None]], similarity: float = SIMILARITY, recall: float = RECALL):
        self.similarity = similarity
        self.ids = [i for i, _ in rows]
        words = [words_of(t) for _, t in rows]
        vocabulary: dict[bytes, int] = {}
        for w in words:
            for x in w:
                vocabulary.setdefault(x, len(vocabulary) + 1)
        self.vocabulary = vocabulary
        #: a random code of every word; word 0 stands for all that are in no item
        self.codes = splitmix(np.arange(1, len(vocabulary) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sizes: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            if w:
                sizes[len(w)].append(k)
        self.sizes = [SizeIndex(n, np.array([[vocabulary[x] for x in words[k]] for k in own], dtype=np.int64), np.array(own), similarity, recall, self.codes) for n, own in sorted(sizes.items())]
        used = sorted({(a * (len(vocabulary) + 1) + b) for s in self.sizes for row in s.items.tolist() for a, b in zip(row, row[1:])})
        self.pair_keys = np.array(used, dtype=np.int64)
        for s in self.sizes:
            s.pairs = np.unique(np.searchsorted(self.pair_keys, (s.items[:, :-1] * (len(vocabulary) + 1) + s.items[:, 1:]).ravel()))
        self.sizes_of = list(map(len, words))
        self.pad = max((s.distance for s in self.sizes), default=0) + 1

    def _pairs_in(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of neighbouring words that are neighbours in an item too, and which pairs they are."""
        at = np.flatnonzero((stream[:-1] > 0) & (stream[1:] > 0))
        if not len(at) or not len(self.pair_keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys = stream[at] * (len(self.vocabulary) + 1) + stream[at + 1]
        k = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        ok = self.pair_keys[k] == keys
        return at[ok], k[ok]

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, distance): the nearest window of every text and item within the distance."""
        get = self.vocabulary.get
        each = [[get(w, 0) for w in words_of(t)] for t in texts]
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        begins = np.cumsum(lengths + self.pad) - lengths - self.pad
        stream = np.zeros(int((lengths + self.pad).sum()), dtype=np.int64)
        for b, n, row in zip(begins.tolist(), lengths.tolist(), each):
            stream[b : b + n] = row
        places, pairs = self._pairs_in(stream)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for s in self.sizes:
            if s.n == 1:
                at = np.flatnonzero(np.isin(stream, s.items))
            else:
                own = np.zeros(len(self.pair_keys), dtype=bool)
                own[s.pairs] = True
                at = s.starts(places[own[pairs]])
            step = max(1, VERIFIED // len(s.items)) if s.exhaustive else 5_000
            for k in range(0, len(at), step):
                starts = at[k : k + step]
                owner = np.searchsorted(begins, starts, "right") - 1
                left = begins[owner] + lengths[owner] - starts  # words from here to the text's end
                fits = left >= s.n - s.distance
                starts, owner, left = starts[fits], owner[fits], left[fits]
                longest = s.n + s.distance  # a passage with inserted words is longer than its item
                windows = stream[np.minimum(starts[:, None] + np.arange(longest), len(stream) - 1)]
                windows[np.arange(longest) >= left[:, None]] = 0
                w, item = s.candidates(windows[:, : s.n], self.codes)
                distance, size = edit_distances(windows[w], np.minimum(left[w], longest), s.items[item])
                for i in np.flatnonzero(distance <= s.distance).tolist():
                    p, t, number = int(starts[w[i]]), int(owner[w[i]]), int(s.numbers[item[i]])
                    mine = int(distance[i]), p - int(begins[t]), int(size[i])
                    if (t, number) not in best or mine < best[t, number]:
                        best[t, number] = mine
        return [(t, k, p, n, d) for (t, k), (d, p, n) in sorted(best.items())]


def indexes(benchmark: DataFrame, item_col: str, text_col: str, similarity: float, recall: float, block_bytes: int = BLOCK_BYTES) -> Iterator[BenchmarkIndex]:
    """Indexes of the items in blocks of a bounded size."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield BenchmarkIndex([(r.item_id, r.text) for r in rows], similarity, recall)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): for each row of `docs` and each item within reach
    the nearest window, the first of equals.

    Whole texts are searched, very long ones too.  Null and empty texts, and items without a letter or digit, match
    nothing; items of fewer than five words only match word by word, since the distance is at most n_words / 5; where a
    size's repetitions can't reach the recall, every window that shares enough word pairs with an item is verified.  A
    text that ends early is compared as far as it goes; repeated rows and rows with a null id each give their matches;
    an empty table or benchmark gives none; extra columns are ignored.
    """
    source = small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    kind = source.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    out = None
    for index in indexes(benchmark, item_col, item_text, similarity, recall):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids = shared.value.ids
            for b in batches:
                found = shared.value.find(b.column("text").to_pylist())
                if found:
                    t, k, p, n, d = (list(x) for x in zip(*found))
                    near = [1 - x / len_ for x, len_ in zip(d, (shared.value.sizes_of[i] for i in k))]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(t)), pa.array([ids[i] for i in k]), pa.array(p, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(near)],
                        names=["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"],
                    )

        part = source.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, first_word bigint, n_words bigint, distance bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item (see `leaks`); null and empty texts and repeated rows stay."""
    out = docs
    at = docs.columns.index(text_col)
    for index in indexes(benchmark, item_col, item_text, similarity, recall):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = {t for t, *_ in shared.value.find(b.column(at).to_pylist())}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        out = small_batches(out).mapInArrow(run, docs.schema)
    return out
