"""Interpolated modified Kneser-Ney word bigrams, counted in Spark and memory-mapped for scoring.

Counting packs the word pairs of lots of texts into sorted blocks, which are summed per hash partition.  The model is a
folder of sorted hash arrays under the cluster's shared checkpoint folder: pair files with a directory over the upper
hash bits, and word files with counts, continuation counts and follower counts.  Workers map the files into memory and
look up whole batches at once.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, ensure_checkpoint_dir, small_batches, splitmix

#: Hashes that no word has by construction: before the first word of a text, and its end.
START, END = np.uint64(1), np.uint64(2)
#: Tokens that a worker packs together, and bytes of text for each partition of the counts.
LOT_TOKENS = 2_000_000
PART_BYTES = 16 << 20
#: Blobs that a lot is packed into at most; with more partitions than that a second exchange divides them further.
COARSE = 2048
#: A word with this share of the sampled tokens is hot: its pairs are spread by their second word too.
HOT_SHARE = 1 / 1024
HOT_SAMPLE = 0.02
DIRECTORY_BITS = 16


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def token_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then END, and the number of tokens of each text."""
    each = [ascii_words(t) for t in texts]
    counts = np.fromiter(map(len, each), np.int64, len(each)) + 1
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    at = 0
    for w in each:
        out[at : at + len(w)] = word_hashes(w)
        at += len(w) + 1
    out[np.cumsum(counts) - 1] = END
    return out, counts


def before(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each, START for the first of a text."""
    prev = np.r_[START, tokens[:-1]] if len(tokens) else tokens
    prev[np.cumsum(counts) - counts] = START
    return prev


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return splitmix(v * np.uint64(0x9E3779B97F4A7C15) + splitmix(w))


def partition_of(v: np.ndarray, pair: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """A pair lives with its first word, or by its own hash if that word is hot."""
    key = splitmix(v)
    if len(hot):
        key = np.where(np.isin(v, hot), pair, key)
    return ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def summed(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of (v, w), with their summed counts."""
    o = np.lexsort((w, v))
    v, w, c = v[o], w[o], c[o]
    cuts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
    return v[cuts], w[cuts], np.add.reduceat(c, cuts)


def pack(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted pairs as columns; a first word is stored once."""
    cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    runs = np.diff(np.r_[cuts, len(v)]).astype(np.uint32)
    head = np.array([len(cuts), len(v)], dtype=np.int64)
    wide = int(c.max(initial=0)) > 255
    body = (c.astype(np.int64) if wide else c.astype(np.uint8)).tobytes()
    return bytes([wide]) + head.tobytes() + v[cuts].tobytes() + runs.tobytes() + w.tobytes() + body


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, n = np.frombuffer(blob, np.int64, 2, 1)
    at = 17
    v = np.frombuffer(blob, np.uint64, heads, at)
    runs = np.frombuffer(blob, np.uint32, heads, at := at + 8 * heads)
    w = np.frombuffer(blob, np.uint64, n, at := at + 4 * heads)
    c = np.frombuffer(blob, np.int64 if blob[0] else np.uint8, n, at + 8 * n).astype(np.int64)
    return np.repeat(v, runs), w, c


# Files of the model, in any store that pyarrow reaches.


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Write under another name and rename, so a task that runs again leaves one whole file."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        for a in arrays:
            out.write(a.data if len(a) else b"")
    store.move(temporary, f"{path}/{name}")


_FETCHED: dict[str, str] = {}


def local_path(folder: str, name: str) -> str:
    """The file itself where the store is a mounted folder; else a copy, fetched once per worker process."""
    store, path = _store(folder)
    if isinstance(store, pafs.LocalFileSystem):
        return f"{path}/{name}"
    key = f"{folder}/{name}"
    if key not in _FETCHED:
        folder_here = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder_here, ignore_errors=True)
        target = os.path.join(folder_here, name)
        if store.get_file_info(f"{path}/{name}").type == pafs.FileType.File:  # a partition without rows has none
            with store.open_input_stream(f"{path}/{name}") as source, open(target, "wb") as out:
                while chunk := source.read(1 << 22):
                    out.write(chunk)
        _FETCHED[key] = target
    return _FETCHED[key]


def pair_file(part: int) -> str:
    return f"pairs-{part:06d}"


def halves(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of pair hashes that the directory doesn't tell: the upper 32 and the lower 16, so keys are kept whole."""
    return (g >> np.uint64(32 - DIRECTORY_BITS)).astype(np.uint32), g.astype(np.uint16)


def word_file(part: int) -> str:
    return f"words-{part:06d}"


# Counting.


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    held: list[str | None] = []
    size = 0
    for b in batches:
        for t in b.column("text").to_pylist():
            held.append(t)
            size += len(t or "") // 6 + 1
            if size > LOT_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def hot_words(train: DataFrame) -> np.ndarray:
    """Words frequent in a sample of the texts.  They only steer where counts are kept, never their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in lots(batches):
            tokens, _ = token_stream(texts)
            words, counts = np.unique(tokens, return_counts=True)
            big = counts > len(tokens) * HOT_SHARE / 2
            yield pa.RecordBatch.from_arrays([pa.array(words[big].view(np.int64)), pa.array(counts[big].astype(np.int64)), pa.array(np.r_[len(tokens), np.zeros(max(0, int(big.sum()) - 1), np.int64)][: int(big.sum())])], names=["h", "n", "of"])

    found = train.sample(HOT_SAMPLE, seed=3).mapInArrow(run, "h bigint, n bigint, of bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    rows = found.collect()  # at most 2 / HOT_SHARE words from each lot
    total = sum(r.of for r in rows)
    return np.array([r.h for r in rows if r.n >= total * HOT_SHARE], dtype=np.int64).view(np.uint64)


def blobs_by(key: np.ndarray, pack, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct keys, and the packed rows (last axis) of each, in their order."""
    o = np.argsort(key, kind="stable")
    key, columns = key[o], [c[..., o] for c in columns]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[cuts], [pack(*(c[..., a:z] for c in columns)) for a, z in zip(cuts, np.r_[cuts[1:], len(key)])]


def blob_batch(keys: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])


def coarse(part: np.ndarray, parts: int) -> np.ndarray:
    return part % COARSE if parts > COARSE else part


def packed_pairs(train: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """(part, blob): the pairs of lots of texts, summed and packed per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in lots(batches):
            w, counts = token_stream(texts)
            v, w, c = summed(before(w, counts), w, np.ones(len(w), np.int64))
            yield blob_batch(*blobs_by(coarse(partition_of(v, pair_hash(v, w), hot, parts), parts), pack, v, w, c))

    def divide(blobs: list[bytes]) -> pa.RecordBatch:
        v, w, c = summed(*(np.concatenate(x) for x in zip(*map(unpack, blobs))))
        return blob_batch(*blobs_by(partition_of(v, pair_hash(v, w), hot, parts), pack, v, w, c))

    return refined(train.mapInArrow(run, "part int, blob binary"), parts, divide)


def refined(rows: DataFrame, parts: int, divide) -> DataFrame:
    """Blobs of coarse partitions divided into those of all partitions, so that blobs grow with the input and not its square.

    Blobs are gathered up to a lot's size before they are divided; rows with a negative number pass through.
    """
    if parts <= COARSE:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            through = b.column("part").to_numpy() < 0
            if through.any():
                yield b.filter(pa.array(through))
            for blob in b.filter(pa.array(~through)).column("blob").to_pylist():
                held.append(blob)
                size += len(blob)
                if size > 16 * LOT_TOKENS:
                    yield divide(held)
                    held, size = [], 0
        if held:
            yield divide(held)

    return rows.repartitionById(COARSE, "part").mapInArrow(run, "part int, blob binary")


def by_part(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, "part").sortWithinPartitions("part")


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each partition number, from rows in its order."""
    now, held = None, []
    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist()):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append(blob)
    if held:
        yield now, held


def pack_words(h: np.ndarray, columns: np.ndarray) -> bytes:
    """Sorted word hashes and five columns of whole numbers; small columns take one byte a value."""
    small = [int(x.max(initial=0)) < 256 for x in columns]
    body = b"".join((x.astype(np.uint8) if s else x.astype(np.int64)).tobytes() for x, s in zip(columns, small))
    return np.array([len(h)], np.int64).tobytes() + bytes(small) + h.tobytes() + body


def unpack_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 13 + 8 * n, []
    for s in blob[8:13]:
        out.append(np.frombuffer(blob, np.uint8 if s else np.int64, n, at).astype(np.int64))
        at += n if s else 8 * n
    return np.frombuffer(blob, np.uint64, n, 13), np.array(out)


def stored_pairs(packed: DataFrame, folder: str, parts: int) -> DataFrame:
    """Write the pair files; hand on (part, blob) of word statistics, and counts of counts as part -1.

    The columns of a word: occurrences, words before it (distinct), and followers seen once, twice and more often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in whole_parts(batches):
            v, w, c = summed(*(np.concatenate(x) for x in zip(*map(unpack, blobs))))
            g = pair_hash(v, w)
            o = np.argsort(g)
            top = (g[o] >> np.uint64(64 - DIRECTORY_BITS)).astype(np.int64)
            directory = np.searchsorted(top, np.arange((1 << DIRECTORY_BITS) + 1)).astype(np.int64)
            count = c[o].astype(np.int64 if int(c.max(initial=0)) >> 32 else np.uint32)
            write_arrays(folder, pair_file(part), [np.array([len(g), count.itemsize], np.int64), directory, *halves(g[o]), count])
            cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            follow = [np.add.reduceat((c == 1).astype(np.int64), cuts), np.add.reduceat((c == 2).astype(np.int64), cuts), np.add.reduceat((c > 2).astype(np.int64), cuts)]
            ow = np.argsort(w)
            cw = np.flatnonzero(np.r_[True, w[ow][1:] != w[ow][:-1]])
            words = np.unique(np.concatenate([v[cuts], w[ow][cw]]))
            columns = np.zeros((5, len(words)), np.int64)
            at = np.searchsorted(words, w[ow][cw])
            columns[0, at], columns[1, at] = np.add.reduceat(c[ow], cw), np.diff(np.r_[cw, len(w)])
            columns[2:, np.searchsorted(words, v[cuts])] = follow
            to, blobs = blobs_by(coarse(word_part(words, parts), parts), pack_words, words, columns)
            counts = np.array([(c == k).sum() for k in (1, 2, 3, 4)] + [len(c)], np.int64)
            yield blob_batch(np.r_[-1, to], [counts.tobytes(), *blobs])

    def divide(blobs: list[bytes]) -> pa.RecordBatch:
        words, sums = summed_words(blobs)
        return blob_batch(*blobs_by(word_part(words, parts), pack_words, words, sums))

    return refined(by_part(packed, parts).mapInArrow(run, "part int, blob binary"), parts, divide)


def word_part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((splitmix(words) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def summed_words(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of packed word statistics, in order, with their summed columns."""
    h, columns = (np.concatenate(x, axis=-1) for x in zip(*map(unpack_words, blobs)))
    words, inverse = np.unique(h, return_inverse=True)
    sums = np.zeros((5, len(words)), np.int64)
    for k in range(5):
        np.add.at(sums[k], inverse, columns[k])
    return words, sums


def stored_words(statistics: DataFrame, folder: str, parts: int) -> DataFrame:
    """Write the word files; hand on one row of totals per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in whole_parts(batches):
            if part < 0:
                total = sum(np.frombuffer(x, np.int64) for x in blobs)
                row = [0, 0, 0, *total[:4].tolist(), int(total[4]), 0, 0, 0, 0]
            else:
                words, sums = summed_words(blobs)
                write_arrays(folder, word_file(part), [np.array([len(words)], np.int64), words, *sums.astype(np.float64)])
                real = sums[0] > 0
                row = [int(sums[0].sum()), int(real.sum()), int(sums[0][words == END].sum()), 0, 0, 0, 0, 0, *[int((sums[1] == k).sum()) for k in (1, 2, 3, 4)]]
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.list_(pa.int64()))], names=["totals"])

    return by_part(statistics, parts).mapInArrow(run, "totals array<bigint>")


def discounts(n: list[int]) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from the numbers of things seen one to four times; index 0 is 0."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


@dataclass
class Model:
    """Small enough to send to every worker: where the files are, and the totals."""

    folder: str
    parts: int
    hot: np.ndarray
    tokens: int
    words: int
    texts: int
    pairs: int
    pair_discount: np.ndarray
    word_discount: np.ndarray
    singles: np.ndarray  # words with one, two, more words before them
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _pairs(self, part: int) -> tuple[np.ndarray, ...] | None:
        key = pair_file(part)
        if key not in self._open:
            self._open[key] = None
            path = local_path(self.folder, key)
            if os.path.exists(path):
                n, width = np.fromfile(path, np.int64, 2).tolist()
                d = (1 << DIRECTORY_BITS) + 1
                at = 16 + 8 * d
                kinds = ((np.uint32, at), (np.uint16, at + 4 * n), (np.int64 if width == 8 else np.uint32, at + 6 * n))
                self._open[key] = np.memmap(path, np.int64, "r", 16, (d,)), *(np.memmap(path, k, "r", x, (n,)) for k, x in kinds)
        return self._open[key]

    def _words(self, part: int) -> tuple[np.ndarray, np.ndarray] | None:
        key = word_file(part)
        if key not in self._open:
            self._open[key] = None
            path = local_path(self.folder, key)
            if os.path.exists(path):
                n = int(np.fromfile(path, np.int64, 1)[0])
                self._open[key] = np.memmap(path, np.uint64, "r", 8, (n,)), np.memmap(path, np.float64, "r", 8 + 8 * n, (5, n))
        return self._open[key]

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of pairs; binary search within the directory's bucket, all pairs of a partition at once."""
        g = pair_hash(v, w)
        part = partition_of(v, g, self.hot, self.parts)
        o = np.lexsort((g, part))
        out = np.zeros(len(g))
        cuts = np.flatnonzero(np.r_[True, part[o][1:] != part[o][:-1]]) if len(o) else []
        for a, z in zip(cuts, [*cuts[1:], len(o)]):
            mine = o[a:z]
            if (opened := self._pairs(int(part[mine[0]]))) is None or not len(opened[1]):
                continue
            directory, low, rest, count = opened
            top, (key, tail) = (g[mine] >> np.uint64(64 - DIRECTORY_BITS)).astype(np.int64), halves(g[mine])
            lo, end = directory[top], directory[top + 1]
            hi = end.copy()
            while (go := lo < hi).any():
                mid = (lo + hi) >> 1
                m = np.minimum(mid, len(low) - 1)
                less = go & ((low[m] < key) | ((low[m] == key) & (rest[m] < tail)))
                lo = np.where(less, mid + 1, lo)
                hi = np.where(go & ~less, mid, hi)
            at = np.minimum(lo, len(low) - 1)
            out[mine] = np.where((lo < end) & (low[at] == key) & (rest[at] == tail), count[at], 0)
        return out

    def word_stats(self, h: np.ndarray) -> np.ndarray:
        """(5, n) statistics of words that are sorted and distinct; zeros for unknown ones."""
        part = word_part(h, self.parts)
        out = np.zeros((5, len(h)))
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            if (opened := self._words(p)) is None or not len(opened[0]):
                continue
            at = np.minimum(np.searchsorted(opened[0], h[mine]), len(opened[0]) - 1)
            ok = opened[0][at] == h[mine]
            out[:, mine[ok]] = opened[1][:, at[ok]]
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, the base score and the model's log10 probability of each text."""
        w, counts = token_stream(texts)
        cuts = np.cumsum(counts) - counts
        v = before(w, counts)
        distinct, inverse = np.unique(np.r_[w, START], return_inverse=True)
        stats = self.word_stats(distinct)
        stats[0, inverse[-1]] = self.texts  # START stands before as many words as there are texts
        base = np.log10((stats[0] + 0.1) / (self.tokens + 0.1 * (self.words + 1)))[inverse[:-1]]
        d1 = self.word_discount[np.minimum(stats[1], 3).astype(np.int64)]
        spare = float(self.word_discount[1:] @ self.singles) / self.pairs if self.pairs else 1.0
        lower = np.maximum(stats[1] - d1, 0) / max(1, self.pairs) + spare / (self.words + 1)
        wi = inverse[:-1]
        vi = np.r_[inverse[-1], wi[:-1]]
        vi[cuts] = inverse[-1]
        c = self.pair_counts(v, w)
        seen = stats[0][vi]
        back = np.where(seen > 0, (self.pair_discount[1:] @ stats[2:])[vi] / np.maximum(seen, 1), 1.0)
        p = np.maximum(c - self.pair_discount[np.minimum(c, 3).astype(np.int64)], 0) / np.maximum(seen, 1) + back * lower[wi]
        known = (stats[0][wi] > 0).astype(np.int64)
        return counts, np.add.reduceat(known, cuts), np.add.reduceat(base, cuts), np.add.reduceat(np.log10(p), cuts)


def fit(train: DataFrame, text_col: str = "text") -> Model:
    """Count all texts of `train` (null: empty) and store the model; only totals come to the driver."""
    texts = small_batches(train.select(F.col(text_col).alias("text")))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(4, -(-size // PART_BYTES))
    hot = hot_words(texts)
    folder = f"{ensure_checkpoint_dir(train.sparkSession)}/lm-{uuid.uuid4().hex}"
    words = stored_words(stored_pairs(packed_pairs(texts, hot, parts), folder, parts), folder, parts)
    sums = words.agg(*[F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(12)]).first()
    t = [int(x or 0) for x in sums]
    more = t[1] - t[8] - t[9]
    return Model(folder, parts, hot, t[0], t[1], t[2], t[7], discounts(t[3:7]), discounts(t[8:12]), np.array([t[8], t[9], more], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Null and empty texts have the end as their only token; without training texts every token is unknown.  Repeated
    rows and rows with a null id stay; very long texts are scored whole; an empty table gives no rows; extra columns are
    ignored.
    """
    source = small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if b.num_rows:
                n, known, base, own = m.score(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n), pa.array(known), pa.array(np.full(len(n), m.tokens)), pa.array(base), pa.array(own)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity():
    """Column: perplexity of a scored text."""
    return F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
