"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round finds, by binary search over the sorted keys of all merge
pairs, the rank of every neighbouring pair, takes the lowest of each word and merges it everywhere in that word; words
without a pair are done.  Words that were met before come from a bounded cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches

#: Words whose tokens a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Bytes of new words that are merged together.
MERGE_BYTES = 4 << 20
#: Texts are handled in lots of so many characters; a longer text is a lot of its own.
LOT_CHARS = 4 << 20

# Fixed value: the published pre-tokenisation pattern of byte-level BPE, with white space spelled out.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself, or the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Tables of a tokenizer file; what is sent to the workers (about 3 MB for 50,000 tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or [] if t["special"]}
        self.specials = specials
        size = max([*vocab.values(), *specials.values()]) + 1
        pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in specials.items():
            pieces[i] = token.encode()
        self.token_len = np.array([len(p) for p in pieces], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)  # by rank

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after the other, and how many each has."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(n), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.merged)
        while len(symbols):
            keys = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), none - 1)
            ok = (self.pair_keys[at] == keys) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(ok, self.pair_rank[at], none), none)
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, cuts)
            per = np.repeat(lowest, np.diff(np.r_[cuts, len(owner)]))
            over = per == none
            if over.any():
                done.append((owner[over], symbols[over]))
                live = ~over
                symbols, owner, rank, per = symbols[live], owner[live], rank[live], per[live]
                if not len(symbols):
                    break
            hit = rank == per
            # of hits that touch (a a a), every second one from the left
            begins = hit & ~np.r_[False, hit[:-1]]
            place = np.arange(len(hit))
            hit &= ((place - np.maximum.accumulate(np.where(begins, place, 0))) & 1) == 0
            symbols = np.where(hit, self.merged[np.where(hit, per, 0)], symbols)
            stay = ~np.r_[False, hit[:-1]]
            symbols, owner = symbols[stay], owner[stay]
        if not done:
            return np.empty(0, np.int64), np.zeros(n, np.int64)
        owner, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=n)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are no UTF-8 become U+FFFD."""
        lens = self.token_len[ids]
        ends = np.cumsum(lens)
        source = np.repeat(self.token_at[ids] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)
        flat = self.token_bytes[source].tobytes()
        cuts = np.r_[0, ends][np.cumsum(counts)] if len(counts) else []
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip([0, *cuts[:-1]], cuts)]


class Encoder:
    """A worker's encoder: pre-tokenisation, the word cache and special tokens."""

    def __init__(self, tables: ByteBpe):
        self.tables = tables
        self.words = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.specials, key=len, reverse=True))) + ")") if tables.specials else None
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.at = self.count = np.empty(0, np.int64)
        if self.special:
            self._store(list(self.tables.specials), np.array(list(self.tables.specials.values())), np.ones(len(self.tables.specials), np.int64))

    def _store(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.cache.update(zip(words, range(len(self.cache), len(self.cache) + len(words))))
        self.at = np.append(self.at, len(self.ids) + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.ids = np.append(self.ids, ids.astype(np.int32))

    def _learn(self, new: list[str]) -> None:
        lot: list[bytes] = []
        begin = size = 0
        for i, w in enumerate(new):
            lot.append(w.encode("utf-8", "surrogatepass"))
            size += len(lot[-1])
            if size > MERGE_BYTES or i == len(new) - 1:
                self._store(new[begin : i + 1], *self.tables.merge(lot))
                begin, size, lot = i + 1, 0, []

    def pieces(self, text: str) -> list[str]:
        if not self.special or not any(s in text for s in self.tables.specials):
            return self.words(text)
        parts = self.special.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.words(p))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and how many each has."""
        each = [self.pieces(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.clear()
        new = {w for words in each for w in words} - self.cache.keys()
        if new:
            self._learn(sorted(new))
        get = self.cache.__getitem__
        n_words = np.fromiter(map(len, each), np.int64, len(each))
        index = np.fromiter((get(w) for words in each for w in words), np.int64, int(n_words.sum()))
        counts = self.count[index]
        ends = np.cumsum(counts)
        source = np.repeat(self.at[index] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        upto = np.r_[0, ends][np.cumsum(n_words)] if len(each) else np.empty(0, np.int64)
        return self.ids[source], np.diff(np.r_[0, upto])


def lots(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most LOT_CHARS characters together."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > LOT_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if texts:
        yield begin, len(texts)


def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, tables: ByteBpe, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, decoded]) of every whole text, special tokens' strings included.

    Null and empty texts have no ids (an empty array) and decode to ''.  Very long texts are encoded whole; repeated rows
    and rows with a null id stay; an empty table gives no rows; extra columns are ignored.
    """
    source = small_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in lots(texts):
                ids, counts = encoder.encode(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
                more = [pa.array(encoder.tables.decode(ids, counts), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), lists, *more], names=names)

    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tables: ByteBpe, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of arrays of token ids; null arrays decode to ''."""
    source = small_batches(encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")))
    shared = encoded.sparkSession.sparkContext.broadcast(tables)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.array(x or [], np.int64) for x in b.column("ids").to_pylist()]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            texts = shared.value.decode(np.concatenate(each) if each else np.empty(0, np.int64), counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {kind}, text string")


def default_tables(spark: SparkSession, name: str = "byte_bpe_50k.json") -> ByteBpe:
    import public_tokenizers

    return load(public_tokenizers.path(name))
