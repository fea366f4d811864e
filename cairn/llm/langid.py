"""Language identification by bit-sliced Bloom filters of frequent n-grams.

Every language has a profile of its most frequent byte n-grams.  One table holds all filters: a slot is a word with a
bit for each language, so the AND of the few slots an n-gram hashes to is the mask of all languages that contain it.
A text's n-grams are looked up together; per-language popcounts, corrected for the filters' false positives, decide.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Length of n-grams in bytes, and how many of the most frequent ones make a language's profile.
PROFILES = {3: 600, 5: 20_000}
HASHES = 3
SLOT_BITS = 20
#: Rows that a training task gathers before it hands on partial counts.
GATHER = 1 << 20
UNDETERMINED = "und"
#: A document is kept if this part of its n-grams can be in the winner's profile.  Labelled prose of the test tables has
#: 0.74 or more, texts in languages without a profile up to 0.25, random letters under 0.05.
MIN_KNOWN = 0.3

_LETTER = re.compile(r"[^\W\d_]")
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def normal_bytes(text: str | None) -> bytes:
    """Lower-cased letters in words between single spaces; b'' if the text has no letter."""
    if not text:
        return b""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def packed(buf: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each position on as an integer; the n-gram length is in the top byte."""
    m = max(0, len(buf) - n + 1)
    v = np.full(m, n << 56, dtype=np.uint64)
    for k in range(n):
        v |= buf[k : k + m].astype(np.uint64) << np.uint64(8 * k)
    return v


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each between spaces and behind a zero byte, and where each begins."""
    lengths = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join(b"\0 " + t + b" " for t in texts), np.uint8)
    return buf, np.cumsum(lengths) - lengths


def crosses(buf: np.ndarray, n: int) -> np.ndarray:
    """Positions whose n-gram has the zero byte between two texts."""
    m = max(0, len(buf) - n + 1)
    out = np.zeros(m, dtype=bool)
    zero = buf == 0
    for k in range(n):
        out |= zero[k : k + m]
    return out


@dataclass
class LanguageFilters:
    languages: list[str]
    default: str
    table: np.ndarray  # (slots, words) of language bits
    false_rate: np.ndarray  # per language

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - SLOT_BITS)
        return [((grams * m) ^ (grams * m >> np.uint64(29))) * _MULTIPLIERS[0] >> shift for m in _MULTIPLIERS[:HASHES]]

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray], default: str) -> LanguageFilters:
        languages = sorted(profiles)
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        width = 8 * np.dtype(kind).itemsize
        table = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // width))), dtype=kind)
        out = cls(languages, default, table, np.zeros(len(languages)))
        for i, name in enumerate(languages):
            word, bit = divmod(i, width)
            for s in out.slots(profiles[name]):
                table[:, word] |= np.where(np.bincount(s.astype(np.int64), minlength=len(table)) > 0, kind(1 << bit), kind(0))
            out.false_rate[i] = ((table[:, word] >> kind(bit)) & kind(1)).mean() ** HASHES
        return out

    def masks(self, grams: np.ndarray) -> np.ndarray:
        first, *rest = self.slots(grams)
        out = self.table[first]
        for s in rest:
            out &= self.table[s]
        return out

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the corrected number of n-grams of each language, and the number of n-grams."""
        buf, starts = joined(texts)
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        width = 8 * self.table.dtype.itemsize
        for n in PROFILES:
            mask = self.masks(packed(buf, n))
            mask[crosses(buf, n)] = 0
            if not len(mask):
                continue
            cuts = np.minimum(starts, len(mask) - 1)
            for i in range(len(self.languages)):
                word, bit = divmod(i, width)
                one = ((mask[:, word] >> self.table.dtype.type(bit)) & self.table.dtype.type(1)).astype(np.uint8)
                hits[:, i] += np.add.reduceat(one, cuts, dtype=np.int64)
            total += np.maximum(0, np.fromiter((len(t) + 3 - n for t in texts), np.int64, len(texts)))
        corrected = (hits - total[:, None] * self.false_rate) / (1 - self.false_rate)
        return np.maximum(corrected, 0), total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the winner's part of its and the runner-up's count) and known part of the n-grams."""
        names = [UNDETERMINED] * len(texts)
        score, known = np.zeros(len(texts)), np.zeros(len(texts))
        has = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not has or not self.languages:
            return names, score, known
        counts, total = self.counts([normal_bytes(texts[i]) for i in has])
        best = counts.argmax(axis=1)
        top = counts[np.arange(len(has)), best]
        counts[np.arange(len(has)), best] = 0
        second = counts.max(axis=1)
        for k, i in enumerate(has):
            names[i] = self.languages[best[k]] if top[k] > 0 else self.default
            score[i] = top[k] / (top[k] + second[k]) if top[k] > 0 else 0.0
            known[i] = min(1.0, top[k] / max(1.0, total[k]))
        return names, score, known

    def identified(self, texts: list[str | None], min_known: float = MIN_KNOWN) -> tuple[list[str], np.ndarray]:
        """Language of each text, and whether it is trusted: of n n-grams at least min_known - 1 / sqrt(n) are known.

        The allowance of two standard deviations keeps texts that are too short to tell.
        """
        names, score, known = self.predict(texts)
        n = np.fromiter((sum(max(0, len(normal_bytes(t)) + 3 - k) for k in PROFILES) for t in texts), np.int64, len(texts))
        return names, (score > 0) & (known > min_known - 1 / np.sqrt(np.maximum(n, 1)))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): exact counts of all n-grams of all labelled texts, summed in the workers before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, counts = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(grams)
            grams, counts = grams[order], counts[order]
            cuts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            return grams[cuts], np.add.reduceat(counts, cuts)

        def out(lang: str) -> pa.RecordBatch:
            grams, counts = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

        for b in batches:
            texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                buf, _ = joined([normal_bytes(texts[i]) for i in np.flatnonzero(langs == lang)])
                parts = held.setdefault(lang, [])
                for n in PROFILES:
                    grams, counts = np.unique(packed(buf, n)[~crosses(buf, n)], return_counts=True)
                    parts.append((grams, counts))
                if len(parts) > 2 and sum(len(g) for g, _ in parts) > GATHER:
                    parts[:] = [merged(parts)]
                    if len(parts[0][0]) > GATHER:
                        yield out(lang)
        for lang in list(held):
            if any(len(g) for g, _ in held[lang]):
                yield out(lang)

    return labelled.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Profiles from all rows with a language and a text; what comes to the driver is bounded by PROFILES."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = gram_counts(small_batches(rows)).withColumn("length", F.shiftrightunsigned("gram", 56))
    order = Window.partitionBy("lang", "length").orderBy(F.col("n").desc(), "gram")
    room = F.create_map(*[F.lit(x) for pair in PROFILES.items() for x in pair])[F.col("length").cast("int")]
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(PROFILES.values())).where(F.col("rank") <= room)
    got = ranked.select("lang", "gram", "n").toPandas()
    profiles = {lang: g["gram"].to_numpy(np.int64).view(np.uint64) for lang, g in got.groupby("lang")}
    weight = got.groupby("lang")["n"].sum()
    return LanguageFilters.build(profiles, min(weight.index, key=lambda k: (-weight[k], k)) if len(weight) else UNDETERMINED)


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, known) of every whole text.

    lang_pred is `und`, with score 0, for null and empty texts and those without a letter; a text with letters but no
    known n-gram gets the most frequent language with score 0.  Very long texts are read whole; repeated rows and rows
    with a null id stay; an empty table gives no rows; extra columns are ignored.
    """
    source = small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # a table of 2 ** SLOT_BITS slots
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, known = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(known)], names=["doc_id", "lang_pred", "score", "known"])

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, known double")


def keep_identified(docs: DataFrame, min_known: float = MIN_KNOWN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, all columns, whose text has an identified language; a null language is set to the one found.

    Rejected are null, empty and letterless texts, texts without a known n-gram and those of which too few n-grams are
    in the winner's profile (`LanguageFilters.identified`): gibberish and languages that no row is labelled with.
    Whole texts are read, very long ones too.  Decided in the row itself, so neither ties nor repeated rows matter; an
    empty table, or one without any label, gives an empty result; columns of any name pass through.
    """
    filters = fit(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lang = names.index(text_col), names.index(lang_col)
        for b in batches:
            found, ok = shared.value.identified(b.column(at).to_pylist(), min_known)
            filled = pc.coalesce(b.column(lang), pa.array(found, pa.string()).cast(b.column(lang).type))
            yield b.set_column(lang, b.schema.field(lang), filled).filter(pa.array(ok))

    return small_batches(docs).mapInArrow(run, docs.schema)


def hash_remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def remainder(doc_id: object, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
