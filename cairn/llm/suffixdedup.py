"""Exact removal of repeated byte strings by longest previous factors over suffix order.

A byte goes if a string of LENGTH bytes that covers it also starts earlier.  The suffixes of all texts can't be sorted
in one place, so they are cut into families: a window of LENGTH bytes is filed under its minimizer (its k-gram of
lowest hash), which equal windows share.  Neighbouring windows with the same minimizer are one record.  Records of
equal content are settled by their order alone.  Families with different contents are sorted as suffixes; in suffix
order, the previous and next smaller positions tell whether the longest previous factor reaches LENGTH.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, splitmix, written

LENGTH = 100
GRAM = 32
#: Bytes of text that a worker handles together, and bytes of family contents that are sorted together.
LOT_BYTES = 1 << 20
SORT_BYTES = 1 << 20
#: Records of different content beyond which a family is settled window by window, over the whole cluster.
FAMILY_LIMIT = 20_000

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_SALT = 15  # bits of the text's hash that tell rows of the same id apart
_PLACE = 48  # bits below them for a position


def words_at(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as integers."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf),), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    n = len(buf) - GRAM + 1
    w = words_at(buf)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM // 8):
        h += w[8 * k : 8 * k + n] * _C[k]
    return splitmix(h)


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest hash of each `width` neighbours, the leftmost of equals."""
    n = len(h) - width + 1
    low, size = h, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    # the place is the first hash equal to the minimum at or behind the window's start
    place = np.full(n, -1, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    ends = np.r_[starts[1:], n]

    def settle(todo: np.ndarray) -> None:
        """First hash from each window's start on that is its minimum; mostly few rounds."""
        for k in range(width):
            if not len(todo):
                return
            hit = h[todo + k] == low[todo]
            place[todo[hit]] = todo[hit] + k
            todo = todo[~hit]

    settle(starts)
    place = place[np.repeat(starts, ends - starts)]
    settle(np.flatnonzero(place < np.arange(n)))  # the same minimum again, further right
    return place


def records(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, minimizer hash, first byte, size) of each run of windows with one minimizer, texts handled together."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < LENGTH:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none, none
    h = gram_hashes(buf)
    place = minimizers(h, LENGTH - GRAM + 1)
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(place)]
    at = np.flatnonzero(np.arange(len(place)) + LENGTH <= (begins + lengths)[owner])  # windows within one text
    starts = np.flatnonzero(np.r_[True, (place[at][1:] != place[at][:-1]) | (owner[at][1:] != owner[at][:-1])]) if len(at) else at
    ends = np.r_[starts[1:], len(at)]
    first = at[starts]
    return owner[first], h[place[first]], first - begins[owner[first]], ends - starts + LENGTH - 1


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges that are sorted by their start; ranges that touch become one."""
    if not len(starts):
        return starts, ends
    top = np.maximum.accumulate(ends)
    new = np.r_[True, starts[1:] > top[:-1]]
    return starts[new], top[np.r_[np.flatnonzero(new)[1:] - 1, len(top) - 1]]


def lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most LOT_BYTES characters together; a longer text is a lot of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > LOT_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def salt(data: bytes) -> int:
    """As salted_docs has it."""
    return xxhash.xxh64_intdigest(data, 42) >> (64 - _SALT)


_SCHEMA = pa.schema([("family", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("size", pa.int64())])
_DDL = "family bigint, content bigint, doc bigint, place bigint, size bigint"


def filed(docs: DataFrame) -> DataFrame:
    """Records of all texts.  Of equal records in a batch only the first is filed; the others are known to go and
    are handed on as merged ranges, marked by a negative size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_numpy(), b.column("text").to_pylist()
            fam, con, doc, plc, siz = [], [], [], [], []
            digest = xxhash.xxh64_intdigest
            for i, j in lots(texts):
                data = [t.encode("utf-8", "surrogatepass") for t in texts[i:j]]
                owner, f, s, n = records(data)
                if not len(f):
                    continue
                salts = np.fromiter(map(salt, data), np.int64, len(data)) << _PLACE
                fam.append(f)
                con.append(np.fromiter((digest(data[o][a : a + m]) for o, a, m in zip(owner.tolist(), s.tolist(), n.tolist())), np.uint64, len(s)))
                doc.append(ids[i:j][owner])
                plc.append(salts[owner] + s)
                siz.append(n)
            if not fam:
                continue
            fam, con, doc, plc, siz = (np.concatenate(x) for x in (fam, con, doc, plc, siz))
            o = np.lexsort((plc, doc, con))
            again = np.r_[False, (con[o[1:]] == con[o[:-1]]) & (fam[o[1:]] == fam[o[:-1]])]
            first = o[np.maximum.accumulate(np.where(again, 0, np.arange(len(o))))]
            twice = again & (doc[o] == doc[first]) & (plc[o] == plc[first])  # the same row of the table once more
            later = np.zeros(len(o), dtype=bool)
            later[o[again & ~twice]] = True
            once = np.ones(len(o), dtype=bool)
            once[o[twice]] = False
            d, p, n = doc[later], plc[later], siz[later]
            if len(d):
                key = np.lexsort((p, d))
                d, p, n = d[key], p[key], n[key]
                cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]).tolist()
                for x, y in zip(cuts, [*cuts[1:], len(d)]):
                    a, z = merged(p[x:y], p[x:y] + n[x:y])
                    yield pa.RecordBatch.from_arrays([pa.array(splitmix((a ^ d[x]).view(np.uint64)).view(np.int64)), pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), d[x])), pa.array(a), pa.array(a - z)], schema=_SCHEMA)
            k = ~later & once
            yield pa.RecordBatch.from_arrays([pa.array(fam[k].view(np.int64)), pa.array(con[k].view(np.int64)), pa.array(doc[k]), pa.array(plc[k]), pa.array(siz[k])], schema=_SCHEMA)

    return docs.mapInArrow(run, _DDL)


def settled(filed_rows: DataFrame) -> DataFrame:
    """Ranges that go (negative size) and records whose family has other contents too.

    One pass over the sorted families that holds a single row back, so a family of any size streams through.
    """
    rows = filed_rows.repartition("family").sortWithinPartitions("family", "content", "doc", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5), np.int64)  # the last first-of-its-content; whether it is emitted already
        told = False
        for b in batches:
            known = b.column("size").to_numpy() < 0
            if known.any():
                yield b.filter(pa.array(known)).cast(_SCHEMA)
                b = b.filter(pa.array(~known))
            if not b.num_rows:
                continue
            t = np.stack([b.column(c).to_numpy() for c in _SCHEMA.names], axis=1)
            with_held = np.concatenate([held, t])
            again = np.r_[False, (with_held[1:, 0] == with_held[:-1, 0]) & (with_held[1:, 1] == with_held[:-1, 1])]
            firsts = with_held[~again]
            same = firsts[1:, 0] == firsts[:-1, 0]
            need = np.r_[False, same] | np.r_[same, False]
            out = need.copy()
            if len(held):
                out[0] &= not told
            if len(out) > 1 or len(held):
                told = bool(need[-1]) or (len(firsts) == 1 and told)
            else:
                told = bool(need[-1])
            first = with_held[np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))]
            twice = (with_held[:, 2] == first[:, 2]) & (with_held[:, 3] == first[:, 3])  # the same row once more
            gone = with_held[again & ~twice].copy()
            gone[:, 4] *= -1
            both = np.concatenate([firsts[out], gone])
            # an emitted held row counts again for its family, so the row after it is seen as one of several
            held = firsts[-1:]
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, i]) for i in range(5)], schema=_SCHEMA)

    return rows.mapInArrow(run, _DDL)


def previous_factors(data: np.ndarray, order: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which valid positions have a longest previous factor of LENGTH or more.

    `order` ranks positions by (document, start).  Suffixes are sorted by their first LENGTH bytes, by prefix
    doubling; a position's factor reaches LENGTH if a previous or next suffix with the same first LENGTH bytes has a
    smaller rank, which the running minima from both sides of each run in suffix order show.
    """
    rank = np.unique(words_at(data), return_inverse=True)[1].astype(np.uint64)
    size = 8
    while 2 * size <= LENGTH:
        rank = np.unique(rank << np.uint64(32) | np.r_[rank[size:], np.zeros(min(size, len(rank)), np.uint64)], return_inverse=True)[1].astype(np.uint64)
        size *= 2
    step = LENGTH - size  # the last doubling overlaps
    at = np.flatnonzero(valid)
    key = rank[at] << np.uint64(32) | rank[at + step]
    suffix = np.argsort(key, kind="stable")
    key, pos = key[suffix], order[at[suffix]]
    run = np.cumsum(np.r_[True, key[1:] != key[:-1]])
    big = int(order.max(initial=0)) + 1
    before = np.minimum.accumulate(pos + (run[-1] - run) * big) - (run[-1] - run) * big  # least rank so far in the run
    after = (np.minimum.accumulate((pos + run * big)[::-1]))[::-1] - run * big
    out = np.zeros(len(data), dtype=bool)
    out[at[suffix[(before < pos) | (after < pos)]]] = True
    return out


def with_contents(needs: DataFrame, salted: DataFrame) -> DataFrame:
    """(family, doc, place, bytes): the records' bytes, fetched in one join with the texts."""
    per_doc = needs.groupBy("doc", F.shiftright("place", _PLACE).alias("salt")).agg(F.collect_list(F.struct("family", "place", "size")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fam, doc, plc, got = [], [], [], []
            for d, s, text, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "salt", "text", "wanted"))):
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    at = w["place"] - (s << _PLACE)
                    fam.append(w["family"]), doc.append(d), plc.append(w["place"]), got.append(data[at : at + w["size"]])
            yield pa.RecordBatch.from_arrays([pa.array(fam, pa.int64()), pa.array(doc, pa.int64()), pa.array(plc, pa.int64()), pa.array(got, pa.binary())], names=["family", "doc", "place", "bytes"])

    joined = salted.join(per_doc.withColumnRenamed("doc", "doc_id"), ["doc_id", "salt"])
    return joined.select("doc_id", "salt", "text", "wanted").mapInArrow(run, "family bigint, doc bigint, place bigint, bytes binary")


def salted_docs(docs: DataFrame) -> DataFrame:
    """Texts with their salt, by DataFrame functions only: both joins with the texts then share one exchange."""
    return docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 64 - _SALT).alias("salt"), "text")


_RANGE = "doc bigint, place bigint, size bigint"


def sorted_families(contents: DataFrame) -> DataFrame:
    """Ranges that go within families, by suffix order."""
    rows = contents.repartition("family").sortWithinPartitions("family").select("family", "doc", "place", "bytes")

    def settle(fam: np.ndarray, doc: np.ndarray, plc: np.ndarray, got: list[bytes]) -> pa.RecordBatch:
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((plc, doc))] = np.arange(len(doc))
        lens = np.fromiter(map(len, got), np.int64, len(got))
        data = np.frombuffer(b"".join(got), np.uint8)
        owner = np.repeat(np.arange(len(got)), lens)
        begin = np.cumsum(lens) - lens
        inside = np.arange(len(data)) - begin[owner]
        valid = inside + LENGTH <= lens[owner]
        # records overlap in their texts, so positions are ranked by document and start themselves
        where = plc[owner] + inside
        by = np.lexsort((where, doc[owner]))
        new = np.r_[True, (where[by][1:] != where[by][:-1]) | (doc[owner][by][1:] != doc[owner][by][:-1])]
        order = np.empty(len(data), np.int64)
        order[by] = np.cumsum(new)
        hit = np.flatnonzero(previous_factors(data, order, valid))
        runs = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]) if len(hit) else np.empty(0, np.int64)
        last = np.r_[runs[1:], len(hit)] - 1 if len(hit) else runs
        a = where[hit[runs]] if len(hit) else runs
        return pa.RecordBatch.from_arrays([pa.array(doc[owner[hit[runs]]] if len(hit) else runs), pa.array(a), pa.array(hit[last] - hit[runs] + LENGTH if len(hit) else runs)], names=["doc", "place", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("family", "doc", "place", "bytes"))):
                if size > SORT_BYTES and row[0] != held[-1][0]:
                    yield settle(*(np.array(x) for x in list(zip(*held))[:3]), [x[3] for x in held])
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield settle(*(np.array(x) for x in list(zip(*held))[:3]), [x[3] for x in held])

    return rows.mapInArrow(run, _RANGE)


def hot_families(contents: DataFrame) -> DataFrame:
    """Ranges that go within families of too many contents: the first of equal windows is a grouped minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, doc, plc = [], [], []
            for d, p, data in zip(*(b.column(c).to_pylist() for c in ("doc", "place", "bytes"))):
                for i in range(len(data) - LENGTH + 1):
                    key.append(xxhash.xxh128_digest(data[i : i + LENGTH])), doc.append(d), plc.append(p + i)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(plc, pa.int64())], names=["key", "doc", "place"])

    windows = contents.mapInArrow(run, "key binary, doc bigint, place bigint")
    first = windows.groupBy("key").agg(F.min(F.struct("doc", "place")).alias("first"))
    later = windows.join(first, "key").where(F.struct("doc", "place") > F.col("first"))
    return later.select("doc", "place", F.lit(LENGTH).cast("bigint").alias("size"))


def removed_ranges(docs: DataFrame, salted: DataFrame) -> DataFrame:
    """(doc, salt, ranges array<struct<a, z>>) of all texts with something to remove."""
    both = written(settled(filed(docs)))
    known = both.where("size < 0").select("doc", "place", (-F.col("size")).alias("size"))
    needs = both.where("size > 0").select("family", "doc", "place", "size")
    large = cut(needs.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > FAMILY_LIMIT).select("family"))
    if large.isEmpty():
        gone = known.unionByName(sorted_families(with_contents(needs, salted)))
    else:
        small = with_contents(needs.join(large, "family", "left_anti"), salted)
        hot = with_contents(needs.join(large, "family", "left_semi"), salted)
        gone = known.unionByName(sorted_families(small)).unionByName(hot_families(hot))
    base = F.shiftright("place", _PLACE)
    start = F.col("place") - F.shiftleft(base, _PLACE)
    return gone.groupBy("doc", base.alias("salt")).agg(F.collect_list(F.struct(start.alias("a"), (start + F.col("size")).alias("z"))).alias("ranges"))


def kept_bytes(data: bytes, ranges: list[dict] | None) -> tuple[bytes, int, int]:
    """What stays of a text, the bytes removed and the maximal removed runs."""
    if not ranges:
        return data, 0, 0
    pairs = np.array(sorted((r["a"], r["z"]) for r in ranges), dtype=np.int64)
    a, z = merged(pairs[:, 0], pairs[:, 1])
    kept = b"".join(data[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(data)]))
    return kept, int((z - a).sum()), len(a)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row.

    Ids are integers.  Null texts count as empty; texts shorter than LENGTH keep everything; rows with a null id are
    neither searched nor matched; rows of the same id and text are one document, rows of the same id and other texts
    are ordered by a hash of the text; very long texts are searched whole; an empty table gives no rows; extra columns
    are ignored.
    """
    source = small_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    salted = salted_docs(source)
    ranges = removed_ranges(source.where("doc_id is not null"), salted)
    joined = salted.join(ranges.withColumnRenamed("doc", "doc_id"), ["doc_id", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            kept, gone, spans = zip(*(kept_bytes(t, r) for t, r in zip(texts, b.column("ranges").to_pylist()))) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return joined.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
