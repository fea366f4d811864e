"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint bit is the majority of that bit over the hashes of all word shingles of a text.  Distinct fingerprints
are sorted by Gray rank; neighbours in that order share long masked bit patterns, which upper nodes of the index hold.
A search carries the differences accumulated on the way down and leaves a whole group as soon as they exceed the
radius.  The index is cut over executors by bit fields that two near fingerprints must share (of three fields and two
differing bits, one field is equal); fields that hold too many fingerprints are subdivided by the same rule over the
bits that are left, three times at most.  Distinct fingerprints that share three fields share 44 of 64 bits at least,
so no route can hold more than 2 ** 20 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.components import connected_components

from .common import ascii_words, cut, id_text, small_batches, splitmix, written

SEED = 42
#: A route with more distinct fingerprints than this is subdivided by further bits.
ROUTE_LIMIT = 4096
#: Entries of a leaf; groups up to this size are one leaf, which is scanned.
LEAF = 32
FANOUT = 8
#: Queries that go down the index together.
QUERY_BLOCK = 2048

#: bit of a byte -> its own byte lane of a 64-bit word, most significant bit in the highest lane
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """XXH64 (seed 42) of every run of `width` words, repeats included; fewer words: of the whole sequence."""
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)]
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(flat[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of consecutive runs of hashes, counts[i] of them each: a bit is set in over half."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    pieces = -(-n // 255)  # a byte lane counts to 255
    piece_of = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(piece_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = starts[piece_of] + nth * 255
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    totals = np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0)  # lane i counts bit i
    bits = (2 * totals > n[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_arrays(texts: list[str | None], width: int, words: int = 1) -> np.ndarray:
    """(len(texts), words) array of 64-bit fingerprint words; further words mix the same hashes again."""
    each = [shingle_hashes(ascii_words(t), width) for t in texts]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
    out = np.empty((len(texts), words), dtype=np.uint64)
    for k in range(words):
        out[:, k] = majority_bits(flat if k == 0 else splitmix(flat + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)), counts)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp bigint): the fingerprint of every whole text; null and wordless texts have fingerprint zero."""
    source = small_batches(id_text(docs, id_col, text_col))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprint_arrays(b.column("text").to_pylist(), width)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {kind}, fp bigint")


def gray_rank(x: Column) -> Column:
    """Position of a bit string in Gray order (as bits; used for order only)."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fields(free: int, parts: int) -> list[int]:
    """Cut the set bits of `free` into `parts` masks."""
    bits = [i for i in range(63, -1, -1) if free >> i & 1]
    return [sum(1 << i for i in chunk) for chunk in (list(map(int, c)) for c in np.array_split(bits, parts))]


def route_tree(radius: int, levels: int = 3) -> list[dict[int, list[int]]]:
    """For each level the masks of a route and the wider masks that replace it where it is too full."""
    full, tree, front = (1 << 64) - 1, [], [0]
    for _ in range(levels):
        step = {m: [m | f for f in _fields(full & ~m, radius + 1)] for m in front}
        tree.append(step)
        front = [m for v in step.values() for m in v]
    return tree


def routes(distinct: DataFrame, radius: int, limit: int = ROUTE_LIMIT) -> DataFrame:
    """(mask, value, fp): every pair of fingerprints within the radius meets in one route at least."""
    tree = route_tree(radius)
    masks = lambda ms: F.array(*[F.lit(_signed(m)).cast("bigint") for m in ms])
    rows = distinct.select("fp", F.explode(masks(tree[0][0])).alias("mask"))
    rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    for level in tree[1:]:
        full = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        full = cut(full.select("mask", "value", F.lit(True).alias("full")))
        if full.isEmpty():
            break
        marked = rows.join(full, ["mask", "value"], "left")
        deeper = F.create_map(*[x for m, v in level.items() for x in (F.lit(_signed(m)).cast("bigint"), masks(v))])
        split = marked.where("full").select("fp", F.explode(deeper[F.col("mask")]).alias("mask"))
        split = split.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        rows = marked.where("full is null").select("fp", "mask", "value").unionByName(split)
    return rows


class GrayIndex:
    """Hierarchical index over rows of 64-bit words that are already in Gray order."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows  # (n, w)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up: patterns, masks of shared bits
        pattern, mask = rows, np.full_like(rows, np.uint64(2**64 - 1))
        size = LEAF
        while True:
            cuts = np.arange(0, len(pattern), size)
            both = np.bitwise_and.reduceat(pattern & mask, cuts, axis=0)
            none = np.bitwise_and.reduceat(~pattern & mask, cuts, axis=0)
            pattern, mask = both, both | none
            self.levels.append((pattern, mask))
            if len(pattern) == 1:
                break
            size = FANOUT

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, row number) within the radius."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        above = np.zeros_like(queries)
        acc = np.zeros(len(queries), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            fresh = mask[node] & ~above  # bits shared here that no node above has counted
            acc = acc + np.bitwise_count((queries[q] ^ pattern[node]) & fresh).sum(axis=1, dtype=np.int64)
            keep = acc <= radius
            q, node, acc = q[keep], node[keep], acc[keep]
            above = mask[node]
            fan = FANOUT if depth else LEAF
            below = len(self.levels[depth - 1][0]) if depth else len(self.rows)
            child = node[:, None] * fan + np.arange(fan)
            ok = child < below
            wide = np.repeat(np.arange(len(q)), fan).reshape(-1, fan)[ok]
            q, acc, above, node = q[wide], acc[wide], above[wide], child[ok]
        acc = acc + np.bitwise_count((queries[q] ^ self.rows[node]) & ~above).sum(axis=1, dtype=np.int64)
        keep = acc <= radius
        return q[keep], node[keep]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links a-b as (member, smallest member)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            parent.setdefault(min(x, y), min(x, y))
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def group_links(rows: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers within the radius inside each run of equal `group`; small runs are one leaf each."""
    n = len(rows)
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.array([], np.int64)
    sizes = np.diff(np.r_[cuts, n])
    small = np.repeat(sizes <= LEAF, sizes)
    for k in range(1, int(min(LEAF, sizes.max(initial=1)))):
        i = np.flatnonzero(small[:-k] & (group[:-k] == group[k:]))
        d = np.bitwise_count(rows[i] ^ rows[i + k]).sum(axis=1, dtype=np.int64)
        i = i[d <= radius]
        if len(i):
            yield i, i + k
    for at, size in zip(cuts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
        index = GrayIndex(rows[at : at + size])
        for q0 in range(0, size, QUERY_BLOCK):
            q, r = index.search(rows[at + q0 : at + min(size, q0 + QUERY_BLOCK)], radius)
            later = r > q + q0
            if later.any():
                yield at + q0 + q[later], at + r[later]


def links(distinct: DataFrame, radius: int = 2, limit: int = ROUTE_LIMIT) -> DataFrame:
    """(a, b): a spanning forest, per partition, of the links between distinct fingerprints within the radius."""
    routed = routes(distinct, radius, limit)
    routed = routed.repartition("mask", "value").withColumn("rank", gray_rank(F.col("fp")))
    routed = routed.sortWithinPartitions("mask", "value", "rank").select("mask", "value", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the route that a batch broke off

        def found(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.r_[True, (table[1:, :2] != table[:-1, :2]).any(axis=1)]
            fp = table[:, 2].view(np.uint64)
            for i, j in group_links(np.ascontiguousarray(fp)[:, None], np.cumsum(change), radius):
                tied = forest(table[i, 2], table[j, 2])
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in tied], "b": [y for _, y in tied]}, schema=schema)

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "fp")], axis=1)
            if not len(table):
                continue
            last = np.flatnonzero((table[:, :2] != table[-1, :2]).any(axis=1))
            at = int(last[-1]) + 1 if len(last) else 0
            if at == 0 and (not held or (held[0][0, :2] == table[0, :2]).all()):
                held.append(table)  # the same route goes on
                continue
            yield from found(np.concatenate([*held, table[:at]]))
            held = [table[at:]]
        if held:
            yield from found(np.concatenate(held))

    return routed.mapInArrow(run, "a bigint, b bigint")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, limit: int = ROUTE_LIMIT
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Two fingerprints are linked at `radius` or fewer differing bits; component_id is the smallest doc_id that links
    reach.  Null, empty and wordless texts have fingerprint zero and are linked like any other; repeated rows stay
    repeated; a null doc_id keeps its row and never names a component unless nothing else is in it; very long texts are
    read whole; extra columns are ignored; an empty table gives an empty result.
    """
    signed = cut(fingerprints(docs, id_col, text_col, width))
    leads = signed.groupBy("fp").agg(F.min("doc_id").alias("lead"))
    roots = connected_components(links(leads.select("fp"), radius, limit))
    classed = cut(leads.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root")))
    heads = classed.groupBy("root").agg(F.min("lead").alias("component_id"))
    named = classed.join(heads, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return signed.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# Near copies by similarity: wide fingerprints in Gray-order indexes, exact Jaccard at the end.

#: Fingerprint words of 64 bits.
WIDE = 4
#: A pair meets in a route if all the smallest hashes of one band are equal: at a similarity of 0.8 in 98.5 of 100 cases.
BANDS = 8
BAND_ROWS = 4
#: Standard deviations above the mean distance at the similarity that still count as near.
SLACK = 4.0
#: Rounds in which the members of a route are tied to a central one; what they leave apart is searched exactly.
ROUNDS = 4
#: Rows of routes that are tied together, and members and queries of a unit of exact search: the bound of a worker's memory.
TIE_ROWS = 2**15
UNIT_ROWS = 2048
#: Pairs whose shingles are counted together.
CANDIDATES = 2**12


def bit_difference(similarity: float) -> float:
    """Expected share of differing bits of two sets with this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def near_radius(similarity: float) -> int:
    """Differing bits of wide fingerprints up to which a pair counts as near."""
    share = bit_difference(similarity)
    return int(64 * WIDE * share + SLACK * np.sqrt(64 * WIDE * share * (1 - share)))


def band_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(sets, BANDS) routes of consecutive sets of hashes: of each band the smallest hashes under BAND_ROWS orders; none for empty sets.

    The orders are those of the upper 32 bits times odd factors.
    """
    factors = np.random.default_rng(SEED).integers(0, 2**31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flat = (flat >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    keys = np.zeros((len(starts), BANDS), dtype=np.uint64)
    if len(starts):
        for k, factor in enumerate(factors):
            least = np.minimum.reduceat(flat * factor, starts).astype(np.uint64)
            keys[:, k // BAND_ROWS] = splitmix(keys[:, k // BAND_ROWS] ^ least)
    return keys + np.arange(BANDS, dtype=np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; much faster than numpy's own for short arrays."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def text_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hash of each text's word sequence, and the sorted distinct hashes of its runs of `width` words.

    A word is hashed once, and the hashes of a run are put together as a polynomial, all texts at a time.  Texts of
    fewer words have the whole sequence as their only run, wordless ones none.
    """
    words = [ascii_words(t) for t in batch.column("text").to_pylist()]
    same = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w)) for w in words), np.uint64, len(words)).view(np.int64)
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    runs = np.zeros(max(0, len(flat) - width + 1), dtype=np.uint64)
    for k in range(width):
        runs *= np.uint64(0x9E3779B97F4A7C15)
        runs += flat[k : k + len(runs)]
    runs = splitmix(runs)
    sets = []
    for start, n, whole in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), same.view(np.uint64)):
        sets.append(distinct(runs[start : start + n - width + 1]) if n >= width else np.array([whole] if n else [], dtype=np.uint64))
    return same, sets


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, held, same, size, f0.., keys) of every row: hashes of the text and of its word sequence, the number of
    distinct shingles, the fingerprint words of the set of shingles, and its routes."""
    source = small_batches(id_text(docs, id_col, text_col).withColumn("held", F.xxhash64("text")))
    kind = source.schema["doc_id"].dataType.simpleString()
    prints = [f"f{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, sets = text_sets(b, width)
            counts = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            wide = [majority_bits(flat if k == 0 else splitmix(flat + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)), counts) for k in range(WIDE)]
            keys = band_keys(flat, counts)
            ends = np.concatenate(([0], np.cumsum(counts > 0) * BANDS)).astype(np.int32)
            routes = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))
            columns = [b.column("doc_id"), b.column("held"), pa.array(same), pa.array(counts), *(pa.array(x.view(np.int64)) for x in wide), routes]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held", "same", "size", *prints, "keys"])

    return source.mapInArrow(run, f"doc_id {kind}, held bigint, same bigint, size bigint, " + ", ".join(f"{f} bigint" for f in prints) + ", keys array<bigint>")


def shingle_sets(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(same, grams): the sorted shingle hashes, 32 bits each, of those texts; `texts` names one row of `docs` each, by id and text hash."""
    source = id_text(docs, id_col, text_col).withColumn("held", F.xxhash64("text"))
    source = small_batches(source.join(texts.select("doc_id", "held"), ["doc_id", "held"], "left_semi").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, sets = text_sets(b, width)
            grams = [distinct((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(same), pa.array(grams, pa.binary())], names=["same", "grams"])

    return source.mapInArrow(run, "same bigint, grams binary").dropDuplicates(["same"])


def tie_to_central(group: np.ndarray, rows: np.ndarray, same: np.ndarray, radius: int) -> np.ndarray:
    """For each row of wide fingerprints the row it is tied to, -1 if to none.

    `group` is ascending.  In each round the member nearest to the majority of its group's open rows takes in what is
    near to it: copies are nearest to what they were copied from.  All groups go through a round together.
    """
    hub = np.full(len(rows), -1, dtype=np.int64)
    for _ in range(ROUNDS):
        at = np.flatnonzero(hub < 0)
        if not len(at):
            break
        own = rows[at]
        cuts = np.flatnonzero(np.r_[True, group[at][1:] != group[at][:-1]])
        sizes = np.diff(np.r_[cuts, len(at)])
        run = np.repeat(np.arange(len(cuts)), sizes)
        sums = np.add.reduceat(np.unpackbits(own.view(np.uint8), axis=1), cuts, axis=0, dtype=np.int32)
        centre = np.packbits(2 * sums > sizes[:, None], axis=1).view(np.uint64)
        away = np.bitwise_count(own ^ centre[run]).sum(axis=1, dtype=np.int64)
        order = np.lexsort((same[at], away, run))
        chosen = order[np.searchsorted(run, np.arange(len(cuts)))]
        near = np.bitwise_count(own ^ own[chosen][run]).sum(axis=1, dtype=np.int64) <= radius
        hub[at[near]] = at[chosen[run[near]]]
    return hub


def tied_routes(texts: DataFrame, radius: int) -> DataFrame:
    """(route, same, hub): the members of every route with two or more texts, and the central member each is tied to, if any.

    Routes are dealt out by range of (route, same), so that a route of any number of texts is spread; its parts get
    hubs of their own.
    """
    names = ["route", "same", *(f"f{k}" for k in range(WIDE))]
    routed = texts.select(F.explode("keys").alias("route"), *names[1:])
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = routed.repartitionByRange(parts, "route", "same").sortWithinPartitions("route")

    def tied(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.r_[True, table[1:, 0] != table[:-1, 0]]) - 1
        ends = (group == 0) | (group == group[-1])  # may go on elsewhere
        at = np.flatnonzero(ends | (np.bincount(group)[group] > 1))
        hub = tie_to_central(group[at], np.ascontiguousarray(table[at, 2:]).view(np.uint64), table[at, 1], radius)
        yield pa.RecordBatch.from_arrays([pa.array(table[at, 0]), pa.array(table[at, 1]), pa.array(table[at[hub], 1], mask=hub < 0)], names=["route", "same", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in names], axis=1))
            if sum(map(len, held)) >= TIE_ROWS:
                table = np.concatenate(held)
                last = np.flatnonzero(table[:, 0] != table[-1, 0])
                at = int(last[-1]) + 1 if len(last) else len(table)
                yield from tied(table[:at])
                held = [table[at:]]
        table = np.concatenate(held) if held else np.empty((0, 0))
        if len(table):
            yield from tied(table)

    return routed.mapInArrow(run, "route bigint, same bigint, hub bigint")


def similar_pairs(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity): the pairs whose shingle sets really are so similar."""
    both = pairs.join(grams.select(F.col("same").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("same").alias("b"), F.col("grams").alias("gb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                near.append(common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.float64())], names=["a", "b", "similarity"])

    return both.mapInArrow(run, "a bigint, b bigint, similarity double").where(F.col("similarity") >= similarity)


def search_units(members: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(route, i, j, home, same, root, size, f0..): routes that hold several components, cut into units of bounded size.

    The members of a route's largest component are asked for, the others ask (home false) and are asked for: so a
    family that is united costs nothing, and one that is united but for a few texts only their comparison with all.
    Every query meets every member in one unit.
    """
    rows = members.join(roots.withColumnRenamed("node", "same"), "same", "left").select("route", "same", F.coalesce("root", "same").alias("root"))
    shares = rows.groupBy("route", "root").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("route").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("roots"))
    mixed = mixed.where("roots > 1").drop("roots")
    rows = rows.join(mixed, "route").join(texts.select("same", "size", *(f"f{k}" for k in range(WIDE))), "same")
    cut_into = lambda n: F.ceil(n / UNIT_ROWS).cast("int")
    part = lambda n: F.pmod(F.xxhash64("same"), n).cast("int")
    rows = rows.withColumn("asks", cut_into(F.col("n") - F.col("most"))).withColumn("blocks", cut_into(F.col("n")))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rest = ["same", "root", "size", *(f"f{k}" for k in range(WIDE))]
    asked = rows.select("route", up_to(F.col("asks")).alias("i"), part(F.col("blocks")).alias("j"), F.lit(True).alias("home"), *rest)
    asking = rows.where("root <> largest").select("route", part(F.col("asks")).alias("i"), up_to(F.col("blocks")).alias("j"), F.lit(False).alias("home"), *rest)
    return asked.unionByName(asking)


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units from batches that are sorted by unit."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        unit = np.stack([table.column(c).to_numpy() for c in ("route", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1).tolist(), len(table)]
        for a, z in zip(cuts, cuts[1:]):
            piece = table.slice(a, z - a)
            if held and any(held[0].column(c)[0] != piece.column(c)[0] for c in ("route", "i", "j")):
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_tables(held)


def unit_candidates(unit: pa.Table, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (query, member) of different components whose fingerprints are near and whose sizes allow the similarity."""
    home = unit.column("home").to_numpy()
    same, root, size = (unit.column(c).to_numpy() for c in ("same", "root", "size"))
    rows = np.stack([unit.column(f"f{k}").to_numpy() for k in range(WIDE)], axis=1).view(np.uint64)
    rank = rows[:, 0].copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    asks, members = np.flatnonzero(~home), np.flatnonzero(home)
    if not len(asks) or not len(members):
        return
    members = members[np.argsort(rank[members], kind="stable")]
    index, twice = GrayIndex(rows[members]), np.isin(same[members], same[asks])
    block = max(1, CANDIDATES * LEAF // len(members))
    for at in range(0, len(asks), block):
        q, r = index.search(rows[asks[at : at + block]], radius)
        q, other, r = asks[at + q], twice[r], members[r]
        ok = (root[q] != root[r]) & (~other | (same[q] < same[r])) & (np.minimum(size[q], size[r]) >= similarity * np.maximum(size[q], size[r]))
        if ok.any():
            yield q[ok], r[ok]


def unit_links(unit: pa.Table, radius: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of `similarity` between the components of a unit."""
    same, root = unit.column("same").to_numpy(), unit.column("root").to_numpy().copy()
    sets = [np.frombuffer(x, np.uint32) for x in unit.column("grams").to_pylist()]
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    shingles, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts, marked, found = np.cumsum(counts) - counts, np.zeros(len(shingles), dtype=bool), []
    for qs, rs in unit_candidates(unit, radius, similarity):
        for q in np.unique(qs).tolist():
            own = flat[starts[q] : starts[q] + counts[q]]
            marked[own] = True
            for r in np.array_split(rs[qs == q], -(-int((qs == q).sum()) // CANDIDATES)):
                r = r[root[r] != root[q]]
                if not len(r):
                    continue
                n = counts[r]
                cuts = np.cumsum(n) - n
                common = np.add.reduceat(marked[flat[np.repeat(starts[r] - cuts, n) + np.arange(int(n.sum()))]], cuts, dtype=np.int64)
                for k in r[common >= similarity * (counts[q] + n - common)].tolist():
                    if root[k] != root[q]:
                        found.append((int(same[q]), int(same[k])))
                        root[root == root[k]] = root[q]
            marked[own] = False
    return found


def links_between(units: DataFrame, grams: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): links that unite components within the units; shingles go to the rows only that have a near partner."""
    fields = ["route", "i", "j", "home", "same", "root", "size", *(f"f{k}" for k in range(WIDE))]
    dealt = lambda df: df.repartition("route", "i", "j").sortWithinPartitions("route", "i", "j")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in whole_units(batches):
            partner = np.zeros(len(unit), dtype=bool)
            for q, r in unit_candidates(unit, radius, similarity):
                partner[q] = partner[r] = True
            if partner.any():
                yield from unit.filter(pa.array(partner)).combine_chunks().to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in whole_units(batches):
            found = unit_links(unit, radius, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    units = units.select(fields)
    near = dealt(units).mapInArrow(close, units.schema).join(grams, "same").select(*fields, "grams")
    return dealt(near).mapInArrow(verify, "a bigint, b bigint")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each group of near copies: that of the smallest id.

    Groups are what links of `similarity` or more between sets of `width`-word shingles connect; texts with the same
    words are always one group, and so are all null, empty and wordless texts.  Rows of the same id and words stay or go
    together, those of one id with different words are different documents; rows with a null id stay; an empty table
    stays empty; very long texts are compared whole; columns of any name pass through.

    Texts that share all the smallest shingle hashes of a band meet in a route.  There each is first tied to a central
    one, and ties that hold are components.  Routes that still hold several are searched through the Gray-order index,
    and all that is near across components is compared, in the worker: no pair leaves it but a link that unites two.
    """
    prints = cut(wide_fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width))
    radius, words = near_radius(similarity), [f"f{k}" for k in range(WIDE)]
    texts = cut(prints.groupBy("same").agg(F.min(F.struct("doc_id", "held")).alias("head"), *[F.first(c).alias(c) for c in ("size", *words, "keys")]))
    members = cut(tied_routes(texts, radius))
    met = members.select("same").distinct().join(texts.select("same", "head.*"), "same")
    grams = written(shingle_sets(docs, met, id_col, text_col, width))
    ties = members.where("hub is not null").select("route", "same", "hub")
    hubs = ties.groupBy("route", "hub").agg(F.count("*").alias("n")).where("n > 1")
    first = hubs.groupBy("route").agg(F.min("hub").alias("first"))
    pairs = ties.select("same", "hub").unionByName(hubs.join(first, "route").select(F.col("hub").alias("same"), F.col("first").alias("hub")))
    pairs = pairs.where("same <> hub").select(F.least("same", "hub").alias("a"), F.greatest("same", "hub").alias("b")).distinct()
    links = cut(similar_pairs(pairs, grams, similarity).select("a", "b"))
    roots = connected_components(links)
    rest = cut(links_between(search_units(members.select("route", "same"), texts, roots), grams, radius, similarity).distinct())
    if not rest.isEmpty():
        roots = connected_components(links.unionByName(rest))
    classed = texts.select("same", F.col("head.doc_id").alias("lead")).join(roots.withColumnRenamed("node", "same"), "same", "left").select("same", F.coalesce("root", "same").alias("root"), "lead")
    heads = classed.groupBy("root").agg(F.min(F.struct("lead", "same")).alias("head"))
    headed = classed.join(heads, "root").select("same", "head")
    gone = prints.select("doc_id", "held", "same").join(headed, "same").where((F.col("doc_id") != F.col("head.lead")) | (F.col("same") != F.col("head.same")))
    gone = cut(gone.select(F.col("doc_id").alias("__gone"), "held").distinct())
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["held"]), "left_anti").select(docs.columns)
