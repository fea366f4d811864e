"""Semi-naive iteration: the one loop behind propagation, traversal and depth."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoint import cut, cut_counted

#: Rows of a frontier up to which it is broadcast (about 150 bytes each); beyond it Spark picks the join.
BROADCAST_ROWS = 100_000
#: Rounds after which the appended changes are put together.
COMPACT = 8


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Rows that every round reads, computed once; lost blocks are computed again from the input."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def laid(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out and sorted by a key, once: joins by it, in however many rounds, shuffle their other side only."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


@contextmanager
def every_round(steps: DataFrame, key: str, held: bool = False) -> Iterator[DataFrame]:
    """Steps for the rounds of a loop, kept and laid by the key; as they are where the caller holds them so."""
    if held:
        yield steps
    else:
        with kept(laid(steps, key)) as steps:
            yield steps


def frontier(df: DataFrame, rows: int) -> DataFrame:
    """The frontier with a broadcast hint where its counted size is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def best_products(edges: DataFrame, seeds: DataFrame, attenuation: float = 1.0, threshold: float = 0.0, max_hops: int | None = None, held_edges: bool = False) -> DataFrame:
    """(root, node, score): the largest product of confidences over all paths from each seed.

    `edges` has (src, dst, c) and `seeds` (root, node, score).  A step scores least(1, score * c * attenuation) and is
    dropped below the threshold.  Only rows that improved go on, so the work follows the changes, and the least upper
    bound is unique on cyclic graphs too.  Zero scores are kept but lead nowhere.  With `held_edges` the caller keeps the
    edges, laid by src, and they are not laid again.

    Changes are appended, so a round writes what it changed and not what is known; a small set of candidates is looked
    up in the known rows by a scan, without a shuffle of them.
    """
    keys, top = ["root", "node"], F.max("score").alias("score")
    delta, rows = cut_counted(seeds.groupBy(*keys).agg(top))
    held, hop = [delta], 0
    with every_round(edges.select(F.col("src").alias("node"), "dst", (F.col("c") * F.lit(float(attenuation))).alias("c")), "node", held_edges) as steps:
        while rows and (max_hops is None or hop < max_hops):
            moved = frontier(delta.where("score > 0"), rows).join(steps, "node")
            cand = moved.select("root", F.col("dst").alias("node"), F.least(F.lit(1.0), F.col("score") * F.col("c")).alias("score")).where(F.col("score") >= threshold)
            cand, found = cut_counted(cand.groupBy(*keys).agg(top))
            old = together(held).join(frontier(cand.select(*keys), found), keys, "left_semi").groupBy(*keys).agg(F.max("score").alias("old"))
            delta, rows = cut_counted(cand.join(old, keys, "left").where("old is null or score > old").select(*keys, "score"))
            if rows:
                held.append(delta)
            if len(held) > COMPACT:
                held = [cut(together(held).groupBy(*keys).agg(top))]
            hop += 1
    return held[0] if len(held) == 1 else together(held).groupBy(*keys).agg(top)


def breadth_first(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, min_confidence: float = 0.0, held_edges: bool = False) -> DataFrame:
    """(root, node, hop, confidence, parent) of every node that is reached, roots at hop 0; without a depth, all of them.

    A node is visited at its first hop; of several arrivals the one with the largest product and then the smallest
    parent counts.  Arrivals under the least confidence are pruned and don't mark the node as visited.  `with_paths`
    puts the parents together.  `held_edges` as in `best_products`.
    """
    keys = ["root", "node"]
    start = roots.select(F.col("node").alias("root"), "node").distinct()
    delta, rows = cut_counted(start.select(*keys, F.lit(0).alias("hop"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("parent")))
    held, hop = [delta], 0
    with every_round(edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), "c"), "parent", held_edges) as steps:
        while rows and (max_depth is None or hop < max_depth):
            hop += 1
            front = delta.select("root", F.col("node").alias("parent"), F.col("confidence").alias("upto"))
            cand = frontier(front, rows).join(steps, "parent").withColumn("confidence", F.col("upto") * F.col("c")).where(F.col("confidence") >= min_confidence)
            order = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), "parent")
            cand, found = cut_counted(cand.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*keys, F.lit(hop).alias("hop"), "confidence", "parent"))
            seen = together(held).select(*keys).join(frontier(cand.select(*keys), found), keys, "left_semi")
            delta, rows = cut_counted(cand.join(seen, keys, "left_anti"))
            if rows:
                held.append(delta)
            if len(held) > COMPACT:
                held = [cut(together(held))]
    return together(held)


def with_paths(visited: DataFrame) -> DataFrame:
    """`visited` with path, the nodes from the root on, by one join for each hop; only rows of that hop take part."""
    visited = cut(visited)
    deepest = visited.agg(F.max("hop")).first()[0] or 0
    level = visited.where("hop = 0").withColumn("path", F.array("node"))
    out = [level]
    for hop in range(1, deepest + 1):
        up = level.select("root", F.col("node").alias("parent"), F.col("path").alias("way"))
        level = cut(visited.where(F.col("hop") == hop).join(up, ["root", "parent"]).withColumn("path", F.concat("way", F.array("node"))).drop("way"))
        out.append(level)
    return together(out)


def path_to(visited: DataFrame, goal: str) -> list[tuple[int, str, str]]:
    """(hop, parent, node) from the root to a goal: the rows of one path, looked up from its end."""
    out, at = [], goal
    while at is not None:
        row = visited.where(F.col("node") == at).select("hop", "parent").first()
        if row is None or row.parent is None:
            break
        out.append((row.hop, row.parent, at))
        at = row.parent
    return out[::-1]


def longest_levels(edges: DataFrame, roots: DataFrame, held_edges: bool = False) -> DataFrame:
    """(node, level): the longest path from any root; on cycles, and behind them, a node's level is its first hop.

    Topological order is the order of (level, node).  A node is placed once all edges into it have been used up, which
    a count of them tells; a round touches only the edges of the nodes it has placed.  `held_edges` as in `best_products`.
    """
    with every_round(edges.select("src", "dst"), "src", held_edges) as edges:
        first = cut(breadth_first(edges.withColumn("c", F.lit(1.0)), roots.select("node"), held_edges=True).groupBy("node").agg(F.min("hop").alias("first")))
        inner = edges.join(first.select(F.col("node").alias("src")), "src", "left_semi").where("src <> dst").select("src", "dst").distinct()
        return _placed(inner, first)


def _placed(inner: DataFrame, first: DataFrame) -> DataFrame:
    with kept(inner) as inner:
        into = cut(inner.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("edges")))
        level, rows = cut_counted(first.join(into, "node", "left_anti").select("node", F.lit(0).alias("level")))
        done, waiting, k = [level], None, 0
        while rows:
            k += 1
            used = frontier(level.select(F.col("node").alias("src")), rows).join(inner, "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("used"))
            used = used if waiting is None else used.unionByName(waiting).groupBy("node").agg(F.sum("used").alias("used"))
            counted = cut(used.join(into, "node"))
            waiting = counted.where("used < edges").select("node", "used")
            level, rows = cut_counted(counted.where("used = edges").select("node", F.lit(k).alias("level")))
            if rows:
                done.append(level)
            if len(done) > COMPACT:
                done = [cut(together(done))]
    placed = together(done)
    rest = first.join(placed.select("node"), "node", "left_anti").select("node", F.col("first").alias("level"))
    return placed.unionByName(rest)
