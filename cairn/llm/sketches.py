"""Threshold-scaled document fingerprints, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range.  Because the threshold does not depend on
the document, sketches merge by set union and estimate containment between documents of very unequal length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_text

WIDTH = 5
#: Kept part of the hash range as a power of two: 2 keeps a quarter.
FRACTION_BITS = 2
#: Rows that a run of neighbouring doc_ids should have, and the number of runs that a table is divided into at most at
#: a time; a larger table gets larger runs.  A run is sorted by Spark's own sort, which spills.
RUN_ROWS = 1024
MAX_RUNS = 10_000
#: Runs of more than so many times their share are divided again by their own range of ids, in so many rounds at most
#: (ids in clusters within clusters); so there are fewer than ROUNDS * 2 * MAX_RUNS runs, and their heads are broadcast.
OVERFULL = 4
ROUNDS = 8

_LOWEST = -(1 << 63)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def shingle_hash_array(words: Column, width: int = WIDTH) -> Column:
    """XXH64 of every run of `width` words; fewer words: of the whole sequence; none: an empty array."""
    runs = F.transform(words, lambda w, i: F.when(i <= F.size(words) - width, F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, width)))))
    short = F.array(F.xxhash64(F.concat_ws(" ", words)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) <= width, short).otherwise(F.array_compact(runs))


def below_threshold(hashes: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    return F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - fraction_bits) == 0) if fraction_bits else hashes


def sketch_of(hashes: Column, below: Column) -> Column:
    """Sorted distinct hashes below the threshold, of all hashes and those below.

    If none is below it, the lowest hash alone stands in, so that a short text has a fingerprint too; `merge` drops
    stand-ins as soon as one side has a proper hash.
    """
    lowest = F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_LOWEST)))).bitwiseXOR(F.lit(_LOWEST))
    return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).when(F.size(hashes) > 0, F.array(lowest)).otherwise(hashes)


def merge(a: Column, b: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """Sketch of two documents together."""
    both = F.array_union(a, b)
    return sketch_of(both, below_threshold(both, fraction_bits))


def as_string(sketch: Column) -> Column:
    return F.concat_ws("", F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two texts without words are alike, one without words is like no other."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a that b holds, 0 to 1."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def with_sketch(df: DataFrame, text_col: str, out: str, width: int = WIDTH, fraction_bits: int = FRACTION_BITS) -> DataFrame:
    """Add the sketch of a text column as array<bigint>.  Each step is a column of its own, so none is computed twice."""
    w, h, kept = f"__{out}_words", f"__{out}_hashes", f"__{out}_below"
    df = df.withColumn(w, words_of(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn(h, shingle_hash_array(F.col(w), width)).drop(w)
    df = df.withColumn(kept, below_threshold(F.col(h), fraction_bits))
    return df.withColumn(out, sketch_of(F.col(h), F.col(kept))).drop(h, kept)


def with_runs(rows: DataFrame) -> DataFrame:
    """Add `run` (array<bigint>), which orders as doc_id does and holds about RUN_ROWS neighbouring ids; null ids: the lowest.

    Even parts of the range of ids come first; parts that turn out overfull (ids that lie in clusters, or one far id)
    are divided by their own range, down to single ids.  Differences are exact decimals, so ids may use all 64 bits.
    """
    exact = lambda c: c.cast("decimal(20,0)")

    def part(lo: Column, hi: Column, n: Column) -> Column:
        share = (exact(F.col("doc_id")) - exact(lo)).cast("double") / (exact(hi) - exact(lo) + 1).cast("double")
        return F.array(F.least(F.floor(share * n), n - 1).cast("bigint"))

    span = rows.agg(F.min("doc_id").cast("string").alias("lo"), F.max("doc_id").cast("string").alias("hi"), F.count("*").alias("n")).first()
    target = max(RUN_ROWS, -(-span.n // MAX_RUNS))
    first = F.when(F.col("doc_id").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(part(F.lit(span.lo), F.lit(span.hi), F.lit(max(1, -(-span.n // target)))))
    ids, rows = rows.select("doc_id", first.alias("run")), rows.withColumn("run", first)
    for _ in range(ROUNDS):
        sums = ids.groupBy("run").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
        full = cut(sums.where((F.col("n") > OVERFULL * target) & (F.col("lo") < F.col("hi"))).select("run", "lo", "hi", F.ceil(F.col("n") / target).alias("parts")))
        if full.isEmpty():
            break
        deeper = F.when(F.col("parts").isNull(), F.col("run")).otherwise(F.concat("run", part(F.col("lo"), F.col("hi"), F.col("parts"))))
        divide = lambda df: df.join(F.broadcast(full), "run", "left").withColumn("run", deeper).drop("lo", "hi", "parts")  # noqa: B023, E731
        ids, rows = divide(ids), divide(rows)
    return rows


def with_next(docs: DataFrame, columns: list[str], derive=lambda df: df, derived: tuple[str, ...] = ()) -> DataFrame:
    """Add next_<c> for the given columns: the row with the next smaller doc_id; after the last row the first.

    `derive` adds the `derived` columns to each row once, before the rows are dealt out; they get a next_<c> as well.

    Rows are dealt to runs of neighbouring ids; a run is ordered by itself and gets a copy of the first row of the run
    that follows, so the texts are shuffled once and no task orders the whole table.  Ties and null ids (last) are
    ordered by the hash of all columns.
    """
    rows = with_runs(docs.select("doc_id", *columns))
    rows = rows.select("doc_id", *columns, "run", F.xxhash64("doc_id", *columns).alias("tie"), F.lit(False).alias("copy"))
    first = F.max(F.struct("doc_id", (-F.col("tie")).alias("tie"))).alias("first")
    heads = rows.groupBy("run").agg(first)
    before = Window.orderBy(F.col("run").desc())  # over a row for each run, bounded by MAX_RUNS
    lowest = F.last("run").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = cut(heads.select(F.col("run").alias("h_run"), F.col("first.doc_id").alias("h_id"), (-F.col("first.tie")).alias("h_tie"), F.coalesce(F.lag("run").over(before), lowest).alias("h_to")))
    is_head = F.expr("run = h_run and doc_id <=> h_id and tie = h_tie")
    copies = rows.join(F.broadcast(heads), is_head).select("doc_id", *columns, F.col("h_to").alias("run"), "tie", F.lit(True).alias("copy"))
    order = Window.partitionBy("run").orderBy(F.col("copy"), F.col("doc_id").desc_nulls_last(), F.col("tie"))
    columns = [*columns, *derived]
    led = derive(rows.unionByName(copies)).select("doc_id", *columns, "copy", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("copy")).drop("copy")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, fraction_bits: int = FRACTION_BITS) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and their likeness.

    Null texts count as empty, and an empty text keeps an empty fingerprint; the edited text replaces the last
    floor(n_chars / 2) code points by the first as many of the next document in descending doc_id.  Ids are integers of
    up to 64 bits; rows with a null id stand behind all others.  A table of one row is its own next document; repeated
    rows stay, equal ids are ordered by a hash of their row; an empty table gives no rows; extra columns are ignored.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer column: documents are ordered by it")
    base = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    led = with_next(base, ["text"], lambda df: with_sketch(df, "text", "sketch", width, fraction_bits), ("sketch",))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    led = led.withColumn("n_chars", n.cast("bigint"))
    led = led.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    led = with_sketch(led.drop("text", "next_text"), "edited", "edited_sketch", width, fraction_bits)
    return led.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
