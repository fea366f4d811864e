"""Tab-separated logs, traces, symbol dumps and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.identity import address_of
from cairn.operators.chain import first_break, genesis_hash

# The columns of each log before its chain hash.
COLUMNS = {
    "experiment": ("iteration", "fitness", "stability", "cycle_ms", "status", "params_json", "description"),
    "evidence": ("timestamp", "operation", "input_hash", "output_hash"),
    "ledger": ("seq", "timestamp", "operation", "actor", "input", "output"),
}
_TYPES = {"iteration": "bigint", "fitness": "double", "stability": "double", "cycle_ms": "bigint", "timestamp": "bigint", "seq": "bigint"}
STATUSES = ("pass", "fail", "inconclusive")


class ChainError(ValueError):
    """A log whose rows don't fit their chain."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of the lines behind the header, blank ones left out but counted.

    Large files are read in splits.  Spark numbers the lines within each split, and the splits' line counts, a few
    numbers on the driver, give where each one begins.
    """
    read = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    split, nth = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    read = read.select(split.alias("split"), nth.alias("nth"), F.regexp_replace("value", "\r$", "").alias("line"))
    begins, start = [], 0
    for r in read.groupBy("split").agg(F.count("*").alias("n")).orderBy("split").collect():  # one row a split of the file
        begins += [F.lit(r["split"]), F.lit(start)]
        start += r.n
    if not begins:
        return spark.createDataFrame([], "pos bigint, line string")
    numbered = read.select((F.create_map(*begins)[F.col("split")] + F.col("nth")).cast("bigint").alias("pos"), "line")
    return numbered.where("pos > 0 and trim(line) <> ''")


def read_log(spark: SparkSession, path: str, log: str, verify: bool = True) -> DataFrame:
    """Rows of a log with pos (their order), row (the hashed text) and chain_hash.

    The header and blank lines are skipped.  Short rows and parameters that are no JSON raise, and so does a broken
    chain unless `verify` is off.
    """
    lines = numbered_lines(spark, path)
    cells = F.split("line", "\t")
    names = COLUMNS[log]
    short = lines.where(F.size(cells) < len(names) + 1).agg(F.min("pos")).first()[0]
    if short is not None:
        raise ValueError(f"{path}: line {short + 1} has too few columns")
    out = lines.select("pos", F.regexp_extract("line", r"(?s)^(.*)\t[^\t]*$", 1).alias("row"), *[F.get(cells, F.lit(i)).try_cast(_TYPES.get(c, "string")).alias(c) for i, c in enumerate(names)], F.try_element_at(cells, F.lit(-1)).alias("chain_hash"))
    if log == "experiment":
        out = out.withColumn("status", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("inconclusive")).withColumn("params", F.from_json("params_json", "map<string,double>"))
        bad = out.where("params is null").agg(F.min("pos")).first()[0]
        if bad is not None:
            raise ValueError(f"{path}: line {bad + 1} has a bad params_json")
    if verify and (at := first_break(out, genesis_hash(log))) is not None:
        raise ChainError(f"Chain integrity failure at line {at + 1} of {path}")
    return out


def tail(log: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The last n rows, in order."""
    return log.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """(caller, callee, count) of a trace with a header; rows with fewer columns or a count that is no number are dropped."""
    raw = spark.read.option("sep", "\t").option("header", True).schema("caller string, callee string, count string, duration string").csv(path)
    return raw.where("callee is not null and try_cast(count as double) is not null").select("caller", "callee", "count")


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path, symbol, role, line) of a JSON array of documents; any role but definition is a reference."""
    schema = "relative_path string, occurrences array<struct<symbol: string, role: string, line: bigint>>"
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    o = docs.select("relative_path", F.explode("occurrences").alias("o"))
    return o.select("relative_path", "o.symbol", F.when(F.col("o.role") == "definition", "definition").otherwise("reference").alias("role"), "o.line")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(address, vector, model, timestamp) of a JSON array; addresses are hashed."""
    raw = spark.read.schema("address string, vector array<float>, model string").option("multiLine", True).json(path)
    return raw.select(address_of("address").alias("address"), "vector", "model", F.unix_millis(F.current_timestamp()).alias("timestamp"))
