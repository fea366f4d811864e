"""Statistics of experiments, graphs and workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranks around a percentile, as a share of all rows, that are ordered to find it.
AROUND = 0.002


def nearest_percentile(df: DataFrame, value: str, p: float, out: str) -> DataFrame:
    """One row: the value at rank round((n - 1) * p), not interpolated; 0 over no rows.

    An approximate percentile brackets the rank, exact counts check the bracket, and only the distinct values inside it
    are ordered.
    """
    v = df.where(F.col(value).isNotNull())
    n, bracket = v.agg(F.count("*"), F.percentile_approx(value, [max(0.0, p - AROUND), min(1.0, p + AROUND)], 10_000)).first()
    if not n:
        return df.sparkSession.createDataFrame([(0.0,)], f"{out} double")
    rank = int((n - 1) * p + 0.5)
    below, upto = v.agg(F.count_if(F.col(value) < bracket[0]), F.count_if(F.col(value) <= bracket[1])).first()
    if below <= rank < upto:
        v, rank = v.where(F.col(value).between(*bracket)), rank - below
    counts = v.groupBy(value).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return upto.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)).select(F.col(value).cast("double").alias(out))


def summary(df: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """One row: min, max, mean, median, population deviation and 90th percentile; zeros over no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    v = F.col(value)
    base = df.agg(
        F.count(v).alias(f"{prefix}count"), zero(F.min(v)).alias(f"{prefix}min"), zero(F.max(v)).alias(f"{prefix}max"), zero(F.avg(v)).alias(f"{prefix}mean"), zero(F.stddev_pop(v)).alias(f"{prefix}std")
    )
    half, p90 = nearest_percentile(df, value, 0.5, f"{prefix}median"), nearest_percentile(df, value, 0.9, f"{prefix}p90")
    return base.crossJoin(F.broadcast(half)).crossJoin(F.broadcast(p90))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation; null under two rows or without variance."""
    return F.when(F.count("*") >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def parameter_correlations(runs: DataFrame, params: str = "params", fitness: str = "fitness") -> DataFrame:
    """(parameter, correlation) of each map key with the fitness; keys without variance are left out."""
    each = runs.select(F.col(fitness).alias("__f"), F.explode(params).alias("parameter", "__v"))
    return each.groupBy("parameter").agg(pearson("__v", "__f").alias("correlation")).where("correlation is not null")


#: Iterations of a block of a single log; a block is ordered by one task.
BLOCK_ROWS = 100_000


def improvements(runs: DataFrame, order: str = "iteration", fitness: str = "fitness", run: str | None = None) -> DataFrame:
    """Rows with improved: over all earlier fitness of the same run (the first counts).

    A single run is cut into blocks of iterations; the best of all blocks before one, a row each, is carried into it.
    """
    earlier = lambda w: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if run:
        best = F.max(fitness).over(earlier(Window.partitionBy(run)))
        return runs.withColumn("improved", best.isNull() | (F.col(fitness) > best))
    blocked = runs.withColumn("__block", F.floor(F.col(order) / BLOCK_ROWS))
    tops = blocked.groupBy("__block").agg(F.max(fitness).alias("__top"))
    carried = tops.select("__block", F.max("__top").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    near = blocked.withColumn("__near", F.max(fitness).over(earlier(Window.partitionBy("__block")))).join(carried, "__block")
    best = F.greatest("__near", "__carried")  # nulls are skipped
    return near.withColumn("improved", best.isNull() | (F.col(fitness) > best)).drop("__block", "__near", "__carried")


def convergence_rate(runs: DataFrame, order: str = "iteration", fitness: str = "fitness", run: str | None = None) -> DataFrame:
    """Share of rows that improve on the best so far; 0 over no rows."""
    marked = improvements(runs, order, fitness, run)
    rate = F.coalesce(F.avg(F.col("improved").cast("double")), F.lit(0.0)).alias("convergence_rate")
    return marked.groupBy(run).agg(rate) if run else marked.agg(rate)


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "inconclusive")])


def experiment_report(runs: DataFrame) -> DataFrame:
    """One row: statistics of fitness and stability, status counts and convergence."""
    out = summary(runs, "fitness", "fitness_").crossJoin(summary(runs, "stability", "stability_"))
    return out.crossJoin(status_counts(runs)).crossJoin(convergence_rate(runs))


def graph_density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges for each node, at most 1; 0 for an empty graph."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e).select("nodes", "edges", F.when(F.col("nodes") == 0, 0.0).otherwise(F.least(F.col("edges") / F.col("nodes"), F.lit(1.0))).alias("density"))


def overlay_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(overlay, nodes, edges) of tables with an overlay column."""
    n = nodes.groupBy("overlay").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("overlay").agg(F.count("*").alias("edges"))
    return n.join(e, "overlay", "full_outer").select("overlay", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def evidence_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("provenance.actor").alias("actor")).agg(F.count("*").alias("edges"))


def repository_coverage(repositories: DataFrame, links: DataFrame) -> DataFrame:
    """Federated edges over ordered pairs of repositories; parallel edges count, so it can pass 1."""
    r, e = repositories.agg(F.count("*").alias("n")), links.agg(F.count("*").alias("edges"))
    return r.crossJoin(e).select(F.when(F.col("n") < 2, 0.0).otherwise(F.col("edges") / (F.col("n") * (F.col("n") - 1))).alias("coverage"))
