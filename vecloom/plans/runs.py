"""Tables of runs: configuration grids, feasibility, resuming, summaries and paired speed-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, axes: dict[str, tuple[str, list]]) -> DataFrame:
    """All combinations of axes (name: type and values): a row is unfolded axis by axis, so there is nothing to join."""
    out = spark.range(1).drop("id")
    for name, (kind, values) in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values)).cast(f"array<{kind}>")).alias(name))
    return out


def sweep(grid: DataFrame, d0: int, k0: int) -> DataFrame:
    """d at the pivot k, and k at the pivot d, the pivot once."""
    return grid.filter((F.col("k") == k0) | (F.col("d") == d0))


def feasible(runs: DataFrame, budget: int) -> DataFrame:
    """runs with need (bytes) and verdict: run, subsample to n_max rows, or infeasible."""
    need = 12 * F.col("n") * F.col("d") + 8 * F.col("n") * F.col("k") + 44 * F.col("n")
    most = F.floor(F.lit(budget) / (12 * F.col("d") + 8 * F.col("k") + 44)).cast("long")
    verdict = F.when(F.col("k") >= F.col("n"), "infeasible").when(F.col("need") <= budget, "run").when(F.col("n_max") > F.col("k"), "subsample").otherwise("infeasible")
    return runs.withColumn("need", need.cast("long")).withColumn("n_max", most).withColumn("verdict", verdict)


def to_do(runs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return runs.join(results, keys, "left_anti")


def summary(results: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median, least and largest value, spread and count of each group."""
    v = F.col(value)
    return results.groupBy(group).agg(F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("largest"), (F.max(v) - F.min(v)).alias("spread"), F.count("*").alias("n"))


def upper_middle(results: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Of each group without its first row: median as the upper middle element, least and largest."""
    rows = results.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("r"))
    rest = F.array_sort(F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda s: s[value]))
    rows = rows.select(group, rest.alias("v")).filter(F.size("v") > 0)
    return rows.select(group, F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("middle"), F.array_min("v").alias("least"), F.array_max("v").alias("largest"))


def speedups(results: DataFrame, shape: list[str], method: str, cost: str, baseline: str) -> DataFrame:
    """Each method's row with its shape's baseline: shape, method, speedup."""
    base = results.filter(F.col(method) == baseline).select(*shape, F.col(cost).alias("base"))
    return results.filter(F.col(method) != baseline).join(base, shape).select(*shape, method, (F.col("base") / F.col(cost)).alias("speedup"))


def least_of_repeats(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of each configuration's repeats, which may be interleaved with others', the least value, and their number."""
    return results.groupBy(*keys).agg(F.min(value).alias("least"), F.count("*").alias("repeats"))


def upsert(manifest: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return manifest.join(rows, key, "left_anti").unionByName(rows).orderBy(key)
