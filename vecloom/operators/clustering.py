"""Nearest centroids, centroid updates, Lloyd iterations and their measures.

Points are rows (id, x array<double>); centroids are rows (cid, c array<double>). Centroids are
one constant of a row's expressions where they are few enough, which is checked; with
more, points meet them block by block, each a broadcast row. Points are never shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.functions import vectors as V

#: Values of all centroids that one constant may hold; with more they are dealt in blocks of so many.
BLOCK_VALUES = 1_000_000
#: Rows that a sort with a limit gathers in one place.
SORTED = 100_000


@dataclass(frozen=True)
class Params:
    """max_iter iterations, fewer where the centroids move less than tol (0: never); theta: the reliability test's
    factor; max_macs: products of a multiword fit; cond3, cond6, cascade: the exclusion tests; accum: fp32 or fp16."""

    max_iter: int = 100
    tol: float = 0.0
    theta: float = 2.5
    max_macs: int = 3
    cond3: bool = True
    cond6: bool = True
    cascade: bool = False
    accum: str = "fp32"

    def __post_init__(self):
        if self.max_iter < 1 or self.tol < 0 or self.theta <= 0 or self.max_macs not in (1, 2, 3) or self.accum not in ("fp32", "fp16"):
            raise ValueError(f"not valid: {self}")


def initial_centroids(points: DataFrame, k: int) -> DataFrame:
    """The k points of least id, numbered in that order."""
    return _numbered(points.orderBy("id").limit(k))


def seeded_centroids(points: DataFrame, k: int, seed: int) -> DataFrame:
    """k points that a seed chooses (those of least md5 of id and seed), numbered in order of id; an error with fewer than k."""
    chosen = points.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(k)
    found = _numbered(chosen)
    if found.count() != k:
        raise ValueError(f"fewer than {k} points")
    return found


def given_centroids(rows: DataFrame, k: int, shift: float = 0.0) -> DataFrame:
    """Centroids from rows (id, x) in the points' own frame, moved by shift, numbered in order of id; an error if they aren't k."""
    n = rows.count()
    if n != k:
        raise ValueError(f"{n} centroids are given, but k is {k}")
    return _numbered(rows.withColumn("x", V.add(F.col("x"), shift)))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows: k of them."""
    return rows.select((F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("cid"), F.col("x").alias("c"))


def subsample(points: DataFrame, m: int) -> DataFrame:
    """Exactly m rows (all, if fewer): those of least md5 of their id, by id.

    Up to SORTED rows by one sort with a limit. More by two passes: rows are counted by the first 16 bits of the hash, whole counts
    are taken as they are, and only rows of the count that m falls into are sorted."""
    rank = F.md5(F.col("id").cast("string"))
    if m <= SORTED:
        return points.orderBy(rank, "id").limit(m).orderBy("id")
    bits = F.conv(F.substring(rank, 1, 4), 16, 10).cast("int")
    counts = {r.b: r.n for r in points.groupBy(bits.alias("b")).agg(F.count("*").alias("n")).collect()}  # at most 65,536 rows
    taken, edge = 0, -1
    for b in sorted(counts):
        if taken + counts[b] > m:
            edge = b
            break
        taken += counts[b]
    if edge < 0:
        return points.orderBy("id")
    last = points.filter(bits == edge).orderBy(rank, "id").limit(m - taken)
    return points.filter(bits < edge).unionByName(last).orderBy("id")


def with_centroids(points: DataFrame, centroids: DataFrame, *extra: Column) -> DataFrame:
    """points with all centroids as one array cs of (cid, c, n2 and extra), in order of cid; an error where they are too many for one constant."""
    blocks = centroid_blocks(points.sparkSession, centroids, *extra)
    if len(blocks) > 1:
        raise ValueError(f"more than {BLOCK_VALUES} centroid values: use them block by block")
    return points.withColumn("cs", blocks[0])


def centroid_blocks(spark: SparkSession, centroids: DataFrame, *extra: Column) -> list[Column]:
    """Arrays of (cid, c, n2 and extra) in order of cid, each of BLOCK_VALUES values at most, or of one centroid.

    An array is a constant of the plan, so rows don't carry it. The k centroids come to the driver for it, as in iterations."""
    row = F.struct("cid", "c", V.norm2(F.col("c")).alias("n2"), *extra).alias("s")
    listed = centroids.select(row)
    kind = listed.schema["s"].dataType.simpleString()
    blocks, held = [], []
    for r in sorted(listed.collect(), key=lambda r: r.s.cid):  # k rows
        value = r.s.asDict(recursive=True)
        if held and (len(held) + 1) * len(value["c"]) > BLOCK_VALUES:
            blocks.append(held)
            held = []
        held.append(value)
    return [F.from_json(F.lit(json.dumps(b)), f"array<{kind}>") for b in [*blocks, held]]


def nearest_of(points: DataFrame, blocks: list[Column], price: Callable[[Column], Column]) -> DataFrame:
    """points with best: the least of the structs that price makes of centroids, over all blocks."""
    best = None
    for cs in blocks:
        mine = F.array_min(F.transform(cs, price))
        best = mine if best is None else F.array_min(F.array(best, mine))
    return points.withColumn("best", best)


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, x, cid and dist (squared distance less the point's own norm) of the nearest centroid; ties to the smaller cid."""
    x = F.col("x")
    priced = nearest_of(points, centroid_blocks(points.sparkSession, centroids), lambda s: F.struct((s["n2"] - 2 * V.dot(x, s["c"])).alias("dist"), s["cid"].alias("cid")))
    return priced.select("id", "x", F.col("best.cid").alias("cid"), F.col("best.dist").alias("dist"))


def cluster_sums(assigned: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """cid, n, s: of each cluster the number of its points, and the sums of their positions, then of the extra columns.

    A task gives one row for each centroid that it met, so k rows a task are shuffled, not points."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column("cid").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1)
            if extra:
                x = np.hstack([x, *(batch.column(c).to_numpy()[:, None] for c in extra)])
            names, which = np.unique(cid, return_inverse=True)
            order = np.argsort(which, kind="stable")
            counts = np.bincount(which)
            totals = np.add.reduceat(x[order], np.cumsum(counts) - counts, axis=0)
            for name, n, total in zip(names.tolist(), counts.tolist(), totals):
                old = held.get(name)
                held[name] = [n, total] if old is None else [old[0] + n, old[1] + total]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([t for _, t in held.values()], pa.list_(pa.float64()))], names=["cid", "n", "s"])

    parts = assigned.select(F.col("cid").cast("int").alias("cid"), "x", *(F.col(c).cast("double").alias(c) for c in extra)).mapInArrow(sums, "cid int, n long, s array<double>")
    placed = parts.select("cid", "n", F.posexplode("s").alias("pos", "v")).groupBy("cid", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return placed.groupBy("cid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("s"))


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """cid, c, moved2 (squared movement): means of the assigned points; an empty cluster keeps its centroid."""
    rows = cluster_sums(assigned).select("cid", F.transform("s", lambda v: v / F.col("n")).alias("new"))
    both = centroids.join(rows, "cid", "left").withColumn("new", F.coalesce("new", "c"))
    return both.select("cid", F.col("new").alias("c"), V.direct_distance(F.col("new"), F.col("c")).alias("moved2"))


def inertia(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    near = assigned.join(F.broadcast(centroids.select("cid", "c")), "cid")
    return near.agg(F.sum(V.direct_distance(F.col("x"), F.col("c"))).alias("inertia"))


@dataclass
class Fit:
    """assigned: before the last update; centroids: after it; work: counters summed over all iterations."""

    assigned: DataFrame
    centroids: DataFrame
    iterations: int
    work: dict[str, int] = field(default_factory=dict)


def fit(points: DataFrame, centroids: DataFrame, params: Params, step: Callable[[DataFrame, DataFrame], DataFrame] = assign, counters: tuple[str, ...] = ()) -> Fit:
    """Iterations of step (points and centroids to id, x, cid and the counters' columns) and update.

    Stops after max_iter, or, with tol > 0, when the whole block of centroids moved less than tol; never for labels that
    stay. An iteration is one pass over the points: sums and counters are taken in the same job. Only the k
    centroids come to the driver, so no iteration's plan holds the one before."""
    spark = points.sparkSession
    again = params.max_iter > 1 and not points.is_cached
    if again:  # read once; what doesn't fit in memory is on the executors' disks, and lost parts are read again
        points = points.select("id", "x").persist(StorageLevel.MEMORY_AND_DISK)
    work = dict.fromkeys(counters, 0)
    held = {r.cid: np.array(r.c) for r in centroids.select("cid", "c").collect()}
    for done in range(1, params.max_iter + 1):
        assigned = step(points, centroids)
        moved2 = 0.0
        for r in cluster_sums(assigned, counters).collect():
            width = len(held[r.cid])
            new = np.array(r.s[:width]) / r.n
            moved2 += float(((new - held[r.cid]) ** 2).sum())
            held[r.cid] = new
            for name, value in zip(counters, r.s[width:]):
                work[name] += int(value)
        centroids = spark.createDataFrame([(cid, c.tolist()) for cid, c in sorted(held.items())], "cid int, c array<double>")
        if params.tol > 0 and moved2 < params.tol**2:
            break
    if again:
        points.unpersist()
    return Fit(assigned, centroids, done, work)


def lloyd(points: DataFrame, centroids: DataFrame, params: Params, step=assign) -> tuple[DataFrame, DataFrame, int]:
    """Assignments before the last update, centroids after it, and iterations."""
    found = fit(points, centroids, params, step)
    return found.assigned, found.centroids, found.iterations


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id").groupBy("la", "lb").agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> float:
    """Share of rows that greedy matching of labels by mass pairs up; ties to the first in order of la, lb. table has a row for each pair of labels."""
    rows = table.collect()
    every, matched, used_a, used_b = sum(r.n for r in rows), 0, set(), set()
    for r in sorted(rows, key=lambda r: (-r.n, r.la, r.lb)):
        if r.la not in used_a and r.lb not in used_b:
            used_a.add(r.la)
            used_b.add(r.lb)
            matched += r.n
    return matched / every if every else 0.0
