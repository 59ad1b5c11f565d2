"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs of a learned rotation of their centred principal
components, of which several rotations give CODE_BITS bits. A code is split into
substrings, each with an index of its own. To find all codes within a Hamming radius r
of a query, pigeonhole: of m substrings one differs in at most r // m bits, some even in fewer, so probing
every substring's index at its small radius retrieves them all. What is retrieved and within r
is ranked by distance in double precision.

Index shards are bounded; a task reads a shard's rows, builds its index once and lets all queries
stream past it, and each shard gives its nearest, of which the nearest of all are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

CODE_BITS, SUB_BITS = 128, 8
#: The bounded sample that the rotations and the radius are learned from.
FIT_ROWS, FIT_QUERIES, ROUNDS, SEED = 4_000, 200, 12, 11
#: Share of the sample's true neighbours that must lie within the radius.
AIM = 0.97
#: Vectors of one dimension that the sample must hold to learn from them; the few of other dimensions are all compared.
LEAST_FIT = 64
#: Vectors in an index shard, about.
SHARD_ROWS = 16_384


def bits_of(codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes).sum(axis=-1)


class Hasher:
    """Iterative quantisation: principal components, then rotations that bring them close to corners of the cube."""

    def __init__(self, scale: float, mean: np.ndarray, turns: np.ndarray, radius: int = CODE_BITS):
        self.scale, self.mean, self.turns, self.radius = scale, mean, turns, radius

    @classmethod
    def fit(cls, sample: np.ndarray, k: int) -> Hasher:
        rng = np.random.default_rng(SEED)
        scale = float(np.abs(sample).max()) or 1.0
        x = sample / scale
        mean, d = x.mean(axis=0), x.shape[1]
        _, basis = np.linalg.eigh(np.cov((x - mean).T).reshape(d, d))
        turns: list[np.ndarray] = []
        while sum(t.shape[1] for t in turns) < CODE_BITS:
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            v = (x - mean) @ basis
            for _ in range(ROUNDS):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            turns.append(basis @ r)
        hasher = cls(scale, mean, np.hstack(turns)[:, :CODE_BITS])
        hasher.learn_radius(sample, k)
        return hasher

    def arrays(self) -> tuple:
        """Plain data: tasks need nothing of this package to read it."""
        return self.scale, self.mean, self.turns, self.radius

    def codes(self, x: np.ndarray) -> np.ndarray:
        """[row, substring] as unsigned numbers."""
        signs = (x / self.scale - self.mean) @ self.turns >= 0
        return np.packbits(signs, axis=1)

    def learn_radius(self, sample: np.ndarray, k: int) -> None:
        """The least radius within which AIM of the nearest of some of the sample lie, as they would in all data:
        the sample's own nearest are farther apart than theirs."""
        codes, sample = self.codes(sample), sample / self.scale
        norms = (sample**2).sum(axis=1)
        found = []
        for i in range(min(FIT_QUERIES, len(sample))):
            distance = norms - 2 * sample @ sample[i]
            distance[i] = np.inf
            near = np.argsort(distance)[: min(k, len(sample) - 1)]
            found.append(bits_of(codes[near] ^ codes[i]))
        if found and len(found[0]):
            self.radius = int(np.ceil(np.quantile(np.concatenate(found), AIM)))


class MultiIndex:
    """An index of each substring over the codes of a shard."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, codes.shape[1]
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(self.parts)]
        self.starts = [np.searchsorted(codes[o, j], np.arange((1 << SUB_BITS) + 1)) for j, o in enumerate(self.order)]

    def retrieved(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that probing finds, all rows whose codes differ from this one in at most radius bits among them.

        Of radius = parts * small + rest, either one of the first rest + 1 substrings differs in at most small bits, or one
        of the others in fewer: else there would be more than radius differences."""
        small, rest = divmod(radius, self.parts)
        seen = np.zeros(len(self.codes), bool)
        for j in range(self.parts):
            near = small if j <= rest else small - 1
            if near < 0:
                break
            keys = probe_masks(near) ^ code[j]
            first, last = self.starts[j][keys], self.starts[j][keys.astype(np.int64) + 1]
            full = last > first
            for a, b in zip(first[full].tolist(), last[full].tolist()):
                seen[self.order[j][a:b]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from this one in at most radius bits: all of them."""
        found = self.retrieved(code, radius)
        return found[bits_of(self.codes[found] ^ code) <= radius]


def probe_masks(radius: int) -> np.ndarray:
    """All substrings with at most radius bits set."""
    every = np.arange(1 << SUB_BITS).astype(np.uint8)
    return every[np.bitwise_count(every) <= radius]


def valid(col: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    bad = F.exists(col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return col.isNotNull() & (F.size(col) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(col, lambda v: v != 0)


class Shard:
    """The vectors of a shard, with their index."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hasher: Hasher | None):
        self.ids, self.vectors, self.hasher = ids, vectors, hasher
        self.index = MultiIndex(hasher.codes(vectors)) if hasher else None

    def candidates(self, query: int, code: np.ndarray | None, k: int) -> np.ndarray:
        if self.index is None:
            return np.flatnonzero(self.ids != query)
        radius = self.hasher.radius
        while True:
            found = self.index.within(code, radius)
            found = found[self.ids[found] != query]
            if len(found) >= k or radius >= CODE_BITS:
                return found
            radius = min(CODE_BITS, radius + 8)

    def nearest(self, queries: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each query its k nearest: ids and distances."""
        codes = self.hasher.codes(vectors) if self.hasher else [None] * len(queries)
        for query, vector, code in zip(queries.tolist(), vectors, codes):
            found = self.candidates(query, code, k)
            difference = self.vectors[found] - vector
            top = np.abs(difference).max(axis=1, initial=0.0)
            if top.max(initial=0.0) > 1e150:  # squares would overflow
                unit = np.where(top > 0, top, 1.0)
                scores = top * np.sqrt(((difference / unit[:, None]) ** 2).sum(axis=1))
            else:
                scores = np.sqrt((difference**2).sum(axis=1))
            best = np.lexsort((self.ids[found], scores))[:k]
            yield self.ids[found][best], scores[best]


def nearest(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that queries holds for, its k nearest other rows: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Nearest first, ties to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components, and rows without an id, take no part. Distances are between vectors of one dimension: those
    of another are no candidates. A candidate that is repeated counts each time but
    is never its own neighbour: rows with the query's id are left out. A query that is repeated, id and vector
    alike, is answered once; queries of one id and different vectors have k each, ranked apart. With fewer candidates all
    are returned; where a shard's codes within the radius are fewer than k, the radius grows until they aren't.
    An empty table, or no query, gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"), queries.alias("q")).filter(F.col("id").isNotNull() & valid(F.col("x")))
    sample: dict[int, list] = {}
    for row in rows.select("x", F.xxhash64("id", F.lit("ann")).alias("h"), "id").orderBy("h", "id").limit(FIT_ROWS).collect():
        sample.setdefault(len(row.x), []).append(row.x)
    held = spark.sparkContext.broadcast({d: Hasher.fit(np.array(x), k).arrays() for d, x in sample.items() if len(x) >= LEAST_FIT})
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    sized = rows.withColumn("d", F.size("x"))
    index = sized.select("d", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("long").alias("query"), F.lit(False).alias("asks"), "id", "x")
    asked = sized.filter("q").dropDuplicates(["id", "x"])
    asked = asked.select("d", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.xxhash64("id", "x").alias("query"), F.lit(True).alias("asks"), "id", "x")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = {d: Hasher(*arrays) for d, arrays in held.value.items()}
        key, parts, shard = None, [], None
        for batch in batches:
            d, number, query, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "shard", "query", "asks", "id"))
            edges = np.flatnonzero((d[1:] != d[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(d)]):
                if first == last:
                    continue
                if key != (d[first], number[first]):
                    key, parts, shard = (d[first], number[first]), [], None
                vectors = batch.column("x").slice(first, last - first).flatten().to_numpy(zero_copy_only=False).reshape(last - first, -1)
                if not asks[first]:
                    parts.append((ids[first:last], vectors))
                    continue
                if shard is None:
                    if not parts:
                        continue
                    shard, parts = Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), hashers.get(int(d[first]))), []
                out = list(shard.nearest(ids[first:last], vectors, k))
                sizes = [len(found) for found, _ in out]
                columns = [np.repeat(ids[first:last], sizes), np.repeat(query[first:last], sizes), np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query", "vec_id", "score"])

    dealt = index.unionByName(asked).repartition("d", "shard").sortWithinPartitions("d", "shard", "asks")
    found = dealt.mapInArrow(tidy(search), "query_id long, query long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
