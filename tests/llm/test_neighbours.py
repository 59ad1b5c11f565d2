"""Neighbour search over several shards and dimensions, and its index, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from vecloom.llm import ann


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (1, 16), dtype=np.uint8)
    flips = np.packbits(rng.random((900, 128)) < rng.random((900, 1)) * 0.5, axis=1)
    index = ann.MultiIndex(np.concatenate([base ^ flips, rng.integers(0, 256, (300, 16), dtype=np.uint8)]))
    for radius in (0, 1, 5, 15, 16, 17, 31, 40, 57, 90, 128):
        for code in (base[0], index.codes[7], rng.integers(0, 256, 16, dtype=np.uint8)):
            gaps = np.unpackbits(index.codes ^ code, axis=1).sum(axis=1)
            assert np.array_equal(index.within(code, radius), np.flatnonzero(gaps <= radius))


def clustered(rng, rows, dimension):
    centres = rng.normal(size=(40, dimension))
    return centres[rng.integers(0, 40, rows)] + 0.15 * rng.normal(size=(rows, dimension))


def plain(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_several_shards_and_dimensions(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    rng = np.random.default_rng(5)
    x, y = clustered(rng, 2500, 24), rng.normal(size=(30, 5))
    ids, more = np.arange(2500), np.arange(5000, 5030)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(int(i), v.tolist()) for i, v in zip(more, y)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = plain(ids, x, range(0, 2500, 50), 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) | {5000} and hits >= 0.9 * 10 * len(want)
    assert all(len(f) == 10 and f == sorted(f, key=lambda p: (p[1], p[0])) for f in got.values())
    few = plain(more, y, [5000], 10)[5000]
    assert [i for i, _ in got[5000]] == [i for i, _ in few] and np.allclose([s for _, s in got[5000]], [s for _, s in few], rtol=1e-14)


def test_an_index_prunes_vectors_that_have_clusters():
    rng = np.random.default_rng(7)
    x = clustered(rng, 6000, 24)
    hasher = ann.Hasher.fit(x[:2000], 10)
    index = ann.MultiIndex(hasher.codes(x))
    assert np.mean([len(index.within(c, hasher.radius)) for c in index.codes[:50]]) < 0.1 * len(x)


def test_no_query_and_no_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<double>")
    assert ann.nearest(df, F.lit(False)).count() == 0 and ann.nearest(df.filter("vec_id = 2"), F.lit(True)).count() == 0 and ann.nearest(df, F.lit(True)).count() == 0
