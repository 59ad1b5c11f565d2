"""Fits, models, products and fills against plain versions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import fills as L
from vecloom.functions import numerics as N
from vecloom.functions import vectors as V
from vecloom.operators import clustering as C
from vecloom.operators import exclusion as E
from vecloom.operators import products as M
from vecloom.plans import results as P
from vecloom.sources import vectors as S


@pytest.fixture(scope="module")
def blobs(spark):
    points = S.blobs(spark, 400, 6, 5, std=1.0, box=2.0, seed=3).select("id", "x")
    points = points.withColumn("x", V.add(F.col("x"), E.shift_of(points))).cache()
    return points, C.initial_centroids(points, 5)


def plain_fit(points, centres, iterations):
    x = np.array([r.x for r in points.orderBy("id").collect()])
    c = np.array([r.c for r in centres.orderBy("cid").collect()])
    for _ in range(iterations):
        near = ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return near.tolist(), c


@pytest.mark.parametrize("scheme", ["fp32", "(3)", "(6)", "(3)+(6)", "(3)->(6)", "mw"])
def test_bounded_fits_give_the_exact_labels(spark, blobs, scheme):
    labels, centres = plain_fit(*blobs, 4)
    found = P.fit_scheme(*blobs, scheme, C.Params(max_iter=4), 6, scales=(64.0, 64.0))
    assert [r.cid for r in found.assigned.orderBy("id").collect()] == labels and found.iterations == 4
    assert np.allclose([r.c for r in found.centroids.orderBy("cid").collect()], centres)
    if scheme != "fp32":
        assert found.work["tested"] == 400 * 4 * 4


def test_a_cascade_prices_no_more_references_than_both_tests(spark, blobs):
    both, cascade = (P.fit_scheme(*blobs, s, C.Params(max_iter=2), 6).work for s in ("(3)+(6)", "(3)->(6)"))
    assert both["reference"] == 800 and cascade["reference"] <= 800 and cascade["priced"] == both["priced"]


def test_theta_and_macs_are_heeded(spark, blobs):
    few, many = (P.fit_scheme(*blobs, "rt", C.Params(max_iter=1, theta=t), 6).work["rejected"] for t in (0.1, 50.0))
    assert few < many
    one = E.multiword_rows(*blobs, 6, (64.0, 64.0), C.Params(max_macs=1)).select("id", "cid").collect()
    assert len(one) == 400


@pytest.mark.parametrize("macs", [1, 2, 3])
def test_multiword_labels_are_exact_where_words_cannot_tell(spark, macs):
    """Points 1e-9 to either side of the plane between two centroids; a label that is wrong would move both in the next iteration."""
    rng = np.random.default_rng(6)
    c = rng.uniform(0.2, 1.0, size=(2, 6))
    across = c[1] - c[0]
    off = rng.uniform(-0.1, 0.1, size=(40, 6))
    off -= np.outer(off @ across / (across @ across), across)
    x = c.mean(axis=0) + off + np.outer(np.where(np.arange(40) % 2, 1e-9, -1e-9), across)
    points = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate([*c, *x])], "id long, x array<double>")
    first = C.initial_centroids(points, 2)
    rows = E.multiword_rows(points, first, 6, (1024.0, 1024.0), C.Params(max_macs=macs)).orderBy("id").collect()
    assert [r.cid for r in rows] == [0, 1] + [0, 1] * 20
    assert [r.undecided for r in rows] == [False] * 2 + [True] * 40 and [r.priced for r in rows] == [0] * 2 + [1] * 40
    found = P.fit_scheme(points, first, "mw", C.Params(max_iter=3, max_macs=macs), 6, scales=(1024.0, 1024.0))
    labels, centres = plain_fit(points, first, 3)
    assert [r.cid for r in found.assigned.orderBy("id").collect()] == labels
    assert np.allclose([r.c for r in found.centroids.orderBy("cid").collect()], centres, rtol=1e-12)


def test_models_that_do_not_hold_are_refused(spark, blobs):
    with pytest.raises(ValueError):
        N.reliability(2046)
    assert N.reliability(2045) > 0 and N.multiword_epsilon(64, 4) == -1.0 and N.multiword_epsilon(1 << 25, 3) == -1.0
    assert N.multiword_epsilon(64, 1) > N.multiword_epsilon(64, 2) > 2.0**-11 > N.multiword_epsilon(64, 3)
    with pytest.raises(ValueError):
        E.survivors(*blobs, 1 << 25, N.epsilon(1 << 25))
    with pytest.raises(ValueError):
        N.slices(F.lit(1.0), F.lit(1.0), 10, 7)
    with pytest.raises(ValueError):
        C.Params(max_iter=0)
    with pytest.raises(ValueError):
        M.schedule(3, 4, 10)


def test_centroids_in_blocks(spark, blobs, monkeypatch):
    want = C.assign(*blobs).select("id", "cid").collect()
    monkeypatch.setattr(C, "BLOCK_VALUES", 12)
    assert sorted(C.assign(*blobs).select("id", "cid").collect()) == sorted(want)


def test_given_and_seeded_centroids(spark, blobs):
    points, _ = blobs
    one, two = (sorted((r.cid, tuple(r.c)) for r in C.seeded_centroids(points, 7, 1).collect()) for _ in range(2))
    assert one == two and len({c for _, c in one}) == 7
    rows = points.orderBy("id").limit(3)
    moved = C.given_centroids(rows, 3, 0.5).orderBy("cid").first()
    assert moved.c == [v + 0.5 for v in points.orderBy("id").first().x]
    with pytest.raises(ValueError):
        C.given_centroids(rows, 4)


def test_a_product_keeps_rows_of_zeros(spark):
    a = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 2.0])], "i long, x array<double>")
    b = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "j int, y array<double>")
    for products in (M.slice_rows(M.sliced_rows(a, "x", 4, 7), M.sliced_rows(b, "y", 4, 7), 4), M.slice_products(M.sliced(M.entries(a), 4, 7), M.sliced(M.entries(b.select(F.col("j").alias("i"), F.col("y").alias("x"))), 4, 7), 4)):
        assert {(r.i, r.j): r.v for r in M.folded(products, 7).collect()} == {(0, 0): 0.0, (0, 1): 0.0, (1, 0): 11.0, (1, 1): 0.0}
    c = spark.createDataFrame([(0, 0, 2.0), (1, 0, float("nan"))], "i long, j int, v double")
    assert {(r.i, r.j): r.v for r in M.gemm(a, b, 2.0, 0.5, c.limit(1)).collect()} == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 22.0, (1, 1): 0.0}
    assert {r.v for r in M.gemm(a, b, 1.0, 0.0, c).collect()} == {0.0, 11.0}


def test_products_in_blocks_and_refined(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(9, 5)).astype(np.float32).astype(float), rng.normal(size=(7, 5)).astype(np.float32).astype(float)
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    b = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(y)], "j int, y array<double>")
    monkeypatch.setattr(M, "BLOCK_VALUES", 10)

    def matrix(rows):
        out = np.full((9, 7), np.nan)
        for r in rows.collect():
            out[r.i, r.j] = r.v
        return out

    assert np.allclose(matrix(M.gemm(a, b)), x @ y.T, rtol=1e-14)
    first = M.split_gemm(a, b, 3, N.bf16, 0, 4)
    errors = [np.abs(matrix(r) - x @ y.T).max() for r in (M.split_gemm(a, b, 3, N.bf16, 0, 1), first, M.split_gemm(a, b, 3, N.bf16, 4, 9, beta=1.0, c=first))]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-6
    bins = M.concat_bins(a, b, 3, N.bf16, 5).groupBy("i", "j").agg(F.sum("v").alias("v"))
    assert np.allclose(matrix(bins), x @ y.T, atol=1e-12)


def test_pairs_of_doubles(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=30) * 2.0 ** rng.integers(-40, 40, 30)).tolist(), (rng.normal(size=30) * 2.0 ** rng.integers(-40, 40, 30)).tolist()) for i in range(50)]
    got = spark.createDataFrame(rows, "i long, x array<double>, y array<double>").select("i", V.double_double_dot(F.col("x"), F.col("y")).alias("p")).collect()
    for r in got:
        exact = sum(Fraction(a) * Fraction(b) for a, b in zip(rows[r.i][1], rows[r.i][2]))
        scale = sum(abs(Fraction(a) * Fraction(b)) for a, b in zip(rows[r.i][1], rows[r.i][2]))
        assert abs(Fraction(r.p.hi) + Fraction(r.p.lo) - exact) <= scale * Fraction(1, 2**95)


def test_fills(spark):
    def plain(x):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    rows = spark.range(300).select("id", L.uniform(F.col("id"), 9, -2.0, 3.0).alias("u"), L.uniform(F.col("id"), 9, exponents=30.0).alias("e"), L.normal(F.col("id"), 9).alias("n"), L.wide(F.col("id"), 9, 2.0).alias("w")).repartition(5).collect()
    for r in rows:
        assert r.u == float(np.float32(-2.0 + (plain(9 ^ r.id) >> 11) / 2.0**53 * 5.0))
    assert max(abs(r.e) for r in rows) > 1e3 and min(abs(r.e) for r in rows) < 1e-3
    assert abs(np.mean([r.n for r in rows])) < 0.2 and 0.85 < np.std([r.n for r in rows]) < 1.15


def test_values_that_are_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(0, [1.0, -3.0, inf]), (1, [nan, -inf]), (2, []), (3, [0.0])], "i int, x array<double>")
    got = {r.i: (r.m, r.s, r.e) for r in rows.select("i", V.max_abs(F.col("x")).alias("m"), N.autoscale(V.max_abs(F.col("x"))).alias("s"), M.row_exponent(F.col("x")).alias("e")).collect()}
    assert got == {0: (3.0, 1024.0, 2), 1: (None, 1.0, None), 2: (None, 1.0, None), 3: (0.0, 1.0, None)}
    words = spark.createDataFrame([(65520.0,), (-inf,), (1e-9,), (1.0,)], "v double").select("v", N.words_of(F.col("v"), 2, N.fp16).alias("w"), N.word_class(N.fp16(F.col("v")), F.col("v") - N.fp16(F.col("v"))).alias("c")).collect()
    assert [r.c for r in words] == ["overflow", "overflow", "subnormal", "ok"]


def test_a_subsample_is_the_same_by_either_way(spark, monkeypatch):
    points = spark.range(3000).select("id", F.array(F.col("id").cast("double")).alias("x"))
    for m in (0, 1, 700, 2999, 3000, 5000):
        monkeypatch.setattr(C, "SORTED", 100_000)
        want = [r.id for r in C.subsample(points, m).collect()]
        monkeypatch.setattr(C, "SORTED", -1)
        assert [r.id for r in C.subsample(points, m).collect()] == want and len(want) == min(m, 3000)
