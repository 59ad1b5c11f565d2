import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import queries as Q
from vecloom.functions import numerics as N
from vecloom.functions import vectors as V
from vecloom.operators import clustering as C
from vecloom.plans import runs as R
from vecloom.sources import vectors as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "embeddings", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert [str(got[c].dtype) for c in cols] == [str(want[c].dtype) for c in cols]
    got, want = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)


def test_half_precision_rounds_like_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=2000) * 2.0 ** rng.integers(-28, 17, 2000), 2.0 ** np.arange(-30, 16), [0.0, 65504.0, 65519.9, 65520.0, -65520.0, 2.0**-24, 2.0**-25]])
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double").select("i", N.fp16(F.col("v")).alias("h")).orderBy("i").toPandas()["h"]
    with np.errstate(over="ignore"):
        assert np.array_equal(got.to_numpy(), x.astype(np.float16).astype(np.float64))


def test_three_words_of_eight_bits_are_exact(spark):
    x = np.float32(np.random.default_rng(1).normal(size=500)).astype(float)
    words = N.split(F.col("v"), 3, N.bf16)
    rest = spark.createDataFrame([(float(v),) for v in x], "v double").select((F.col("v") - words[0] - words[1] - words[2]).alias("r"))
    assert rest.filter("r <> 0").count() == 0


def test_exponent_at_powers_of_two(spark):
    x = [2.0**e for e in range(-126, 128)] + [float(np.nextafter(np.float32(2.0**e), np.float32(0))) for e in range(-120, 127)]
    got = spark.createDataFrame([(v,) for v in x], "v double").select("v", N.exponent(F.col("v")).alias("e")).collect()
    assert all(r.e == math.frexp(r.v)[1] - 1 for r in got)


def test_schedule():
    assert N.terms(3) == [(0, 0), (0, 1), (1, 0), (0, 2), (1, 1), (2, 0), (1, 2), (2, 1), (2, 2)]
    assert N.bits_per_slice(512) == 7 and N.epsilon(1 << 25) == -1.0


def test_ties_and_empty_clusters(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id long, x array<double>")
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [9.0, 9.0])], "cid int, c array<double>")
    near = C.assign(points, centres)
    assert {r.id: r.cid for r in near.collect()} == {1: 0, 2: 0}
    moved = {r.cid: (r.c, r.moved2) for r in C.update(near, centres).collect()}
    assert moved == {0: ([0.5, 0.5], 0.5), 1: ([0.0, 0.0], 0.0), 2: ([9.0, 9.0], 0.0)}


def test_lloyd_stops_on_movement_only(spark):
    points = S.blobs(spark, 200, 4, 3, std=0.1).cache()
    centres = C.initial_centroids(points.select("id", "x"), 3)
    assert C.lloyd(points, centres, C.Params(max_iter=4))[2] == 4
    assert C.lloyd(points, centres, C.Params(max_iter=50, tol=1e-9))[2] < 50


def test_compensated_sum(spark):
    row = spark.createDataFrame([([1.0, 1e100, 1.0, -1e100],)], "x array<double>").select(V.neumaier(F.col("x")).alias("s")).first()
    assert row.s == 2.0


def test_sparse_text(spark):
    lines = ["1 2:3 1:4 # 3:1", "", "  # only", "-2.5,7 qid:3 3:1e1 3:2 0:9 x:1 2:", "+3"]
    got = {r.id: (r.label, r.x) for r in S.parse_libsvm(spark.createDataFrame(list(enumerate(lines)), "id long, value string")).collect()}
    assert got == {0: (1.0, [4.0, 3.0, 0.0]), 3: (-2.5, [0.0, 0.0, 2.0]), 4: (3.0, [0.0, 0.0, 0.0])}


def test_raw_floats(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(struct.pack("<6f", *range(6)))
    got = S.read_float32(spark, str(tmp_path / "m.bin"), 3).orderBy("id").collect()
    assert [(r.id, r.x) for r in got] == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]


def test_blobs_do_not_depend_on_partitions(spark):
    a = S.blobs(spark, 50, 3, 5).collect()
    assert a == sorted(S.blobs(spark, 50, 3, 5).repartition(7).collect()) and len({r.label for r in a}) == 5


def test_first_seen_and_upsert(spark):
    rows = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "at long, l string")
    assert {r.l: r["class"] for r in S.first_seen(rows, "l", "at").collect()} == {"b": 0, "a": 1, "c": 2}
    assert [r.at for r in R.upsert(rows, rows.filter("at = 2"), "at").collect()] == [0, 1, 2, 3]
