"""Files of vectors, their dimensions, result rows and runs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import clustering as C
from vecloom.plans import results as P
from vecloom.plans import runs as R
from vecloom.sources import vectors as S


def test_raw_rows_by_prefix_and_torn(spark, tmp_path, monkeypatch):
    path = tmp_path / "m.bin"
    path.write_bytes(np.arange(60, dtype="<f4").tobytes())
    monkeypatch.setattr(S, "TASK_ROWS", 7)
    monkeypatch.setattr(S, "BATCH_ROWS", 3)
    assert [(r.id, r.x) for r in S.read_float32(spark, str(path), 3).orderBy("id").collect()] == [(i, [3.0 * i, 3.0 * i + 1, 3.0 * i + 2]) for i in range(20)]
    assert S.read_float32(spark, str(path), 3, 4).count() == 4 and S.read_float32(spark, str(path), 3, 0).count() == 0 and S.read_float32(spark, str(path), 3, 99).count() == 20
    with pytest.raises(Exception, match="whole rows"):
        S.read_float32(spark, str(path), 7).count()
    with pytest.raises(ValueError):
        S.read_float32(spark, str(path), 0)


def test_dumped_points_come_back(spark, tmp_path):
    points = spark.range(100).select((F.col("id") * 3).alias("id"), F.array(*(F.col("id").cast("double") + n for n in range(4))).alias("x")).repartition(6)
    assert S.dump_float32(points, f"{tmp_path}/d", 4) == 100
    assert S.resolve_dimension(f"{tmp_path}/d") == 4
    assert [r.x for r in S.read_float32(spark, f"{tmp_path}/d", 4).orderBy("id").collect()] == [[float(i + n) for n in range(4)] for i in range(100)]
    with pytest.raises(Exception, match="another dimension"):
        S.dump_float32(points, f"{tmp_path}/e", 5)


def test_dimension_of_a_file(tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    (tmp_path / "manifest.tsv").write_text("id\tn\td\nsome\t10\t96\nother\t5\t7\n")
    named = f"{folder}/data_some.bin"
    assert S.resolve_dimension(named) == 96 and S.resolve_dimension(named, 96) == 96
    (folder / "data_some.bin.meta").write_text("10 128\n")
    assert S.resolve_dimension(named) == 128
    with pytest.raises(ValueError, match="says 128"):
        S.resolve_dimension(named, 96)
    assert S.resolve_dimension(f"{folder}/data_some_test.bin", 5) == 5
    with pytest.raises(ValueError, match="no sidecar"):
        S.resolve_dimension(f"{folder}/x.bin")


def test_sparse_text_files(spark, tmp_path):
    (tmp_path / "t").write_text("b 1:1\n".replace("b", "2") + "1 3:4 3:5 2:1\n\n# none\n2 1:7 1:8\n")
    rows = S.read_libsvm(spark, str(tmp_path / "t")).orderBy("id").collect()
    assert [(r.label, r["class"], r.x) for r in rows] == [(2.0, 0, [1.0, 0.0, 0.0]), (1.0, 1, [0.0, 1.0, 5.0]), (2.0, 0, [8.0, 0.0, 0.0])]
    lines = spark.read.text(str(tmp_path / "t")).select(F.monotonically_increasing_id().alias("id"), "value")
    assert S.parse_libsvm_points(lines, 2).columns == ["id", "x"] and sorted(r.x for r in S.parse_libsvm_points(lines, 2).collect()) == [[0.0, 1.0], [1.0, 0.0], [8.0, 0.0]]
    with pytest.raises(ValueError):
        S.parse_libsvm(lines, most=5)


def test_runs_are_appended_and_resumed(spark, tmp_path):
    points = S.blobs(spark, 60, 3, 3, std=0.2, box=5.0).select("id", F.transform("x", lambda v: v + 20).alias("x")).cache()
    configs = R.grid(spark, {"dataset": ("string", ["blobs"]), "n": ("long", [60]), "d": ("long", [3]), "k": ("long", [2, 3, 99]), "cond": ("string", ["(3)", "fp32"])})
    asked = []

    def data(config):
        asked.append((config["k"], config["cond"]))
        return points, C.initial_centroids(points, config["k"]), {"dataset": config["dataset"]}

    path = f"{tmp_path}/results"
    planned = P.run_all(spark, configs.filter("k <> 3"), path, data, 1 << 30, max_iter=2)
    assert {r.verdict for r in planned.filter("k = 99").collect()} == {"infeasible"} and len(asked) == 2
    P.run_all(spark, configs, path, data, 1 << 30, max_iter=2)
    assert sorted(asked) == [(2, "(3)"), (2, "fp32"), (3, "(3)"), (3, "fp32")]
    rows = P.read_results(spark, path, f"{tmp_path}/none")
    assert rows.count() == 4 and rows.filter("violations <> 0 OR label_diff <> 0 OR rel_inertia > 1e-9").count() == 0
    assert len(rows.columns) == 39 and P.work_table(rows).count() == 4 and P.timing_table(rows).filter("ms_total_each > 0").count() == 4
    assert P.clustering_table(rows).filter("same_pct = 100").count() == 4 and P.attribution_table(rows).columns[-1] == "violations"


def test_rows_that_do_not_parse_are_left_out(spark):
    rows = spark.createDataFrame([("data_a.bin", "rt-mp-k5", 2.0, 1.0), ("a", "rt-mp-kx", 2.0, 1.0), ("b", "(3)", 2.0, 1.0), ("b", "rt-mp-k1e6", None, 1.0), ("c.bin", "rt-mp-k0.5", 1.0, 0.0)], "dataset string, cond string, ms_total double, ms_total_fp32 double")
    assert sorted((r.dataset, r.kappa, r.ratio) for r in P.named_runs(rows, "rt-mp-k").collect()) == [("a", 5.0, 2.0), ("c", 0.5, None)]
    report = P.scalars(P.named_runs(rows, "rt-mp-k")).first()
    assert (report.n, report.slower, report.median, report.worst_name) == (1, 1, 2.0, "a")


def test_raw_floats_need_whole_rows(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(struct.pack("<5f", *range(5)))
    with pytest.raises(Exception, match="whole rows"):
        S.read_float32(spark, str(tmp_path / "m.bin"), 2).collect()
