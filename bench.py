"""Times the headline queries, each warm and the least of several runs; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_RUNS the runs of each query after one that warms it up.
With BENCH_PLAIN set, numpy's times for the same work on one process are printed in a line before it.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from vecloom.queries import queries

HEADLINE = ["nn_assign", "zscore", "centroid_update", "lloyd_3iter", "lloyd_mixed", "excl_both", "mixed_assign", "rt_assign", "mw_assign", "gemm_coo", "gemm_bf16_prefix", "gemm_ozaki_prefix", "fp16_round", "summary_median", "speedup_selfjoin", "libsvm_parse"]


def least(work: Callable[[], object], runs: int) -> float:
    work()
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        work()
        times.append(time.perf_counter() - began)
    return round(min(times), 3)


def plain(sf: str) -> dict[str, float]:
    """numpy on the same vectors, read once beforehand: assignment, three iterations, a product in nine terms."""
    import numpy as np
    import pyarrow.parquet as pq

    x = np.array(pq.read_table(f"{sf}/embeddings.parquet", columns=["embedding"])["embedding"].to_pylist(), float)

    def nearest(c):
        return ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)

    def lloyd():
        c = x[:10].copy()
        for _ in range(3):
            near = nearest(c)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(10)])

    def bf16(v):
        q = 2.0 ** (np.floor(np.log2(np.where(v == 0, 1.0, np.abs(v)))) - 7)
        return np.rint(v / q) * q

    def words(v):
        out = []
        for _ in range(3):
            out.append(bf16(v))
            v = v - out[-1]
        return out

    return {"nn_assign": least(lambda: nearest(x[:10]), 5), "lloyd_3iter": least(lloyd, 5), "gemm_bf16_prefix": least(lambda: [a @ b.T for a in words(x) for b in words(x[:10])], 5), "fp16_round": least(lambda: x.astype(np.float16), 5)}


def main() -> None:
    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    if os.environ.get("BENCH_PLAIN"):
        print(json.dumps({"plain": plain(sf)}))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every = queries()
    times = {name: least(lambda name=name: every[name](spark, sf).write.format("noop").mode("overwrite").save(), runs) for name in HEADLINE}
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
