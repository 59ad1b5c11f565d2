"""Result rows of fits, tables of them, and reports on them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import numerics as N
from vecloom.functions import vectors as V
from vecloom.operators import clustering as C
from vecloom.operators import exclusion as E
from vecloom.sources.vectors import uri

from . import runs as R

#: The columns of a result row, in order.
COLUMNS = (
    "dataset string, n int, d int, k int, std double, box double, seed int, zscore int, accum string, cond string, iters int, eps double, "
    "hp_baseline long, hp_reference long, hp_update long, hp_total long, pct_eliminated double, pct_reference double, pct_update double, "
    "pct_cond3 double, pct_cond6 double, pct_cond3_only double, pct_cond6_only double, violations long, label_diff long, inertia double, "
    "inertia_fp32 double, rel_inertia double, ms_dist double, ms_dist_fp32 double, speedup double, ms_prep double, ms_gemm double, "
    "ms_argmin double, ms_hpupdate double, ms_assign double, ms_total double, ms_total_fp32 double, iters_fp32 int"
)
#: The exclusion schemes by name, as parameters.
SCHEMES = {
    "(3)": {"cond3": True, "cond6": False},
    "(6)": {"cond3": False, "cond6": True},
    "(3)+(6)": {"cond3": True, "cond6": True},
    "(3)->(6)": {"cond3": True, "cond6": True, "cascade": True},
    "raw": {"cond3": False, "cond6": False},
}


def fit_scheme(points: DataFrame, centroids: DataFrame, scheme: str, params: C.Params, d: int, scales: tuple[float, float] = (1.0, 1.0)) -> C.Fit:
    """A fit by name: one of SCHEMES, fp32, rt or mw. All but fp32 and rt need points without negative values."""
    if scheme == "fp32":
        return C.fit(points, centroids, params)
    if scheme == "rt":
        return C.fit(points, centroids, params, lambda p, c: E.reliability_rows(p, c, d, params.theta), E.RELIABLE_WORK)
    if scheme == "mw":
        return C.fit(points, centroids, params, lambda p, c: E.multiword_rows(p, c, d, scales, params), E.MULTIWORD_WORK)
    if scheme not in SCHEMES:
        raise ValueError(f"no scheme {scheme}")
    own = C.Params(max_iter=params.max_iter, tol=params.tol, theta=params.theta, max_macs=params.max_macs, accum=params.accum, **SCHEMES[scheme])
    return C.fit(points, centroids, own, lambda p, c: E.mixed_step(p, c, d, own), E.MIXED_WORK)


def compare_fits(a: C.Fit, b: C.Fit) -> dict[str, float]:
    """Two fits on the same points and first centroids: labels that differ, their share that agrees, inertias and their relative difference."""
    both = a.assigned.select("id", F.col("cid").alias("a")).join(b.assigned.select("id", F.col("cid").alias("b")), "id")
    row = both.agg(F.count_if(F.col("a") != F.col("b")).alias("diff"), F.count("*").alias("n")).first()
    one, two = (C.inertia(x.assigned, x.centroids).first()[0] for x in (a, b))
    return {"label_diff": row["diff"], "same_pct": 100.0 * (1 - row["diff"] / row["n"]) if row["n"] else 100.0, "inertia": one, "inertia_fp32": two, "rel_inertia": abs(one - two) / max(two, 1e-300)}


def attribution(points: DataFrame, centroids: DataFrame, d: int) -> DataFrame:
    """One row: candidates tested, excluded by each test, by both, by either, and nearest centroids among what is excluded (0, or a bound is wrong)."""
    cs = E.constants(points, centroids)
    rows = E.survivors(points, centroids, d, N.epsilon(d))
    nearest = F.array_min(F.transform(cs, lambda s, j: F.struct((s["n2"] - 2 * V.dot(F.col("x"), s["c"])).alias("dist"), j.alias("j"))))["j"]
    rows = rows.select(F.col("best.j").alias("j"), (F.size("ts") - 1).alias("n"), nearest.alias("nearest"), *(F.transform(s, lambda t: t["j"]).alias(s) for s in ("s3", "s6", "s36")))
    lost = (F.col("nearest") != F.col("j")) & ~F.array_contains("s36", F.col("nearest"))
    n3, n6, n36 = (F.col("n") - F.size(s) for s in ("s3", "s6", "s36"))
    return rows.agg(F.sum("n").alias("tested"), F.sum(n3).alias("by3"), F.sum(n6).alias("by6"), F.sum(n3 + n6 - n36).alias("both"), F.sum(n36).alias("either"), F.count_if(lost).alias("violations"))


def excess(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row: rows whose label isn't the nearest centroid's, and by how much their scores exceed it in all. assigned: id, x, cid of all points."""
    cs = E.constants(assigned, centroids)

    def score(s):
        return s["n2"] - 2 * V.dot(F.col("x"), s["c"])

    best = F.array_min(F.transform(cs, lambda s: F.struct(score(s).alias("dist"), s["cid"].alias("cid"))))
    own = F.array_min(F.transform(F.filter(cs, lambda s: s["cid"] == F.col("cid")), score))
    rows = assigned.select("cid", best.alias("best"), own.alias("own"))
    wrong = F.col("cid") != F.col("best.cid")
    return rows.agg(F.count_if(wrong).alias("label_diff"), F.sum(F.when(wrong, F.col("own") - F.col("best.dist")).otherwise(0.0)).alias("excess"))


def result_row(points: DataFrame, centroids: DataFrame, scheme: str, params: C.Params, about: dict) -> dict:
    """One configuration against FP32 on the same points and centroids, as a row of COLUMNS; phases that a
    plan doesn't separate are null. about: dataset, std, box, seed, zscore."""
    n, d, k = points.count(), len(points.first()["x"]), centroids.count()
    began = time.monotonic()
    mine = fit_scheme(points, centroids, scheme, params, d)
    own_ms = 1000 * (time.monotonic() - began)
    began = time.monotonic()
    full = C.fit(points, centroids, params)
    full_ms = 1000 * (time.monotonic() - began)
    compared, bounds = compare_fits(mine, full), attribution(points, centroids, d).first()
    baseline, reference, update = n * k * mine.iterations, mine.work.get("reference", 0), mine.work.get("priced", mine.work.get("rejected", mine.work.get("left", 0)))
    tested = max(1, bounds.tested)
    row = dict.fromkeys(c.split()[0] for c in COLUMNS.split(", "))
    row |= {"n": n, "d": d, "k": k, "accum": params.accum, "cond": scheme, "iters": mine.iterations, "eps": N.epsilon(d)} | about
    row |= {"hp_baseline": baseline, "hp_reference": reference, "hp_update": update, "hp_total": reference + update, "pct_eliminated": 100.0 * (1 - (reference + update) / baseline), "pct_reference": 100.0 * reference / baseline, "pct_update": 100.0 * update / baseline}
    row |= {"pct_cond3": 100.0 * bounds.by3 / tested, "pct_cond6": 100.0 * bounds.by6 / tested, "pct_cond3_only": 100.0 * (bounds.by3 - bounds.both) / tested, "pct_cond6_only": 100.0 * (bounds.by6 - bounds.both) / tested, "violations": bounds.violations}
    row |= {c: compared[c] for c in ("label_diff", "inertia", "inertia_fp32", "rel_inertia")}
    return row | {"ms_total": own_ms, "ms_total_fp32": full_ms, "speedup": full_ms / max(own_ms, 1e-9), "iters_fp32": full.iterations}


def result_table(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], COLUMNS)


def append_results(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV files, each with its header."""
    rows.write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """All rows of folders of results, one after the other; folders that aren't there have none."""
    out = spark.createDataFrame([], COLUMNS)
    for path in paths:
        fs, at = pafs.FileSystem.from_uri(uri(path))
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            out = out.unionByName(spark.read.schema(COLUMNS).option("header", True).csv(path))
    return out


def run_all(spark: SparkSession, configs: DataFrame, path: str, data: Callable[[dict], tuple[DataFrame, DataFrame, dict]], budget: int, keys: tuple[str, ...] = ("dataset", "n", "k", "cond"), max_iter: int = 10) -> DataFrame:
    """Runs every configuration (n, d, k, dataset, cond) that fits the budget and has no row in path yet, and appends a row each.

    data gives a configuration's points, centroids and what its row says about them; those over the budget run on the
    rows that fit. Gives what was planned, with verdicts. Configurations are a small table."""
    planned = R.feasible(configs, budget)
    open_ = R.to_do(planned, read_results(spark, path), list(keys))
    for config in sorted(open_.filter("verdict <> 'infeasible'").collect(), key=str):  # a row for each configuration
        points, centroids, about = data(config.asDict())
        if config.verdict == "subsample":
            points = C.subsample(points, config.n_max)
        row = result_row(points, centroids, config.cond, C.Params(max_iter=max_iter), about)
        append_results(result_table(spark, [row | {"n": config.n}]), path)
    return planned


# Reports -------------------------------------------------------------------------------------------
def named_runs(results: DataFrame, prefix: str) -> DataFrame:
    """Rows whose cond begins with a prefix that a number follows (as kappa); those that don't parse are left out. dataset loses data_ and .bin."""
    rows = results.filter(F.col("cond").startswith(prefix)).withColumn("kappa", F.substring("cond", len(prefix) + 1, 1000).try_cast("double"))
    base = F.regexp_replace(F.regexp_replace("dataset", r"^data_", ""), r"\.bin$", "")
    return rows.filter(F.col("kappa").isNotNull() & F.col("ms_total").isNotNull()).withColumn("dataset", base).withColumn("ratio", F.when(F.col("ms_total_fp32") > 0, F.col("ms_total") / F.col("ms_total_fp32")))


def work_table(results: DataFrame) -> DataFrame:
    """High-precision entries of each run in an iteration."""
    per = [(F.col(c) / F.col("iters")).alias(c) for c in ("hp_baseline", "hp_reference", "hp_update", "hp_total")]
    return results.select("dataset", "n", "d", "k", "cond", *per, "pct_eliminated")


def attribution_table(results: DataFrame) -> DataFrame:
    return results.select("dataset", "n", "d", "k", "cond", "pct_cond3", "pct_cond6", "pct_cond3_only", "pct_cond6_only", "violations")


def timing_table(results: DataFrame) -> DataFrame:
    """Milliseconds of a run, in all and in an iteration, beside FP32's."""
    each = [(F.col(a) / F.col(b)).alias(f"{a}_each") for a, b in (("ms_total", "iters"), ("ms_total_fp32", "iters_fp32"))]
    return results.select("dataset", "n", "d", "k", "cond", "iters", "iters_fp32", "ms_total", "ms_total_fp32", *each, "speedup")


def clustering_table(results: DataFrame) -> DataFrame:
    """What a run's labels and inertia are against FP32's."""
    return results.select("dataset", "n", "d", "k", "cond", "label_diff", (100.0 * (1 - F.col("label_diff") / F.col("n"))).alias("same_pct"), "inertia", "inertia_fp32", "rel_inertia")


def medians(results: DataFrame, group: list[str]) -> DataFrame:
    """Exact medians of speed-up, share eliminated and relative inertia, and the most violations, in order of group."""
    return results.groupBy(*group).agg(*(F.median(c).alias(c) for c in ("speedup", "pct_eliminated", "rel_inertia")), F.max("violations").alias("violations"), F.count("*").alias("n")).orderBy(*group)


def scalars(results: DataFrame, value: str = "ratio", name: str = "dataset") -> DataFrame:
    """One row: how many ratios are above 1, the upper median, and the worst and best with their names."""
    listed = F.array_sort(F.collect_list(value))  # a row for each run
    v = F.col(value)
    return results.filter(v.isNotNull()).agg(F.count("*").alias("n"), F.count_if(v > 1).alias("slower"), F.get(listed, (F.count("*") / 2).cast("int")).alias("median"), F.max(v).alias("worst"), F.max_by(name, F.struct(v, F.col(name))).alias("worst_name"), F.min(v).alias("best"), F.min_by(name, F.struct(v, F.col(name))).alias("best_name"))


def spread_against(results: DataFrame, group: list[str], value: str, reference: DataFrame) -> DataFrame:
    """group, spread: the largest less the least value over the group's reference (group and ref; one row a group)."""
    found = results.groupBy(*group).agg((F.max(value) - F.min(value)).alias("range"))
    return found.join(reference, group).select(*group, (F.col("range") / F.col("ref")).alias("spread"))
