"""Nearest centroids by low-precision products, with proved bounds on what must be priced again.

A row holds a short struct of each candidate, its number and two scores; a bound is a filter on
them, and what must be priced again looks its centroid up in the plan's constant. Nothing of size points
times centroids is ever shuffled. Each assignment can be a step of clustering.fit: it returns id, x, cid and counters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions import numerics as N
from vecloom.functions import vectors as V

from .clustering import Params, centroid_blocks

#: Counters of mixed_step and of multiword_step: candidates tested, left by the tests, reference entries, rows left undecided, candidates
#: that a multiword step leaves after all its products and prices in double.
MIXED_WORK = ("tested", "priced", "reference")
RELIABLE_WORK = ("tested", "rejected")
MULTIWORD_WORK = ("tested", "undecided", "left", "priced")


def half(x: Column) -> Column:
    return F.transform(x, N.fp16)


def shift_of(points: DataFrame) -> float:
    return points.agg(F.max(V.max_abs(F.col("x")))).first()[0] or 0.0


def _word(x: Column, scale: float, p: int) -> Column:
    return F.transform(x, lambda v: N.split(v * scale, p + 1, N.fp16)[p])


def constants(points: DataFrame, centroids: DataFrame, *extra: Column) -> Column:
    """All centroids as one constant array of (cid, c, n2 and extra), its place being cid."""
    blocks = centroid_blocks(points.sparkSession, centroids, *extra)
    if len(blocks) > 1:
        raise ValueError("bounds need all centroids in one constant; they are too many")
    return blocks[0]


def at(cs: Column, place: Column) -> Column:
    return F.element_at(cs, place + 1)


def scored(points: DataFrame, centroids: DataFrame, by_products: int = 0, scales: tuple[float, float] = (1.0, 1.0), accum: str = "fp32") -> tuple[DataFrame, Column]:
    """points with ts (of each candidate its half-precision score dt, its place j among the centroids and its product g) and
    best, that of least (dt, j); and the constant of centroids.

    by_products: of how many words the split operands are, 0 for plain half precision. accum fp16 rounds each product and sum."""
    if by_products:
        cs, unscale = constants(points, centroids, _word(F.col("c"), scales[1], 0).alias("h")), 1.0 / (scales[0] * scales[1])
        rows = points.withColumn("xh", _word(F.col("x"), scales[0], 0))
    else:
        cs, unscale = constants(points, centroids, half(F.col("c")).alias("h")), 1.0
        rows = points.withColumn("xh", half(F.col("x")))
    xh = F.col("xh")

    def product(s: Column) -> Column:
        return V.half_dot(xh, s["h"], N.fp16) if accum == "fp16" else V.dot(xh, s["h"]) * unscale

    def score(s: Column, j: Column) -> Column:
        return N.let(product(s), lambda g: F.struct((s["n2"] - 2 * g).alias("dt"), j.alias("j"), g.alias("g")))

    rows = rows.withColumn("ts", F.transform(cs, score))
    return rows.withColumn("best", F.array_min("ts")).drop("xh"), cs


def excluded_3(t: Column, best: Column, factor: float) -> Column:
    """From the incumbent's low-precision score alone."""
    db, dt = best["dt"], t["dt"]
    return db + N.SLACK * (F.abs(db) + F.abs(dt)) <= dt - factor * (F.greatest(t["g"], F.lit(0.0)) + best["g"])


def excluded_6(t: Column, up: Column, factor: float) -> Column:
    """From the incumbent's upper bound up, which its product in high precision gives."""
    return up + N.SLACK * (F.abs(up) + F.abs(t["dt"])) <= t["dt"] - factor * F.greatest(t["g"], F.lit(0.0))


def bounds_of(d: int, epsilon: float) -> tuple[float, float]:
    """What the tests multiply products by: of the low-precision ones, and of the incumbent's; an error where the model holds no more."""
    small = N.gamma(d, N.U32)
    if not 0 <= epsilon < 1 or small >= 1:
        raise ValueError(f"the error model doesn't hold at dimension {d}")
    return 2 * epsilon / (1 - epsilon), 2 * small / (1 - small)


def survivors(points: DataFrame, centroids: DataFrame, d: int, epsilon: float, **more) -> DataFrame:
    """id, x, ts, best, ge, s3, s6, s36 and cascade: candidates that each test, both, and the second only where the first leaves any, leave.

    For reports on the tests. s6 needs the incumbent's product ge of every row; mixed_step computes it only where it is needed."""
    factor, gfac = bounds_of(d, epsilon)
    rows, cs = scored(points, centroids, **more)
    best, ge = F.col("best"), F.col("ge")
    rows = rows.withColumn("ge", V.dot(F.col("x"), at(cs, best["j"])["c"]))
    rows = rows.withColumn("up", at(cs, best["j"])["n2"] - 2 * ge + gfac * ge)

    def other(t: Column) -> Column:
        return t["j"] != best["j"]

    rows = rows.withColumn("s3", F.filter("ts", lambda t: other(t) & ~excluded_3(t, best, factor)))
    rows = rows.withColumn("s6", F.filter("ts", lambda t: other(t) & ~excluded_6(t, F.col("up"), factor)))
    rows = rows.withColumn("s36", F.filter("s3", lambda t: ~excluded_6(t, F.col("up"), factor)))
    cids = F.transform(cs, lambda s: s["cid"])
    rows = rows.withColumn("cid", F.element_at(cids, best["j"] + 1))
    return rows.withColumn("cascade", F.when(F.size("s3") > 0, F.col("s36")).otherwise(F.col("s3")))


def mixed_step(points: DataFrame, centroids: DataFrame, d: int, params: Params = Params(cascade=True)) -> DataFrame:
    """id, x, cid and MIXED_WORK: candidates that the chosen tests leave, and the incumbent, priced again; rows with none left keep
    the incumbent. With neither test (raw) all rows keep it. In a cascade the incumbent's product is computed only where the first test leaves any."""
    cond3, cond6 = params.cond3, params.cond6
    factor, gfac = bounds_of(d, N.epsilon(d, N.U16 if params.accum == "fp16" else N.U32)) if cond3 or cond6 else (0.0, 0.0)
    rows, cs = scored(points, centroids, accum=params.accum)
    best, x = F.col("best"), F.col("x")
    none = F.array().cast("array<int>")

    def left_by(t: Column, tests: list[Callable[[Column], Column]]) -> Column:
        keep = t["j"] != best["j"]
        for test in tests:
            keep = keep & ~test(t)
        return keep

    def places(tests: list[Callable[[Column], Column]], of: Column) -> Column:
        return F.transform(F.filter(of, lambda t: left_by(t, tests)), lambda t: t["j"])

    def third(t: Column) -> Column:
        return excluded_3(t, best, factor)

    def upper(s: Column) -> Column:
        return N.let(V.dot(x, s["c"]), lambda ge: s["n2"] - 2 * ge + gfac * ge)

    def sixth(up: Column) -> Callable[[Column], Column]:
        return lambda t: excluded_6(t, up, factor)

    reference = F.lit(0)
    if not cond3 and not cond6:
        left = none
    elif not cond6:
        left = places([third], F.col("ts"))
    elif cond3 and params.cascade:
        rows = rows.withColumn("ts", F.filter("ts", lambda t: left_by(t, [third])))
        reference = (F.size("ts") > 0).cast("int")
        left = F.when(F.size("ts") == 0, none).otherwise(N.let(upper(at(cs, best["j"])), lambda up: places([sixth(up)], F.col("ts"))))
    else:
        reference = F.lit(1)
        left = N.let(upper(at(cs, best["j"])), lambda up: places([*([third] if cond3 else []), sixth(up)], F.col("ts")))
    rows = rows.withColumn("left", left).select("id", "x", F.col("best.j").alias("j"), "left", reference.alias("reference"))
    return priced_again(rows, cs).withColumn("tested", F.size(cs) - 1).select("id", "x", "cid", "tested", F.size("left").alias("priced"), "reference")


def priced_again(rows: DataFrame, cs: Column) -> DataFrame:
    """rows (x, j, left) with cid: of the places left and the incumbent j that of the least exact distance; j's own where none is left."""

    def price(j: Column) -> Column:
        return N.let(at(cs, j), lambda s: F.struct((s["n2"] - 2 * V.dot(F.col("x"), s["c"])).alias("dist"), s["cid"].alias("cid")))

    again = F.array_min(F.transform(F.concat(F.array("j"), F.col("left")), price))["cid"]
    return rows.withColumn("cid", F.when(F.size("left") == 0, at(cs, F.col("j"))["cid"]).otherwise(again))


def refined(rows: DataFrame, left: str, centroids: DataFrame) -> DataFrame:
    """id, x, cid from what survivors returned: candidates left and the incumbent priced again."""
    cs = constants(rows, centroids)
    named = rows.select("id", "x", F.col("best.j").alias("j"), F.transform(left, lambda t: t["j"]).alias("left"))
    return priced_again(named, cs).select("id", "x", "cid")


def reliability_rows(points: DataFrame, centroids: DataFrame, d: int, theta: float = 2.5) -> DataFrame:
    """id, x, cid and RELIABLE_WORK: expanded half-precision distances where they pass the reliability test, direct ones elsewhere."""
    limit = N.reliability(d, theta)
    cs = constants(points, centroids, half(F.col("c")).alias("h"))
    rows = points.withColumn("xh", half(F.col("x"))).withColumn("x2", V.norm2(F.col("x")))

    def price(s: Column) -> Column:
        def choose(low: Column) -> Column:
            ok = low > limit * (F.col("x2") + s["n2"])
            return F.struct(F.when(ok, low).otherwise(V.direct_distance(F.col("x"), s["c"])).alias("dist"), s["cid"].alias("cid"), ok.alias("ok"))

        return N.let(F.col("x2") + s["n2"] - 2 * V.dot(F.col("xh"), s["h"]), choose)

    priced = rows.withColumn("ps", F.transform(cs, price))
    return priced.select("id", "x", F.array_min("ps")["cid"].alias("cid"), F.size("ps").alias("tested"), F.size(F.filter("ps", lambda p: ~p["ok"])).alias("rejected"))


def multiword_rows(points: DataFrame, centroids: DataFrame, d: int, scales: tuple[float, float], params: Params = Params()) -> DataFrame:
    """id, x, cid, undecided and the counters of MULTIWORD_WORK: one product of split operands, the tests, then for rows left
    undecided as many products as max_macs allows, of all candidates (the dense plan) or of those left (the narrow one).

    The narrow plan prices only what the tests left, the incumbent among it; both give the same nearest, as what the
    tests drop can't be. The bound after one product decides which rows are open. The products' own bound then drops what
    can't be nearest, and what that leaves is priced in double with the new incumbent: words alone can't tell nearly equal
    distances apart, whose labels would move all later centroids. Words of the centroids are constants."""
    factor, gfac = bounds_of(d, N.multiword_epsilon(d, 1))
    words = [_word(F.col("c"), scales[1], q).alias(f"h{q}") for q in range(2)]
    cs = constants(points, centroids, *words)
    unscale = 1.0 / (scales[0] * scales[1])
    rows = points.withColumn("w", F.transform("x", lambda v: N.words_of(v * scales[0], 2, N.fp16)))
    rows = rows.withColumn("w0", F.transform("w", lambda w: F.element_at(w, 1))).withColumn("w1", F.transform("w", lambda w: F.element_at(w, 2))).drop("w")

    def score(s: Column, j: Column) -> Column:
        return N.let(V.dot(F.col("w0"), s["h0"]) * unscale, lambda g: F.struct((s["n2"] - 2 * g).alias("dt"), j.alias("j"), g.alias("g")))

    rows = rows.withColumn("ts", F.transform(cs, score)).withColumn("best", F.array_min("ts"))
    best = F.col("best")
    rows = rows.withColumn("s3", F.filter("ts", lambda t: (t["j"] != best["j"]) & ~excluded_3(t, best, factor)))

    def sixth(s: Column) -> Column:
        up = N.let(V.dot(F.col("x"), s["c"]), lambda ge: s["n2"] - 2 * ge + gfac * ge)
        return N.let(up, lambda u: F.filter("s3", lambda t: ~excluded_6(t, u, factor)))

    rows = rows.withColumn("left", F.when(F.size("s3") == 0, F.col("s3")).otherwise(sixth(at(cs, best["j"]))))

    open_ = F.size("left") > 0
    finer, _ = bounds_of(d, N.multiword_epsilon(d, params.max_macs))

    def refine(t: Column) -> Column:
        def add(s: Column) -> Column:
            more = [V.dot(F.col(f"w{p}"), s[f"h{q}"]) for p, q in N.terms(2, params.max_macs)[1:]]
            whole = t["g"] + sum(more[1:], more[0]) * unscale if more else t["g"]
            return N.let(whole, lambda g: F.struct((s["n2"] - 2 * g).alias("dt"), t["j"].alias("j"), g.alias("g")))

        return N.let(at(cs, t["j"]), add)

    def close(t: Column) -> Column:
        return (t["j"] != F.col("first.j")) & (F.isnan(t["dt"]) | ~excluded_3(t, F.col("first"), finer))

    fine = F.transform(F.concat(F.array("best"), F.col("left")), refine)
    rows = rows.withColumn("fine", F.when(open_, fine).otherwise(F.array("best"))).withColumn("first", F.array_min("fine"))
    counts = (open_.alias("undecided"), (F.size("ts") - 1).alias("tested"), F.size("left").alias("open"))
    rows = rows.select("id", "x", F.col("first.j").alias("j"), F.transform(F.filter("fine", close), lambda t: t["j"]).alias("left"), *counts)
    return priced_again(rows, cs).select("id", "x", "cid", "undecided", "tested", F.col("open").alias("left"), F.size("left").alias("priced"))


def accuracy(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """formula, max_rel, mean_rel, wrong: of the expanded distance in double and in half precision, the errors relative to the
    direct distance (where that isn't 0), and the points whose nearest centroid it gets wrong."""
    rows, cs = scored(points, centroids)
    x = F.col("x")

    def price(t: Column) -> Column:
        def rate(s: Column) -> Column:
            own = V.norm2(x)
            return F.struct(V.direct_distance(x, s["c"]).alias("exact"), (own + s["n2"] - 2 * V.dot(x, s["c"])).alias("expanded"), (own + t["dt"]).alias("half"), t["j"].alias("j"))

        return N.let(at(cs, t["j"]), rate)

    rows = rows.select("id", F.transform("ts", price).alias("ps"))

    def first(name: str) -> Column:
        return F.array_min(F.transform("ps", lambda p: F.struct(p[name].alias("d"), p["j"].alias("j"))))["j"]

    out = None
    for name in ("expanded", "half"):
        wrong = rows.withColumn("wrong", (first("exact") != first(name)).cast("int")).select("wrong", F.posexplode("ps").alias("at", "p"))
        rel = F.when(F.col("p.exact") > 0, F.abs(F.col(f"p.{name}") - F.col("p.exact")) / F.col("p.exact"))
        one = wrong.agg(F.max(rel).alias("max_rel"), F.avg(rel).alias("mean_rel"), F.sum(F.when(F.col("at") == 0, F.col("wrong"))).alias("wrong")).select(F.lit(name).alias("formula"), "*")
        out = one if out is None else out.unionByName(one)
    return out
