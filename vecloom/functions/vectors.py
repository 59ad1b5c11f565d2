"""Scalar functions of vectors held as array<double>, as columns. All sums run in array order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm2(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def direct_distance(x: Column, c: Column) -> Column:
    """Squared distance as the sum of squared differences."""
    return total(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)))


def expanded_distance(x2: Column, c2: Column, g: Column) -> Column:
    """Squared distance from the squared norms and the product g."""
    return x2 + c2 - 2 * g


def max_abs(x: Column) -> Column:
    """Largest finite absolute value; null if there is none."""
    return F.array_max(F.transform(F.filter(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))), F.abs))


def add(x: Column, m: Column | float) -> Column:
    return F.transform(x, lambda v: v + m)


def normalise(x: Column) -> Column:
    """x over its length; lengths below 1e-12 count as that."""
    return F.transform(x, lambda v: v / F.greatest(F.sqrt(norm2(x)), F.lit(1e-12)))


def neumaier(x: Column) -> Column:
    """Compensated sum in array order."""

    def step(a: Column, v: Column) -> Column:
        t = a["s"] + v
        lost = F.when(F.abs(a["s"]) >= F.abs(v), (a["s"] - t) + v).otherwise((v - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step, lambda a: a["s"] + a["c"])


def two_sum(a: Column, b: Column) -> Column:
    """a + b rounded (s), and what the rounding lost (e), exactly."""
    s = a + b
    back = s - a
    return F.struct(s.alias("s"), ((a - (s - back)) + (b - back)).alias("e"))


def _halves(a: Column) -> tuple[Column, Column]:
    high = a * 134217729.0 - (a * 134217729.0 - a)  # 2^27 + 1: halves whose products are exact
    return high, a - high


def two_product(a: Column, b: Column) -> Column:
    """a * b rounded (s), and what the rounding lost (e), exactly, of values within about 2^-480 and 2^480."""
    p, (ah, al), (bh, bl) = a * b, _halves(a), _halves(b)
    return F.struct(p.alias("s"), (((ah * bh - p) + ah * bl + al * bh) + al * bl).alias("e"))


def double_double_dot(x: Column, y: Column) -> Column:
    """The product of two vectors as a pair hi, lo of doubles, about 106 bits."""

    def step(acc: Column, p: Column) -> Column:
        summed = two_sum(acc["hi"], p["s"])
        low = summed["e"] + p["e"] + acc["lo"]
        total = two_sum(summed["s"], low)
        return F.struct(total["s"].alias("hi"), total["e"].alias("lo"))

    start = F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo"))
    return F.aggregate(F.zip_with(x, y, two_product), start, step)


def half_dot(x: Column, y: Column, rounding) -> Column:
    """The product of two vectors, each product and each sum rounded."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: rounding(a * b)), F.lit(0.0), lambda a, v: rounding(a + v))


def standardised(df: DataFrame, col: str) -> DataFrame:
    """df with col z-scored by position: population deviation, 1 where that is at most 1e-12. All vectors are as long
    as the longest one's moments; sums of each task are shuffled, not values."""
    width = df.agg(F.max(F.size(col))).first()[0] or 0
    if not width:
        return df
    moments = [f(F.element_at(F.col(col), i + 1)) for i in range(width) for f in (F.avg, F.stddev_pop)] if width <= 128 else None
    if moments:
        row = df.agg(*(m.alias(f"m{i}") for i, m in enumerate(moments)))
        stats = row.select(F.array(*(F.struct(F.col(f"m{2 * i}").alias("mean"), F.when(F.col(f"m{2 * i + 1}") > 1e-12, F.col(f"m{2 * i + 1}")).otherwise(1.0).alias("sd")) for i in range(width))).alias("__stats"))
    else:
        by_place = df.select(F.posexplode(col).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
        listed = F.array_sort(F.collect_list(F.struct("pos", "mean", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0).alias("sd"))))  # a row for each dimension
        stats = by_place.agg(F.transform(listed, lambda s: F.struct(s["mean"].alias("mean"), s["sd"].alias("sd"))).alias("__stats"))
    scaled = F.zip_with(col, "__stats", lambda v, s: (v - s["mean"]) / s["sd"])
    return df.join(F.broadcast(stats)).withColumn(col, scaled).drop("__stats")
