"""Matrix products of rows of vectors: exact, split in words, or in integer slices; also as joins of entries.

A product takes a left operand of any size, rows (i, x), and a right one, rows (j, y), whose columns
of words are constants of the plan where they are few enough (with more, block by block). So the left operand's rows
are read once a block and nothing is shuffled: each row makes its own part of the result. The
same products over entries (i, l, v) join on the inner index; they are for sparse operands.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions import numerics as N
from vecloom.functions import vectors as V

#: Values of the right operand that one constant may hold; with more it is dealt in blocks.
BLOCK_VALUES = 1_000_000


# Rows ------------------------------------------------------------------------------------------
def constant_blocks(b: DataFrame) -> list[Column]:
    """The rows of b as constant arrays of structs in order of j, each of at most BLOCK_VALUES values. b is the small operand: its rows come to the driver."""
    kind = b.select(F.struct(*b.columns).alias("s")).schema["s"].dataType.simpleString()
    blocks, held, size = [], [], 0
    for r in sorted(b.collect(), key=lambda r: r["j"]):
        value = r.asDict(recursive=True)
        n = sum(len(v) for v in value.values() if isinstance(v, list))
        if held and size + n > BLOCK_VALUES:
            blocks.append(held)
            held, size = [], 0
        held.append(value)
        size += n
    return [F.from_json(F.lit(json.dumps(block)), f"array<{kind}>") for block in [*blocks, held]]


def each_pair(a: DataFrame, b: DataFrame, result: Callable[[Column], Column], keep: list[str] | None = None) -> DataFrame:
    """Rows of a with each row of b: i, j and the fields of the struct that result makes of b's struct; a's columns are at hand in it."""
    out = None
    for block in constant_blocks(b):
        pairs = F.transform(block, lambda s: F.struct(s["j"].alias("j"), result(s).alias("r")))
        one = a.select("i", *(keep or []), F.explode(pairs).alias("p")).select("i", *(keep or []), "p.j", "p.r.*")
        out = one if out is None else out.unionByName(one)
    return out


def combined(products: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """i, j, v: alpha times the products (i, j, v) plus beta times c (i, j, v). With beta 0 c is never read; where
    either lacks an entry it counts as 0."""
    scaled = products.select("i", "j", (F.col("v") * alpha).alias("v"))
    if not beta:
        return scaled
    if c is None:
        raise ValueError("beta needs a matrix to add")
    both = scaled.join(c.select("i", "j", F.col("v").alias("w")), ["i", "j"], "full")
    return both.select("i", "j", (F.coalesce("v", F.lit(0.0)) + beta * F.coalesce("w", F.lit(0.0))).alias("v"))


def gemm_of_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v: the transpose of A times B, rows (i, x) and (i, y) of one index, which may be of any size: tasks add up
    products of their own rows, so a result's rows a task are shuffled, not operands' columns."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "y"))
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = a.join(b, "i").select("x", "y").mapInArrow(sums, "i long, row array<double>")
    return parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", F.col("j").cast("long").alias("j")).agg(F.sum("v").alias("v"))


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, transpose_a: bool = False) -> DataFrame:
    """i, j, v: alpha A B + beta C. a is rows (i, x), b B's columns (j, y); with transpose_a both are rows (i, x) and (i, y) of the inner index."""
    if transpose_a:
        return combined(gemm_of_columns(a, b), alpha, beta, c)
    x = F.col("x")
    return combined(each_pair(a, b, lambda s: F.struct(V.dot(x, s["y"]).alias("v"))), alpha, beta, c)


def nth(p: int) -> Callable[[Column], Column]:
    return lambda array: F.element_at(array, p + 1)


def worded(rows: DataFrame, col: str, words: int, rounding, scale: float = 1.0) -> DataFrame:
    """rows with col as its planes: an array of words, each an array as long as col; every value is split once."""
    split = rows.withColumn("__w", F.transform(col, lambda v: N.words_of(v * scale, words, rounding)))
    planes = F.array(*(F.transform("__w", nth(p)) for p in range(words)))
    return split.withColumn(col, planes).drop("__w")


def schedule(words: int, begin: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """Terms begin to end (None: all) of a split product: number, word of the left operand, word of the right one."""
    every = N.terms(words)
    end = len(every) if end is None else end
    if not N.term_count(words) or not 0 <= begin <= end <= len(every):
        raise ValueError(f"no terms {begin} to {end} of {words} words")
    return [(n, p, q) for n, (p, q) in enumerate(every)][begin:end]


def term_rows(a: DataFrame, b: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """i, j, pos, bin, v: a product for each planned term of operands that worded has made (x and y are planes)."""
    x = F.col("x")

    def result(s: Column) -> Column:
        terms = [F.struct(F.lit(n).alias("pos"), F.lit(p + q).alias("bin"), V.dot(F.element_at(x, p + 1), F.element_at(s["y"], q + 1)).alias("v")) for n, p, q in plan]
        return F.struct(F.array(*terms).alias("ts"))

    return each_pair(a, b, result).select("i", "j", F.explode("ts").alias("t")).select("i", "j", "t.*")


def prefix_rows(a: DataFrame, b: DataFrame, words: int, counts: list[int], unscale: float = 1.0) -> DataFrame:
    """i, j, terms, v: the products of the first so many terms, for each of counts, all from one look at a row."""
    x, plan = F.col("x"), schedule(words, 0, max(counts))

    def result(s: Column) -> Column:
        terms = F.array(*(V.dot(F.element_at(x, p + 1), F.element_at(s["y"], q + 1)) for _, p, q in plan))
        return F.struct(N.let(terms, lambda t: F.array(*(F.struct(F.lit(n).alias("terms"), (V.total(F.slice(t, 1, n)) * unscale).alias("v")) for n in counts))).alias("ps"))

    return each_pair(a, b, result).select("i", "j", F.explode("ps").alias("p")).select("i", "j", "p.*")


def split_gemm(a: DataFrame, b: DataFrame, words: int, rounding, begin: int = 0, end: int | None = None, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, scales: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """i, j, v: alpha times the sum of terms begin to end, plus beta C: a refinement goes on where the one before stopped, with
    beta 1 and its result as C. No terms at all leave beta C. Scales are taken out again."""
    plan = schedule(words, begin, end)
    if not plan:
        if not beta or c is None:
            x = F.col("x")
            return each_pair(a, b, lambda s: F.struct((F.size(x) * 0.0).alias("v")))
        return c.select("i", "j", (F.col("v") * beta).alias("v"))
    left, right = worded(a, "x", words, rounding, scales[0]), worded(b, "y", words, rounding, scales[1])
    x, unscale = F.col("x"), alpha / (scales[0] * scales[1])

    def result(s: Column) -> Column:
        return F.struct(V.total(F.array(*(V.dot(F.element_at(x, p + 1), F.element_at(s["y"], q + 1)) for _, p, q in plan))).alias("v"))

    return combined(each_pair(left, right, result), unscale, beta, c)


def stacked(rows: DataFrame, col: str, words: int, rounding, scale: float = 1.0) -> DataFrame:
    """rows with col as its words one behind the other in reverse: word p begins at (words - 1 - p) times col's length."""
    return worded(rows, col, words, rounding, scale).withColumn(col, F.flatten(F.reverse(col)))


def concat_bins(a: DataFrame, b: DataFrame, words: int, rounding, length: int) -> DataFrame:
    """i, j, bin, v: for each sum of word numbers one product of longer vectors: the left one's words in order against
    as many of the right one's, which stand in reverse, so that those that belong together meet. length: of the operands' vectors."""
    left, right = worded(a, "x", words, rounding), stacked(b, "y", words, rounding)
    x = F.col("x")

    def result(s: Column) -> Column:
        out = []
        for n in range(2 * words - 1):
            low, high = max(0, n - words + 1), min(n, words - 1)
            many = high - low + 1
            mine = F.flatten(F.slice(x, low + 1, many))
            theirs = F.slice(s["y"], (words - 1 - n + low) * length + 1, many * length)
            out.append(F.struct(F.lit(n).alias("bin"), V.dot(mine, theirs).alias("v")))
        return F.struct(F.array(*out).alias("bs"))

    return each_pair(left, right, result).select("i", "j", F.explode("bs").alias("b")).select("i", "j", "b.*")


def batched(a: DataFrame, b: DataFrame, words: int, rounding, begin: int = 0, end: int | None = None) -> DataFrame:
    """i, j, v: all planned terms at once, then one reduction; the same as split_gemm's."""
    plan = schedule(words, begin, end)
    if not plan:
        raise ValueError("an empty plan")
    return term_rows(worded(a, "x", words, rounding), worded(b, "y", words, rounding), plan).groupBy("i", "j").agg(F.sum("v").alias("v"))


def row_exponent(x: Column) -> Column:
    """The least power of two above a vector's finite entries; null for zeros alone."""
    return N.let(V.max_abs(x), lambda m: F.when(m > 0, N.exponent(m) + 1).cast("int"))


def sliced_rows(rows: DataFrame, col: str, count: int, bits: int) -> DataFrame:
    """rows with e, the exponent of col, and col as count planes of integers on it; a row of zeros has a null e and planes of zeros."""
    with_e = rows.withColumn("e", row_exponent(F.col(col)))
    fields = F.transform(col, lambda v: F.array(*N.slices(v, F.col("e").cast("double"), count, bits)))
    cut = with_e.withColumn("__s", fields)
    return cut.withColumn(col, F.array(*(F.transform("__s", nth(p)) for p in range(count)))).drop("__s")


def slice_rows(a: DataFrame, b: DataFrame, count: int) -> DataFrame:
    """i, j, bin, t, ea, eb: exact integer sums of products of slices whose numbers add up to bin, less than count. a and b are what sliced_rows has made."""
    x = F.col("x")

    def whole(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda v, w: v * w), F.lit(0).cast("long"), lambda acc, v: acc + v)

    def result(s: Column) -> Column:
        bins = [F.struct(F.lit(n).alias("bin"), sum((whole(F.element_at(x, p + 1), F.element_at(s["y"], n - p + 1)) for p in range(1, n + 1)), whole(F.element_at(x, 1), F.element_at(s["y"], n + 1))).alias("t")) for n in range(count)]
        return F.struct(F.col("e").alias("ea"), s["e"].alias("eb"), F.array(*bins).alias("bs"))

    return each_pair(a, b, result).select("i", "j", "ea", "eb", F.explode("bs").alias("b")).select("i", "j", "ea", "eb", "b.*")


# Entries -----------------------------------------------------------------------------------------
def entries(rows: DataFrame) -> DataFrame:
    """i, l, v from rows (i, x)."""
    return rows.select("i", F.posexplode("x").alias("l", "v"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v of A times the transpose of B; both in entries. Joined on the inner index, summed map-side first."""
    right = b.select(F.col("i").alias("j"), "l", F.col("v").alias("w"))
    return a.join(right, "l").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def planes(a: DataFrame, words: int, rounding, scale: float = 1.0) -> DataFrame:
    """i, l, p, v: entry by entry the words of a split."""
    return a.select("i", "l", F.posexplode(N.words_of(F.col("v") * scale, words, rounding)).alias("p", "v"))


def term_products(a: DataFrame, b: DataFrame, words: int) -> DataFrame:
    """i, j, pos, bin, v: a product for each term of the schedule, in its order; any prefix sums to a refinement of the one before."""
    spark = a.sparkSession
    terms = spark.createDataFrame(schedule(words), "pos int, p int, q int")
    right = b.select(F.col("i").alias("j"), "l", F.col("p").alias("q"), F.col("v").alias("w"))
    joined = a.join(right, "l").join(F.broadcast(terms), ["p", "q"])
    return joined.groupBy("i", "j", "pos", (F.col("p") + F.col("q")).alias("bin")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def prefixes(products: DataFrame, counts: list[int], unscale: float = 1.0) -> DataFrame:
    """i, j, terms, v for each number of terms."""
    spark = products.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(n,) for n in counts], "terms int"))
    return products.join(sizes, F.col("pos") < F.col("terms")).groupBy("i", "j", "terms").agg((F.sum("v") * unscale).alias("v"))


def exponents(a: DataFrame) -> DataFrame:
    """i, e: the least power of two above each row's entries; null for a row of zeros."""
    top = a.groupBy("i").agg(F.max(F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.abs("v"))).alias("m"))
    return top.select("i", N.let(F.col("m"), lambda m: F.when(m > 0, N.exponent(m) + 1).cast("int")).alias("e"))


def sliced(a: DataFrame, count: int, bits: int) -> DataFrame:
    """i, l, p, v, e: integer slices of entries on their row's exponent; zeros, and a null e, for a row of zeros."""
    joined = a.join(exponents(a), "i")
    fields = F.posexplode(F.array(*N.slices(F.col("v"), F.col("e").cast("double"), count, bits)))
    return joined.select("i", "l", "e", fields.alias("p", "v"))


def slice_products(a: DataFrame, b: DataFrame, count: int) -> DataFrame:
    """i, j, bin, t, ea, eb: exact integer sums of slice products by bin, less than count."""
    right = b.select(F.col("i").alias("j"), "l", F.col("p").alias("q"), F.col("v").alias("w"), F.col("e").alias("eb"))
    joined = a.withColumnRenamed("e", "ea").join(right, "l").filter(F.col("p") + F.col("q") < count)
    return joined.groupBy("i", "j", (F.col("p") + F.col("q")).alias("bin")).agg(F.sum(F.col("v") * F.col("w")).alias("t"), F.first("ea").alias("ea"), F.first("eb").alias("eb"))


def folded(products: DataFrame, bits: int, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """i, j, v from slice products: alpha times their sum plus beta C. An entry of a row or column of zeros is 0, or beta C."""
    weight = F.pow(F.lit(2.0), (F.col("ea") + F.col("eb") - (F.col("bin") + 2) * bits).cast("double"))
    return combined(products.groupBy("i", "j").agg(F.sum(F.coalesce(F.col("t") * weight, F.lit(0.0))).alias("v")), alpha, beta, c)


def error_norms(c: DataFrame, d: DataFrame, by: str) -> DataFrame:
    """by, rel_frob, rel_max of c (i, j, by, v) against d (i, j, v)."""
    joined = c.join(d.select("i", "j", F.col("v").alias("w")), ["i", "j"])
    gap = F.col("v") - F.col("w")
    return joined.groupBy(by).agg(F.sqrt(F.sum(gap * gap) / F.sum(F.col("w") * F.col("w"))).alias("rel_frob"), (F.max(F.abs(gap)) / F.max(F.abs("w"))).alias("rel_max"))


def split_report(rows: DataFrame, value: str, back: str, by: list[str] | None = None) -> DataFrame:
    """Of values and what their words or slices add up to: how many are inexact, the largest relative error (of values that aren't 0),
    and the largest error over the largest value."""
    gap = F.abs(F.col(value) - F.col(back))
    return rows.groupBy(*(by or [])).agg(F.count_if(gap > 0).alias("inexact"), F.max(F.when(F.col(value) != 0, gap / F.abs(value))).alias("rel"), (F.max(gap) / F.max(F.abs(value))).alias("norm"), F.count("*").alias("n"))
