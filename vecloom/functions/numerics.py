"""Low-precision rounding, residual splits, error models and integer slices, as columns or plain numbers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit roundoffs of half and single precision, the comparison slack, the largest autoscaled value.
U16, U32, SLACK, SCALE_TO = 2.0**-11, 2.0**-24, 8 * 2.0**-24, 4096.0


#: The most words and terms of a split product, and of a half-precision one; bits of the integer that slices are fields of.
MOST_WORDS, MOST_HALF_WORDS, SLICE_BITS = 16, 4, 63


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exponent(x: Column) -> Column:
    """floor(log2 x) of x > 0, put right where the logarithm is off by one."""
    g = F.floor(F.log2(x))
    return F.when(F.pow(F.lit(2.0), g) > x, g - 1).when(F.pow(F.lit(2.0), g + 1) <= x, g + 1).otherwise(g)


def _rounded(x: Column, bits: int, least: int) -> Column:
    a = F.abs(x)
    q = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(a)), F.lit(least)) - bits)
    return F.when((x == 0) | F.isnan(x) | (a == float("inf")), x).otherwise(F.rint(x / q) * q)


def fp16(x: Column) -> Column:
    """Nearest half-precision value, ties to even; beyond its range infinite."""
    return F.when(F.abs(x) >= 65520.0, F.signum(x) * F.lit(float("inf"))).otherwise(_rounded(x, 10, -14))


def bf16(x: Column) -> Column:
    """Nearest value of 8 significant bits, ties to even."""
    return _rounded(x, 7, -126)


def words_of(x: Column, words: int, rounding: Callable[[Column], Column]) -> Column:
    """Words of x as an array: each is the rounded remainder of those before. Each is computed once."""

    def step(state: Column, _: Column) -> Column:
        return let(rounding(state["rest"]), lambda w: F.struct((state["rest"] - w).alias("rest"), F.concat(state["words"], F.array(w)).alias("words")))

    start = F.struct(x.alias("rest"), F.array().cast("array<double>").alias("words"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(words)), start, step, lambda s: s["words"])


def split(x: Column, words: int, rounding: Callable[[Column], Column]) -> list[Column]:
    """Words of x: each is the rounded remainder of those before."""
    if words < 1:
        raise ValueError("a split has one word at least")
    if words == 1:
        return [rounding(x)]
    every = words_of(x, words, rounding)
    return [F.element_at(every, n + 1) for n in range(words)]


def autoscale(largest: Column) -> Column:
    """The largest power of two that keeps largest at most SCALE_TO; 1 for null or 0."""
    return F.when(largest > 0, F.pow(F.lit(2.0), exponent(F.lit(SCALE_TO) / largest))).otherwise(1.0)


def word_class(word: Column, rest: Column) -> Column:
    small = ((word == 0) & (rest != 0)) | ((word != 0) & (F.abs(word) < 2.0**-14))
    return F.when(F.isnan(word) | (F.abs(word) == float("inf")), "overflow").when(small, "subnormal").otherwise("ok")


def slices(v: Column, e: Column, count: int, bits: int) -> list[Column]:
    """Signed fields of bits bits of |v| 2^-e, from the top; all 0 where e is null, which stands for a row of zeros."""
    if count < 1 or not 1 <= bits <= 7 or count * bits > SLICE_BITS:
        raise ValueError(f"{count} slices of {bits} bits: slices are of 1 to 7 bits, and all together of {SLICE_BITS} at most")
    whole = F.coalesce(F.floor(F.abs(v) * F.pow(F.lit(2.0), -e) * 2.0 ** (count * bits)).cast("long"), F.lit(0).cast("long"))
    return [(F.shiftright(whole, (count - 1 - p) * bits).bitwiseAND(F.lit((1 << bits) - 1)) * F.when(v < 0, -1).otherwise(1)).cast("long") for p in range(count)]


def gamma(n: int, u: float) -> float:
    return n * u / (1 - n * u) if n * u < 1 else math.inf


def epsilon(d: int, accumulator: float = U32) -> float:
    """Relative error of a product of half-precision vectors; -1 where the model holds no more."""
    return 2 * U16 + gamma(d, accumulator) if d * accumulator < 1 else -1.0


def multiword_epsilon(d: int, macs: int) -> float:
    """Relative error after the first 1, 2 or 3 products of two-word splits; -1 where the model holds no more, or for other numbers.

    What the products left out are worth, and the accumulation, which grows by the products' own sums."""
    if macs not in (1, 2, 3):
        return -1.0
    left_out = {1: 2 * U16 + U16**2, 2: U16 + U16**2, 3: 3 * U16**2}[macs]
    more = {1: 0, 2: 1, 3: 3}[macs]
    error = (1 + left_out) * (1 + gamma(d + more, U32)) - 1
    return error if error < 1 else -1.0


def bits_per_slice(k: int) -> int:
    """Bits of a slice so that k products of two slices add up below 2^31; 0 where one bit is too many."""
    return max(0, min((31 - math.ceil(math.log2(k))) // 2, 7)) if k > 0 else 0


def longest_inner(bits: int) -> int:
    """The longest inner index for slices of bits bits."""
    return (2**31 - 1) // ((1 << bits) - 1) ** 2 if bits > 0 else 0


def slice_terms(count: int) -> int:
    """Products of slices whose numbers add up to less than count."""
    return count * (count + 1) // 2


def term_count(words: int) -> int:
    """Products of a split in words; 0 beyond MOST_WORDS."""
    return words * words if 1 <= words <= MOST_WORDS else 0


def half_term_count(words: int) -> int:
    """Products of a half-precision split that its error bound keeps; 0 beyond MOST_HALF_WORDS."""
    return words * (words + 1) // 2 if 1 <= words <= MOST_HALF_WORDS else 0


def reliability(d: int, theta: float = 2.5) -> float:
    """The share of the norms that a half-precision distance must exceed to be relied on; an error where the model holds no more."""
    if (d + 2) * U16 >= 1:
        raise ValueError(f"the reliability model holds up to dimension {int(1 / U16) - 3}, not {d}")
    return theta * 2 * gamma(d + 2, U16)


def terms(words: int, most: int | None = None) -> list[tuple[int, int]]:
    """Pairs of words by ascending sum, then first: the order in which products refine a result."""
    return sorted(((i, j) for i in range(words) for j in range(words)), key=lambda t: (t[0] + t[1], t[0]))[:most]
