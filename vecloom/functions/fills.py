"""Reproducible fills: each value follows from its number and a seed alone, however rows are dealt.

A counter-based generator works on 64-bit numbers that wrap, which SQL's integers don't, so values are
computed in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
#: splitmix64's increment and multipliers, and what tells a value's second draws from its first.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
EXPONENT_SEED, WIDE_SEED, WIDE_STRIDE = 0x5DEECE66D, 0xABCDEF, 2654435761


def hashed(x: np.ndarray) -> np.ndarray:
    x = x + U(STEP)
    x = (x ^ (x >> U(30))) * U(FIRST)
    x = (x ^ (x >> U(27))) * U(SECOND)
    return x ^ (x >> U(31))


def unit(h: np.ndarray) -> np.ndarray:
    """[0, 1) by the 53 high bits."""
    return (h >> U(11)).astype(np.float64) / 2.0**53


def draw(seed: int, at: np.ndarray) -> np.ndarray:
    return hashed(U(seed & (2**64 - 1)) ^ at)


def single(seed: int, at: np.ndarray, low: float, high: float) -> np.ndarray:
    """A uniform value, drawn in double and rounded once: all bits of a single are used."""
    return (low + unit(draw(seed, at)) * (high - low)).astype(np.float32)


def _column(number: Column, values: Callable[[np.ndarray], np.ndarray]) -> Column:
    def fill(batches):
        for batch in batches:
            yield pa.array(values(batch.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).astype(np.float64), pa.float64())

    fill.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(fill, "double")(number.cast("long"))


def uniform(number: Column, seed: int, low: float = -1.0, high: float = 1.0, exponents: float = 0.0) -> Column:
    """A single in [low, high); with exponents, times 2 to a uniform power within that range. number isn't null."""

    def values(at: np.ndarray) -> np.ndarray:
        v = single(seed, at, low, high)
        return v * np.exp2(single(seed ^ EXPONENT_SEED, at, -1.0, 1.0) * np.float32(exponents)) if exponents > 0 else v

    return _column(number, values)


def uniform_double(number: Column, seed: int) -> Column:
    """A double in [-1, 1)."""
    return _column(number, lambda at: 2.0 * unit(draw(seed, at)) - 1.0)


def normal(number: Column, seed: int) -> Column:
    """A standard normal double."""

    def values(at: np.ndarray) -> np.ndarray:
        first = draw(seed, at)
        return np.sqrt(-2.0 * np.log(np.maximum(unit(first), 1e-300))) * np.cos(2 * np.pi * unit(hashed(first ^ U(STEP))))

    return _column(number, values)


def wide(number: Column, seed: int, spread: float) -> Column:
    """A double in (-0.5, 0.5], times e to a uniform power of up to 3 * spread, up or down."""

    def values(at: np.ndarray) -> np.ndarray:
        v = unit(draw(seed, at)) - 0.5
        if spread <= 0:
            return v
        return v * np.exp(spread * (2.0 * unit(hashed(U((WIDE_SEED ^ seed) & (2**64 - 1)) ^ (at * U(WIDE_STRIDE)))) - 1.0) * 3.0)

    return _column(number, values)
