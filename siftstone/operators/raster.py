"""Measures of a small single-channel raster kept as an array column, in expressions only (no shuffle, no Python).

``p`` is an array<double> in row-major order; ``w`` and ``h`` are its sides. Image files of any size go through the
kernels in ``siftstone.functions.pixels``, which compute the same measures with numpy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(a) / F.size(a)).otherwise(F.lit(0.0))


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m)))))


def variation(a: Column) -> Column:
    """Coefficient of variation: deviation / |mean|, 0 where the mean is all but 0."""
    return let(mean(a), lambda m: F.when(F.abs(m) <= 1e-6, F.lit(0.0)).otherwise(deviation(a) / F.abs(m)))


def cells(w: int, h: int, where=lambda x, y: True) -> list[tuple[int, int]]:
    return [(x, y) for y in range(h) for x in range(w) if where(x, y)]


def at(p: Column, w: int, x: int, y: int) -> Column:
    return F.get(p, F.lit(y * w + x))


def _array(columns: list[Column]) -> Column:
    return F.array(*columns) if columns else F.array().cast("array<double>")


def hash_bits(bits: list[Column]) -> Column:
    """64-bit value of conditions, the first as lowest bit."""
    out = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        value = 1 << i
        out = out.bitwiseOR(F.when(b, F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def average_hash(p: Column) -> Column:
    """Bit i is set where value i of 64 is at least the mean."""
    return let(mean(p), lambda m: F.aggregate(F.zip_with(p, F.sequence(F.lit(0), F.lit(63)), lambda v, i: F.when(v >= m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def difference_hash(p: Column, w: int, h: int) -> Column:
    """Bits, row by row, where a cell is above its right neighbour."""
    return hash_bits([at(p, w, x, y) > at(p, w, x + 1, y) for x, y in cells(w - 1, h)][:64])


def fraction(p: Column, condition) -> Column:
    return mean(F.transform(p, lambda v: F.when(condition(v), 1.0).otherwise(0.0)))


def edge_x(p: Column, w: int, h: int, where=lambda x: True) -> Column:
    """Mean |difference| of horizontal neighbours (x - 1, x) where x is chosen."""
    return mean(_array([F.abs(at(p, w, x, y) - at(p, w, x - 1, y)) for x, y in cells(w, h) if x > 0 and where(x)]))


def edge_y(p: Column, w: int, h: int) -> Column:
    return mean(_array([F.abs(at(p, w, x, y) - at(p, w, x, y - 1)) for x, y in cells(w, h) if y > 0]))


def boundary_ratio(p: Column, w: int, h: int, block: int) -> Column:
    """Mean step at block boundaries over mean step inside blocks; 1 where there is none inside."""
    inside = edge_x(p, w, h, lambda x: x % block)
    return let(inside, lambda i: F.when(i <= 1e-9, F.lit(1.0)).otherwise(edge_x(p, w, h, lambda x: x % block == 0) / i))


def phase_dominance(p: Column, w: int, h: int, phases: int) -> Column:
    """Largest over mean of the mean steps by x modulo ``phases``."""
    each = _array([edge_x(p, w, h, lambda x, k=k: x % phases == k) for k in range(phases)])
    return let(each, lambda e: F.when(mean(e) <= 1e-9, F.lit(0.0)).otherwise(F.array_max(e) / mean(e)))


def periodicity(p: Column, w: int, h: int, longest: int, step: int = 2) -> Column:
    """Largest coefficient of variation, over periods 2 to ``longest``, of the mean |second difference| by x modulo the
    period. With step 2 only odd x are taken, so that even periods have phases without a value, which count as 0."""
    chosen = [(x, y) for x, y in cells(w, h) if 1 <= x < w - 1 and (x - 1) % step == 0]
    second = lambda x, y: F.abs(at(p, w, x - 1, y) - 2 * at(p, w, x, y) + at(p, w, x + 1, y))
    return F.greatest(*[variation(_array([mean(_array([second(x, y) for x, y in chosen if x % n == k])) for k in range(n)])) for n in range(2, longest + 1)])


def region_variation(p: Column, w: int, h: int, regions: int) -> Column:
    """Coefficient of variation of the mean |high-pass| by region, the border left out."""
    high = lambda x, y: F.abs(4 * at(p, w, x, y) - at(p, w, x - 1, y) - at(p, w, x + 1, y) - at(p, w, x, y - 1) - at(p, w, x, y + 1))
    inner = [(x, y) for x, y in cells(w, h) if 0 < x < w - 1 and 0 < y < h - 1]
    groups: dict = {}
    for x, y in inner:
        groups.setdefault((min(regions - 1, x * regions // w), min(regions - 1, y * regions // h)), []).append(high(x, y))
    return variation(_array([mean(_array(groups[k])) for k in sorted(groups)]))


def peakiness(p: Column, bins: int, low: float, high: float) -> Column:
    """Largest bin over the mean of all bins."""
    bin_ = lambda v: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - low) / (high - low) * bins).cast("int")))
    one = lambda b, k: _sum(F.transform(b, lambda v: F.when(v == k, 1.0).otherwise(0.0)))
    counts = lambda b: _array([one(b, k) for k in range(bins)])
    return let(F.transform(p, bin_), lambda b: F.array_max(counts(b)) / (F.size(b) / F.lit(float(bins))))


def edge_density(p: Column, w: int, h: int, above: float) -> Column:
    """Share of inner cells whose |dx| + |dy| (to the left and upper neighbour) is above a threshold."""
    inner = [(x, y) for x, y in cells(w, h) if x > 0 and y > 0]
    return mean(_array([F.when(F.abs(at(p, w, x, y) - at(p, w, x - 1, y)) + F.abs(at(p, w, x, y) - at(p, w, x, y - 1)) > above, 1.0).otherwise(0.0) for x, y in inner]))


def upper_median(a: Column) -> Column:
    """The element at n div 2 of the sorted array."""
    return F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))


def dct_low(p: Column, w: int, h: int, band: int) -> Column:
    """The ``band`` x ``band`` lowest unnormalised DCT-II coefficients, row by row."""
    out = []
    for v in range(band):
        for u in range(band):
            weights = [math.cos((2 * x + 1) * u * math.pi / (2 * w)) * math.cos((2 * y + 1) * v * math.pi / (2 * h)) for x, y in cells(w, h)]
            out.append(_sum(F.zip_with(p, F.array(*map(F.lit, weights)), lambda a, b: a * b)))
    return F.array(*out)


def pair_error(a: Column, b: Column) -> tuple[Column, Column]:
    """Mean absolute and root mean square difference."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    return mean(F.transform(d, lambda x: F.abs(x))), F.sqrt(mean(F.transform(d, lambda x: x * x)))
