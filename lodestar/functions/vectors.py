"""Column functions over array<double> vectors; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(c: str | Column) -> Column:
    """A vector column in double precision."""
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm product is below 1e-8."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-8, 0.0).otherwise(dot(a, b) / n)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where f uses it inside a lambda."""
    return F.transform(F.array(value), f)[0]


def scale(a: Column, k: Column | float) -> Column:
    return let(F.lit(k) if isinstance(k, (int, float)) else k, lambda c: F.transform(a, lambda x: x * c))


def normalise(a: Column) -> Column:
    """Projection to the unit sphere; a zero vector stays zero."""
    return let(a, lambda v: scale(v, 1.0 / (norm(v) + 1e-8)))


def geodesic(a: Column, b: Column) -> Column:
    """Arc length between unit vectors; 0 when they nearly coincide."""
    return let(dot(a, b), lambda d: F.when(d > 1 - 1e-5, 0.0).otherwise(F.acos(F.least(F.greatest(d, F.lit(-1 + 1e-7)), F.lit(1 - 1e-7)))))


def tangent(v: Column, x: Column) -> Column:
    """v without its part along x."""
    return let(v, lambda a: let(x, lambda b: let(dot(a, b), lambda d: F.zip_with(a, b, lambda p, q: p - d * q))))


def exp_map(x: Column, v: Column) -> Column:
    def moved(a, b, n):
        return F.when(n < 1e-10, a).otherwise(F.zip_with(a, b, lambda p, q: F.cos(n) * p + F.sin(n) * q / n))

    return let(x, lambda a: let(v, lambda b: let(norm(b), lambda n: moved(a, b, n))))


def log_map(x: Column, y: Column) -> Column:
    def along(t, d, n):
        return F.when(n < 1e-10, scale(t, 0.0)).otherwise(scale(t, d / n))

    return let(x, lambda a: let(y, lambda b: let(tangent(b, a), lambda t: along(t, geodesic(a, b), norm(t)))))


def matryoshka(a: Column, d: int) -> Column:
    """The first d components on the unit sphere."""
    return normalise(F.slice(a, 1, d))


def pairs(a: Column) -> Column:
    """Consecutive components as (x, y) structs."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 2).cast("int") - 1), lambda i: F.struct(a[2 * i].alias("x"), a[2 * i + 1].alias("y")))


def polar_encode(a: Column, bits: int) -> Column:
    """Array of (r, code): radius and angle bin of each pair."""
    n = 1 << bits
    return F.transform(pairs(a), lambda p: F.struct(F.hypot(p.x, p.y).alias("r"), F.pmod(F.floor((F.atan2(p.y, p.x) + math.pi) / (2 * math.pi) * n), F.lit(n)).cast("int").alias("code")))


def polar_decode(codes: Column, bits: int) -> Column:
    """Vectors from polar codes, each angle at the left edge of its bin."""
    step = 2 * math.pi / (1 << bits)
    return F.flatten(F.transform(codes, lambda c: F.array(c.r * F.cos(c.code * step - math.pi), c.r * F.sin(c.code * step - math.pi))))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of radius 6371."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def is_inside(p: Column, low: Column, high: Column) -> Column:
    """Point in an axis-aligned box."""
    return F.forall(F.arrays_zip(p.alias("p"), low.alias("l"), high.alias("h")), lambda t: (t.p >= t.l) & (t.p <= t.h))
