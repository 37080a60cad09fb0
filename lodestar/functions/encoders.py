"""Column encoders: 3-D points with colours and attributes to 640 components, and text to hashed features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

EPS = 1e-8


def positions(x: Column, y: Column, z: Column, bands: int = 10, dim: int = 64) -> Column:
    """sin and cos of 2^band times each coordinate (scaled to [0, 1] before), padded with zeros."""
    waves = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda d: F.flatten(F.transform(F.array(x, y, z), lambda c: F.array(F.sin(c * F.pow(F.lit(2.0), d)), F.cos(c * F.pow(F.lit(2.0), d)))))))
    return F.concat(waves, F.array_repeat(F.lit(0.0), dim - 6 * bands)) if dim > 6 * bands else waves


def colours(r: Column, g: Column, b: Column, bins: int = 8) -> Column:
    """exp(-d2 / 4) of every cell of a colour cube from the colour's own cell.

    The plane of all cells with one r is one of ``bins`` ** 3, by its distance in r and the own cell's g and b: a literal of the plan holds them all.
    """
    cell = lambda c: F.least(F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * bins), F.lit(bins - 1)).cast("int")
    n = range(bins)
    planes = [math.exp(-((dr * dr + (i - g) ** 2 + (j - b) ** 2) / 4.0)) for dr in n for g in n for b in n for i in n for j in n]
    table = F.split(F.lit(",".join(map(repr, planes))), ",").cast("array<double>")  # folded when the plan is made
    own = cell(g) * bins + cell(b)
    return V.let(table, lambda t: F.flatten(F.array(*[F.slice(t, (F.abs(cell(r) - i) * bins * bins + own) * bins * bins + 1, bins * bins) for i in n])))


def attributes(o: Column, scale: list[Column], turn: list[Column]) -> Column:
    """Powers and flags of opacity (8 places), scale statistics (24), quaternion products (32)."""
    x, y, z = scale
    w, i, j, k = turn
    opacity = [o, o * o, o * o * o, F.sqrt(o + EPS), F.log(o + EPS), 1.0 - o, F.when(o > 0.5, 1.0).otherwise(0.0), F.when(o < 0.5, 1.0).otherwise(0.0)]
    sizes = [x, y, z, x * y * z, (x + y + z) / 3.0, F.sqrt(x * x + y * y + z * z), x / (y + EPS), x / (z + EPS), y / (z + EPS), x * x, y * y, z * z, F.log(x + EPS), F.log(y + EPS), F.log(z + EPS)]
    turns = [w, i, j, k, w * w, i * i, j * j, k * k, w * i, w * j, w * k, i * j, i * k, j * k]
    pad = lambda row, n: [c.cast("double") for c in row] + [F.lit(0.0)] * (n - len(row))
    return F.array(*pad(opacity, 8), *pad(sizes, 24), *pad(turns, 32))


def unit_quaternion(q: list[Column]) -> list[Column]:
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0])) + EPS
    return [c / n for c in q]


def rotation_matrix(q: list[Column]) -> list[list[Column]]:
    """Rows of the rotation of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)],
        [2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)],
        [2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)],
    ]


def covariance(q: list[Column], scale: list[Column]) -> list[list[Column]]:
    """R S S' R' of a rotation and scales."""
    r = rotation_matrix(q)
    return [[sum((r[a][k] * scale[k] * scale[k] * r[b][k] for k in range(1, 3)), r[a][0] * scale[0] * scale[0] * r[b][0]) for b in range(3)] for a in range(3)]


def hashed(text: Column, dim: int = 64) -> Column:
    """A text's pseudo-random unit vector."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(20001)) / 10000.0 - 1.0)
    return V.normalise(raw)


def features(text: Column) -> Column:
    """Character trigrams, and words and word pairs under marks of their own."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    grams = V.let(F.split(low, ""), lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: F.concat_ws("", F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
    pairs = V.let(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.lit("wb:"), F.get(w, i), F.get(w, i + 1))))
    return F.concat(F.when(F.length(low) >= 3, grams).otherwise(F.array(low)), F.transform(words, lambda w: F.concat(F.lit("w:"), w)), F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


#: Encoders by name: functions of a table that return (key, embedding).
REGISTRY: dict = {}


def register(name: str, encode) -> None:
    """Make ``encode(table) -> (key, embedding)`` known under a name; a later one of the same name replaces it."""
    REGISTRY[name] = encode


def encode(name: str, table: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """What the named encoder gives, with vectors cut or filled with zeros to ``dim`` components and of length 1; null vectors stay null."""
    if name not in REGISTRY:
        raise KeyError(f"no encoder {name!r}; there are {sorted(REGISTRY)}")
    fitted = F.slice(F.concat(V.vec(vec), F.array_repeat(F.lit(0.0), dim)), 1, dim)
    return REGISTRY[name](table).withColumn(vec, V.normalise(fitted))
