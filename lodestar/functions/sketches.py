"""Seeded random sketches of vectors, in Arrow batches: rotations, sign sketches, two-stage codes, hash buckets.

The random matrices depend on the dimension and the seed alone, so every task makes the same ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """An orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def projections(m: int, dim: int, seed: int = 43) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((m, dim))


def mapped(vectors: DataFrame, f, schema: str, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, ...) with f(matrix) -> list of Arrow arrays behind the keys, a batch at a time.

    Vectors that are null, of another dimension than most or with a component that is not finite have no code and no row.
    """
    from ..operators import knn

    names = [c.split()[0] for c in schema.split(", ")]
    dim = knn.dimension(vectors, vec)

    def run(batches):
        for b in batches:
            x, which = knn.matrix(b.column(1), dim)
            if len(x):
                yield pa.record_batch([b.column(0).filter(pa.array(which)), *f(x)], names=["key", *names])

    return vectors.select(F.col(key).cast("long"), F.col(vec).cast("array<float>")).mapInArrow(run, f"key long, {schema}").withColumnRenamed("key", key)


def lists(x: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def polar(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(radius, code) of each pair of components."""
    a, b = x[:, ::2], x[:, 1::2]
    return np.hypot(a, b), np.floor((np.arctan2(b, a) + math.pi) / (2 * math.pi) * (1 << bits)).astype(np.int64) % (1 << bits)


def unpolar(r: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    """Vectors from codes, each angle at the left edge of its bin."""
    t = code * (2 * math.pi / (1 << bits)) - math.pi
    return np.stack([r * np.cos(t), r * np.sin(t)], axis=2).reshape(len(r), -1)


def sign_sketch(x: np.ndarray, m: int, seed: int = 43) -> np.ndarray:
    return np.where(x @ projections(m, x.shape[1], seed).T >= 0, 1, -1).astype(np.int8)


def sign_inner_product(signs: np.ndarray, norms: np.ndarray, query: np.ndarray, seed: int = 43, reference_scale: bool = False) -> np.ndarray:
    """Estimate of <x, query>; the unbiased scale is sqrt(pi / 2) |x| / m, the other one pi / (2 m)."""
    m = signs.shape[1]
    scale = math.pi / (2 * m) if reference_scale else math.sqrt(math.pi / 2) * norms / m
    return scale * (signs @ (projections(m, len(query), seed) @ query))


def two_stage(x: np.ndarray, query: np.ndarray, bits: int = 8, m: int = 128, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(inner product, distance) estimates: polar codes of the rotated vector, and a sign sketch of what they miss."""
    turn = rotation(x.shape[1], seed)
    y, q = x @ turn.T, turn @ query
    r, code = polar(y, bits - 1)
    near = unpolar(r, code, bits - 1)
    rest = y - near
    ip = near @ q + sign_inner_product(sign_sketch(rest, m, seed + 1), np.linalg.norm(rest, axis=1), q, seed + 1)
    return ip, np.sqrt(np.maximum(0.0, query @ query + (r**2).sum(axis=1) - 2 * ip))


def cross_polytope(x: np.ndarray, turns: int = 2, seed: int = 44, identity: bool = False) -> np.ndarray:
    """For each rotation, twice the place of the largest component by size, and one more where it is negative."""
    out = []
    for t in range(turns):
        y = x if identity else x @ rotation(x.shape[1], seed + t).T
        at = np.abs(y).argmax(axis=1)
        out.append(2 * at + (y[np.arange(len(y)), at] < 0))
    return np.stack(out, axis=1)


def multi_probe(x: np.ndarray, turns: int = 2, top: int = 3, n: int = 6, seed: int = 44) -> list[list[list[int]]]:
    """The n most likely hashes of each row: combinations of each rotation's top components, by the sum of their sizes."""
    import itertools

    ys = [x @ rotation(x.shape[1], seed + t).T for t in range(turns)]
    out = []
    for i in range(len(x)):
        choices = []
        for y in ys:
            at = np.argsort(-np.abs(y[i]), kind="stable")[:top]
            choices.append([(abs(float(y[i, j])), int(2 * j + (y[i, j] < 0))) for j in at])
        found = sorted(itertools.product(*choices), key=lambda c: (-sum(s for s, _ in c), [h for _, h in c]))
        out.append([[h for _, h in c] for c in found[:n]])
    return out


def project(x: np.ndarray, out_dim: int, seed: int = 45) -> np.ndarray:
    """A linear head, then the unit sphere."""
    w = projections(out_dim, x.shape[1], seed) * math.sqrt(2.0 / x.shape[1])
    y = x @ w.T
    return y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-8)


def fnv1a(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h
