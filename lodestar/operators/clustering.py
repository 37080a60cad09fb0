"""Clustering of vectors. Centers are a small table; assignments are one pass over all rows.

Only centers and bounded samples go to the driver. A sample is the first rows in the order of
a hash of the key, of a documented size; every row is assigned, whatever the sample was.

Vectors that are null, have another dimension than most rows or a component that is null or not
finite take no part in the fitting; their rows get a null cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import written
from . import knn

#: Rows that center fitting looks at, for each center asked for.
SAMPLE_PER_CENTER = 500


def _sample(vectors: DataFrame, n: int, vec: str, key: str) -> np.ndarray:
    rows = vectors.where(knn.usable(vec, knn.dimension(vectors, vec))).select(key, F.col(vec).cast("array<float>").alias("v"), F.xxhash64(key).alias("h")).orderBy("h", key).limit(n).collect()
    return np.array([r.v for r in rows], dtype=np.float64)


def fit(x: np.ndarray, k: int, seed: int = 42, steps: int = 50, weights: np.ndarray | None = None) -> np.ndarray:
    """Centers by k-means++ and weighted Lloyd steps; an empty cluster takes the farthest point."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(x)) if weights is None else weights
    k = max(1, min(k, len(x)))
    centers = x[rng.choice(len(x), p=w / w.sum())][None]
    while len(centers) < k:
        d = ((x[:, None] - centers[None]) ** 2).sum(-1).min(1) * w
        centers = np.vstack([centers, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))]])
    labels = None
    for _ in range(steps):
        d = (x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)
        new = d.argmin(1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for c in range(k):
            own = labels == c
            centers[c] = np.average(x[own], axis=0, weights=w[own]) if own.any() else x[d.min(1).argmax()]
    return centers


def as_centers(spark, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cluster int, center array<double>")


def seeded(vectors: DataFrame, k: int, seed: int = 42, vec: str = "embedding", key: str = "vec_id", steps: int = 20, settled: float = 1e-6) -> DataFrame:
    """(cluster, center): k centers seeded by every Arrow batch's weighted centers, then moved by passes over all rows.

    The passes end when no component moves by more than ``settled``, or after ``steps``. No row is
    left out; a center without rows stays where it is.
    """
    spark = vectors.sparkSession
    centers = fitted(vectors, k, seed, vec)
    for _ in range(steps):
        moved = centers.copy()
        for r in lloyd_step(vectors, as_centers(spark, centers), vec, key).collect():  # one row for each center
            moved[r.cluster] = r.center
        done = np.abs(moved - centers).max() <= settled
        centers = moved
        if done:
            break
    return as_centers(spark, centers)


def center_arrays(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, centers) of a checked size, in order of cluster."""
    rows = centers.select("cluster", "center").limit(knn.MAX_CENTERS + 1).collect()
    if len(rows) > knn.MAX_CENTERS:
        raise ValueError(f"more than {knn.MAX_CENTERS} centers: join them instead")
    rows = sorted(rows, key=lambda r: r.cluster)
    return np.array([r.cluster for r in rows], dtype=np.int64), np.array([r.center for r in rows], dtype=np.float64)


def assign(vectors: DataFrame, centers: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance) of every row: its nearest center, ties by cluster; null for null vectors and other dimensions."""
    held = vectors.sparkSession.sparkContext.broadcast(center_arrays(centers))

    def run(batches):
        ids, table = held.value
        for b in batches:
            if not b.num_rows:
                continue
            best = np.full(b.num_rows, np.inf)
            cluster = np.zeros(b.num_rows, dtype=np.int64)
            ok = np.zeros(b.num_rows, dtype=bool)
            if len(ids):
                x, ok = knn.matrix(b.column(1), table.shape[1])
                low, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
                for i, c in enumerate(table):
                    d = ((x - c) ** 2).sum(axis=1)
                    closer = d < low
                    low[closer], at[closer] = d[closer], ids[i]
                best[ok], cluster[ok] = np.sqrt(low), at
            yield pa.record_batch([b.column(0), pa.array(cluster, mask=~ok), pa.array(best, mask=~ok)], names=["key", "cluster", "distance"])

    out = vectors.select(F.col(key).cast("long"), F.col(vec).cast("array<float>")).mapInArrow(run, "key long, cluster long, distance double")
    return out.select(F.col("key").alias(key), F.col("cluster").cast(centers.schema["cluster"].dataType).alias("cluster"), "distance")


def lloyd_step(vectors: DataFrame, centers: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(cluster, center, n): means of what is nearest to each center; each Arrow batch passes on one sum for each center."""
    held = vectors.sparkSession.sparkContext.broadcast(center_arrays(centers))

    def run(batches):
        ids, table = held.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            x, _ = knn.matrix(b.column(0), table.shape[1])
            near = ((x[:, None] - table[None]) ** 2).sum(-1).argmin(1) if x.size * len(ids) < 1 << 24 else np.array([((table - r) ** 2).sum(1).argmin() for r in x])
            for i in np.unique(near):
                yield pa.record_batch([pa.array([ids[i]]), pa.array([x[near == i].sum(axis=0).tolist()], pa.list_(pa.float64())), pa.array([int((near == i).sum())])], names=["cluster", "total", "n"])

    parts = vectors.select(F.col(vec).cast("array<float>")).mapInArrow(run, "cluster long, total array<double>, n long")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = each.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("n").alias("n"))  # one row for each component
    return out.select(F.col("cluster").cast(centers.schema["cluster"].dataType).alias("cluster"), F.transform("c", lambda s: s.x / F.col("n")).alias("center"), "n")


def two_level(vectors: DataFrame, coarse: int, fine: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, coarse_id, fine_id): coarse clusters, and fine ones inside each, fitted on the same bounded sample."""
    x = _sample(vectors, coarse * SAMPLE_PER_CENTER, vec, key)
    n_coarse = max(1, min(coarse, len(x) // 10))
    top = fit(x, n_coarse)
    own = ((x[:, None] - top[None]) ** 2).sum(-1).argmin(1)
    below = []
    for c in range(len(top)):
        rows = x[own == c]
        below.append(fit(rows, max(1, min(fine, len(rows) // 5)), 42 + c) if len(rows) else top[c][None])
    held = vectors.sparkSession.sparkContext.broadcast((top, below))

    def run(batches):
        top, below = held.value
        for b in batches:
            if b.num_rows:
                x, which = knn.matrix(b.column(1), top.shape[1])
                c = ((x[:, None] - top[None]) ** 2).sum(-1).argmin(1)
                f = np.zeros(len(x), dtype=np.int32)
                for k in np.unique(c):
                    f[c == k] = ((x[c == k][:, None] - below[k][None]) ** 2).sum(-1).argmin(1)
                all_c, all_f = np.zeros(b.num_rows, dtype=np.int32), np.zeros(b.num_rows, dtype=np.int32)
                all_c[which], all_f[which] = c, f
                yield pa.record_batch([b.column(0), pa.array(all_c, mask=~which), pa.array(all_f, mask=~which)], names=["key", "coarse_id", "fine_id"])

    out = vectors.select(F.col(key).cast("long"), F.col(vec).cast("array<float>")).mapInArrow(run, "key long, coarse_id int, fine_id int")
    return out.withColumnRenamed("key", key)


def merged_levels(parts: DataFrame, merge, most: int) -> DataFrame:
    """(center, n) of all Arrow batches, merged in bounded groups, level by level, until ``most`` rows or fewer are left.

    ``merge(centers, weights)`` gives fewer (centers, weights) of the same sum of weights. A level
    that leaves more than three quarters of its rows is the last. Every row enters the result.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("h", "ascending")])
        x = np.array(table.column("center").to_pylist(), dtype=np.float64)
        centers, n = merge(x, table.column("n").to_numpy().astype(np.float64))
        return pa.table({"center": pa.array(centers.tolist(), pa.list_(pa.float64())), "n": pa.array(n, pa.float64())})

    rows = written(parts.select("center", F.col("n").cast("double").alias("n")), "partial-centers")
    count, level = rows.count(), 0
    while count > most:
        groups = -(-count // most)
        dealt = rows.withColumn("h", F.xxhash64("center", "n")).withColumn("g", F.pmod(F.xxhash64("h", F.lit(level)), F.lit(groups)))
        rows, before, level = written(dealt.groupBy("g").applyInArrow(run, "center array<double>, n double"), "partial-centers"), count, level + 1
        count = rows.count()
        if count > 0.75 * before:
            break
    return rows


def fitted(vectors: DataFrame, k: int, seed: int = 42, vec: str = "embedding", most: int | None = None) -> np.ndarray:
    """k centers from all rows: each Arrow batch gives weighted centers; their mergers, at most ``most`` at once, give the final ones."""
    dim = knn.dimension(vectors, vec)

    def run(batches):
        for b in batches:
            x, _ = knn.matrix(b.column(0), dim)
            if len(x):
                centers = fit(x, k, steps=20)
                n = np.bincount(((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1), minlength=len(centers))
                yield pa.record_batch([pa.array(centers.tolist(), pa.list_(pa.float64())), pa.array(n)], names=["center", "n"])

    parts = vectors.select(F.col(vec).cast("array<float>")).mapInArrow(run, "center array<double>, n long").where("n > 0")

    def merge(x, n):
        centers = fit(x, k, steps=20, weights=n)
        near = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        own = np.unique(near)
        return np.array([np.average(x[near == c], axis=0, weights=n[near == c]) for c in own]), np.array([n[near == c].sum() for c in own])

    most = max(most or k * SAMPLE_PER_CENTER, 8 * k)  # a group of some 8 k rows leaves k
    rows = merged_levels(parts, merge, most).orderBy(F.xxhash64("center", "n")).collect()
    return fit(np.array([r.center for r in rows]), k, seed, weights=np.array([float(r.n) for r in rows]))


def map_reduce(vectors: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id", most: int | None = None) -> DataFrame:
    """(key, cluster, distance): each Arrow batch gives weighted centers; their mergers, at most ``most`` at once, give the final ones."""
    return assign(vectors, as_centers(vectors.sparkSession, fitted(vectors, k, vec=vec, most=most)), vec, key)


def leaders(vectors: DataFrame, threshold: float, vec: str = "embedding", key: str = "vec_id", most: int = knn.MAX_CENTERS) -> DataFrame:
    """(key, cluster, distance): leaders of each Arrow batch, then leaders among those, level by level, then every row to its nearest.

    Each task keeps at most as many leaders as its batch has rows; more than ``most`` final leaders are an error.
    """

    def follow(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centers, n = [], []
        for row, k in zip(x, w):
            d = ((np.array(centers) - row) ** 2).sum(1) if centers else np.array([np.inf])
            i = int(d.argmin())
            if d[i] <= threshold**2:
                n[i] += k
                centers[i] = centers[i] + (row - centers[i]) * k / n[i]
            else:
                centers.append(row)
                n.append(k)
        return np.array(centers), np.array(n)

    dim = knn.dimension(vectors, vec)

    def run(batches):
        for b in batches:
            x, _ = knn.matrix(b.column(0), dim)
            if len(x):
                centers, n = follow(x, np.ones(len(x)))
                yield pa.record_batch([pa.array(centers.tolist(), pa.list_(pa.float64())), pa.array(n)], names=["center", "n"])

    parts = vectors.select(F.col(vec).cast("array<float>")).mapInArrow(run, "center array<double>, n double")
    rows = merged_levels(parts, follow, most).orderBy(F.desc("n"), F.xxhash64("center")).limit(4 * most + 1).collect()
    centers, _ = follow(np.array([r.center for r in rows]), np.array([r.n for r in rows])) if rows else (np.zeros((0, 0)), None)
    if len(rows) > 4 * most or len(centers) > most:
        raise ValueError(f"more than {most} leaders: the threshold is too small")
    return assign(vectors, as_centers(vectors.sparkSession, centers), vec, key)


def merge_small(splats: DataFrame, least: int) -> DataFrame:
    """(cluster, n, mu): clusters below ``least`` rows go to the nearest large one, means weighted by rows."""
    big = splats.where(F.col("n") >= least)
    small = splats.where(F.col("n") < least)
    if big.isEmpty():
        return splats.select("cluster", "n", "mu")
    table = knn.center_table(big.select("cluster", F.col("mu").alias("center")))
    best = F.array_min(F.transform(table, lambda c: F.struct(V.l2(F.col("mu"), c.center).alias("d"), c.cluster.alias("cluster"))))
    rows = big.select("cluster", "n", "mu").unionByName(small.select(best.cluster.alias("cluster"), "n", "mu"))
    each = rows.select("cluster", "n", F.posexplode("mu").alias("i", "x")).groupBy("cluster", "i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    out = each.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    return out.select("cluster", "n", F.transform("m", lambda s: s.x).alias("mu"))


def standardised(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, vec): centred and scaled by population deviations, then on the unit sphere."""
    each = vectors.select(F.posexplode(V.vec(vec)).alias("i", "x"))
    rows = sorted(each.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect())  # one row for each component
    mean, sd = knn.literal([r.m for r in rows]), knn.literal([r.s if r.s >= 1e-8 else 1.0 for r in rows])
    z = F.zip_with(F.zip_with(V.vec(vec), mean, lambda x, m: x - m), sd, lambda x, s: x / s)
    return vectors.select(key, V.normalise(z).alias(vec))
