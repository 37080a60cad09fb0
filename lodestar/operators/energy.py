"""Mixture energy of vectors: splats are weighted, concentrated means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

FLAT = 10.0


def splats(vectors: DataFrame, cluster: str, vec: str = "embedding") -> DataFrame:
    """(cluster, mu, alpha, kappa, n): a splat of each cluster; kappa = clamp(1 / spread, 0.1, 100)."""
    each = vectors.select(F.col(cluster).alias("cluster"), F.posexplode(V.vec(vec)).alias("pos", "x"))
    stats = each.groupBy("cluster", "pos").agg(F.avg("x").alias("mean"), F.count("*").alias("n"), (F.var_pop("x") * F.count("*")).alias("ss"))
    rows = stats.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m"), F.max("n").alias("n"), F.sum("ss").alias("ss"))
    spread = F.sqrt("ss") / F.col("n") + 1e-8
    total = vectors.count()
    return rows.select("cluster", F.transform("m", lambda s: s.mean).alias("mu"), (F.col("n") / F.lit(total)).alias("alpha"), F.least(F.greatest(1 / spread, F.lit(0.1)), F.lit(100.0)).alias("kappa"), "n")


def splat_energy(vectors: DataFrame, mix: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, energy): -ln of the sum of alpha exp(-kappa d2); 10 where nothing is near or there is no splat; null for null vectors and other dimensions.

    The mixture is a model of a checked size; a batch of vectors meets one splat after the other.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    from . import knn

    if mix.isEmpty():
        return vectors.select(key, F.lit(FLAT).alias("energy"))
    rows = sorted(_held(mix), key=lambda r: r.cluster)
    held = vectors.sparkSession.sparkContext.broadcast((np.array([r.mu for r in rows]), [(float(r.alpha), float(r.kappa)) for r in rows]))

    def run(batches):
        mu, weights = held.value
        for b in batches:
            if b.num_rows:
                x, ok = knn.matrix(b.column(1), mu.shape[1])
                p = np.zeros(len(x))
                for m, (a, k) in zip(mu, weights):
                    p += a * np.exp(-k * ((x - m) ** 2).sum(axis=1))
                e = np.zeros(b.num_rows)
                e[ok] = np.where(p < 1e-10, FLAT, -np.log(np.maximum(p, 1e-300)))
                yield pa.record_batch([b.column(0), pa.array(e, mask=~ok)], names=["key", "energy"])

    schema = T.StructType([T.StructField("key", vectors.schema[key].dataType), T.StructField("energy", T.DoubleType())])
    return vectors.select(F.col(key).alias("key"), V.vec(vec).alias("v")).mapInArrow(run, schema).withColumnRenamed("key", key)


def _held(mix: DataFrame) -> list:
    from . import knn

    rows = mix.select("cluster", "mu", "alpha", "kappa").limit(knn.MAX_CENTERS + 1).collect()
    if len(rows) > knn.MAX_CENTERS:
        raise ValueError(f"more than {knn.MAX_CENTERS} splats")
    return rows


def geometric_energy(v: Column) -> Column:
    return F.pow(V.norm(v) - 1, 2)


def confidence(energy: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(energy, F.lit(0.0)))


def zone(energy: Column) -> Column:
    return F.when(energy < 0.3, "high_confidence").when(energy < 0.7, "moderate").otherwise("uncertain")


def criticality(rows: DataFrame, energy: str, size: str) -> DataFrame:
    """(index, state): .6 ve/(ve+1) + .4 vs/(vs+1) of population variances."""
    ve, vs = F.var_pop(energy), F.var_pop(size)
    out = rows.agg((0.6 * ve / (ve + 1) + 0.4 * vs / (vs + 1)).alias("criticality"))
    return out.select("criticality", F.when(F.col("criticality") < 0.3, "subcritical").when(F.col("criticality") < 0.7, "critical").otherwise("supercritical").alias("state"))


def relax(mix: DataFrame, rounds: int = 1) -> DataFrame:
    """alpha (1 + .05 exp(-.1 kappa)) with the sum of alpha put back to 1, kappa 1.01 within [.1, 100], ``rounds`` times."""
    for _ in range(rounds):
        grown = mix.withColumn("alpha", F.col("alpha") * (1 + 0.05 * F.exp(-0.1 * F.col("kappa"))))
        total = grown.agg(F.sum("alpha")).first()[0]
        mix = grown.withColumn("alpha", F.col("alpha") / F.lit(total))
        mix = mix.withColumn("kappa", F.least(F.greatest(F.col("kappa") * 1.01, F.lit(0.1)), F.lit(100.0)))
    return mix


def boltzmann(rows: DataFrame, energy: str, k: int, temperature: float = 1.0, seed: int = 1) -> DataFrame:
    """k rows without replacement, weight exp(E / T): the largest Gumbel-shifted energies."""
    u = F.rand(seed)
    return rows.withColumn("g_", F.col(energy) / temperature - F.log(-F.log(u))).orderBy(F.desc("g_")).limit(k).drop("g_")


def held_mix(mix: DataFrame) -> Column:
    """The mixture as one array literal of (mu, a, k)."""
    from . import knn

    return F.array(*[F.struct(knn.literal(r.mu).alias("mu"), F.lit(float(r.alpha)).alias("a"), F.lit(float(r.kappa)).alias("k")) for r in _held(mix)])


def gradient(vectors: DataFrame, mix: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, gradient): sum of 2 kappa alpha exp(-kappa d2) (x - mu) over the sum of alpha exp(-kappa d2)."""
    v = V.vec(vec)
    parts = F.transform(held_mix(mix), lambda t: F.struct(t.mu.alias("mu"), t.k.alias("k"), (t.a * F.exp(-t.k * V.l2_squared(v, t.mu))).alias("p")))
    zero = F.transform(v, lambda x: F.lit(0.0))
    step = lambda s, t: F.zip_with(s, F.zip_with(v, t.mu, lambda x, m: 2 * t.k * t.p * (x - m)), lambda a, b: a + b)
    rows = vectors.select(key, v.alias(vec), parts.alias("parts_"))
    total = F.aggregate("parts_", F.lit(0.0), lambda s, t: s + t.p)
    return rows.select(key, V.scale(F.aggregate("parts_", zero, step), 1.0 / total).alias("gradient"))


def avalanche(mix: DataFrame, share: float = 0.3, near: int = 10) -> DataFrame:
    """(cluster, energy, step): from the splat of most energy, ``share`` of it goes to its nearest ones; those lifted over the mean follow.

    The splats are a bounded model (more than it allows are an error), so the cascade runs on the driver; each is met once.
    """
    import numpy as np

    rows = sorted(_held(mix), key=lambda r: r.cluster)
    if not rows:
        return mix.sparkSession.createDataFrame([], "cluster int, energy double, step int")
    mu, e = np.array([r.mu for r in rows]), np.array([r.alpha for r in rows], dtype=float)
    limit, front, step = e.mean() * 1.5, [int(e.argmax())], {}
    while front:
        i = front.pop(0)
        if i in step:
            continue
        step[i] = len(step)
        others = np.argsort(((mu - mu[i]) ** 2).sum(1), kind="stable")[1 : near + 1]
        moved = share * e[i]
        e[i] -= moved
        if len(others):
            e[others] += moved / len(others)
        front += [int(j) for j in others if e[j] > limit and j not in step]
    return mix.sparkSession.createDataFrame([(int(r.cluster), float(e[i]), step.get(i)) for i, r in enumerate(rows)], "cluster int, energy double, step int")


def regions(vectors: DataFrame, mix: DataFrame, n: int, radius: float = 0.5, spread: float = 0.5, top: int = 1000, seed: int = 3, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(region, center, energy, n_points): points moved off the data at random, the ``top`` of most energy grouped greedily within ``radius``."""
    import numpy as np

    moved = vectors.select(key, V.vec(vec).alias(vec)).withColumn("u_", F.rand(seed))
    shift = F.transform(F.col(vec), lambda x, i: x + spread * (F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(2001)) / 1000.0 - 1.0))
    points = moved.select(key, shift.alias(vec))
    scored = splat_energy(points, mix, vec, key).join(points, key)
    rows = scored.orderBy(F.desc("energy"), key).limit(top).collect()
    found: list[list] = []
    for r in rows:
        p = np.array(r[vec])
        for f in found:
            if np.linalg.norm(f[0] - p) <= radius:
                f[2] += 1
                break
        else:
            found.append([p, float(r.energy), 1])
    return vectors.sparkSession.createDataFrame([(i, f[0].tolist(), f[1], f[2]) for i, f in enumerate(found[:n])], "region long, center array<double>, energy double, n_points long")


def splat_state(mix: DataFrame) -> DataFrame:
    """(cluster, energy, size): the state that new splats start from, one cluster for each, its energy the splat's weight."""
    return mix.select("cluster", F.col("alpha").cast("double").alias("energy"), F.lit(1).alias("size"))
