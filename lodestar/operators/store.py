"""Document and vector tables: upserts, deletes, logs, catalogs, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key by ``order``; of equal ones the change wins."""
    both = table.withColumn("new_", F.lit(0)).unionByName(changes.withColumn("new_", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("new_"))
    return both.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_", "new_")


def soft_delete(table: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    gone = ids.select(key).distinct().withColumn("gone_", F.lit(True))
    out = table.join(gone, key, "left")
    hit = F.coalesce("gone_", F.lit(False))
    return out.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).withColumn("deleted", F.col("deleted") | hit).drop("gone_")


def hard_delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def append(table: DataFrame, batch: DataFrame, capacity: int) -> tuple[DataFrame, bool]:
    """The table with the batch, or the table alone when both together pass the capacity."""
    fits = table.count() + batch.count() <= capacity
    return (table.unionByName(batch, allowMissingColumns=True) if fits else table), fits


def compacted(splats: DataFrame, alpha: str = "alpha", mu: str = "mu") -> DataFrame:
    """Rows with weight and finite components."""
    from ..functions import vectors as V

    return splats.where((F.col(alpha) >= 1e-6) & V.finite(F.col(mu).cast("array<double>")))


def entropy(rows: DataFrame, weight: str) -> DataFrame:
    """(entropy): -sum p ln p / ln n within [0, 1]."""
    total = rows.agg(F.sum(weight)).first()[0]
    p = F.col(weight) / F.lit(total)
    h = F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)) / F.log(F.count("*"))
    return rows.agg(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)).alias("entropy"))


def backup(table: DataFrame, path: str) -> DataFrame:
    """A copy under a new path; an error where there is something already."""
    table.write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.parquet(path)


def tiers(rows: DataFrame, score: Column, key: str, hot: float = 0.2, warm: float = 0.5) -> DataFrame:
    """(key, tier): the best 20 % hot, up to 50 % warm, the rest cold; ties by key."""
    import math

    from .ordered import numbered

    scored = rows.select(key, score.alias("s_"))
    n = scored.count()
    i = F.col("i_")
    tier = F.when(i <= math.ceil(n * hot), "hot").when(i <= math.ceil(n * warm), "warm").otherwise("cold")
    return numbered(scored, [F.desc("s_"), F.col(key)], "i_").select(key, tier.alias("tier"))
