"""Shard merges, node metrics, strategy choice and retrieval quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def shard_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def merge_rrf(hits: DataFrame, key: str = "vec_id", k: int = 60) -> DataFrame:
    """(key, score, distance) from shard lists (key, rank from 0, distance): summed 1 / (k + rank + 1), best distance."""
    return hits.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"), F.min("distance").alias("distance"))


def merge_best(hits: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    return hits.groupBy(key).agg(F.min("distance").alias("distance")).orderBy("distance", key).limit(k)


def strategy(n: int, k: int, batch: int = 1, is_range: bool = False) -> str:
    """exact, batch, range or hrm2."""
    if is_range:
        return "range"
    if batch >= 4:
        return "hrm2" if n >= 1000 else "batch"
    if n < 1000 or k < 5:
        return "exact"
    return "exact" if n <= 5000 and k <= 20 else "hrm2"


def index_for(n: int) -> str:
    return "bruteforce" if n < 15_000 else "hrm2" if n < 100_000 else "hnsw"


def nearest_rank(rows: DataFrame, value: str, by: str, shares: dict[str, float]) -> DataFrame:
    """(by, name...): the value at place floor(n p) + 1 of each group."""
    r = ordered.placed(rows.select(by, value), by, [value])
    return r.groupBy(by).agg(*[F.max(F.when(F.col("i_") == F.least(F.floor(F.col("n_") * p) + 1, F.col("n_")), F.col(value))).alias(name) for name, p in shares.items()])


def inbox(messages: DataFrame, now, priority: Column, least: int, seconds: Column, ts: str = "ts") -> DataFrame:
    """Messages of priority ``least`` or more with ``place``: inbox, or dead once older than ``seconds``."""
    age = (F.unix_micros(F.lit(now)) - F.unix_micros(F.col(ts))) / 1e6
    return messages.where(priority >= least).withColumn("place", F.when(age > seconds, "dead").otherwise("inbox"))


def latency_report(rows: DataFrame, size: str, latency: str) -> DataFrame:
    """(size, p50, p95, p99, best): latencies at the rounded place (n - 1) p, and whether the size has most operations a second."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    r = ordered.placed(rows.select(size, latency), size, [latency])
    at = lambda p: F.round((F.col("n_") - 1) * p).cast("long") + 1
    out = r.groupBy(size).agg(*[F.max(F.when(F.col("i_") == at(p), F.col(latency))).alias(name) for name, p in shares.items()])
    ops = rows.groupBy(size).agg(F.round(F.count("*") / F.sum(latency), 9).alias("ops_"))
    first = ops.orderBy(F.desc("ops_"), size).select(size).first()
    return out.withColumn("best", F.col(size) == F.lit(first[0] if first else None))


def ndcg(relevant: Column, rank: Column, k: int = 10) -> Column:
    """Aggregate: discounted gain of 0-based ranks below k, log2(rank + 2)."""
    return F.sum(F.when((rank < k) & relevant, 1.0 / (F.log(rank + 2.0) / math.log(2))).otherwise(0.0))


def successors(rows: DataFrame, by: str, order: list[str], item: str) -> DataFrame:
    """(item, next_item, n): what follows what."""
    pairs = ordered.framed(rows.select(by, *order, F.col(item).alias("next_item")), by, order, 1, {"item": lambda w: F.first("next_item").over(w), "k_": lambda w: F.count("*").over(w)})
    return pairs.where("k_ = 2 and next_item is not null").groupBy("item", "next_item").agg(F.count("*").alias("n"))


def warmup_cosine(steps: int, warm: int, peak: float, low: float) -> list[float]:
    """A learning-rate schedule: linear to the peak, then half a cosine to the low."""
    return [peak * (s + 1) / warm if s < warm else low + (peak - low) * 0.5 * (1 + math.cos(math.pi * (s - warm) / max(1, steps - warm))) for s in range(steps)]


def strategy_of(n: Column, k: Column, batch: Column) -> Column:
    """:func:`strategy` as a column."""
    small = F.when((n < 1000) | (k < 5) | ((n <= 5000) & (k <= 20)), "exact").otherwise("hrm2")
    return F.when(batch >= 4, F.when(n >= 1000, "hrm2").otherwise("batch")).otherwise(small)


def trends(rows: DataFrame, by: str, value: str, order: list[str], margin: float = 0.1) -> DataFrame:
    """(by, latest, trend): the mean of each later half against that of the earlier one."""
    r = ordered.placed(rows.select(by, value, *order), by, order)
    late, early = F.avg(F.when(F.col("i_") * 2 > F.col("n_"), F.col(value))), F.avg(F.when(F.col("i_") * 2 <= F.col("n_"), F.col(value)))
    trend = F.when(late > (1 + margin) * early, "up").when(late < (1 - margin) * early, "down").otherwise("flat")
    return r.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias("latest"), trend.alias("trend"))


class ResultCache:
    """Results of searches by key, least recently used out first, each for ``ttl`` seconds."""

    def __init__(self, capacity: int = 128, ttl: float = 300.0, clock=None):
        import time
        from collections import OrderedDict

        self.capacity, self.ttl, self.clock = capacity, ttl, clock or time.monotonic
        self.hits = self.misses = 0
        self.held: OrderedDict = OrderedDict()

    def get_or_run(self, key, search):
        now = self.clock()
        if key in self.held and now - self.held[key][0] <= self.ttl:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][1]
        self.misses += 1
        self.held[key] = (now, search())
        self.held.move_to_end(key)
        while len(self.held) > self.capacity:
            self.held.popitem(last=False)
        return self.held[key][1]
