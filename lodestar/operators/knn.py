"""Nearest neighbours: exact, filtered, cluster-pruned and graph-indexed.

Rows whose vector is null, has another dimension than the queries or a component that is null or not
finite have no distance: they are no neighbour of anything and are left out. A query set with such
a vector raises ValueError, as a single query does.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import written

#: Query vectors that are sent to every executor at once; a larger set is taken in blocks.
QUERY_BLOCK = 4096


def validated(query: list[float], k: int, dim: int | None = None) -> list[float]:
    """The query, or ValueError for k below 1, a wrong dimension or a component that is no number."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    if dim is not None and len(query) != dim:
        raise ValueError(f"the query has {len(query)} components, the table {dim}")
    if not np.isfinite(np.asarray(query, dtype=float)).all():
        raise ValueError("the query has a component that is not finite")
    return [float(x) for x in query]


def literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def usable(vec: str, dim: int) -> Column:
    """Whether a row's vector has ``dim`` components, all of them finite numbers."""
    inf = F.lit(float("inf"))
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def dimension(vectors: DataFrame, vec: str = "embedding") -> int:
    """The dimension of most rows (the smaller of two), 0 without any."""
    row = vectors.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row.d if row else 0


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, distance) of the k nearest rows, ties by key: a TakeOrderedAndProject without a shuffle of vectors."""
    q = literal(validated(query, k))
    v = V.vec(vec)
    d = {"l2": lambda: V.l2(v, q), "cosine": lambda: 1.0 - V.cosine(v, q), "geodesic": lambda: V.geodesic(V.normalise(v), V.normalise(q))}[metric]()
    return vectors.where(usable(vec, len(query))).select(key, d.alias("distance")).orderBy("distance", key).limit(k)


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return 1.0 - np.where(n < 1e-8, 0.0, q @ x.T / np.where(n < 1e-8, 1.0, n))
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        out[i] = np.sqrt(((x - row) ** 2).sum(axis=1))
    return out


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, which): the vectors of ``dim`` finite components as a matrix, and which rows of the column they are."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    which = sizes == dim
    flat = column.filter(pa.array(which)).flatten() if not which.all() else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    finite = np.isfinite(x).all(axis=1)
    if not finite.all():
        which = which.copy()
        which[np.flatnonzero(which)[~finite]] = False
        x = x[finite]
    return x, which


def query_blocks(queries: DataFrame, vec: str = "embedding", qid: str = "qid", block: int = QUERY_BLOCK) -> list:
    """Broadcast (ids, matrix) of the queries, about ``block`` in each."""
    parts = max(1, -(-queries.count() // block))
    out = []
    for part in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(qid), F.lit(parts)) == part)
        rows = own.select(F.col(qid).cast("long"), V.vec(vec)).collect()
        if len({r[1] is not None and len(r[1]) for r in rows}) > 1 or any(r[1] is None or None in r[1] or not np.isfinite(r[1]).all() for r in rows):
            raise ValueError("queries need vectors of one dimension with finite components")
        out.append(queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64))))
    return out


def compared(b: pa.RecordBatch, q: np.ndarray):
    """(keys, vectors) of an Arrow batch (key, vector) that can be compared with the queries, some rows at a time.

    No more than a million distances are in the making.
    """
    step = max(1, (1 << 20) // max(1, len(q)))
    for lo in range(0, b.num_rows, step):
        part = b.slice(lo, step)
        x, which = matrix(part.column(1), q.shape[1])
        if len(x):
            yield part.column(0).to_numpy(zero_copy_only=False)[which], x


def united(frames) -> DataFrame:
    """The rows of all frames, which have the same columns."""
    return reduce(DataFrame.unionByName, frames)


class Best:
    """The k nearest keys of each of n queries, of all that were added; ties go to the smaller key."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.full((n, 1), np.inf)
        self.held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, keys: np.ndarray, d: np.ndarray) -> None:
        """Take in the distances of the queries (rows) to the keys (columns)."""
        near = d <= self.limit
        if self.k < d.shape[1] and np.count_nonzero(near) > 4 * self.k * len(d):
            near &= d <= np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        i, j = np.nonzero(near)
        if not len(i):
            return
        i, keys, d = (np.concatenate(x) for x in zip(self.held, (i, keys[j], d[i, j])))
        order = np.lexsort((keys, d, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        first = order[place < self.k]
        self.held = i[place < self.k], keys[first], d[first]
        full = place == self.k - 1
        self.limit[i[full], 0] = d[order[full]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, key, distance)."""
        return self.held


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", vec: str = "embedding", key: str = "vec_id", qid: str = "qid", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, key, distance, rank) of each query's k nearest rows, ties by key.

    Each task's vectors meet a broadcast block of queries; it holds the k best of each query so far
    (ties by key) and passes those on, so the shuffle holds k rows for each query and task. Query sets
    beyond ``block`` are taken in blocks.
    """

    def run(batches, held):
        ids, q = held.value
        if not len(ids):
            return
        best = Best(len(ids), k)
        for b in batches:
            for keys, x in compared(b, q):
                best.add(keys, _distances(q, x, metric))
        i, keys, d = best.rows()
        yield pa.record_batch([pa.array(ids[i]), pa.array(keys), pa.array(d)], names=["qid", "key", "distance"])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<float>").alias("v"))
    out = united(rows.mapInArrow(partial(run, held=held), "qid long, key long, distance double") for held in query_blocks(queries, vec, qid, block))
    w = Window.partitionBy("qid").orderBy("distance", "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("qid").alias(qid), F.col("key").alias(key), "distance", "rank")


def knn_filtered(vectors: DataFrame, candidates: DataFrame, query: list[float], k: int, key: str = "vec_id", **options) -> DataFrame:
    """k nearest among the candidate keys; the semi-join lies below the distances."""
    return knn(vectors.join(candidates.select(key), key, "left_semi"), query, k, key=key, **options)


def knn_post_filtered(vectors: DataFrame, predicate: Column, query: list[float], k: int, over: int = 10, key: str = "vec_id", **options) -> DataFrame:
    """The 10 k nearest, then the predicate, then k: may return fewer than k."""
    near = knn(vectors, query, over * k, key=key, **options)
    return near.join(vectors.where(predicate).select(key), key, "left_semi").orderBy("distance", key).limit(k)


def centroids(vectors: DataFrame, cluster: str, vec: str = "embedding") -> DataFrame:
    """(cluster, center, n): means of the clusters' vectors, one aggregation by component."""
    each = vectors.select(F.col(cluster).alias("cluster"), F.posexplode(V.vec(vec)).alias("pos", "x"))
    means = each.groupBy("cluster", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    rows = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"), F.max("n").alias("n"))  # one row for each component
    return rows.select("cluster", F.transform("c", lambda s: s.x).alias("center"), "n")


#: Centers that become literals of a plan; a model has few, whatever the table holds.
MAX_CENTERS = 4096


def center_table(centers: DataFrame) -> Column:
    """The centers as one array of (center, cluster), of a checked size."""
    rows = centers.select("cluster", "center").limit(MAX_CENTERS + 1).collect()
    if len(rows) > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centers: join them instead")
    return F.array(*[F.struct(literal(r.center).alias("center"), F.lit(r.cluster).alias("cluster")) for r in sorted(rows, key=lambda r: r.cluster)])


def similarities(vectors: DataFrame, queries: DataFrame, group: str, vec: str = "embedding", qid: str = "qid", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, group, similarity): the largest cosine of each query and group; each Arrow batch passes on its own largest. Queries go in blocks."""

    def run(batches, held):
        ids, q = held.value
        if not len(ids):
            return
        for b in batches:
            for g, x in compared(b, q):
                s = 1.0 - _distances(q, x, "cosine")
                for k in np.unique(g):
                    yield pa.record_batch([pa.array(ids), pa.array(np.full(len(ids), k, dtype=np.int64)), pa.array(s[:, g == k].max(axis=1))], names=["qid", "g", "similarity"])

    rows = vectors.select(F.col(group).cast("long"), F.col(vec).cast("array<float>"))
    found = united(rows.mapInArrow(partial(run, held=held), "qid long, g long, similarity double") for held in query_blocks(queries, vec, qid, block))
    return found.groupBy(F.col("qid").alias(qid), F.col("g").cast(vectors.schema[group].dataType).alias(group)).agg(F.max("similarity").alias("similarity"))


def all_similarities(vectors: DataFrame, queries: DataFrame, vec: str = "embedding", key: str = "vec_id", qid: str = "qid", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, key, similarity) of a query set, taken in blocks, against every row; nothing is shuffled."""

    def run(batches, held):
        ids, q = held.value
        if not len(ids):
            return
        for b in batches:
            for keys, x in compared(b, q):
                s = 1.0 - _distances(q, x, "cosine")
                yield pa.record_batch([pa.array(np.repeat(ids, len(keys))), pa.array(np.tile(keys, len(ids))), pa.array(s.ravel())], names=["qid", "key", "similarity"])

    rows = vectors.select(F.col(key).cast("long"), F.col(vec).cast("array<float>"))
    out = united(rows.mapInArrow(partial(run, held=held), "qid long, key long, similarity double") for held in query_blocks(queries, vec, qid, block))
    return out.select(F.col("qid").alias(qid), F.col("key").alias(key), "similarity")


def ivf_search(vectors: DataFrame, centers: DataFrame, query: list[float], k: int, n_probe: int, cluster: str, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Exact search inside the n_probe clusters with the nearest centers."""
    q = literal(validated(query, k))
    probed = centers.orderBy(V.l2(F.col("center"), q), "cluster").limit(n_probe).select(F.col("cluster").alias(cluster))
    return knn(vectors.join(F.broadcast(probed), cluster, "left_semi"), query, k, vec=vec, key=key)


def two_level_search(vectors: DataFrame, query: list[float], k: int, lod: int, n_probe: int, coarse: str, fine: str, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, distance) in a two-level index: rows that know their ``coarse`` and ``fine`` cluster.

    Level of detail 0 takes the first k rows (by key) of each of the ``n_probe`` nearest coarse clusters, 1
    all rows of each one's nearest fine cluster; both stop at the cluster that completes k. 2 searches the
    coarse clusters whole. Only the probed clusters' rows are read on.
    """
    q = literal(validated(query, k))
    tops = centroids(vectors, coarse).orderBy(V.l2(F.col("center"), q), "cluster").limit(n_probe).collect()
    order = [r.cluster for r in tops]
    if lod >= 2:
        return knn(vectors.where(F.col(coarse).isin(order)), query, k, vec=vec, key=key)
    if lod == 0:
        sizes = {r.cluster: min(k, r.n) for r in tops}
        rows = vectors.where(F.col(coarse).isin(order)).withColumn("r_", F.row_number().over(Window.partitionBy(coarse).orderBy(key))).where(F.col("r_") <= k)
        match = lambda c: F.col(coarse) == c
    else:
        below = centroids(vectors.where(F.col(coarse).isin(order)).withColumn("c_", F.struct(F.col(coarse).alias("top"), F.col(fine).alias("low"))), "c_", vec)
        near = below.groupBy("cluster.top").agg(F.min(F.struct(V.l2(F.col("center"), q).alias("d"), F.col("cluster.low").alias("low"), "n")).alias("m")).collect()
        best = {r.top: r.m for r in near}
        order = [c for c in order if c in best]
        sizes, rows = {c: m.n for c, m in best.items()}, vectors
        match = lambda c: (F.col(coarse) == c) & (F.col(fine) == best[c].low)
    chosen, held = [], 0
    for c in order:
        if held < k:
            chosen.append(c)
            held += sizes[c]
    return knn(rows.where(reduce(lambda x, y: x | y, (match(c) for c in chosen), F.lit(False))), query, k, vec=vec, key=key)


def recall(approximate: DataFrame, exact: DataFrame, k: int, qid: str = "qid", key: str = "vec_id") -> DataFrame:
    """(n_queries, recall) of one ranking against another."""
    a = exact.join(approximate.select(qid, key).withColumn("hit", F.lit(1)), [qid, key], "left")
    return a.agg(F.countDistinct(qid).alias("n_queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def sign_buckets(vectors: DataFrame, tables: int = 16, bits: int = 8, seed: int = 7, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, table_id, bucket): sign-projection hashes of every row of the table's dimension."""
    dim = dimension(vectors, vec)

    def run(batches):
        planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
        for b in batches:
            x, which = matrix(b.column(1), dim)
            if not len(x):
                continue
            keys = b.column(0).to_numpy(zero_copy_only=False)[which]
            codes = ((x @ planes >= 0).reshape(len(keys), tables, bits) << np.arange(bits)).sum(axis=2)
            yield pa.record_batch([pa.array(np.repeat(keys, tables)), pa.array(np.tile(np.arange(tables), len(keys)).astype(np.int32)), pa.array(codes.ravel().astype(np.int64))], names=["key", "table_id", "bucket"])

    return vectors.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<float>").alias("v")).mapInArrow(run, "key long, table_id int, bucket long")


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 32, bits: int = 8, flips: int = 1, seed: int = 7, vec: str = "embedding", key: str = "vec_id", qid: str = "qid", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, key, distance, rank): exact distances on the candidates, top k for each query.

    Candidates share a query's bucket in one of the tables, or lie in a bucket that differs in
    ``flips`` bits at most. Each Arrow batch passes on its own k best. Queries with fewer than k
    candidates are answered exactly, so they have k rows where the table does.
    """
    near = np.array([[j for j in range(1 << bits) if (i ^ j).bit_count() <= flips] for i in range(1 << bits)])

    def run(batches, held):
        ids, q = held.value
        if not len(ids):
            return
        planes = np.random.default_rng(seed).standard_normal((q.shape[1], tables * bits))
        codes = lambda x: ((x @ planes >= 0).reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2)
        asked = codes(q)
        for b in batches:
            x, which = matrix(b.column(1), q.shape[1])
            if not len(x):
                continue
            keys = b.column(0).to_numpy(zero_copy_only=False)[which]
            # for each table and bucket, the rows in it or beside it, as bits
            held_in = [np.packbits(np.arange(1 << bits)[:, None] == own[None], axis=1) for own in codes(x).T]
            beside = np.stack([np.bitwise_or.reduce(bucket[near], axis=1) for bucket in held_in])
            for i, name in enumerate(ids):
                at = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(beside[np.arange(tables), asked[i]], axis=0), count=len(x)))
                d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                if k < len(at):
                    keep = d <= np.partition(d, k - 1)[k - 1]
                    at, d = at[keep], d[keep]
                if len(at):
                    yield pa.record_batch([pa.array(np.full(len(at), name)), pa.array(keys[at]), pa.array(d)], names=["qid", "key", "distance"])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<float>").alias("v"))
    found = united(rows.mapInArrow(partial(run, held=held), "qid long, key long, distance double") for held in query_blocks(queries, vec, qid, block))
    w = Window.partitionBy("qid").orderBy("distance", "key")
    best = written(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "lsh")
    out = best.select(F.col("qid").alias(qid), F.col("key").alias(key), "distance", "rank")
    full = best.where(F.col("rank") == k).select(F.col("qid").alias(qid))
    short = written(queries.join(full, qid, "left_anti"), "lsh-short")
    if short.isEmpty():
        return out
    return out.join(full, qid, "left_semi").unionByName(knn_batch(vectors, short, k, vec=vec, key=key, qid=qid, block=block)).select(qid, key, "distance", "rank")
