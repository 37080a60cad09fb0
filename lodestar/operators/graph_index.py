"""Navigable small-world graphs kept as a table: one graph for each bounded part, every row in one.

(part, key, pos, v, near): a row's place in its graph and the places of its neighbours. Rows are
added in a seeded random order, so early ones keep long links. Links are pruned over old and new
alike. A search walks each part's graph and the parts' results are merged, so parts can be added
(a new batch is a new part) and removed keys are left out by an anti-join on the results.

:func:`packed` keeps each graph as one row of flat arrays; a search of that table walks every row
where it is read, without a shuffle. Vectors that are null, of another dimension than most or with
a component that is not finite are in no graph.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import knn

#: Rows of one graph: a walk of fixed width finds less in a larger one, so recall does not fall with the table; what a task holds is bounded too.
MAX_PART = 4_000


def walk(x: np.ndarray, near, v: np.ndarray, width: int) -> list[tuple[float, int]]:
    """The best ``width`` places found from place 0: (squared distance, place), nearest first."""
    d0 = float(((x[0] - v) ** 2).sum())
    seen, heap, best = {0}, [(d0, 0)], [(-d0, 0)]
    while heap:
        d, i = heapq.heappop(heap)
        if len(best) >= width and d > -best[0][0]:
            break
        new = [j for j in near[i] if j not in seen]
        if not new:
            continue
        seen.update(new)
        for dj, j in zip(((x[new] - v) ** 2).sum(axis=1).tolist(), new):
            if len(best) < width or dj < -best[0][0]:
                heapq.heappush(heap, (dj, j))
                heapq.heappush(best, (-dj, j))
                if len(best) > width:
                    heapq.heappop(best)
    return sorted((-d, j) for d, j in best)


def linked(x: np.ndarray, m: int, ef: int) -> list[list[int]]:
    """Neighbours of each place."""
    near: list[list[int]] = [[] for _ in x]
    for i in range(1, len(x)):
        for _, j in walk(x, near, x[i], ef)[:m]:
            near[i].append(j)
            near[j].append(i)
            if len(near[j]) > 4 * m:
                old = near[j][m:]
                order = np.argsort(((x[old] - x[j]) ** 2).sum(axis=1), kind="stable")
                near[j] = near[j][:m] + [old[t] for t in order[: 2 * m]]
    return near


def build(vectors: DataFrame, m: int = 16, ef: int = 48, vec: str = "embedding", key: str = "vec_id", max_part: int = MAX_PART) -> DataFrame:
    """The graph table of every row of ``vectors``."""
    vectors = vectors.where(knn.usable(vec, knn.dimension(vectors, vec)))
    parts = max(1, -(-vectors.count() // max_part))

    def run(table: pa.Table) -> pa.Table:
        order = np.random.default_rng(0).permutation(table.num_rows)
        keys = table.column("key").to_numpy()[order]
        x = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(table.num_rows, -1)[order]
        near = linked(x, m, ef)
        part = table.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * len(keys), pa.int32()), "key": pa.array(keys), "pos": pa.array(np.arange(len(keys)), pa.int32()), "v": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())), "near": pa.array(near, pa.list_(pa.int32()))})

    rows = vectors.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.col(key).cast("long").alias("key"), F.col(vec).cast("array<float>").alias("v"))
    out = rows.groupBy("part").applyInArrow(run, "part int, key long, pos int, v array<float>, near array<int>")
    return out.withColumnRenamed("key", key)


def broken(index: DataFrame) -> DataFrame:
    """(part, near): links to a place that the part's graph does not have."""
    ends = index.select("part", F.explode("near").alias("near"))
    return ends.join(index.select("part", F.col("pos").alias("near")), ["part", "near"], "left_anti")


def packed(index: DataFrame, key: str = "vec_id") -> DataFrame:
    """A written table with one row for each graph: (part, n, keys, v, ends, near) as flat arrays in bytes."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy())
        near = table.column("near").to_pylist()
        near = [near[i] for i in order]
        keys = table.column("key").to_numpy()[order].astype("<i8")
        x = table.column("v").combine_chunks().flatten().to_numpy().astype("<f4").reshape(len(keys), -1)[order]
        data = [keys, x, np.cumsum([len(e) for e in near]).astype("<i4"), np.array([j for e in near for j in e], dtype="<i4")]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int32()), **{c: pa.array([d.tobytes()], pa.binary()) for c, d in zip(("keys", "v", "ends", "near"), data)}})

    rows = index.withColumnRenamed(key, "key").select("part", "key", "pos", "v", "near").groupBy("part")
    return written(rows.applyInArrow(run, "part int, n int, keys binary, v binary, ends binary, near binary"), "packed-graph")


def _search_packed(index: DataFrame, blocks: list, k: int, ef: int) -> DataFrame:
    """(qid, key, distance): each graph's best, one row of the packed table at a time."""

    def run(batches, held):
        for b in batches:
            for row in range(b.num_rows):
                n, keys, v, ends, flat = (b.column(c)[row].as_py() for c in ("n", "keys", "v", "ends", "near"))
                keys, x = np.frombuffer(keys, "<i8"), np.frombuffer(v, "<f4").reshape(n, -1).astype(np.float64)
                near = [e.tolist() for e in np.split(np.frombuffer(flat, "<i4"), np.frombuffer(ends, "<i4")[:-1])]
                for name, q in zip(*held.value):
                    found = walk(x, near, q, max(ef, k))[:k]
                    yield pa.record_batch([pa.array([int(name)] * len(found), pa.int64()), pa.array([int(keys[j]) for _, j in found], pa.int64()), pa.array([float(np.sqrt(d)) for d, _ in found], pa.float64())], names=["qid", "key", "distance"])

    rows = index.select("n", "keys", "v", "ends", "near")
    return knn.united(rows.mapInArrow(partial(run, held=held), "qid long, key long, distance double") for held in blocks)


def search_live(index: DataFrame, removed: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, over: int = 3, ef: int = 64, vec: str = "embedding", key: str = "vec_id", qid: str = "qid") -> DataFrame:
    """(qid, key, distance, rank) without ``removed`` keys: the index stays as it is, a walk takes ``over`` times k and the removed ones go.

    Queries that then have fewer than k are answered exactly from the rows of ``vectors`` that are left.
    """
    gone = removed.select(F.col(key)).distinct()
    wide = search(index, queries, over * k, max(ef, over * k), vec, key, qid)
    w = Window.partitionBy(qid).orderBy("distance", key)
    best = written(wide.drop("rank").join(gone, key, "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(qid, key, "distance", "rank"), "live")
    full = best.where(F.col("rank") == k).select(qid)
    short = written(queries.join(full, qid, "left_anti"), "live-short")
    if short.isEmpty():
        return best
    exact = knn.knn_batch(vectors.join(gone, key, "left_anti"), short, k, vec=vec, key=key, qid=qid)
    return best.join(full, qid, "left_semi").select(qid, key, "distance", "rank").unionByName(exact)


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = 64, vec: str = "embedding", key: str = "vec_id", qid: str = "qid", block: int = knn.QUERY_BLOCK) -> DataFrame:
    """(qid, key, distance, rank): each part's best, merged, of a graph table or a packed one. Queries go in blocks; with several a graph table is written first, so that it is built once."""
    blocks = knn.query_blocks(queries, vec, qid, block)
    w = Window.partitionBy("qid").orderBy("distance", "key")
    if "keys" in index.columns:
        found = _search_packed(index, blocks, k, ef).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return found.select(F.col("qid").alias(qid), F.col("key").alias(key), "distance", "rank")
    if len(blocks) > 1:
        index = written(index, "graph")

    def walked(held):
        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("pos").to_numpy())
            keys = table.column("key").to_numpy()[order]
            x = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(table.num_rows, -1)[order]
            all_near = table.column("near").to_pylist()
            near = [all_near[i] for i in order]
            out = [(int(name), int(keys[j]), float(np.sqrt(d))) for name, v in zip(*held.value) for d, j in walk(x, near, v, max(ef, k))[:k]]
            return pa.table({"qid": pa.array([o[0] for o in out], pa.int64()), "key": pa.array([o[1] for o in out], pa.int64()), "distance": pa.array([o[2] for o in out], pa.float64())})

        return run

    rows = index.withColumnRenamed(key, "key").select("part", "key", "pos", "v", "near").groupBy("part")
    found = knn.united(rows.applyInArrow(walked(held), "qid long, key long, distance double") for held in blocks)
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("qid").alias(qid), F.col("key").alias(key), "distance", "rank")
