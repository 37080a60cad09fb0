"""One object for the usual calls: presets, a vector table, its documents, searches over both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import energy, graph_index, knn, routing, store, text


@dataclass(frozen=True)
class Preset:
    """Settings of an engine."""

    metric: str = "l2"
    n_probe: int = 5
    links: int = 16
    beam: int = 64
    vector_weight: float = 0.6
    rrf_k: int = 60
    cache: int = 128
    cache_seconds: float = 300.0


PRESETS = {
    "default": Preset(),
    "simple": Preset(n_probe=3, links=8, beam=32, cache=16),
    "advanced": Preset(n_probe=10, links=32, beam=100, cache=1024),
    "training": Preset(n_probe=3, cache=0),
    "distributed": Preset(n_probe=10, links=16, beam=64, cache=4096),
}


class Engine:
    """Searches over (vec_id, embedding, ...) and, by the same id, (doc_id, text, ...)."""

    def __init__(self, vectors: DataFrame, docs: DataFrame | None = None, preset: str | Preset = "default"):
        self.preset = PRESETS[preset] if isinstance(preset, str) else preset
        self.vectors, self.docs, self.index, self.words = vectors, docs, None, None
        self.cache = routing.ResultCache(max(1, self.preset.cache), self.preset.cache_seconds)

    def build_index(self) -> Engine:
        """Write the graph index of all vectors."""
        self.index = graph_index.packed(graph_index.build(self.vectors, self.preset.links))
        return self

    def build_text_index(self) -> Engine:
        """Write the word index of all documents; searches read it until documents change."""
        self.words = text.build_index(self.docs)
        return self

    def search(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """(vec_id, distance) of the k nearest rows, of those that match ``where``."""
        rows = self.vectors if where is None else self.vectors.where(where)
        return knn.knn(rows, query, k, self.preset.metric)

    def search_cached(self, query: list[float], k: int) -> list:
        return self.cache.get_or_run((tuple(query), k), lambda: self.search(query, k).collect())

    def search_batch(self, queries: DataFrame, k: int, approximate: bool = False) -> DataFrame:
        """(qid, vec_id, distance, rank) for rows of (qid, embedding)."""
        if approximate and self.index is not None:
            return graph_index.search(self.index, queries, k, self.preset.beam)
        return knn.knn_batch(self.vectors, queries, k, self.preset.metric)

    def search_text(self, query: str, k: int) -> DataFrame:
        """(doc_id, score) by BM25, from the word index if it was built."""
        return text.search_index(self.words, query, k) if self.words else text.bm25(self.docs, query, k)

    def search_hybrid(self, query: list[float], words: str, k: int) -> DataFrame:
        """(doc_id, score) by weighted rank fusion of both sides' 2 k best."""
        near = text.ranked(self.search(query, 2 * k).withColumnRenamed("vec_id", "doc_id"), F.col("distance"), "rank")
        hits = text.ranked(self.search_text(words, 2 * k), F.desc("score"), "rank")
        return text.rrf(near, hits, self.preset.vector_weight, self.preset.rrf_k).orderBy(F.desc("score"), "doc_id").limit(k)

    def confidence(self, cluster: str = "label") -> DataFrame:
        """(vec_id, energy, confidence, zone) of every vector under the mixture of its clusters."""
        e = energy.splat_energy(self.vectors, energy.splats(self.vectors, cluster))
        return e.withColumn("confidence", energy.confidence(F.col("energy"))).withColumn("zone", energy.zone(F.col("energy")))

    def add(self, rows: DataFrame, key: str = "vec_id", order: str | None = None) -> Engine:
        """Add rows, or put them in place of rows with the same id."""
        old = self.vectors if order else self.vectors.join(rows.select(key), key, "left_anti")
        self.vectors = store.upsert(old, rows, key, order) if order else old.unionByName(rows, allowMissingColumns=True)
        return self

    def remove(self, ids: DataFrame, key: str = "vec_id") -> Engine:
        """Remove rows; documents of the same ids go too."""
        self.vectors = store.hard_delete(self.vectors, ids, key)
        if self.docs is not None:
            self.docs, self.words = self.docs.join(ids.select(F.col(key).alias("doc_id")), "doc_id", "left_anti"), None
        return self

    def stats(self) -> dict:
        """Counts and dimension."""
        r = self.vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        return {"n_vectors": r.n, "dim": r.dim, "n_documents": self.docs.count() if self.docs is not None else 0, "index": routing.index_for(r.n), "cache_hits": self.cache.hits, "cache_misses": self.cache.misses}
