"""Property graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written


#: Folders of a written edge table.
FOLDERS = 16


def deduplicated(entities: DataFrame, name: str = "name", key: str = "node_id") -> DataFrame:
    """One row for each lower-cased name: the smallest key."""
    first = entities.groupBy(F.lower(name).alias("name_")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in entities.columns]), key).alias("row_"))
    return first.select("row_.*")  # merged map-side, so a name of very many rows does not meet in one task


def dangling(edges: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Edges with an end that is no node, or a weight that is not finite."""
    ids = nodes.select(F.col(key).alias("id_")).distinct()
    src = edges.join(ids, edges.src == ids.id_, "left_anti")
    dst = edges.join(ids, edges.dst == ids.id_, "left_anti")
    return src.unionByName(dst).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour), either direction, distinct."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour")))
    return both.distinct()


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of what directed edges reach from ``starts.node``; a join for each level, frontiers are written tables.

    Edges are written once, dealt into folders by a hash of their source; a level reads the folders of its frontier.
    """
    folder = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(FOLDERS)).cast("int")
    edges = edges.select("src", "dst").withColumn("folder", folder("src"))
    edges = written(edges.repartition(FOLDERS, "folder", F.pmod(F.xxhash64("dst"), F.lit(4))), "edges", ("folder",))
    seen = written(starts.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    front = seen
    for depth in range(1, max_depth + 1):
        read = [r.f for r in front.select(folder("node").alias("f")).distinct().collect()]  # FOLDERS at most
        step = front.join(edges.where(F.col("folder").isin(read)).select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct()
        new = written(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if new.isEmpty():
            dropped(new)
            break
        seen, front = seen.unionByName(new), new
    return seen


#: Rows of one task of a co-occurrence, and pairs of one.
ROWS, PAIRS = 1_000_000, 2_000_000


def cooccurrence(pairs: DataFrame, doc: str = "doc_id", entity: str = "entity") -> DataFrame:
    """(a, b, n): entities in the same document, a < b.

    Documents' entities are gathered once and written; the tasks of both steps grow in number, not in size.
    """
    p = pairs.select(F.col(doc).alias("doc_"), F.col(entity).alias("e_")).where("doc_ is not null and e_ is not null")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = p.repartition(max(n, -(-p.count() // ROWS)), "doc_").groupBy("doc_").agg(F.sort_array(F.collect_set("e_")).alias("s")).where(F.size("s") > 1)
    own = written(own.select("s"), "together")
    made = own.agg(F.sum(F.size("s").cast("long") * (F.size("s") - 1) / 2)).first()[0] or 0
    first = own.select("s", F.posexplode("s").alias("i", "a"))
    both = first.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s") - F.col("i") - 1)).alias("b"))
    return both.repartition(max(n, -(-int(made) // PAIRS)), "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))
