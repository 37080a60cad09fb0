"""Queries of encoders and sketches, and of graph indexes kept as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import encoders, sketches
from ..functions import vectors as V
from ..operators import graph_index, knn
from ..session import load, written
from .registry import query
from .vector_queries import BASE, R, asked, emb, first

F64 = pa.float64()


@query()
def v09_projection_head(spark, sf_dir):
    return sketches.mapped(emb(spark, sf_dir), lambda x: [sketches.lists(sketches.project(x, 32), F64)], "projected array<double>")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as length, true as restored from embeddings")
def v11_rotation(spark, sf_dir):
    """A rotation keeps lengths, and its transpose undoes it."""

    def f(x):
        turn = sketches.rotation(x.shape[1])
        y = x @ turn.T
        return [pa.array(np.linalg.norm(y, axis=1)), pa.array(np.abs(y @ turn - x).max(axis=1) < 1e-9)]

    return sketches.mapped(emb(spark, sf_dir), f, "length double, restored boolean").withColumn("length", R(F.col("length"), 5))


@query()
def v14_sign_sketch(spark, sf_dir):
    return sketches.mapped(emb(spark, sf_dir), lambda x: [sketches.lists(sketches.sign_sketch(x, 256), pa.int8())], "signs array<tinyint>")


@query()
def v15_sign_inner_product(spark, sf_dir):
    q = np.array(first(spark, sf_dir))

    def f(x):
        est = sketches.sign_inner_product(sketches.sign_sketch(x, 256), np.linalg.norm(x, axis=1), q)
        return [pa.array(est), pa.array(x @ q)]

    return sketches.mapped(emb(spark, sf_dir), f, "estimate double, exact double")


@query()
def v16_two_stage_code(spark, sf_dir):
    q = np.array(first(spark, sf_dir))

    def f(x):
        ip, d = sketches.two_stage(x, q)
        return [pa.array(ip), pa.array(d), pa.array(np.sqrt(((x - q) ** 2).sum(axis=1)))]

    return sketches.mapped(emb(spark, sf_dir), f, "inner_product double, distance double, exact double")


POINTS = """p as (select p_partkey, (p_size - (select min(p_size) from part)) / greatest((select max(p_size) - min(p_size) from part), 1e-8) as x,
    (p_retailprice - (select min(p_retailprice) from part)) / greatest((select max(p_retailprice) - min(p_retailprice) from part), 1e-8) as y, (p_partkey % 97) / 96.0::double as z from part)"""


def points(spark, sf_dir):
    """Parts as 3-D points scaled by the data's bounds."""
    p = load(spark, sf_dir, "part")
    b = p.agg(*[f(c).alias(f"{n}_{c}") for c in ("p_size", "p_retailprice") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    unit = lambda c: (F.col(c) - F.lit(b[f"lo_{c}"])) / F.greatest(F.lit(float(b[f"hi_{c}"] - b[f"lo_{c}"])), F.lit(1e-8))
    return p.select("p_partkey", unit("p_size").alias("x"), unit("p_retailprice").alias("y"), ((F.col("p_partkey") % 97) / 96.0).alias("z"))


def dealt(spark, sf_dir):
    """The points over all cores: a narrow table comes as few files, and hundreds of components are made of each row."""
    return points(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")


@query(f"with {POINTS}, d as (select p_partkey, x, y, z, unnest(range(10)) as d from p) select p_partkey, round(sum(sin(x * 2 ** d) + cos(x * 2 ** d) + sin(y * 2 ** d) + cos(y * 2 ** d) + sin(z * 2 ** d) + cos(z * 2 ** d)), 5) as total, 64::int as dim from d group by p_partkey")
def v17_positions(spark, sf_dir):
    e = encoders.positions(F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select("p_partkey", e.alias("e")).select("p_partkey", R(V.total(F.col("e")), 5).alias("total"), F.size("e").alias("dim"))


@query(f"""with {POINTS}, c as (select p_partkey, least(floor(x * 8), 7) as r, least(floor(y * 8), 7) as g, least(floor(z * 8), 7) as b, unnest(range(512)) as i from p)
    select p_partkey, round(sum(exp(-((i // 64 - r) ** 2 + (i // 8 % 8 - g) ** 2 + (i % 8 - b) ** 2) / 4.0)), 5) as total, 512::int as dim from c group by p_partkey""")
def v18_colours(spark, sf_dir):
    e = encoders.colours(F.col("x"), F.col("y"), F.col("z"))
    return dealt(spark, sf_dir).select("p_partkey", e.alias("e")).select("p_partkey", R(V.total(F.col("e")), 5).alias("total"), F.size("e").alias("dim"))


TURN = ["z", "x", "y", "x"]


@query(f"with {POINTS} select p_partkey, round(x * x * x + ln(y + 1e-8) + x / (z + 1e-8) + z * x * 2 + (x + y + z) / 3.0, 5) as mixed, 64::int as dim from p")
def v19_attributes(spark, sf_dir):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    e = F.col("e")
    rows = points(spark, sf_dir).select("p_partkey", encoders.attributes(x, [x, y, z], [z, x, y, x]).alias("e"))
    return rows.select("p_partkey", R(e[2] + e[21] + e[15] + e[40] + e[42] + e[12], 5).alias("mixed"), F.size("e").alias("dim"))


@query("select p_partkey, 640::int as dim from part")
def v20_full_embedding(spark, sf_dir):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    e = F.concat(encoders.positions(x, y, z), encoders.colours(x, y, z), encoders.attributes(x, [x, y, z], [z, x, y, x]))
    return dealt(spark, sf_dir).select("p_partkey", F.size(e).alias("dim"))


@query(f"""with {POINTS}, q as (select p_partkey, 1.0 / (sqrt(1 + x*x + y*y + z*z) + 1e-8) as w, x, y, z from p), u as (select p_partkey, w, x * w as x, y * w as y, z * w as z from q)
    select p_partkey, round(1 - 2 * (y * y + z * z), 5) as r00, round(2 * (x * y + w * z), 5) as r01, round(4 + 1 + 0.25, 5)::double as trace from u""")
def v21_rotations(spark, sf_dir):
    """Rotation matrix entries, and the covariance's trace, which no rotation changes."""
    q = encoders.unit_quaternion([F.lit(1.0), F.col("x"), F.col("y"), F.col("z")])
    s = [F.lit(2.0), F.lit(1.0), F.lit(0.5)]
    r, c = encoders.rotation_matrix(q), encoders.covariance(q, s)
    return points(spark, sf_dir).select("p_partkey", R(r[0][0], 5).alias("r00"), R(r[0][1], 5).alias("r01"), R(c[0][0] + c[1][1] + c[2][2], 5).alias("trace"))


@query("select doc_id, (list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::uhugeint)), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) % 8)::int as shard from documents")
def v24_fnv_shard(spark, sf_dir):
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([sketches.fnv1a(str(i).encode()) % 8 for i in b.column(0).to_pylist()], pa.int32())], names=["doc_id", "shard"])

    return load(spark, sf_dir, "documents").select("doc_id").mapInArrow(run, "doc_id long, shard int")


@query(f"{BASE}, m as (select vec_id, v, list_transform(v, lambda x: abs(x)) as a from e), i as (select vec_id, v, list_position(a, list_max(a)) as i from m) select vec_id, (2 * (i - 1) + (v[i] < 0)::int)::bigint as bucket from i")
def v25_cross_polytope(spark, sf_dir):
    out = sketches.mapped(emb(spark, sf_dir), lambda x: [pa.array(sketches.cross_polytope(x, 1, identity=True)[:, 0].astype(np.int64))], "bucket long")
    return out


@query()
def v26_multi_probe(spark, sf_dir):
    kind = pa.list_(pa.list_(pa.int64()))
    out = sketches.mapped(emb(spark, sf_dir), lambda x: [pa.array(sketches.multi_probe(x), kind)], "probes array<array<bigint>>")
    return out.select("vec_id", F.posexplode("probes").alias("probe", "hash"))


@query()
def v27_sign_buckets(spark, sf_dir):
    return knn.sign_buckets(emb(spark, sf_dir))


@query("select doc_id, 1.0::double as length from documents")
def v28_hash_embedding(spark, sf_dir):
    e = encoders.hashed(F.coalesce("text", F.lit("")))
    return load(spark, sf_dir, "documents").select("doc_id", R(V.norm(e), 5).alias("length"))


@query()
def v29_text_embedding(spark, sf_dir):
    """Hashed features: each goes to three places with a sign, sums per place, unit length.

    A feature is summed as it stands, into its document's 64 places, in its own task: the shuffles hold places, not features.
    """
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(encoders.features(F.col("text"))).alias("f"))
    place = lambda band: F.struct(F.pmod(F.xxhash64("f", F.lit(band)), F.lit(64)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64("f", F.lit(band + 10)), F.lit(2)) == 0, 1).otherwise(-1).alias("s"))
    sums = d.select("doc_id", F.explode(F.array(*[place(b) for b in range(3)])).alias("p")).groupBy("doc_id", "p.i").agg(F.sum("p.s").cast("double").alias("x"))
    dense = sums.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))  # 64 places at most
    return dense.select("doc_id", V.normalise(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))).alias("embedding"))


# graph indexes as tables --------------------------------------------------------------------


@query()
def k12_graph_build(spark, sf_dir):
    return graph_index.build(emb(spark, sf_dir)).select("part", "vec_id", F.size("near").alias("degree"))


@query("select count(*) as n_saved, count(*) as n_read, sum(vec_id)::bigint as ids, 0::bigint as broken from embeddings")
def s13_graph_checks(spark, sf_dir):
    """A saved index read back: its rows, what its packed form holds, and links that lead out of their graph."""
    index = written(graph_index.build(emb(spark, sf_dir)), "graph")
    broken, n_read = graph_index.broken(index).count(), graph_index.packed(index).agg(F.sum("n")).first()[0]
    return index.agg(F.count("*").alias("n_saved"), F.lit(n_read).cast("long").alias("n_read"), F.sum("vec_id").alias("ids"), F.lit(broken).cast("long").alias("broken"))


@query()
def k26_index_tables(spark, sf_dir):
    """Build once, then search the packed index without shuffling it."""
    index = graph_index.packed(graph_index.build(emb(spark, sf_dir)))
    return graph_index.search(index, asked(spark, sf_dir), 10)


@query(f"{BASE}, d as (select a.vec_id as qid, e.vec_id, list_distance(e.v, a.v) as d, row_number() over (partition by a.vec_id order by list_distance(e.v, a.v), e.vec_id) as rank from e, e a where a.vec_id % 20 = 0) select count(distinct qid) as n_queries, true as enough from d where rank <= 10")
def k13_graph_recall(spark, sf_dir):
    """The graph's recall against the exact answer is at least 0.9."""
    e, q = emb(spark, sf_dir), asked(spark, sf_dir)
    found = knn.recall(graph_index.search(graph_index.build(e), q, 10), knn.knn_batch(e, q, 10), 10)
    return found.select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


@query("select vec_id, label from embeddings where label <> 9 union all select vec_id + 1000000, label from embeddings where label = 0")
def k19_add_remove(spark, sf_dir):
    """Rows added under new ids, others removed; ids are never renumbered."""
    e = emb(spark, sf_dir).select("vec_id", "label")
    kept = e.join(e.where("label = 9").select("vec_id"), "vec_id", "left_anti")
    return kept.unionByName(e.where("label = 0").withColumn("vec_id", F.col("vec_id") + 1000000))


@query(f"{BASE} select vec_id, label as collection, round(1 - list_cosine_similarity(v, q), 6) as distance from e, o where label in (1, 2) order by round(1 - list_cosine_similarity(v, q), 9), vec_id limit 10")
def k24_collection_search(spark, sf_dir):
    e = emb(spark, sf_dir).where("label in (1, 2)")
    d = F.round(1 - V.cosine(V.vec("embedding"), knn.literal(first(spark, sf_dir))), 9)
    return e.select("vec_id", F.col("label").alias("collection"), d.alias("d")).orderBy("d", "vec_id").limit(10).select("vec_id", "collection", R(F.col("d")).alias("distance"))


@query(f"{BASE}, f as (select vec_id, list_concat(v, list_transform(range(16), lambda x: 0.0::double)) as f from e) select vec_id, len(f)::int as dim, round(list_sum(f) / (sqrt(list_sum(list_transform(f, lambda x: x * x))) + 1e-8), 6) as total from f")
def v30_encoder_registry(spark, sf_dir):
    """An encoder known by its name; here the vectors come from a table, 64 components fitted to 80."""
    encoders.register("table", lambda table: table.select("vec_id", "embedding"))
    out = encoders.encode("table", emb(spark, sf_dir), 80)
    return out.select("vec_id", F.size("embedding").alias("dim"), R(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("total"))
