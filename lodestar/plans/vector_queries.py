"""Queries of vector functions, nearest-neighbour search, splats and energy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clustering, energy, graph_index, knn, ordered, store
from ..session import load, written
from .registry import query

E_, O_ = "embeddings", "(select list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id = 0)"
BASE = f"with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), o as {O_}"


def emb(spark, sf_dir):
    return load(spark, sf_dir, "embeddings")


def first(spark, sf_dir):
    """The components of vector 0."""
    rows = emb(spark, sf_dir).where("vec_id = 0").select(V.vec("embedding")).limit(1).collect()
    return list(rows[0][0]) if rows else []


def per_vector(spark, sf_dir, **columns):
    q = knn.literal(first(spark, sf_dir))
    v = V.vec("embedding")
    return emb(spark, sf_dir).select("vec_id", *[f(v, q).alias(c) for c, f in columns.items()])


R = lambda c, n=6: F.round(c, n)
NORM = "sqrt(list_inner_product(v, v))"


@query(f"{BASE} select vec_id, round(list_distance(v, q), 6) as l2, round(list_distance(v, q) ** 2, 6) as l2_squared from e, o")
def v01_l2(spark, sf_dir):
    return per_vector(spark, sf_dir, l2=lambda v, q: R(V.l2(v, q)), l2_squared=lambda v, q: R(V.l2_squared(v, q)))


@query(f"{BASE} select vec_id, round(list_cosine_similarity(v, q), 6) as similarity, round(1 - list_cosine_similarity(v, q), 6) as distance from e, o")
def v02_cosine(spark, sf_dir):
    return per_vector(spark, sf_dir, similarity=lambda v, q: R(V.cosine(v, q)), distance=lambda v, q: R(1 - V.cosine(v, q)))


@query(f"{BASE} select vec_id, round(v[1] / ({NORM} + 1e-8), 6) as x1, round(list_sum(v) / ({NORM} + 1e-8), 6) as total from e")
def v03_normalise(spark, sf_dir):
    return per_vector(spark, sf_dir, x1=lambda v, q: R(V.normalise(v)[0]), total=lambda v, q: R(V.total(V.normalise(v))))


UNIT = f"{BASE}, u as (select vec_id, list_transform(v, lambda x: x / ({NORM} + 1e-8)) as v, (select list_transform(q, lambda x: x / (sqrt(list_inner_product(q, q)) + 1e-8)) from o) as q from e), d as (select *, list_inner_product(v, q) as d from u)"
GEO = "case when d > 1 - 1e-5 then 0.0 else acos(least(greatest(d, -1 + 1e-7), 1 - 1e-7)) end"


@query(f"{UNIT} select vec_id, round({GEO}, 6) as geodesic from d")
def v04_geodesic(spark, sf_dir):
    return per_vector(spark, sf_dir, geodesic=lambda v, q: R(V.geodesic(V.normalise(v), V.normalise(q))))


@query(f"{UNIT}, n as (select *, {NORM} as n from u) select vec_id, round(case when n < 1e-10 then q[1] else cos(n) * q[1] + sin(n) * v[1] / n end, 6) as x1 from n")
def v05_exp_map(spark, sf_dir):
    return per_vector(spark, sf_dir, x1=lambda v, q: R(V.exp_map(V.normalise(q), V.normalise(v))[0]))


TAN = f"{UNIT}, t as (select *, list_transform(list_zip(v, q), lambda p: p[1] - d * p[2]) as t from d)"


@query(f"{TAN} select vec_id, round(case when sqrt(list_inner_product(t, t)) < 1e-6 then 0.0 else {GEO} / sqrt(list_inner_product(t, t)) * t[1] end, 5) as x1 from t")
def v06_log_map(spark, sf_dir):
    def f(v, q):
        t = V.norm(V.tangent(V.normalise(v), V.normalise(q)))
        return R(F.when(t < 1e-6, 0.0).otherwise(V.log_map(V.normalise(q), V.normalise(v))[0]), 5)

    return per_vector(spark, sf_dir, x1=f)


@query(f"{TAN} select vec_id, round(abs(t[1]), 6) as x1, round(sqrt(list_inner_product(t, t)), 6) as length from t")
def v07_tangent(spark, sf_dir):
    return per_vector(spark, sf_dir, x1=lambda v, q: R(F.abs(V.tangent(V.normalise(v), V.normalise(q))[0])), length=lambda v, q: R(V.norm(V.tangent(V.normalise(v), V.normalise(q)))))


@query(f"{BASE}, s as (select vec_id, d, v[1:d] as v from e, unnest([16, 32, 64]) as t(d)) select vec_id, d, round(v[1] / ({NORM} + 1e-8), 6) as x1 from s")
def v08_matryoshka(spark, sf_dir):
    v = V.vec("embedding")
    each = F.array(*[F.struct(F.lit(d).alias("d"), R(V.matryoshka(v, d)[0]).alias("x1")) for d in (16, 32, 64)])
    return emb(spark, sf_dir).select("vec_id", F.explode(each).alias("m")).select("vec_id", "m.d", "m.x1")


@query(f"{BASE} select round(avg(list_distance(v, q) ** 2 / len(v) + (1 - list_cosine_similarity(v, q)) + ((1 - list_cosine_similarity(v[1:16], q[1:16])) + (1 - list_cosine_similarity(v[1:32], q[1:32]))) / 2), 6) as loss from e, o")
def v10_distillation_loss(spark, sf_dir):
    def f(v, q):
        short = lambda d: 1 - V.cosine(F.slice(v, 1, d), F.slice(q, 1, d))
        return V.l2_squared(v, q) / F.size(v) + (1 - V.cosine(v, q)) + (short(16) + short(32)) / 2

    return per_vector(spark, sf_dir, loss=f).agg(R(F.avg("loss")).alias("loss"))


POLAR = f"{BASE}, p as (select vec_id, unnest(range(32))::int as i, v from e), c as (select vec_id, i, sqrt(v[2*i+1] ** 2 + v[2*i+2] ** 2) as r, (floor((atan2(v[2*i+2], v[2*i+1]) + pi()) / (2 * pi()) * 16)::int) % 16 as code from p)"


@query(f"{POLAR} select vec_id, i, round(r, 6) as r, code from c")
def v12_polar_codes(spark, sf_dir):
    codes = V.polar_encode(V.vec("embedding"), 4)
    return emb(spark, sf_dir).select("vec_id", F.posexplode(codes).alias("i", "c")).select("vec_id", "i", R(F.col("c.r")).alias("r"), F.col("c.code").alias("code"))


@query(f"{POLAR} select vec_id, round(sum(r * (q[2*i+1] * cos(code * 2 * pi() / 16 - pi()) + q[2*i+2] * sin(code * 2 * pi() / 16 - pi()))), 5) as estimate from c, o group by vec_id")
def v13_polar_inner_product(spark, sf_dir):
    return per_vector(spark, sf_dir, estimate=lambda v, q: R(V.dot(V.polar_decode(V.polar_encode(v, 4), 4), q), 5))


@query("""select c_custkey, round(2 * 6371.0 * asin(sqrt(least(sin(radians(la - 40.0) / 2) ** 2 + cos(radians(40.0)) * cos(radians(la)) * sin(radians(lo - 10.0) / 2) ** 2, 1.0))), 4) as km
    from (select c_custkey, (c_custkey % 180 - 90)::double as la, (c_custkey % 360 - 180)::double as lo from customer)""")
def v23_haversine(spark, sf_dir):
    la, lo = (F.col("c_custkey") % 180 - 90).cast("double"), (F.col("c_custkey") % 360 - 180).cast("double")
    return load(spark, sf_dir, "customer").select("c_custkey", R(V.haversine(F.lit(40.0), F.lit(10.0), la, lo), 4).alias("km"))


@query(f"""{BASE}, b as (select label, i, min(v[i]) as lo, max(v[i]) as hi, avg(v[i]) as c from (select label, v, unnest(range(1, 4)) as i from e) group by label, i),
    t as (select e.vec_id, b.label, bool_and(e.v[b.i] between b.lo and b.hi) as inside from e, b group by e.vec_id, b.label) select vec_id, sum(inside::int)::bigint as n_inside, min(case when inside then label end) as first_box from t group by vec_id""")
def v22_bounding_boxes(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id", "label", F.slice(V.vec("embedding"), 1, 3).alias("v"))
    each = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    box = each.groupBy(F.col("label").alias("cluster")).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("b"))  # three components each
    low = knn.center_table(box.select("cluster", F.transform("b", lambda s: s.lo).alias("center")))
    high = knn.center_table(box.select("cluster", F.transform("b", lambda s: s.hi).alias("center")))
    within = F.filter(F.arrays_zip(low.alias("l"), high.alias("h")), lambda t: V.is_inside(F.col("v"), t.l.center, t.h.center))
    out = e.select("vec_id", F.transform(within, lambda t: t.l.cluster).alias("in_"))
    return out.select("vec_id", F.size("in_").cast("long").alias("n_inside"), F.array_min("in_").alias("first_box"))


# nearest neighbours -------------------------------------------------------------------------


@query(f"{BASE} select vec_id, round(list_distance(v, q), 6) as distance from e, o order by list_distance(v, q), vec_id limit 10")
def k01_knn_l2(spark, sf_dir):
    return knn.knn(emb(spark, sf_dir), first(spark, sf_dir), 10).select("vec_id", R(F.col("distance")).alias("distance"))


def asked(spark, sf_dir):
    return emb(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def batch_sql(distance: str, k: int = 10) -> str:
    return f"{BASE}, d as (select a.vec_id as qid, e.vec_id, {distance} as d from e, e a where a.vec_id % 20 = 0), r as (select *, row_number() over (partition by qid order by d, vec_id) as rank from d) select qid, vec_id, round(d, 6) as distance, rank::int as rank from r where rank <= {k}"


@query(batch_sql("list_distance(e.v, a.v)"))
def k02_knn_batch_l2(spark, sf_dir):
    return knn.knn_batch(emb(spark, sf_dir), asked(spark, sf_dir), 10).withColumn("distance", R(F.col("distance")))


@query(batch_sql("round(1 - list_cosine_similarity(e.v, a.v), 9)"))
def k03_knn_batch_cosine(spark, sf_dir):
    from pyspark.sql import Window

    found = knn.knn_batch(emb(spark, sf_dir), asked(spark, sf_dir), 12, metric="cosine").withColumn("distance", F.round("distance", 9))
    w = Window.partitionBy("qid").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= 10").withColumn("distance", R(F.col("distance")))


@query(f"{BASE} select vec_id, round(list_distance(v, q), 6) as distance from e, o where not list_contains(list_transform(v, lambda x: isnan(x) or isinf(x)), true) order by list_distance(v, q), vec_id limit 5")
def k04_knn_validated(spark, sf_dir):
    e = emb(spark, sf_dir)
    query_ = knn.validated(first(spark, sf_dir), 5, 64)
    return knn.knn(e.where(V.finite(V.vec("embedding"))), query_, 5).select("vec_id", R(F.col("distance")).alias("distance"))


@query(f"{BASE} select vec_id, round(list_distance(v, q), 6) as distance from e, o where label = 3 order by list_distance(v, q), vec_id limit 10")
def k05_knn_filtered(spark, sf_dir):
    e = emb(spark, sf_dir)
    return knn.knn_filtered(e, e.where("label = 3"), first(spark, sf_dir), 10).select("vec_id", R(F.col("distance")).alias("distance"))


@query(f"{BASE}, n as (select vec_id, label, list_distance(v, q) as d from e, o order by d, vec_id limit 100) select vec_id, round(d, 6) as distance from n where label < 5 order by d, vec_id limit 10")
def k06_knn_post_filtered(spark, sf_dir):
    return knn.knn_post_filtered(emb(spark, sf_dir), F.col("label") < 5, first(spark, sf_dir), 10).select("vec_id", R(F.col("distance")).alias("distance"))


@query(f"{UNIT} select vec_id, round({GEO}, 6) as distance from d order by {GEO}, vec_id limit 10")
def k07_knn_geodesic(spark, sf_dir):
    return knn.knn(emb(spark, sf_dir), first(spark, sf_dir), 10, metric="geodesic").select("vec_id", R(F.col("distance")).alias("distance"))


@query(f"{BASE} select vec_id, label as coarse_id, (vec_id % 3)::bigint as fine_id, round(list_distance(v, q), 6) as distance from e, o order by list_distance(v, q), vec_id limit 15")
def k08_expert_distances(spark, sf_dir):
    e = emb(spark, sf_dir)
    near = knn.knn(e, first(spark, sf_dir), 15)
    return near.join(e, "vec_id").select("vec_id", F.col("label").alias("coarse_id"), (F.col("vec_id") % 3).alias("fine_id"), R(F.col("distance")).alias("distance"))


CENTERS = f"{BASE}, m as (select label, i, avg(v[i]) as x from (select label, v, unnest(range(1, 65)) as i from e) group by label, i), c as (select label, list(x order by i) as c from m group by label), p as (select label from c, o order by list_distance(c, q), label limit 3)"


@query(f"{CENTERS} select vec_id, round(list_distance(v, q), 6) as distance from e, o where label in (select label from p) order by list_distance(v, q), vec_id limit 10")
def k09_cluster_pruned(spark, sf_dir):
    e = emb(spark, sf_dir)
    return knn.ivf_search(e, knn.centroids(e, "label"), first(spark, sf_dir), 10, 3, "label").select("vec_id", R(F.col("distance")).alias("distance"))


#: Two levels with clusters that are given: labels, and in each the remainder by four.
LEVELS = f"{CENTERS}, top as (select label, row_number() over (order by list_distance(c, q), label) as place from c, o order by 2 limit 3)"


def levels(spark, sf_dir, lod):
    e = emb(spark, sf_dir).withColumn("fine", F.pmod("vec_id", F.lit(4)))
    return knn.two_level_search(e, first(spark, sf_dir), 60, lod, 3, "label", "fine").select("vec_id", R(F.col("distance")).alias("distance"))


@query(f"{LEVELS}, r as (select vec_id, v, label, place, row_number() over (partition by label order by vec_id) as i from e join top using (label)), n as (select place, least(count(*), 60) as n from e join top using (label) group by place), s as (select place, coalesce(sum(n) over (order by place rows between unbounded preceding and 1 preceding), 0) as before from n) select vec_id, round(list_distance(v, q), 6) as distance from r join s using (place), o where i <= 60 and before < 60 order by list_distance(v, q), vec_id limit 60")
def k09_lod0(spark, sf_dir):
    """The first rows of the nearest coarse clusters."""
    return levels(spark, sf_dir, 0)


@query(f"""{LEVELS}, fm as (select label, fine, i, avg(v[i]) as x, count(*) as n from (select label, vec_id % 4 as fine, v, unnest(range(1, 65)) as i from e) group by label, fine, i), fc as (select label, fine, list(x order by i) as c, max(n) as n from fm group by label, fine),
    best as (select label, place, fine, n from (select *, row_number() over (partition by label order by list_distance(c, q), fine) as r from fc join top using (label), o) where r = 1), s as (select *, coalesce(sum(n) over (order by place rows between unbounded preceding and 1 preceding), 0) as before from best)
    select vec_id, round(list_distance(v, q), 6) as distance from e join s on e.label = s.label and e.vec_id % 4 = s.fine, o where before < 60 order by list_distance(v, q), vec_id limit 60""")
def k09_lod1(spark, sf_dir):
    """The nearest fine cluster of each of the nearest coarse ones."""
    return levels(spark, sf_dir, 1)


@query(f"{LEVELS} select vec_id, round(list_distance(v, q), 6) as distance from e join top using (label), o order by list_distance(v, q), vec_id limit 60")
def k09_lod2(spark, sf_dir):
    return levels(spark, sf_dir, 2)


@query(f"{CENTERS.replace('limit 3', 'limit 5')} select vec_id, case when (select count(*) from e) < 100 then 'linear' else 'hrm2' end as strategy, round(list_distance(v, q), 6) as distance from e, o where (select count(*) from e) < 100 or label in (select label from p) order by list_distance(v, q), vec_id limit 10")
def k10_fast_with_fallback(spark, sf_dir):
    """Linear below 100 rows, else inside the nearest clusters."""
    e, q = emb(spark, sf_dir), first(spark, sf_dir)
    small = e.count() < 100
    near = knn.knn(e, q, 10) if small else knn.ivf_search(e, knn.centroids(e, "label"), q, 10, 5, "label")
    return near.select("vec_id", F.lit("linear" if small else "hrm2").alias("strategy"), R(F.col("distance")).alias("distance"))


@query(f"{CENTERS}, t as (select e.vec_id, list_distance(v, q) as d, row_number() over (partition by e.label order by list_distance(v, q), vec_id) as r from e join p using (label), o) select vec_id, round(min(d), 6) as distance from t where r <= 5 group by vec_id order by min(d), vec_id limit 10")
def k11_two_stage(spark, sf_dir):
    from pyspark.sql import Window

    e = emb(spark, sf_dir)
    q = knn.literal(first(spark, sf_dir))
    probed = knn.centroids(e, "label").orderBy(V.l2(F.col("center"), q), "cluster").limit(3).select(F.col("cluster").alias("label"))
    near = e.join(F.broadcast(probed), "label", "left_semi").select("vec_id", "label", V.l2(V.vec("embedding"), q).alias("d"))
    w = Window.partitionBy("label").orderBy("d", "vec_id")
    top = near.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("vec_id").agg(F.min("d").alias("d"))
    return top.orderBy("d", "vec_id").limit(10).select("vec_id", R(F.col("d")).alias("distance"))


@query()
def k13_graph_search(spark, sf_dir):
    return graph_index.search(graph_index.build(emb(spark, sf_dir)), asked(spark, sf_dir), 10)


@query(batch_sql("list_distance(e.v, a.v)").replace("from e, e a where a.vec_id % 20 = 0", "from e, e a where a.vec_id % 20 = 0 and e.vec_id % 7 <> 3"))
def k14_tombstones(spark, sf_dir):
    e = emb(spark, sf_dir)
    live = e.join(e.where("vec_id % 7 = 3").select("vec_id"), "vec_id", "left_anti")
    return knn.knn_batch(live, asked(spark, sf_dir), 10).withColumn("distance", R(F.col("distance")))


@query(f"{BASE} select count(*) as n_queries, true as enough, 0::bigint as removed_found from e where vec_id % 20 = 0")
def k14_graph_tombstones(spark, sf_dir):
    """The index with tombstones: recall at 10 against the exact answer over live rows is at least 0.9, and no removed key is found."""
    e, q = emb(spark, sf_dir), asked(spark, sf_dir)
    gone = e.where("vec_id % 7 = 3").select("vec_id")
    found = written(graph_index.search_live(graph_index.packed(graph_index.build(e)), gone, e, q, 10), "tombstones")
    r = knn.recall(found, knn.knn_batch(e.join(gone, "vec_id", "left_anti"), q, 10), 10)
    return r.select("n_queries", (F.col("recall") >= 0.9).alias("enough"), F.lit(found.join(gone, "vec_id", "left_semi").count()).cast("long").alias("removed_found"))


@query()
def k15_lsh_search(spark, sf_dir):
    return knn.lsh_search(emb(spark, sf_dir), asked(spark, sf_dir), 10)


@query(f"{POLAR}, s as (select vec_id, sum(r * (q[2*i+1] * cos(code * 2 * pi() / 16 - pi()) + q[2*i+2] * sin(code * 2 * pi() / 16 - pi()))) as s from c, o group by vec_id) select vec_id, round(s, 5) as score from s order by s desc, vec_id limit 10")
def k16_quantised_search(spark, sf_dir):
    q = knn.literal(first(spark, sf_dir))
    s = V.dot(V.polar_decode(V.polar_encode(V.vec("embedding"), 4), 4), q)
    return emb(spark, sf_dir).select("vec_id", s.alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", R(F.col("s"), 5).alias("score"))


@query(f"{POLAR}, s as (select vec_id, sum(r * (q[2*i+1] * cos(code * 2 * pi() / 16 - pi()) + q[2*i+2] * sin(code * 2 * pi() / 16 - pi()))) as s from c, o group by vec_id), a as (select vec_id from s order by round(s, 9) desc, vec_id limit 50), m as (select label, i, avg(v[i]) as x from (select label, v, unnest(range(1, 65)) as i from e) group by label, i), t as (select label, list(x order by i) as t from m group by label), b as (select vec_id from e, o where label = (select label from t, o order by list_distance(t, q), label limit 1) order by list_distance(v, q), vec_id limit 50), u as (select * from a union select * from b) select vec_id, round(list_distance(v, q), 6) as distance from e join u using (vec_id), o order by list_distance(v, q), vec_id limit 10")
def k17_fused_search(spark, sf_dir):
    """Candidates by quantised scores and from the query's own cluster, ranked exactly."""
    e, q = emb(spark, sf_dir), first(spark, sf_dir)
    s = V.dot(V.polar_decode(V.polar_encode(V.vec("embedding"), 4), 4), knn.literal(q))
    a = e.select("vec_id", F.round(s, 9).alias("s")).orderBy(F.desc("s"), "vec_id").limit(50).select("vec_id")
    b = knn.ivf_search(e, knn.centroids(e, "label"), q, 50, 1, "label").select("vec_id")
    return knn.knn_filtered(e, a.union(b).distinct(), q, 10).select("vec_id", R(F.col("distance")).alias("distance"))


#: Noise of a start on a component: 0 for the first start, else within a tenth of 1.
NOISE = "case when s = 0 then 0.0 else ((s * 7919 + i * 104729) % 1000) / 1000.0::double * 0.2::double - 0.1::double end"


@query(f"{BASE}, p as (select s, list(q[i + 1] + {NOISE} order by i) as v from (select s, unnest(range(64)) as i, q from unnest(range(5)) as t(s), o) group by s), d as (select s, vec_id, list_distance(e.v, p.v) as d, row_number() over (partition by s order by list_distance(e.v, p.v), vec_id) as r from e, p) select vec_id, count(*) as votes, round(avg(d), 6) as mean_distance from d where r <= 10 group by vec_id order by count(*) desc, round(avg(d), 6), vec_id limit 10")
def k18_multi_start(spark, sf_dir):
    """One query from five starts, four of them shifted by noise; results by votes, then mean distance."""
    q = first(spark, sf_dir)
    noise = lambda s, i: 0.0 if s == 0 else ((s * 7919 + i * 104729) % 1000) / 1000.0 * 0.2 - 0.1
    starts = spark.createDataFrame([(s, [x + noise(s, i) for i, x in enumerate(q)]) for s in range(5)], "qid long, embedding array<double>")
    near = knn.knn_batch(emb(spark, sf_dir), starts, 10)
    return near.groupBy("vec_id").agg(F.count("*").alias("votes"), R(F.avg("distance")).alias("mean_distance")).orderBy(F.desc("votes"), "mean_distance", "vec_id").limit(10)


@query(f"{batch_sql('list_distance(e.v, a.v)').rpartition('select qid')[0]} select vec_id, count(*) as votes, round(avg(d), 6) as mean_distance from r where rank <= 10 group by vec_id order by count(*) desc, round(avg(d), 6), vec_id limit 10")
def k18_voting(spark, sf_dir):
    near = knn.knn_batch(emb(spark, sf_dir), asked(spark, sf_dir), 10)
    return near.groupBy("vec_id").agg(F.count("*").alias("votes"), R(F.avg("distance")).alias("mean_distance")).orderBy(F.desc("votes"), "mean_distance", "vec_id").limit(10)


@query(f"""{BASE}, x as (select a.vec_id as qid, e.vec_id, row_number() over (partition by a.vec_id order by list_distance(e.v, a.v), e.vec_id) as r, row_number() over (partition by a.vec_id order by list_distance(e.v[1:16], a.v[1:16]), e.vec_id) as s from e, e a where a.vec_id % 20 = 0)
    select count(distinct qid) as n_queries, round(sum((s <= 10)::int) / count(*), 6) as recall from x where r <= 10""")
def k20_recall(spark, sf_dir):
    e, q = emb(spark, sf_dir), asked(spark, sf_dir)
    short = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 16))
    return knn.recall(knn.knn_batch(short(e), short(q), 10), knn.knn_batch(e, q, 10), 10).select("n_queries", R(F.col("recall")).alias("recall"))


@query(f"{BASE} select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 6) as similarity from e a, e b where a.vec_id % 20 = 0")
def k21_cosine_matrix(spark, sf_dir):
    """The rows of the query set, over all columns."""
    return knn.all_similarities(emb(spark, sf_dir), asked(spark, sf_dir)).select(F.col("qid").alias("a"), F.col("vec_id").alias("b"), R(F.col("similarity")).alias("similarity"))


@query(f"{BASE}, n as (select vec_id, list_distance(v, q) as d from e, o order by d, vec_id limit 50) select case when d < 0.3 then 'HIGH' when d < 0.6 then 'MEDIUM' else 'LOW' end as confidence, count(*) as n, round(avg(1 / (1 + d)), 6) as similarity from n group by 1")
def k22_verbatim_confidence(spark, sf_dir):
    near = knn.knn(emb(spark, sf_dir), first(spark, sf_dir), 50)
    level = F.when(F.col("distance") < 0.3, "HIGH").when(F.col("distance") < 0.6, "MEDIUM").otherwise("LOW")
    return near.groupBy(level.alias("confidence")).agg(F.count("*").alias("n"), R(F.avg(1 / (1 + F.col("distance")))).alias("similarity"))


@query(f"{BASE}, n as (select vec_id, list_distance(v, q) as d from e, o order by d, vec_id limit 20) select n.vec_id, round(d, 6) as distance, coalesce(lang, '') as lang, coalesce(length(text), 0)::bigint as n_text from n left join documents on doc_id = vec_id")
def k23_memory_search(spark, sf_dir):
    near = knn.knn(emb(spark, sf_dir), first(spark, sf_dir), 20)
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", F.length("text").cast("long").alias("n_text"))
    return near.join(docs, "vec_id", "left").select("vec_id", R(F.col("distance")).alias("distance"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("n_text", F.lit(0)).alias("n_text"))


# splats, clustering, energy -----------------------------------------------------------------

MIX = f"""{BASE}, m as (select label, i, avg(v[i]) as x, var_pop(v[i]) * count(*) as ss, count(*) as n from (select label, v, unnest(range(1, 65)) as i from e) group by label, i),
    s as (select label, list(x order by i) as mu, max(n) as n, max(n) / (select count(*) from e) as alpha, least(greatest(1 / (sqrt(sum(ss)) / max(n) + 1e-8), 0.1), 100.0) as kappa from m group by label)"""


@query(f"{MIX}, d as (select e.vec_id, s.label, list_distance(v, mu) as d, row_number() over (partition by e.vec_id order by list_distance(v, mu), s.label) as r from e, s) select vec_id, label as cluster, round(d, 6) as distance from d where r = 1")
def a03_assign(spark, sf_dir):
    e = emb(spark, sf_dir)
    return clustering.assign(e, knn.centroids(e, "label")).withColumn("distance", R(F.col("distance")))


@query(f"{MIX} select label as cluster, n::bigint as n, round(list_sum(mu), 6) as total, round(mu[1], 6) as x1 from s")
def a04_update_centroids(spark, sf_dir):
    return knn.centroids(emb(spark, sf_dir), "label").select("cluster", "n", R(V.total(F.col("center"))).alias("total"), R(F.col("center")[0]).alias("x1"))


@query(f"{BASE}, x as (select vec_id, v, unnest(range(1, 65)) as i from e), s as (select i, avg(v[i]) as m, case when stddev_pop(v[i]) < 1e-8 then 1 else stddev_pop(v[i]) end as sd from x group by i), z as (select vec_id, i, (v[i] - m) / sd as z from x join s using (i)) select vec_id, round(max(z) / (sqrt(sum(z * z)) + 1e-8), 6) as top from z group by vec_id")
def a08_standardise(spark, sf_dir):
    each = emb(spark, sf_dir).select("vec_id", F.posexplode(V.vec("embedding")).alias("i", "x"))
    sd = F.stddev_pop("x")
    stats = each.groupBy("i").agg(F.avg("x").alias("m"), F.when(sd < 1e-8, 1.0).otherwise(sd).alias("sd"))
    z = each.join(F.broadcast(stats), "i").select("vec_id", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z"))  # a row for each component
    return z.groupBy("vec_id").agg(R(F.max("z") / (F.sqrt(F.sum(F.col("z") * F.col("z"))) + 1e-8)).alias("top"))


@query("with r as (select vec_id, row_number() over (order by vec_id) as i, count(*) over () as n from embeddings) select case when i <= floor(n * 0.8) then 'train' when i <= floor(n * 0.8) + floor(n * 0.1) then 'validation' else 'test' end as split, count(*) as n, min(vec_id) as low, max(vec_id) as high from r group by 1")
def a10_ordered_split(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id")
    n = e.count()
    train, val = int(n * 0.8), int(n * 0.1)
    split = F.when(F.col("i") <= train, "train").when(F.col("i") <= train + val, "validation").otherwise("test")
    return ordered.numbered(e, ["vec_id"], "i").groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))


@query(f"{MIX} select label as cluster, n::bigint as n, round(alpha, 6) as alpha, round(kappa, 5) as kappa, round(list_sum(mu), 6) as total from s")
def a11_splats(spark, sf_dir):
    return energy.splats(emb(spark, sf_dir), "label").select("cluster", "n", R(F.col("alpha")).alias("alpha"), R(F.col("kappa"), 5).alias("kappa"), R(V.total(F.col("mu"))).alias("total"))


@query(f"{MIX}, r as (select label, row_number() over (order by 0.4 * alpha + 0.3 * n + 0.3 * kappa desc, label) as i, count(*) over () as c from s) select label as cluster, case when i <= ceil(c * 0.2) then 'hot' when i <= ceil(c * 0.5) then 'warm' else 'cold' end as tier from r")
def a15_tiers(spark, sf_dir):
    s = energy.splats(emb(spark, sf_dir), "label")
    return store.tiers(s, 0.4 * F.col("alpha") + 0.3 * F.col("n") + 0.3 * F.col("kappa"), "cluster")


@query(f"{MIX} select count(*) as n_splats, sum(n)::bigint as n_vectors, round(sum(n) / count(*), 4) as ratio, round(100 * (1 - count(*) / sum(n)), 4) as savings from s")
def a16_compression(spark, sf_dir):
    s = energy.splats(emb(spark, sf_dir), "label")
    n, m = F.count("*"), F.sum("n")
    return s.agg(n.alias("n_splats"), m.alias("n_vectors"), R(m / n, 4).alias("ratio"), R(100 * (1 - n / m), 4).alias("savings"))


@query(f"{MIX}, p as (select kappa / sum(kappa) over () as p, count(*) over () as c from s) select round(least(greatest(sum(-p * ln(p)) / ln(max(c)), 0), 1), 6) as entropy from p")
def a18_entropy(spark, sf_dir):
    return store.entropy(energy.splats(emb(spark, sf_dir), "label"), "kappa").select(R(F.col("entropy")).alias("entropy"))


@query(f"{MIX} select label as cluster from s where alpha >= 1e-6 and not list_contains(list_transform(mu, lambda x: isnan(x) or isinf(x)), true)")
def a19_compact(spark, sf_dir):
    return store.compacted(energy.splats(emb(spark, sf_dir), "label")).select("cluster")


@query("with h as (select user_id as vec_id, count(*) as hits from events group by 1) select vec_id, round((1.0 + coalesce(hits, 0)) * 0.95, 6)::double as frequency from embeddings left join h using (vec_id)")
def a20_access_frequency(spark, sf_dir):
    hits = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vec_id")).agg(F.count("*").alias("hits"))
    return emb(spark, sf_dir).select("vec_id").join(hits, "vec_id", "left").select("vec_id", R((1.0 + F.coalesce("hits", F.lit(0))) * 0.95).alias("frequency"))


@query("select count(*) as n_active, max(len(embedding))::int as dim, count(distinct label) as n_labels, round(avg(len(embedding) * 4.0), 4) as bytes, round(64 * 4.0 / (32 * 6), 4) as polar_ratio from embeddings")
def a21_statistics(spark, sf_dir):
    n = F.size("embedding")
    return emb(spark, sf_dir).agg(F.count("*").alias("n_active"), F.max(n).alias("dim"), F.countDistinct("label").alias("n_labels"), R(F.avg(n * 4.0), 4).alias("bytes"), F.lit(round(64 * 4.0 / (32 * 6), 4)).alias("polar_ratio"))


ENERGY = f"{MIX}, p as (select vec_id, sum(alpha * exp(-kappa * list_distance(v, mu) ** 2)) as p from e, s group by vec_id), n as (select vec_id, case when p < 1e-10 then 10.0 else -ln(p) end as energy from p)"


@query(f"{ENERGY} select vec_id, round(energy, 5) as energy from n")
def e01_splat_energy(spark, sf_dir):
    e = emb(spark, sf_dir)
    return energy.splat_energy(e, energy.splats(e, "label")).select("vec_id", R(F.col("energy"), 5).alias("energy"))


@query(f"{BASE} select vec_id, round(({NORM} - 1) ** 2, 6) as energy from e")
def e02_geometric_energy(spark, sf_dir):
    return emb(spark, sf_dir).select("vec_id", R(energy.geometric_energy(V.vec("embedding"))).alias("energy"))


@query(f"{ENERGY} select vec_id, round(energy + 0.1 * ({NORM} - 1) ** 2, 5) as energy from n join e using (vec_id)")
def e03_total_energy(spark, sf_dir):
    e = emb(spark, sf_dir)
    return energy.splat_energy(e, energy.splats(e, "label")).join(e, "vec_id").select("vec_id", R(F.col("energy") + 0.1 * energy.geometric_energy(V.vec("embedding")), 5).alias("energy"))


@query(f"{ENERGY} select vec_id, round(1 / (1 + greatest(energy, 0)), 5) as confidence, case when energy < 0.3 then 'high_confidence' when energy < 0.7 then 'moderate' else 'uncertain' end as zone from n")
def e04_confidence(spark, sf_dir):
    e = emb(spark, sf_dir)
    x = energy.splat_energy(e, energy.splats(e, "label"))
    return x.select("vec_id", R(energy.confidence(F.col("energy")), 5).alias("confidence"), energy.zone(F.col("energy")).alias("zone"))


@query(f"{MIX} select round(-ln(sum(alpha)), 5) + 0.0 as free_energy from s")
def e06_free_energy(spark, sf_dir):
    s = energy.splats(emb(spark, sf_dir), "label")
    return s.agg((R(-F.log(F.sum("alpha")), 5) + 0.0).alias("free_energy"))


@query(f"{ENERGY}, c as (select 0.6 * var_pop(energy) / (var_pop(energy) + 1) + 0.4 * 0 as c from n) select round(c, 5) as criticality, case when c < 0.3 then 'subcritical' when c < 0.7 then 'critical' else 'supercritical' end as state from c")
def e08_criticality(spark, sf_dir):
    e = emb(spark, sf_dir)
    x = energy.splat_energy(e, energy.splats(e, "label")).withColumn("size", F.lit(1.0))
    return energy.criticality(x, "energy", "size").select(R(F.col("criticality"), 5).alias("criticality"), "state")


@query(f"{MIX}, g as (select label, alpha * (1 + 0.05 * exp(-0.1 * kappa)) as a, kappa from s) select label as cluster, round(a / (select sum(a) from g), 6) as alpha, round(least(greatest(kappa * 1.01, 0.1), 100.0), 5) as kappa from g")
def e10_relaxation(spark, sf_dir):
    return energy.relax(energy.splats(emb(spark, sf_dir), "label")).select("cluster", R(F.col("alpha")).alias("alpha"), R(F.col("kappa"), 5).alias("kappa"))


@query()
def e12_boltzmann(spark, sf_dir):
    e = emb(spark, sf_dir)
    return energy.boltzmann(energy.splat_energy(e, energy.splats(e, "label")), "energy", 20)


@query()
def a02_kmeans(spark, sf_dir):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = emb(spark, sf_dir).select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=10, seed=42, maxIter=20).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))
