"""Queries of sources and tables, splat construction, energy, sharding, and quality reports."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clustering, energy, knn, ordered, routing, store
from ..session import app_folder, load, written
from ..sources import binary_vectors
from .registry import query
from .vector_queries import BASE, ENERGY, MIX, R, asked, batch_sql, emb, first


def folder(spark, name: str) -> str:
    return f"{app_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cents():
    return F.round(F.col("value") * 100).cast("long")


def mills(total, n):
    """A mean as whole thousandths; values have two decimals."""
    return F.floor(total * 10 / n).cast("long")


# sources, sinks, tables ---------------------------------------------------------------------


@query("select row_number() over (order by vec_id) - 1 as vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total from embeddings")
def s01_binary_scan(spark, sf_dir):
    """Vectors written as flat binary files and read back."""
    at = folder(spark, "vectors")
    binary_vectors.write_vectors(emb(spark, sf_dir), at).collect()  # a row for each file
    return binary_vectors.read_vectors(spark, at).select("vec_id", R(V.total(V.vec("embedding"))).alias("total"))


@query("select count(*) as n_rows from embeddings")
def s02_binary_sink(spark, sf_dir):
    return binary_vectors.write_vectors(emb(spark, sf_dir), folder(spark, "vectors")).agg(F.sum("n_rows").alias("n_rows"))


@query("select l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 4) as total from lineitem")
def s03_vector_text(spark, sf_dir):
    """Vectors typed as comma-separated text."""
    typed = F.concat_ws(", ", *[F.col(c).cast("string") for c in ("l_quantity", "l_discount", "l_tax")])
    parsed = F.transform(F.split(typed, ","), lambda x: F.trim(x).cast("double"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R(V.total(parsed), 4).alias("total"))


@query(batch_sql("list_distance(e.v, a.v)").replace("select qid, vec_id, round(d, 6) as distance, rank::int as rank", "select (dense_rank() over (order by qid) - 1)::bigint as qid, vec_id, (rank - 1)::bigint as rank"))
def s04_ground_truth(spark, sf_dir):
    """The exact neighbours of the query set, written as a ground-truth file and read back."""
    near = knn.knn_batch(emb(spark, sf_dir), asked(spark, sf_dir), 10)
    lists = sorted(near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("n")).collect())  # the bounded query set
    ids = np.array([[x.vec_id for x in r.n] for r in lists], dtype="<i8")
    at = folder(spark, "truth")
    binary_vectors.put(f"{at}/truth.gt", struct.pack("<QQ", *ids.shape) + ids.tobytes())
    return binary_vectors.read_ground_truth(spark, at)


@query("select vec_id % 4 as shard, count(*) as n, min(vec_id) as low, max(vec_id) as high from embeddings group by 1")
def s05_shards(spark, sf_dir):
    """Shards as partition folders: written once, then each read by pruning."""
    at = folder(spark, "shards")
    emb(spark, sf_dir).withColumn("shard", F.col("vec_id") % 4).write.partitionBy("shard").parquet(at)
    return spark.read.parquet(at).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))


def records(spark, sf_dir):
    """Documents as records of a store; nothing deleted, version 0."""
    return load(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("updated_at"))


GOOD, TOXIC = "(select distinct doc_id from labels where quality = 1)", "(select distinct doc_id from labels where toxic = 1)"


@query(f"select doc_id, case when doc_id in {GOOD} then 'xx' else lang end as lang, (doc_id in {GOOD})::bigint as updated_at from documents")
def s07_upsert(spark, sf_dir):
    good = load(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    changes = good.join(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    changes = changes.select("doc_id", F.lit("xx").alias("lang"), F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("updated_at"))
    return store.upsert(records(spark, sf_dir), changes, "doc_id", "updated_at").select("doc_id", "lang", "updated_at")


@query("select doc_id, lang, n_chars from documents where doc_id = 7")
def s08_point_lookup(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("doc_id = 7").select("doc_id", "lang", "n_chars")


@query(f"select doc_id, doc_id in {TOXIC} as deleted, (doc_id in {TOXIC})::bigint as updated_at from documents where doc_id not in (select doc_id from labels where quality = 0 and toxic = 0)")
def s09_deletes(spark, sf_dir):
    """Toxic documents are marked, documents labelled bad but not toxic are removed."""
    labels = load(spark, sf_dir, "labels")
    marked = store.soft_delete(records(spark, sf_dir), labels.where("toxic = 1"), "doc_id", F.lit(1).cast("long"))
    return store.hard_delete(marked, labels.where("quality = 0 and toxic = 0"), "doc_id").select("doc_id", "deleted", "updated_at")


@query(f"select count(*) as n_all, sum((doc_id not in {TOXIC})::int)::bigint as n_live from documents")
def s10_counts(spark, sf_dir):
    marked = store.soft_delete(records(spark, sf_dir), load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", F.lit(1).cast("long"))
    return marked.agg(F.count("*").alias("n_all"), F.sum((~F.col("deleted")).cast("long")).alias("n_live"))


@query(f"{BASE}, n as (select vec_id, list_distance(v, q) as d from e, o order by d, vec_id limit 30) select vec_id, doc_id, lang from n join documents on doc_id = vec_id where doc_id not in {TOXIC}")
def s11_reverse_lookup(spark, sf_dir):
    near = knn.knn(emb(spark, sf_dir), first(spark, sf_dir), 30).select("vec_id")
    live = records(spark, sf_dir).join(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return near.join(live, near.vec_id == live.doc_id).select("vec_id", "doc_id", "lang")


@query(f"{MIX} select label as cluster, round(alpha, 6) as alpha, round(kappa, 5) as kappa, len(mu)::int as dim from s")
def s12_energy_state(spark, sf_dir):
    mix = written(energy.splats(emb(spark, sf_dir), "label"), "energy-state")
    return mix.select("cluster", R(F.col("alpha")).alias("alpha"), R(F.col("kappa"), 5).alias("kappa"), F.size("mu").alias("dim"))


@query("with c as (select max(event_id) as done from events where event_type = 'signup') select event_id as lsn, event_type as op from events, c where event_id > done")
def s14_log_recovery(spark, sf_dir):
    """Operations after the last checkpoint of a log, in order."""
    log = load(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.col("event_type").alias("op"))
    at = log.where("op = 'signup'").agg(F.max("lsn")).first()[0]
    return (log.where(F.col("lsn") > at) if at is not None else log).orderBy("lsn")


@query("select count(*) as n, sum(n_chars)::bigint as n_chars from documents")
def s15_backup(spark, sf_dir):
    return store.backup(load(spark, sf_dir, "documents"), folder(spark, "backup")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("select label as id, 'label ' || label as name, count(*) as n_vectors, max(len(embedding))::int as dim from embeddings group by label")
def s16_dataset_catalog(spark, sf_dir):
    e = emb(spark, sf_dir).groupBy(F.col("label").alias("id")).agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("dim"))
    return e.withColumn("name", F.concat(F.lit("label "), F.col("id").cast("string")))


@query("select label as collection, count(*) as n, min(len(embedding))::int as low_dim, max(len(embedding))::int as high_dim from embeddings where len(embedding) between 1 and 65536 group by label")
def s17_collections(spark, sf_dir):
    ok = emb(spark, sf_dir).where(F.size("embedding").between(1, 65536))
    return ok.groupBy(F.col("label").alias("collection")).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low_dim"), F.max(F.size("embedding")).alias("high_dim"))


@query("with n as (select count(*) as n, sum((label = 0)::int) as z from embeddings) select vec_id, 1.0::double as alpha, 1.0::double as kappa from embeddings, n where label <> 0 or z + (n - z) <= n")
def s18_capacity_append(spark, sf_dir):
    """A batch joins the table only as a whole, within the capacity."""
    e = emb(spark, sf_dir)
    fresh = lambda df: df.select("vec_id", F.lit(1.0).alias("alpha"), F.lit(1.0).alias("kappa"))
    return store.append(fresh(e.where("label <> 0")), fresh(e.where("label = 0")), e.count())[0]


@query("select vec_id, label from embeddings where label <> 0")
def s18_capacity_refused(spark, sf_dir):
    """A batch that passes the capacity by one row is refused whole."""
    e = emb(spark, sf_dir).select("vec_id", "label")
    return store.append(e.where("label <> 0"), e.where("label = 0"), e.count() - 1)[0]


@query("with n as (select doc_id, coalesce(source, '') || case doc_id % 5 when 1 then '/../x' when 2 then '..' when 3 then chr(92) || 'y' else '-' || doc_id end as name from documents) select doc_id, not (name = '' or contains(name, '/') or contains(name, chr(92)) or contains(name, '..')) as safe from n")
def s06_shard_names(spark, sf_dir):
    """Whether a name may become a shard's file."""
    i = F.pmod("doc_id", F.lit(5))
    tail = F.when(i == 1, "/../x").when(i == 2, "..").when(i == 3, "\\y").otherwise(F.concat(F.lit("-"), F.col("doc_id").cast("string")))
    name = F.concat(F.coalesce("source", F.lit("")), tail)
    return load(spark, sf_dir, "documents").select("doc_id", binary_vectors.is_safe(name).alias("safe"))


@query(f"{MIX} select count(*) as n_splats, round(sum(alpha), 6) as weight, max(len(mu))::int as dim from s")
def s19_load_splats(spark, sf_dir):
    mix = written(energy.splats(emb(spark, sf_dir), "label"), "splats")
    return mix.agg(F.count("*").alias("n_splats"), R(F.sum("alpha")).alias("weight"), F.max(F.size("mu")).alias("dim"))


# clustering and splats ----------------------------------------------------------------------


@query()
def a01_seeded_centers(spark, sf_dir):
    return clustering.seeded(emb(spark, sf_dir), 10)


@query()
def a05_two_level_index(spark, sf_dir):
    return clustering.two_level(emb(spark, sf_dir), 10, 4)


@query()
def a06_simple_kmeans(spark, sf_dir):
    e = emb(spark, sf_dir)
    centers = clustering.seeded(e, 10, seed=7).select("cluster", "center")
    for _ in range(5):
        centers = written(clustering.lloyd_step(e, centers).select("cluster", "center"), "centers")
    return clustering.assign(e, centers)


@query()
def a07_map_reduce_index(spark, sf_dir):
    return clustering.map_reduce(emb(spark, sf_dir), 10)


@query()
def a09_augmentation(spark, sf_dir):
    """Uniform noise on each component and a sign for each row, from hashes of its id: a task that runs again gives the same."""
    sign = F.when(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(2)) == 0, -1.0).otherwise(1.0)
    noise = lambda i: F.pmod(F.xxhash64("vec_id", i, F.lit(6)), F.lit(20_001)) / 1e6 - 0.01
    return emb(spark, sf_dir).select("vec_id", V.let(sign, lambda s: F.transform(V.vec("embedding"), lambda x, i: s * (x + noise(i)))).alias("embedding"))


@query()
def a12_hierarchical_splats(spark, sf_dir):
    rows = clustering.two_level(emb(spark, sf_dir), 10, 4)
    return energy.splats(emb(spark, sf_dir).join(rows, "vec_id").withColumn("both", F.col("coarse_id") * 4 + F.col("fine_id")), "both")


@query()
def a13_leader_clusters(spark, sf_dir):
    return clustering.leaders(emb(spark, sf_dir), 1.2)


MERGED = f"""{MIX}, big as (select * from s where n >= 50), small as (select * from s where n < 50), near as (select a.label, b.label as into_, row_number() over (partition by a.label order by list_distance(a.mu, b.mu), b.label) as r from small a, big b)"""


@query(f"{MERGED}, t as (select label, n from big union all select into_, n from small join (select label, into_ from near where r = 1) using (label)) select label as cluster, sum(n)::bigint as n from t group by label")
def a14_merge_small(spark, sf_dir):
    return clustering.merge_small(energy.splats(emb(spark, sf_dir), "label"), 50).select("cluster", "n")


@query()
def a17_ingest(spark, sf_dir):
    """Standardise, cluster, make splats."""
    e = clustering.standardised(emb(spark, sf_dir))
    centers = clustering.seeded(e, 10)
    return energy.splats(e.join(clustering.assign(e, centers), "vec_id"), "cluster").select("cluster", "n", "alpha", "kappa")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events), o as (select event_type, count(*) / sum(value) as ops from events group by 1)
    select event_type as size, """ + ", ".join(f"max(case when i = round((n - 1) * {p})::bigint + 1 then value end) as {name}" for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + """, event_type = (select event_type from o order by round(ops, 9) desc, event_type limit 1) as best from r group by 1""")
def r14_latency_report(spark, sf_dir):
    """Percentiles of latency for each size by rounded place, and the size of most operations a second."""
    return routing.latency_report(load(spark, sf_dir, "events"), "event_type", "value").withColumnRenamed("event_type", "size")


@query("select count(*) as n, sum(len(embedding) * 4)::bigint as raw_bytes, sum((len(embedding) // 2) * 6)::bigint as code_bytes, round(sum(len(embedding) * 4) / sum((len(embedding) // 2) * 6), 6) as actual_ratio, 8.0::double as nominal_ratio from embeddings")
def a22_quantised_stats(spark, sf_dir):
    n = F.size("embedding")
    raw, code = F.sum(n * 4), F.sum(F.floor(n / 2) * 6)
    return emb(spark, sf_dir).agg(F.count("*").alias("n"), raw.alias("raw_bytes"), code.alias("code_bytes"), R(raw / code).alias("actual_ratio"), F.lit(8.0).alias("nominal_ratio"))


# energy -------------------------------------------------------------------------------------

GRADIENT = f"{MIX}, w as (select vec_id, v, mu, 2 * kappa * alpha * exp(-kappa * list_distance(v, mu) ** 2) as g, alpha * exp(-kappa * list_distance(v, mu) ** 2) as p from e, s)"


@query(f"{GRADIENT}, x as (select vec_id, i, sum(g * (v[i] - mu[i])) / sum(p) as g from (select *, unnest(range(1, 65)) as i from w) group by vec_id, i) select vec_id, round(sqrt(sum(g * g)), 5) as length from x group by vec_id")
def e05_gradient(spark, sf_dir):
    e = emb(spark, sf_dir)
    g = energy.gradient(e, energy.splats(e, "label"))
    return g.select("vec_id", R(V.norm(F.col("gradient")), 5).alias("length"))


@query(f"""{MIX}, g as (select x, y from unnest(range(11)) as a(x), unnest(range(11)) as b(y)), c as (select x, y, list_concat([q[1] + (x - 5) / 5.0, q[2] + (y - 5) / 5.0], q[3:]) as v from g, o),
    p as (select x, y, sum(alpha * exp(-kappa * list_distance(v, mu) ** 2)) as p from c, s group by x, y) select x::int as x, y::int as y, round(case when p < 1e-10 then 10.0 else -ln(p) end, 5) as energy from p""")
def e07_energy_map(spark, sf_dir):
    """Energy on a grid over the first two components around vector 0."""
    e, q = emb(spark, sf_dir), first(spark, sf_dir)
    grid = spark.range(121).select((F.col("id") % 11).cast("int").alias("x"), F.floor(F.col("id") / 11).cast("int").alias("y"))
    at = F.concat(F.array(q[0] + (F.col("x") - 5) / 5.0, q[1] + (F.col("y") - 5) / 5.0), knn.literal(q[2:]))
    cells = grid.select(F.struct("x", "y").alias("cell"), at.alias("embedding"))
    out = energy.splat_energy(cells, energy.splats(e, "label"), key="cell")
    return out.select("cell.x", "cell.y", R(F.col("energy"), 5).alias("energy"))


@query()
def e09_avalanche(spark, sf_dir):
    e = emb(spark, sf_dir)
    return energy.avalanche(energy.splats(e, "label"))


@query()
def e11_high_energy_regions(spark, sf_dir):
    e = emb(spark, sf_dir)
    return energy.regions(e, energy.splats(e, "label"), 5)


@query()
def e13_exploration(spark, sf_dir):
    """Regions of high energy and the five vectors nearest to each."""
    e = emb(spark, sf_dir)
    found = energy.regions(e, energy.splats(e, "label"), 5)
    near = knn.knn_batch(e, found.select(F.col("region").alias("qid"), F.col("center").alias("embedding")), 5)
    lists = near.groupBy(F.col("qid").alias("region")).agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("n"))
    return found.join(lists, "region").select("region", "energy", F.transform("n", lambda s: s.vec_id).alias("nearest"))


@query("select vec_id, 0.0::double as compositional from embeddings")
def e14_compositional(spark, sf_dir):
    return emb(spark, sf_dir).select("vec_id", F.lit(0.0).alias("compositional"))


@query(f"{MIX} select label as cluster, round(alpha, 6) as energy, 1::int as size from s")
def e14_splat_state(spark, sf_dir):
    """The state that follows new splats: one cluster for each, its energy the splat's weight, its size 1."""
    return energy.splat_state(energy.splats(emb(spark, sf_dir), "label")).select("cluster", R(F.col("energy")).alias("energy"), "size")


# sharding, routing, nodes -------------------------------------------------------------------


@query(f"{MIX}, d as (select e.vec_id, s.label % 4 as shard, row_number() over (partition by e.vec_id order by list_distance(v, mu), s.label) as r from e, s) select vec_id, shard::int as shard from d where r = 1")
def d01_shard_by_cluster(spark, sf_dir):
    e = emb(spark, sf_dir)
    return clustering.assign(e, knn.centroids(e, "label")).select("vec_id", (F.col("cluster") % 4).cast("int").alias("shard"))


SHARDS = f"{BASE}, h as (select vec_id % 4 as shard, vec_id, list_distance(v, q) as d, row_number() over (partition by vec_id % 4 order by list_distance(v, q), vec_id) - 1 as rank from e, o), t as (select * from h where rank < 20)"


def shard_hits(spark, sf_dir, k=20):
    """The k best of each shard: (shard, vec_id, distance, rank from 0)."""
    rows = emb(spark, sf_dir).select((F.col("vec_id") % 4).alias("shard"), "vec_id", V.l2(V.vec("embedding"), knn.literal(first(spark, sf_dir))).alias("distance"))
    w = Window.partitionBy("shard").orderBy("distance", "vec_id")
    top = rows.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= k)  # each task passes on k rows of a shard
    return top.withColumn("rank", F.col("n_") - 1).drop("n_")


@query(f"{SHARDS} select vec_id, round(sum(1.0 / (61 + rank)), 8) as score, round(min(d), 6) as distance from t group by vec_id")
def d02_merge_rrf(spark, sf_dir):
    return routing.merge_rrf(shard_hits(spark, sf_dir)).select("vec_id", F.round("score", 8).alias("score"), R(F.col("distance")).alias("distance"))


@query(f"{SHARDS} select vec_id, round(min(d), 6) as distance from t group by vec_id order by min(d), vec_id limit 10")
def d03_merge_best(spark, sf_dir):
    return routing.merge_best(shard_hits(spark, sf_dir), 10).select("vec_id", R(F.col("distance")).alias("distance"))


@query(f"{SHARDS} select vec_id, shard, round(d, 6) as distance from t order by d, vec_id limit 10")
def d04_distributed_search(spark, sf_dir):
    return shard_hits(spark, sf_dir, 10).orderBy("distance", "vec_id").limit(10).select("vec_id", "shard", R(F.col("distance")).alias("distance"))


@query("select l_partkey as doc_id, array_to_string(list_sort(list(distinct l_suppkey % 4)), ',') as shards from lineitem group by 1")
def d05_locations(spark, sf_dir):
    s = F.array_sort(F.collect_set(F.col("l_suppkey") % 4))  # four shards at most
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.array_join(F.transform(s, lambda x: x.cast("string")), ",").alias("shards"))


NODES = "n as (select event_type as node, count(*) as active, avg(value) as latency, max(ts) as seen, sum((value > 100)::int) as slow from events group by 1)"


def nodes(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("node")).agg(F.count("*").alias("active"), F.avg("value").alias("latency"), F.max("ts").alias("seen"), F.sum((F.col("value") > 100).cast("long")).alias("slow"))


@query(f"with {NODES} select node, round(active * 100 + latency, 4) as load, row_number() over (order by active * 100 + latency, node)::int as place from n")
def d06_least_loaded(spark, sf_dir):
    n = nodes(spark, sf_dir).select("node", R(F.col("active") * 100 + F.col("latency"), 4).alias("load"), (F.col("active") * 100 + F.col("latency")).alias("l_"))
    return n.withColumn("place", F.row_number().over(Window.orderBy("l_", "node"))).drop("l_")  # a row for each node


@query(f"with {NODES}, w as (select node, (select max(latency) from n) - latency * 0.5 + 0.1 as w from n) select node, round(w / sum(w) over (), 6) as share, round(sum(w) over (order by node) / sum(w) over (), 6) as upto from w")
def d07_energy_routing(spark, sf_dir):
    n = nodes(spark, sf_dir)
    every = Window.partitionBy(F.lit(0))  # a row for each node
    w = n.withColumn("w", F.max("latency").over(every) - F.col("latency") * 0.5 + 0.1)
    return w.select("node", R(F.col("w") / F.sum("w").over(every)).alias("share"), R(F.sum("w").over(every.orderBy("node")) / F.sum("w").over(every)).alias("upto"))


@query("with s as (select user_id as node, max(ts) as seen from events group by 1) select node, (select max(ts) from events) - seen > interval 86400 seconds as stale from s")
def d08_stale_nodes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0])
    seen = e.groupBy(F.col("user_id").alias("node")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("seen"))
    return seen.select("node", (now - F.col("seen") > 86400 * 1_000_000).alias("stale"))


@query(f"with {NODES} select count(*) as n_nodes, sum(active)::bigint as n_requests, round(avg(latency), 6) as latency, arg_min(node, latency) as fastest from n")
def d09_cluster_stats(spark, sf_dir):
    return nodes(spark, sf_dir).agg(F.count("*").alias("n_nodes"), F.sum("active").alias("n_requests"), R(F.avg("latency")).alias("latency"), F.min_by("node", "latency").alias("fastest"))


@query("select user_id, least(count(*), 5) as retries, count(*) > 5 as given_up from events where event_type = 'error' group by 1")
def d10_retry_queue(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.least(F.count("*"), F.lit(5)).alias("retries"), (F.count("*") > 5).alias("given_up"))


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type in ('error', 'purchase')), f as (select user_id, min(case when event_type = 'purchase' then i end) as done from r group by 1)
    select event_id, user_id, i - 1 as attempt, case when i - 1 >= 5 then 'dropped' when done is not null and i > done then 'new' when done is not null then 'sent' else 'waiting' end as state from r join f using (user_id) where event_type = 'error'""")
def d10_sync_queue(spark, sf_dir):
    """Each failed action in its sender's queue: sent by the sender's first success after it, waiting, or dropped after five attempts."""
    e = load(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").select("event_id", "user_id", "event_type", "ts")
    r = written(ordered.placed(e, "user_id", ["ts", "event_id"]).withColumnRenamed("i_", "i"), "queue")
    done = r.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("i"))).alias("done"))
    state = F.when(F.col("i") - 1 >= 5, "dropped").when(F.col("done").isNotNull() & (F.col("i") > F.col("done")), "new").when(F.col("done").isNotNull(), "sent").otherwise("waiting")
    return r.where("event_type = 'error'").join(done, "user_id").select("event_id", "user_id", (F.col("i") - 1).alias("attempt"), state.alias("state"))


@query("""with r as (select event_type as node, value, ts, event_id, row_number() over (partition by event_type order by ts, event_id) as i, count(*) over (partition by event_type) as n from events)
    select node, arg_max(value, (ts, event_id)) as latest, case when avg(case when i * 2 > n then value end) > 1.1 * avg(case when i * 2 <= n then value end) then 'up' when avg(case when i * 2 > n then value end) < 0.9 * avg(case when i * 2 <= n then value end) then 'down' else 'flat' end as trend from r group by node""")
def d11_scaling_signals(spark, sf_dir):
    return routing.trends(load(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"]).select(F.col("event_type").alias("node"), "latest", "trend")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events)
    select event_type, """ + ", ".join(f"max(case when i = least(floor(n * {p}) + 1, n) then value end) as {name}" for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " from r group by 1")
def d12_percentiles(spark, sf_dir):
    return routing.nearest_rank(load(spark, sf_dir, "events"), "value", "event_type", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


PRIORITY = "case event_type when 'error' then 3 when 'purchase' then 2 when 'signup' then 1 else 0 end"


@query(f"with m as (select event_id as message, 'user' || (user_id % 4) as receiver, event_type as topic, {PRIORITY} as priority, ts from events), n as (select max(ts) as now from events) select message, receiver, topic, priority, case when epoch(now) - epoch(ts) > 86400.0 * (1 + priority * 3) then 'dead' else 'inbox' end as place from m, n where priority >= 1")
def d12_message_bus(spark, sf_dir):
    """Messages of priority 1 or more by receiver and topic; those past their time to live lie with the dead letters."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts")).first()[0]
    m = e.select(F.col("event_id").alias("message"), F.concat(F.lit("user"), F.pmod("user_id", F.lit(4)).cast("string")).alias("receiver"), F.col("event_type").alias("topic"), F.expr(PRIORITY).alias("priority"), "ts")
    return routing.inbox(m, now, F.col("priority"), least=1, seconds=86400.0 * (1 + F.col("priority") * 3)).drop("ts")


@query("with h as (select user_id as splat, count(*) as hits, max(event_id) as last from events group by 1) select splat, case when hits >= 10 then 'hot' else 'cold' end as tier, row_number() over (order by last, splat)::int as eviction from h")
def d13_tiers_lru(spark, sf_dir):
    h = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("splat")).agg(F.count("*").alias("hits"), F.max("event_id").alias("last"))
    place = ordered.numbered(h, ["last", "splat"], "eviction")
    return place.select("splat", F.when(F.col("hits") >= 10, "hot").otherwise("cold").alias("tier"), F.col("eviction").cast("int").alias("eviction"))


@query("select l_partkey as doc_id, count(distinct l_suppkey) as n_edges from lineitem where l_suppkey not in (select s_suppkey from supplier where s_nationkey = 1) group by 1")
def d14_membership(spark, sf_dir):
    """Locations left after the nodes of one nation are gone."""
    gone = load(spark, sf_dir, "supplier").where("s_nationkey = 1").select(F.col("s_suppkey").alias("l_suppkey"))
    return load(spark, sf_dir, "lineitem").join(gone, "l_suppkey", "left_anti").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.countDistinct("l_suppkey").alias("n_edges"))


@query("select event_id, event_type as node, ((sum(round(value * 100)::bigint) over w * 10) // count(*) over w)::bigint as mean_latency from events window w as (partition by event_type order by event_id rows unbounded preceding)")
def d15_running_mean(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = ordered.running(e, "event_type", ["event_id"], {"cents": cents(), "n": F.lit(1)})
    return out.select("event_id", F.col("event_type").alias("node"), mills(F.col("cents"), F.col("n")).alias("mean_latency"))


@query("select event_type as kind, count(*) as n, count(distinct user_id) as senders, sum((value is null)::int)::bigint as empty from events group by 1")
def d16_message_counts(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("senders"), F.sum(F.col("value").isNull().cast("long")).alias("empty"))


# planning and quality -----------------------------------------------------------------------

ROUTE = "case when batch >= 4 then case when n >= 1000 then 'hrm2' else 'batch' end when n < 1000 or k < 5 then 'exact' when n <= 5000 and k <= 20 then 'exact' else 'hrm2' end"


@query(f"with g as (select (c_custkey * 37) % 8000 as n, c_custkey % 40 + 1 as k, c_custkey % 6 + 1 as batch, c_custkey from customer) select c_custkey, {ROUTE} as strategy from g")
def r01_strategy(spark, sf_dir):
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select("c_custkey", routing.strategy_of((key * 37) % 8000, key % 40 + 1, key % 6 + 1).alias("strategy"))


@query("select c_custkey, case when c_custkey * 100 < 15000 then 'bruteforce' when c_custkey * 100 < 100000 then 'hrm2' else 'hnsw' end as index from customer")
def r02_index(spark, sf_dir):
    n = F.col("c_custkey") * 100
    return load(spark, sf_dir, "customer").select("c_custkey", F.when(n < 15_000, "bruteforce").when(n < 100_000, "hrm2").otherwise("hnsw").alias("index"))


@query("with q as (select o_orderkey, (o_totalprice * 10)::bigint as n, o_orderkey % 50 as k, o_orderkey % 9 as batch from orders) select o_orderkey, case when n < 10000 and batch <= 1 and k <= 10 then 'simple' when n < 1000000 and batch <= 4 then 'moderate' else 'complex' end as complexity from q")
def r03_complexity(spark, sf_dir):
    n, k, batch = F.round(F.col("o_totalprice") * 10).cast("long"), F.col("o_orderkey") % 50, F.col("o_orderkey") % 9
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when((n < 10_000) & (batch <= 1) & (k <= 10), "simple").when((n < 1_000_000) & (batch <= 4), "moderate").otherwise("complex").alias("complexity"))


@query("select event_id, ((sum(round(value * 100)::bigint) over w * 10) // count(*) over w)::bigint as latency from events window w as (partition by event_type order by event_id rows between 99 preceding and current row)")
def r04_rolling_latency(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = ordered.framed(e, "event_type", ["event_id"], 99, {"latency": lambda w: mills(F.sum(cents()).over(w), F.count("*").over(w))})
    return out.select("event_id", "latency")


@query("select 1::bigint as hits, 1::bigint as misses, least(count(*), 10)::bigint as n_results from embeddings")
def r05_result_cache(spark, sf_dir):
    """The same search asked twice: one hit, one miss."""
    cache = routing.ResultCache(capacity=8, ttl=300)
    q = first(spark, sf_dir)
    for _ in range(2):
        out = cache.get_or_run((tuple(q), 10, ""), lambda: knn.knn(emb(spark, sf_dir), q, 10).collect())
    return spark.createDataFrame([(cache.hits, cache.misses, len(out))], "hits long, misses long, n_results long")


@query("with s as (select event_type as item, lead(event_type) over (partition by user_id order by ts, event_id) as next_item from events) select item, next_item, count(*) as n from s where next_item is not null group by 1, 2")
def r06_successors(spark, sf_dir):
    return routing.successors(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


RANKED = f"{BASE}, x as (select a.vec_id as qid, e.vec_id, (e.label = a.label) as rel, list_distance(e.v, a.v) as d, row_number() over (partition by a.vec_id order by list_distance(e.v, a.v), e.vec_id) - 1 as r from e, e a where a.vec_id % 20 = 0 and e.vec_id <> a.vec_id), rel as (select a.vec_id as qid, count(*) as n from e, e a where a.vec_id % 20 = 0 and e.label = a.label and e.vec_id <> a.vec_id group by 1)"


def ranked(spark, sf_dir, k=10, dims=64):
    """(qid, vec_id, r from 0, d, rel) of the query set's k nearest others; rel: the same label."""
    e = emb(spark, sf_dir).withColumn("embedding", F.slice("embedding", 1, dims))
    q = e.where("vec_id % 20 = 0")
    near = knn.knn_batch(e, q.select(F.col("vec_id").alias("qid"), "embedding"), k + 1).where("qid <> vec_id")
    w = Window.partitionBy("qid").orderBy("rank")
    near = near.withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < k)
    labels = e.select("vec_id", F.col("label").alias("l1"))
    asked_ = q.select(F.col("vec_id").alias("qid"), F.col("label").alias("l2"))
    return near.join(labels, "vec_id").join(asked_, "qid").select("qid", "vec_id", "r", F.col("distance").alias("d"), (F.col("l1") == F.col("l2")).alias("rel"))


def relevant(spark, sf_dir):
    """(qid, n): others with the query's label."""
    e = emb(spark, sf_dir)
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n"))
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label").join(sizes, "label").select("qid", "n")


LEVEL = "case when m >= 0.9 then 'excellent' when m >= 0.7 then 'good' when m >= 0.5 then 'fair' when m >= 0.3 then 'poor' else 'bad' end"


@query(f"{RANKED}, p as (select qid, sum(rel::int) / 10.0 as p, sum(rel::int) / greatest(max(n), 1) as rc from x join rel using (qid) where r < 10 group by qid), m as (select *, round((p + rc) / 2, 9) as m from p) select qid, round(p, 6)::double as precision, round(rc, 6) as recall, {LEVEL} as level from m")
def r07_quality(spark, sf_dir):
    p = ranked(spark, sf_dir).groupBy("qid").agg(F.sum(F.col("rel").cast("long")).alias("hit")).join(relevant(spark, sf_dir), "qid")
    p = p.select("qid", (F.col("hit") / 10.0).alias("p"), (F.col("hit") / F.greatest("n", F.lit(1))).alias("rc")).withColumn("m", F.round((F.col("p") + F.col("rc")) / 2, 9))
    return p.select("qid", R(F.col("p")).alias("precision"), R(F.col("rc")).alias("recall"), F.expr(LEVEL).alias("level"))


@query(f"{RANKED}, g as (select qid, d, r, d - lag(d) over (partition by qid order by r) as gap from x where r < 10), s as (select qid, quantile_disc(gap, 0.5) as mid, max(gap) as top, min(gap) as low, stddev_pop(d) / avg(d) as cv from g group by qid) select qid, low < 0 as descending, top > 5 * mid as jump, cv < 0.01 as flat from s")
def r08_anomalies(spark, sf_dir):
    w = Window.partitionBy("qid").orderBy("r")
    g = ranked(spark, sf_dir).withColumn("gap", F.col("d") - F.lag("d").over(w))
    s = g.groupBy("qid").agg(F.expr("percentile_disc(0.5) within group (order by gap)").alias("mid"), F.max("gap").alias("top"), F.min("gap").alias("low"), (F.stddev_pop("d") / F.avg("d")).alias("cv"))
    return s.select("qid", (F.col("low") < 0).alias("descending"), (F.col("top") > 5 * F.col("mid")).alias("jump"), (F.col("cv") < 0.01).alias("flat"))


@query("with w as (select event_id, event_type, value, avg(value) over (partition by event_type order by event_id rows between 10 preceding and 1 preceding) as before from events) select event_id, coalesce(before > 0.5 and value < 0.7 * before, false) as degraded from w")
def r09_degradation(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = ordered.framed(e, "event_type", ["event_id"], 10, {"b": lambda w: F.avg("value").over(w)}, until=-1)
    return out.select("event_id", F.coalesce((F.col("b") > 0.5) & (F.col("value") < 0.7 * F.col("b")), F.lit(False)).alias("degraded"))


SHORT = RANKED.replace("list_distance(e.v, a.v)", "list_distance(e.v[1:16], a.v[1:16])")


@query(f"with f as ({RANKED} select qid, rel from x where r < 10), h as ({SHORT} select qid, rel from x where r < 10), u as (select 'full' as backend, * from f union all select 'short', * from h) select backend, round(sum(rel::int) / count(*), 6) as precision from u group by backend")
def r10_cross_backend(spark, sf_dir):
    both = ranked(spark, sf_dir).withColumn("backend", F.lit("full")).unionByName(ranked(spark, sf_dir, dims=16).withColumn("backend", F.lit("short")))
    return both.groupBy("backend").agg(R(F.sum(F.col("rel").cast("long")) / F.count("*")).alias("precision"))


@query(f"""{RANKED}, q as (select qid, sum(rel::int) / 10.0 as p, sum(rel::int) / greatest(max(n), 1) as rc, coalesce(max(case when rel then 1.0 / (r + 1) end), 0) as rr, sum(case when rel then 1 / (ln(r + 2) / ln(2)) else 0 end) as dcg, max(n) as n from x join rel using (qid) where r < 10 group by qid),
    i as (select qid, sum(1 / (ln(g + 2) / ln(2))) as idcg from (select qid, unnest(range(least(n, 10)::bigint)) as g from rel) group by qid)
    select count(*) as n_queries, round(avg(p), 6) as precision, round(avg(rc), 6) as recall, round(avg(rr), 6) as mrr, round(avg(coalesce(dcg / idcg, 0)), 6) as ndcg from q left join i using (qid)""")
def r11_embedding_evaluation(spark, sf_dir):
    rel, r = F.col("rel"), F.col("r")
    q = ranked(spark, sf_dir).groupBy("qid").agg(F.sum(rel.cast("long")).alias("hit"), F.coalesce(F.max(F.when(rel, 1.0 / (r + 1))), F.lit(0.0)).alias("rr"), routing.ndcg(rel, r).alias("dcg")).join(relevant(spark, sf_dir), "qid")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / (F.log(i + 1.0) / F.log(F.lit(2.0))))
    q = q.withColumn("i", F.when(F.col("n") > 0, ideal))
    return q.agg(F.count("*").alias("n_queries"), R(F.avg(F.col("hit") / 10.0)).alias("precision"), R(F.avg(F.col("hit") / F.greatest("n", F.lit(1)))).alias("recall"), R(F.avg("rr")).alias("mrr"), R(F.avg(F.coalesce(F.col("dcg") / F.col("i"), F.lit(0.0)))).alias("ndcg"))


@query(f"with f as ({RANKED} select qid, vec_id from x where r < 10 and rel), h as ({SHORT} select qid, vec_id from x where r < 10) select count(*) as kept_of, round(sum((h.vec_id is not null)::int) / count(*), 6) as kept from f left join h using (qid, vec_id)")
def r12_student_teacher(spark, sf_dir):
    teacher = ranked(spark, sf_dir).where("rel").select("qid", "vec_id")
    student = ranked(spark, sf_dir, dims=16).select("qid", "vec_id", F.lit(1).alias("hit"))
    return teacher.join(student, ["qid", "vec_id"], "left").agg(F.count("*").alias("kept_of"), R(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("kept"))


@query(f"""{RANKED}, q as (select qid, max((rel and r < 1)::int) as h1, max((rel and r < 5)::int) as h5, max((rel and r < 10)::int) as h10 from x where r < 10 group by qid) select round(avg(h1), 6) as hit_1, round(avg(h5), 6) as hit_5, round(avg(h10), 6) as hit_10 from q""")
def r13_hits(spark, sf_dir):
    at = lambda k: F.max((F.col("rel") & (F.col("r") < k)).cast("int")).alias(f"h{k}")
    q = ranked(spark, sf_dir).groupBy("qid").agg(at(1), at(5), at(10))
    return q.agg(*[R(F.avg(f"h{k}")).alias(f"hit_{k}") for k in (1, 5, 10)])


@query("select s::int as step, round(case when s < 10 then 0.001 * (s + 1) / 10 else 0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(pi() * (s - 10) / 90.0)) end, 10) as rate from unnest(range(100)) as t(s)")
def r15_schedule(spark, sf_dir):
    return spark.createDataFrame([(s, round(x, 10)) for s, x in enumerate(routing.warmup_cosine(100, 10, 0.001, 0.00001))], "step int, rate double")


@query("select event_type as backend, count(*) as n, round(sum((value < 10)::int) / count(*), 6) as hit_rate, round(avg(value), 6) as mean_latency, round(avg(json_extract(props, '$.k')::double), 6) as mean_k from events group by 1")
def r16_operations(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("backend")).agg(F.count("*").alias("n"), R(F.sum((F.col("value") < 10).cast("long")) / F.count("*")).alias("hit_rate"), R(F.avg("value")).alias("mean_latency"), R(F.avg(F.get_json_object("props", "$.k").cast("double"))).alias("mean_k"))
