"""Queries of text search, fusion, graphs and hierarchical metadata."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph, knn, ordered, text
from ..session import load, written
from .registry import query
from .vector_queries import BASE, R, emb, first

TOK = "[a-záéíóúñü0-9]+"
ASKED = "(select text from benchmark order by item_id limit 1)"
BM = f"""with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOK}') as w from documents), st as (select count(*) as n, avg(len(w)) as avgdl from t),
    tf as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(w) as dl, unnest(w) as term from t) group by doc_id, dl, term), df as (select term, count(*) as df from tf group by term),
    q as (select term, count(*) as times from (select unnest(regexp_extract_all(lower({ASKED}), '{TOK}')) as term) group by term),
    bm as (select doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from tf join q using (term) join df using (term), st group by doc_id)"""
TOP20 = "b as (select doc_id, score, row_number() over (order by round(score, 9) desc, doc_id) - 1 as rank from bm order by rank limit 20)"
NEAR20 = "v as (select vec_id as doc_id, list_distance(list_transform(embedding, lambda x: x::double), q) as d, row_number() over (order by list_distance(list_transform(embedding, lambda x: x::double), q), vec_id) - 1 as rank from embeddings, (select list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id = 0) order by rank limit 20)"


def docs(spark, sf_dir):
    return load(spark, sf_dir, "documents")


def question(spark, sf_dir) -> str:
    rows = load(spark, sf_dir, "benchmark").orderBy("item_id").select("text").limit(1).collect()
    return (rows[0].text or "") if rows else ""


_INDEXES: dict[tuple, text.Index] = {}


def word_index(spark, sf_dir) -> text.Index:
    """The word index of the documents: built once for each state of their files, then read by every search of the session."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size, at = fs.getContentSummary(path), fs.getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, size.getLength(), size.getFileCount(), at)
    if key not in _INDEXES:
        _INDEXES[key] = text.build_index(docs(spark, sf_dir))
    return _INDEXES[key]


def word_hits(spark, sf_dir, k=20, **options):
    """The k best documents of the first benchmark item, with ranks from 0."""
    all_ = text.search_index(word_index(spark, sf_dir), question(spark, sf_dir), None, **options)
    top = all_.withColumn("r_", F.round("score", 9)).orderBy(F.desc("r_"), "doc_id").limit(k)
    return text.ranked(top, F.desc("r_"), "rank").drop("r_")


def vector_hits(spark, sf_dir, k=20):
    near = knn.knn(emb(spark, sf_dir), first(spark, sf_dir), k).withColumnRenamed("vec_id", "doc_id")
    return text.ranked(near, F.col("distance"), "rank")


@query(f"{BM}, {TOP20} select doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text[1:200], '')), '{TOK}')), (select list(term) from q)))::double / (select count(*) from q), 6) as rerank_score, row_number() over (order by round(len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text[1:200], '')), '{TOK}')), (select list(term) from q)))::double / (select count(*) from q), 6) desc, doc_id) - 1 as rank from b join documents using (doc_id) order by 3 limit 10")
def t23_title_rerank(spark, sf_dir):
    """The 20 best documents, ranked again by a scorer over their openings: the share of the question's words there."""
    words = sorted(set(text.re_tokens(question(spark, sf_dir))))
    hits = docs(spark, sf_dir).join(F.broadcast(word_hits(spark, sf_dir).select("doc_id")), "doc_id")
    found = F.size(F.array_intersect(F.array_distinct(text.tokens(F.substring("text", 1, 200))), F.array(*[F.lit(w) for w in words])))
    return text.rerank(hits, F.round(found / F.lit(float(max(1, len(words)))), 6), 10).select("doc_id", "rerank_score", "rank")


@query(f"select doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{TOK}'))::bigint as n_tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{TOK}')))::bigint as n_terms from documents")
def t01_tokens(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query(f"{BM} select term, df, (select sum(tf)::bigint from tf x where x.term = df.term) as total, round((select avgdl from st), 6) as avgdl from df")
def t02_bm25_index(spark, sf_dir):
    """One pass over the texts, then counts by term; the mean length follows from the index and the number of rows."""
    d = docs(spark, sf_dir)
    index = written(text.postings(d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), "index")
    n, total = d.count(), index.agg(F.sum("total")).first()[0]
    return index.withColumn("avgdl", F.lit(round((total or 0) / max(n, 1), 6)))


@query(f"{BM} select doc_id, round(score, 6) as score from bm order by round(score, 9) desc, doc_id limit 10")
def t03_bm25_search(spark, sf_dir):
    return word_hits(spark, sf_dir, 10).select("doc_id", R(F.col("score")).alias("score"))


@query(f"{BM} select doc_id, round(score, 6) as score from bm join documents using (doc_id) where lang = 'en' order by round(score, 9) desc, doc_id limit 10")
def t04_bm25_filtered(spark, sf_dir):
    return word_hits(spark, sf_dir, 10, allowed=docs(spark, sf_dir).where("lang = 'en'")).select("doc_id", R(F.col("score")).alias("score"))


@query(BM.replace("from documents)", "from documents where doc_id not in (select doc_id from labels where toxic = 1))", 1) + " select doc_id, round(score, 6) as score from bm order by round(score, 9) desc, doc_id limit 10")
def t05_bm25_removed(spark, sf_dir):
    gone = load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    top = text.search_index(word_index(spark, sf_dir), question(spark, sf_dir), None, removed=gone).withColumn("r_", F.round("score", 9)).orderBy(F.desc("r_"), "doc_id").limit(10)
    return top.select("doc_id", R(F.col("score")).alias("score"))


@query(f"{BM}, {TOP20}, {NEAR20} select doc_id, round(0.6 / (61 + coalesce(v.rank, 20)) + 0.4 / (61 + coalesce(b.rank, (select count(*) from b))), 8) as score from v full join b using (doc_id)")
def t06_hybrid_rrf(spark, sf_dir):
    return text.rrf(vector_hits(spark, sf_dir), word_hits(spark, sf_dir)).select("doc_id", F.round("score", 8).alias("score"))


@query(f"{BM}, {TOP20}, {NEAR20} select doc_id, round(0.6 * coalesce(1 - d, 0) + 0.4 * coalesce(score, 0), 6) as score from v full join b using (doc_id)")
def t07_hybrid_weighted(spark, sf_dir):
    a, b = vector_hits(spark, sf_dir).select("doc_id", "distance"), word_hits(spark, sf_dir).select("doc_id", "score")
    s = 0.6 * F.coalesce(1 - F.col("distance"), F.lit(0.0)) + 0.4 * F.coalesce("score", F.lit(0.0))
    return a.join(b, "doc_id", "full_outer").select("doc_id", R(s).alias("score"))


AGED = "exp(-0.693 * (epoch((select max(ts) from events)) - epoch(ts)) / (7 * 86400.0))"


@query(f"{BM}, {TOP20} select doc_id, round(score * {AGED.replace('epoch((select', 'epoch((select')}, 6) as score from b join events on event_id = doc_id")
def t08_decay_search(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    hits = word_hits(spark, sf_dir).join(e, "doc_id")
    age = F.floor(F.unix_micros(now) / 1) - F.floor(F.unix_micros(F.col("ts")) / 1)
    return hits.select("doc_id", R(F.col("score") * F.exp(-0.693 * (age / 1e6) / (7 * 86400.0))).alias("score"))


@query(f"select event_type, count(*) as n, sum(case when {AGED.replace('7 *', '1 *')} < 0.01 then 1 else 0 end)::bigint as evicted from events group by event_type")
def t09_decay_eviction(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    w = F.exp(-0.693 * ((F.unix_micros(now) - F.unix_micros(F.col("ts"))) / 1e6) / (1 * 86400.0))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((w < 0.01).cast("long")).alias("evicted"))


def category_sql(column: str) -> str:
    scores = {c: "(" + " + ".join(f"contains(lower({column}), '{w}')::int" for w in ws) + ")" for c, ws in text.CATEGORIES.items()}
    best = f"greatest({', '.join(scores.values())})"
    return f"case when {best} = 0 then null " + " ".join(f"when {s} = {best} then '{c}'" for c, s in scores.items()) + " end"


@query(f"select doc_id, {category_sql('text')} as category from documents")
def t10_category(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.category(F.col("text")).alias("category"))


@query(f"select coalesce({category_sql('text')}, 'none') as category, count(*) as n from conversations group by 1")
def t11_category_counts(spark, sf_dir):
    return load(spark, sf_dir, "conversations").groupBy(F.coalesce(text.category(F.col("text")), F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query("select count(*) as stored, sum((trim(coalesce(text, '')) <> '')::int)::bigint as live, count(distinct conv_id) as conversations, round(avg(length(text)), 4) as mean_length from conversations")
def t12_memory_stats(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    live = (F.trim(F.coalesce("text", F.lit(""))) != "").cast("long")
    return c.agg(F.count("*").alias("stored"), F.sum(live).alias("live"), F.countDistinct("conv_id").alias("conversations"), R(F.avg(F.length("text")), 4).alias("mean_length"))


def entities_sql(table: str, key: str) -> str:
    parts = " union all ".join(f"select {key}, '{k}' as kind, unnest(regexp_extract_all(coalesce({'html' if table == 'pages' else 'text'}, ''), '{p[1:-1]}')) as m from {table}" for k, p in text.ENTITIES)
    return f"select {key}, kind, lower(m) as entity, count(*) as n from ({parts}) group by all"


@query(entities_sql("documents", "doc_id"))
def t13_structural_entities(spark, sf_dir):
    return text.entities(docs(spark, sf_dir), "doc_id", "text")


def names(spark, sf_dir):
    """(doc_id, name, n, score) of capitalised names; score .8 and .1 more for each repeat, 1 at most."""

    def run(batches):
        for b in batches:
            rows = [(i, form, n, min(1.0, 0.8 + 0.1 * (n - 1))) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for form, n in text.names_in(t or "").values()]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["doc_id", "name", "n", "score"])

    return docs(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "doc_id long, name string, n long, score double")


@query()
def t14_capitalised_names(spark, sf_dir):
    return names(spark, sf_dir)


@query()
def t15_entities_by_type(spark, sf_dir):
    a = text.entities(docs(spark, sf_dir), "doc_id", "text").select("kind")
    b = names(spark, sf_dir).where("score >= 0.3").select(F.lit("proper_noun").alias("kind"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"))


CENTER = f"{BASE}, m as (select label, i, avg(v[i]) as x from (select label, v, unnest(range(1, 65)) as i from e) group by label, i), c as (select label, list(x order by i) as c from m group by label)"


@query(f"{CENTER}, s as (select vec_id, c.label, list_cosine_similarity(v, c) as s, row_number() over (partition by vec_id order by round(list_cosine_similarity(v, c), 9) desc, c.label) as r from e, c) select vec_id, label as cluster, round(least(1.0, 0.8 + case when s > 0.8 then 0.2 else 0 end), 6)::double as score from s where r = 1")
def t16_semantic_validation(spark, sf_dir):
    e = emb(spark, sf_dir)
    table = knn.center_table(knn.centroids(e, "label"))
    v = V.vec("embedding")
    best = F.array_min(F.transform(table, lambda c: F.struct((-F.round(V.cosine(v, c.center), 9)).alias("s"), c.cluster.alias("cluster"))))
    return e.select("vec_id", best.alias("b")).select("vec_id", F.col("b.cluster").alias("cluster"), R(F.least(F.lit(1.0), 0.8 + F.when(-F.col("b.s") > 0.8, 0.2).otherwise(0.0))).alias("score"))


def compressed(spark, sf_dir, packed=True, unpacked=True):
    """(doc_id, original, dense, packed, intact): bytes of each text, after semantic and, if ``packed``, after run-length compression; if ``unpacked``, whether it unpacks."""

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d = text.dense(t or "").encode()
                p = text.rle(d) if packed else None
                rows.append((i, len((t or "").encode()), len(d), len(p) if packed else None, text.unrle(p) == d if packed and unpacked else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "original", "dense", "packed", "intact"])

    return docs(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "doc_id long, original long, dense long, packed long, intact boolean")


@query()
def t17_semantic_compression(spark, sf_dir):
    return compressed(spark, sf_dir, packed=False).select("doc_id", "original", "dense")


@query("select doc_id, strlen(coalesce(text, ''))::bigint as original, true as intact from documents")
def t18_run_length(spark, sf_dir):
    return compressed(spark, sf_dir).select("doc_id", "original", "intact")


@query()
def t19_two_layer_ratios(spark, sf_dir):
    c = compressed(spark, sf_dir, unpacked=False)
    return c.select("doc_id", (F.col("original") / F.greatest("dense", F.lit(1))).alias("semantic_ratio"), (F.col("original") / F.greatest("packed", F.lit(1))).alias("total_ratio"))


WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
PASSAGES = f"w as (select doc_id, {WORDS} as w from documents), p as (select doc_id, unnest(range(0, greatest(len(w), 0), 150)) as i, w from w)"


@query(f"with {PASSAGES} select doc_id, (i // 150)::int as passage, len(array_to_string(w[i + 1:i + 200], ' '))::int as n_chars from p")
def t20_passages(spark, sf_dir):
    return text.passages(docs(spark, sf_dir)).select("doc_id", "passage", F.length("body").alias("n_chars"))


@query(f"""with {PASSAGES}, q as (select list_distinct(regexp_extract_all(lower({ASKED}), '{TOK}')) as q), s as (select doc_id, len(list_intersect(regexp_extract_all(lower(array_to_string(w[i + 1:i + 200], ' ')), '{TOK}'), q)) as s from p, q)
    select doc_id, max(s)::int as score from s group by doc_id""")
def t21_passage_retrieval(spark, sf_dir):
    import re

    asked = F.array(*[F.lit(w) for w in sorted(set(re.findall(text.TOKEN, question(spark, sf_dir).lower())))])
    p = text.passages(docs(spark, sf_dir))
    return p.select("doc_id", F.size(F.array_intersect(text.tokens(F.col("body")), asked)).alias("s")).groupBy("doc_id").agg(F.max("s").alias("score"))


@query(f"{BASE}, s as (select a.vec_id as qid, e.label, max(list_cosine_similarity(a.v, e.v)) as s from e a, e where a.vec_id % 20 = 0 group by a.vec_id, e.label) select label, round(avg(s), 6) as maxsim from s group by label")
def t22_maxsim(spark, sf_dir):
    e = emb(spark, sf_dir)
    near = knn.similarities(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), "label")
    return near.groupBy("label").agg(R(F.avg("similarity")).alias("maxsim"))


@query(f"{BM}, {TOP20}, {NEAR20} select doc_id, round(sum(1.0 / (61 + rank)), 8) as score from (select doc_id, rank from v union all select doc_id, rank from b) group by doc_id")
def t24_rrf_unweighted(spark, sf_dir):
    return text.rrf_sum([vector_hits(spark, sf_dir), word_hits(spark, sf_dir)]).select("doc_id", F.round("score", 8).alias("score"))


@query(f"""with q as (select list_distinct(regexp_extract_all({ASKED}, '[A-Z][a-z]+')) as q) select doc_id, round(least(0.05 * len(list_intersect(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+')), q)), 0.2), 6)::double as boost from documents, q""")
def t25_entity_boost(spark, sf_dir):
    import re

    q = sorted(set(re.findall("[A-Z][a-z]+", question(spark, sf_dir))))
    own = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Z][a-z]+)"), F.lit(1))
    asked = F.array(*[F.lit(w) for w in q]) if q else F.array().cast("array<string>")
    return docs(spark, sf_dir).select("doc_id", R(F.least(0.05 * F.size(F.array_intersect(own, asked)), F.lit(0.2))).alias("boost"))


CLEAN = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), ' +'), lambda x: x <> '')"


@query(f"""with p as (select conv_id, turn, {CLEAN.format("coalesce(text, '')")} as p, lead({CLEAN.format("coalesce(text, '')")}) over (partition by conv_id order by turn) as e from conversations), s as (select *, len(list_intersect(list_distinct(p), e)) as s from p where e is not null)
    select conv_id, turn, round(case when s = 0 then 0.0 else 2.0 * s / (len(p) + len(e)) end, 6) as f1 from s""")
def t26_answer_f1(spark, sf_dir):
    """Each turn against the next one of its conversation."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("e"))
    before = {"t": lambda w: F.first("e").over(w), "at": lambda w: F.first("turn").over(w), "k_": lambda w: F.count("*").over(w)}
    pairs = ordered.framed(c, "conv_id", ["turn"], 1, before).where("k_ = 2")
    return pairs.select("conv_id", F.col("at").alias("turn"), R(text.answer_f1(F.col("t"), F.col("e"))).alias("f1"))


@query()
def t27_extractive_answer(spark, sf_dir):
    """The sentence of each document with most words of the question, and its longest run of other words."""
    asked = set(text.re_tokens(question(spark, sf_dir)))

    def run(batches):
        import itertools
        import re

        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                best = max(re.split(r"(?<=[.!?])\s+", t or ""), key=lambda s: (len(asked & set(text.re_tokens(s))), -len(s)))
                runs = [" ".join(g) for new, g in itertools.groupby(text.re_tokens(best), lambda w: w not in asked) if new]
                out.append((best, max(runs, key=len, default="")))
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=["doc_id", "sentence", "answer"])

    return docs(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "doc_id long, sentence string, answer string")


# graphs -------------------------------------------------------------------------------------

EDGES = """g as (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem union all select 's' || s_suppkey, 'n' || s_nationkey from supplier union all
    select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"""


def edges(spark, sf_dir):
    """part -> supplier -> nation -> region and customer -> nation."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    arrow = lambda t, a, x, b, y: load(spark, sf_dir, t).select(name(a, x).alias("src"), name(b, y).alias("dst"))
    out = arrow("lineitem", "p", "l_partkey", "s", "l_suppkey").distinct()
    for e in (arrow("supplier", "s", "s_suppkey", "n", "s_nationkey"), arrow("customer", "c", "c_custkey", "n", "c_nationkey"), arrow("nation", "n", "n_nationkey", "r", "n_regionkey")):
        out = out.unionByName(e)
    return out


@query("""with n as (select c_custkey as node_id, 'Nation ' || c_nationkey as name from customer union all select s_suppkey + 1000000, 'NATION ' || s_nationkey from supplier)
    select lower(name) as entity, min(node_id)::bigint as node_id, count(*) as times from n group by 1""")
def g01_entity_deduplication(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("node_id"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("name"))
    b = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).cast("long").alias("node_id"), F.concat(F.lit("NATION "), F.col("s_nationkey").cast("string")).alias("name"))
    both = a.unionByName(b)
    times = both.groupBy(F.lower("name").alias("entity")).agg(F.count("*").alias("times"))
    return graph.deduplicated(both).select(F.lower("name").alias("entity"), "node_id").join(times, "entity")


@query("""select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer) or o_custkey % 7 = 0""")
def g01_relation_integrity(spark, sf_dir):
    """Relations whose end was removed: every seventh customer is gone."""
    nodes = load(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select("c_custkey")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(nodes, o.o_custkey == nodes.c_custkey, "left_anti")


@query(f"with {EDGES}, b as (select src as node, dst as other from g union select dst, src from g), d as (select src as node, count(*) as n from g group by src) select node, coalesce(max(d.n), 0) as out_degree, count(*) as n_neighbours from b left join d using (node) group by node")
def g02_degrees_and_neighbours(spark, sf_dir):
    e = edges(spark, sf_dir)
    near = graph.neighbours(e).groupBy("node").agg(F.count("*").alias("n_neighbours"))
    return near.join(graph.degrees(e).withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), "n_neighbours")


@query(f"with recursive {EDGES}, b as (select 'p1' as node, 0 as depth union select dst, depth + 1 from b join g on src = node where depth < 3) select node, min(depth)::int as depth from b group by node")
def g03_bfs(spark, sf_dir):
    return graph.bfs(edges(spark, sf_dir), spark.createDataFrame([("p1",)], "node string"), 3)


@query(f"{BASE} select vec_id, round(list_cosine_similarity(v, q), 6) as similarity from e, o where label % 2 = 0 order by round(list_cosine_similarity(v, q), 9) desc, vec_id limit 10")
def g04_entity_search(spark, sf_dir):
    s = F.round(V.cosine(V.vec("embedding"), knn.literal(first(spark, sf_dir))), 9)
    return emb(spark, sf_dir).where("label % 2 = 0").select("vec_id", s.alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", R(F.col("s")).alias("similarity"))


DEGREE = "d as (select l_partkey as vec_id, count(distinct l_suppkey) as deg from lineitem group by 1)"
ORDER9 = "order by round(list_cosine_similarity(v, q) + least(0.05 * coalesce(deg, 0), 0.2), 9) desc, vec_id"


def degree(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("vec_id")).agg(F.countDistinct("l_suppkey").alias("deg"))


@query(f"{BASE}, {DEGREE} select vec_id, round(list_cosine_similarity(v, q) + least(0.05 * coalesce(deg, 0), 0.2), 6) as score from e left join d using (vec_id), o {ORDER9} limit 10")
def g05_hybrid_graph_search(spark, sf_dir):
    s = V.cosine(V.vec("embedding"), knn.literal(first(spark, sf_dir))) + F.least(0.05 * F.coalesce("deg", F.lit(0)), F.lit(0.2))
    out = emb(spark, sf_dir).join(degree(spark, sf_dir), "vec_id", "left").select("vec_id", F.round(s, 9).alias("s"))
    return out.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", R(F.col("s")).alias("score"))


@query(f"with {EDGES} select kind, sum(n_nodes)::bigint as n_nodes, sum(n_edges)::bigint as n_edges from (select substr(node, 1, 1) as kind, count(distinct node) as n_nodes, 0 as n_edges from (select src as node from g union select dst from g) group by 1 union all select substr(src, 1, 1), 0, count(*) from g group by 1) group by kind")
def g06_graph_stats(spark, sf_dir):
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    a = nodes.groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n_nodes"))
    b = e.groupBy(F.substring("src", 1, 1).alias("kind")).agg(F.count("*").alias("n_edges"))
    return a.join(b, "kind", "full_outer").select("kind", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query("with p as (select distinct l_orderkey, l_suppkey from lineitem) select a.l_suppkey as a, b.l_suppkey as b, count(*) as n from p a join p b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by 1, 2")
def g07_cooccurrence(spark, sf_dir):
    return graph.cooccurrence(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


LINK = "pe as (select distinct l_partkey as vec_id, l_suppkey as s from lineitem where l_partkey in (select vec_id from embeddings))"
SEEDS = "seed as (select vec_id, list_cosine_similarity(v, q) as s from e, o order by round(list_cosine_similarity(v, q), 9) desc, vec_id limit 10)"
HOP2 = "hop as (select distinct b.vec_id from seed join pe a using (vec_id) join pe b on a.s = b.s)"


def part_links(spark, sf_dir):
    """(vec_id, s): the entities (suppliers) of each vector's part."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("vec_id"), F.col("l_suppkey").alias("s")).distinct()
    return rows.join(emb(spark, sf_dir).select("vec_id"), "vec_id", "left_semi")


def seeds(spark, sf_dir):
    s = V.cosine(V.vec("embedding"), knn.literal(first(spark, sf_dir)))
    return emb(spark, sf_dir).select("vec_id", s.alias("s0")).orderBy(F.desc(F.round("s0", 9)), "vec_id").limit(10)


@query(f"{BASE}, {DEGREE}, {LINK}, {SEEDS}, {HOP2} select vec_id, round(coalesce(s, 0.1 * least(0.05 * coalesce(deg, 0), 0.2)), 6) as score from hop full join seed using (vec_id) left join d using (vec_id)")
def g08_graph_augmented(spark, sf_dir):
    links, top = part_links(spark, sf_dir), seeds(spark, sf_dir)
    hop = top.select("vec_id").join(links, "vec_id").select("s").distinct().join(links, "s").select("vec_id").distinct()
    all_ = hop.join(top, "vec_id", "full_outer").join(degree(spark, sf_dir), "vec_id", "left")
    return all_.select("vec_id", R(F.coalesce("s0", 0.1 * F.least(0.05 * F.coalesce("deg", F.lit(0)), F.lit(0.2)))).alias("score"))


@query(f"""{BASE}, {LINK}, {SEEDS}, {HOP2}, m as (select i, avg(v[i]) as x from (select v, unnest(range(1, 65)) as i from e where vec_id in (select vec_id from hop)) group by i), q2 as (select list(0.7 * q[i] + 0.3 * x order by i) as q2 from m, o)
    select vec_id, round(list_cosine_similarity(v, q2), 6) as score from e, q2 order by round(list_cosine_similarity(v, q2), 9) desc, vec_id limit 10""")
def g09_query_expansion(spark, sf_dir):
    e, q, links = emb(spark, sf_dir), first(spark, sf_dir), part_links(spark, sf_dir)
    hop = seeds(spark, sf_dir).select("vec_id").join(links, "vec_id").select("s").distinct().join(links, "s").select("vec_id").distinct()
    each = e.join(hop, "vec_id", "left_semi").select(F.posexplode(V.vec("embedding")).alias("i", "x"))
    mean = {r.i: r.m for r in each.groupBy("i").agg(F.avg("x").alias("m")).collect()}  # one row for each component
    moved = knn.literal([0.7 * x + 0.3 * mean.get(i, x) for i, x in enumerate(q)])
    return e.select("vec_id", F.round(V.cosine(V.vec("embedding"), moved), 9).alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", R(F.col("s")).alias("score"))


@query(f"{BASE}, {LINK}, {SEEDS}, ent as (select distinct pe.s from seed join pe using (vec_id)), n as (select vec_id, count(*) as shared from pe join ent using (s) group by vec_id) select vec_id, shared, round(least(0.1 * shared, 0.5), 6)::double as graph_score, round(0.15 * shared + case when shared >= 2 then 0.3 else 0 end, 6)::double as entity_first from n")
def g10_shared_entities(spark, sf_dir):
    links = part_links(spark, sf_dir)
    ent = seeds(spark, sf_dir).select("vec_id").join(links, "vec_id").select("s").distinct()
    n = links.join(ent, "s").groupBy("vec_id").agg(F.count("*").alias("shared"))
    return n.select("vec_id", "shared", R(F.least(0.1 * F.col("shared"), F.lit(0.5))).alias("graph_score"), R(0.15 * F.col("shared") + F.when(F.col("shared") >= 2, 0.3).otherwise(0.0)).alias("entity_first"))


# hierarchical metadata: wing = source, room = lang, hall = length ----------------------------

HALL = "case when n_chars < 1000 then 'short' when n_chars < 5000 then 'medium' else 'long' end"
SPACE = f"s as (select doc_id, text, coalesce(source, '') as wing, coalesce(lang, '') as room, {HALL} as hall from documents)"


def space(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "text", F.coalesce("source", F.lit("")).alias("wing"), F.coalesce("lang", F.lit("")).alias("room"), F.expr(HALL).alias("hall"))


@query(f"with {SPACE} select wing, room, count(*) as n_docs from s group by wing, room")
def p01_rooms(spark, sf_dir):
    return space(spark, sf_dir).groupBy("wing", "room").agg(F.count("*").alias("n_docs"))


@query(f"with {SPACE} select doc_id from s where room = 'en' and hall = 'medium'")
def p02_filter(spark, sf_dir):
    return text.where_all(space(spark, sf_dir), wing=None, room="en", hall="medium").select("doc_id")


@query(f"with {SPACE}, r as (select distinct wing, room from s) select room, a.wing as wing_a, b.wing as wing_b from r a join r b using (room) where a.wing < b.wing")
def p03_tunnels(spark, sf_dir):
    r = space(spark, sf_dir).select("wing", "room").distinct()
    a, b = r.withColumnRenamed("wing", "wing_a"), r.withColumnRenamed("wing", "wing_b")
    return a.join(b, "room").where("wing_a < wing_b")


@query(f"with {SPACE} select wing, count(distinct room) as n_rooms, count(distinct hall) as n_halls, count(*) as n_docs from s group by wing")
def p04_listing(spark, sf_dir):
    return space(spark, sf_dir).groupBy("wing").agg(F.countDistinct("room").alias("n_rooms"), F.countDistinct("hall").alias("n_halls"), F.count("*").alias("n_docs"))


@query(f"""with {SPACE}, t as (select wing, room, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as w from s), c as (select wing, room, w, count(*) as n from t where length(w) >= 3 and w not in ({", ".join(f"'{w}'" for w in text.LABEL_STOP)}) group by all),
    r as (select *, row_number() over (partition by wing, room order by n desc, w) as i from c) select wing, room, w as label, n from r where i = 1""")
def p05_room_labels(spark, sf_dir):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    t = space(spark, sf_dir).select("wing", "room", F.explode(words).alias("w")).where(F.length("w") >= 3).where(~F.col("w").isin(text.LABEL_STOP))
    n = t.groupBy("wing", "room", "w").agg(F.count("*").alias("n"))
    best = n.groupBy("wing", "room").agg(F.min(F.struct((-F.col("n")).alias("m"), "w")).alias("b"))
    return best.select("wing", "room", F.col("b.w").alias("label"), (-F.col("b.m")).alias("n"))


@query(f"{BASE}, {SPACE} select vec_id, round(list_distance(v, q), 6) as distance from e join s on doc_id = vec_id, o where room = 'en' order by list_distance(v, q), vec_id limit 10")
def p06_spatial_search(spark, sf_dir):
    allowed = text.where_all(space(spark, sf_dir), room="en").select(F.col("doc_id").alias("vec_id"))
    return knn.knn_filtered(emb(spark, sf_dir), allowed, first(spark, sf_dir), 10).select("vec_id", R(F.col("distance")).alias("distance"))


@query(f"with {SPACE}, r as (select distinct wing, room from s), t as (select distinct a.wing, room from r a join r b using (room) where a.wing <> b.wing) select wing, array_to_string(list_sort(list(distinct room)), ',') as rooms, array_to_string(list_sort(list(distinct hall)), ',') as halls, (select count(*) from t where t.wing = s.wing) as n_tunnel_rooms from s group by wing")
def p07_overview(spark, sf_dir):
    s = space(spark, sf_dir)
    shared = s.select("wing", "room").distinct().groupBy("room").agg(F.count("*").alias("n")).where("n > 1").select("room")
    tunnels = s.select("wing", "room").distinct().join(shared, "room").groupBy("wing").agg(F.count("*").alias("n_tunnel_rooms"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return s.groupBy("wing").agg(listed("room").alias("rooms"), listed("hall").alias("halls")).join(tunnels, "wing", "left").withColumn("n_tunnel_rooms", F.coalesce("n_tunnel_rooms", F.lit(0)))


@query(f"""{BASE}, d as (select a.vec_id as qid, a.label as kind, e.vec_id, (e.label = a.label)::int as hit, row_number() over (partition by a.vec_id order by list_distance(e.v, a.v), e.vec_id) as r from e, e a where a.vec_id % 20 = 0 and e.vec_id <> a.vec_id),
    h as (select qid, kind, max(case when r <= 1 then hit else 0 end) as h1, max(case when r <= 3 then hit else 0 end) as h3, max(case when r <= 5 then hit else 0 end) as h5, max(case when r <= 10 then hit else 0 end) as h10 from d group by qid, kind)
    select kind, count(*) as n, round(avg(h1), 6) as recall_1, round(avg(h3), 6) as recall_3, round(avg(h5), 6) as recall_5, round(avg(h10), 6) as recall_10 from h group by kind""")
def p08_session_recall(spark, sf_dir):
    e = emb(spark, sf_dir)
    q = e.where("vec_id % 20 = 0")
    near = knn.knn_batch(e, q.select(F.col("vec_id").alias("qid"), "embedding"), 11).where("qid <> vec_id")
    w = Window.partitionBy("qid").orderBy("rank")
    hits = near.withColumn("r", F.row_number().over(w)).join(e.select("vec_id", "label"), "vec_id").join(q.select(F.col("vec_id").alias("qid"), F.col("label").alias("kind")), "qid")
    at = lambda k: F.max(F.when((F.col("r") <= k) & (F.col("label") == F.col("kind")), 1).otherwise(0)).alias(f"h{k}")
    per = hits.groupBy("qid", "kind").agg(*[at(k) for k in (1, 3, 5, 10)])
    return per.groupBy("kind").agg(F.count("*").alias("n"), *[R(F.avg(f"h{k}")).alias(f"recall_{k}") for k in (1, 3, 5, 10)])
