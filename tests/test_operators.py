"""Operators on small fixtures: worked-out answers, empty tables, ties, odd vectors, errors."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import sketches
from lodestar.functions import vectors as V
from lodestar.operators import energy, graph, graph_index, knn, routing, store, text
from lodestar.sources import binary_vectors


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(i % 5), float(i // 5)], i % 3) for i in range(25)] + [(99, [0.0, 0.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_distances(spark):
    assert one(spark, V.l2(arr(0, 0), arr(3, 4)), V.l2_squared(arr(0, 0), arr(3, 4))) == (5.0, 25.0)
    assert one(spark, V.cosine(arr(0, 0), arr(1, 1)), energy.geometric_energy(arr(2, 0, 0))) == (0.0, 1.0)
    assert one(spark, V.finite(arr(1, float("nan"))), V.finite(arr(1, float("inf"))), V.finite(arr(1, 2))) == (False, False, True)
    (x,) = one(spark, V.exp_map(arr(1, 0), V.log_map(arr(1, 0), arr(0, 1))))
    assert x == pytest.approx([0, 1], abs=1e-6)


def test_knn_edges(spark, vectors):
    assert [r.vec_id for r in knn.knn(vectors, [0, 0], 3).collect()] == [0, 99, 1]  # ties by id
    assert knn.knn(vectors, [0, 0], 100).count() == 26
    assert knn.knn(vectors.where("false"), [0, 0], 5).count() == 0
    for bad in (([0, 0], 0), ([0.0], 1), ([math.nan, 0], 1)):
        with pytest.raises(ValueError):
            knn.validated(*bad, dim=2)
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [4.0, 4.0])], "qid long, embedding array<float>")
    got = [(r.qid, r.vec_id) for r in knn.knn_batch(vectors, q, 2, block=1).orderBy("qid", "rank").collect()]
    assert got == [(1, 0), (1, 99), (2, 24), (2, 19)]
    assert knn.knn_batch(vectors, q.where("false"), 2).count() == 0


def test_graph_index(spark):
    x = np.random.default_rng(0).standard_normal((600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    index = graph_index.build(df, max_part=250)  # several parts
    assert index.count() == 600 and graph_index.broken(index).count() == 0
    r = knn.recall(graph_index.search(index, q, 10), knn.knn_batch(df, q, 10), 10).first()
    assert r.n_queries == 30 and r.recall >= 0.95


def test_compression_of_odd_letters():
    """Letters that only fold to those of a word start no short form, and are kept; runs unpack at once, whatever they hold."""
    assert text.dense("plea\u017fe wait. \u0131nformation. than\u212a You") == "plea\u017fe wait. \u0131nformation. thx"
    assert text.dense("PLEASE, xplease please_ pleased \u212aplease") == "Plz, xplease plz_ pleased \u212aplease"
    data = b"\n\n\n\n\n\xff\xff\xff\xffab" + b"c" * 600
    assert text.unrle(text.rle(data)) == data and isinstance(text.unrle(text.rle(b"")), bytes)


def test_cooccurrence_tasks_stay_small(spark, monkeypatch):
    """Pairs are dealt into more tasks where there are more, and equal those by hand, with repeats and nulls."""
    from collections import Counter
    from itertools import combinations

    monkeypatch.setattr(graph, "ROWS", 50)
    monkeypatch.setattr(graph, "PAIRS", 100)
    rows = [(i % 60, f"e{i * i % 37}") for i in range(500)] + [(None, "e1"), (None, "e2"), (3, None), (3, "e0"), (3, "e0")]
    out = graph.cooccurrence(spark.createDataFrame(rows, "d long, e string"), "d", "e")
    sets = {}
    for d, e in rows:
        if d is not None and e is not None:
            sets.setdefault(d, set()).add(e)
    want = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    assert {(r.a, r.b): r.n for r in out.collect()} == want
    assert out.rdd.getNumPartitions() == max(4, -(-sum(want.values()) // 100)) > 4


def test_batch_passes_on_k_rows(spark):
    """A task passes on k rows for each query, also of many Arrow batches and of equal vectors; ties go by key."""
    rows = spark.range(3000, numPartitions=1).select((2999 - F.col("id")).alias("vec_id"), F.array((F.col("id") % 3).cast("float")).alias("embedding"))
    q = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "qid long, embedding array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = knn.knn_batch(rows, q, 4)
        got = sorted((r.qid, r["rank"], r.vec_id, r.distance) for r in found.collect())
        best = knn.Best(2, 4)
        for lo in range(0, 3000, 100):
            keys = 2999 - np.arange(lo, lo + 100)
            best.add(keys, np.abs(np.array([[0.0], [5.0]]) - (np.arange(lo, lo + 100) % 3)[None]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(1, i + 1, 3 * i + 2, 0.0) for i in range(4)] + [(2, i + 1, 3 * i, 3.0) for i in range(4)]
    assert [x.tolist() for x in best.rows()] == [[0] * 4 + [1] * 4, [2, 5, 8, 11, 0, 3, 6, 9], [0.0] * 4 + [3.0] * 4]


def test_graph_parts_stay_small(spark):
    """One graph of 8,500 rows would be found through a walk of the same width as one of 100; it is dealt into parts instead."""
    df = spark.range(8500).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2), F.rand(3)).cast("array<float>").alias("embedding"))
    sizes = [r["count"] for r in graph_index.build(df).groupBy("part").count().collect()]
    assert sum(sizes) == 8500 and max(sizes) < 4500


def test_query_blocks(spark):
    """Any number of queries is taken, in blocks, with the results of one block."""
    x = np.random.default_rng(2).standard_normal((4200, 4))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    q = df.withColumnRenamed("vec_id", "qid").select("qid", "embedding")
    few, base = q.where("qid < 40"), df.where("vec_id < 200")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(knn.all_similarities(base, few, block=7)) == rows(knn.all_similarities(base, few))
    assert rows(knn.similarities(base, few, "label", block=7)) == rows(knn.similarities(base, few, "label"))
    index = graph_index.build(base)
    assert rows(graph_index.search(index, few, 5, block=7)) == rows(graph_index.search(index, few, 5))
    small = df.where("vec_id < 30")
    assert knn.all_similarities(small, q).count() == 4200 * 30 and knn.similarities(small, q, "label").count() == 4200 * 3
    assert graph_index.search(graph_index.build(small), q, 3).count() == 4200 * 3
    assert knn.all_similarities(small, q.where("false")).count() == 0


def test_lsh_recall(spark):
    """Recall at 10 is 0.9 or more on vectors without clusters, and no query has fewer than k rows."""
    x = np.random.default_rng(3).standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    r = knn.recall(knn.lsh_search(df, q, 10), knn.knn_batch(df, q, 10), 10).first()
    assert r.n_queries == 100 and r.recall >= 0.9
    few, one = df.where("vec_id < 12"), q.where("qid < 60")
    got = knn.lsh_search(few, one, 10, tables=1, flips=0)  # hardly any candidates
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn.knn_batch(few, one, 10).collect()))
    assert knn.lsh_search(few, one, 20).count() == 3 * 12 and knn.lsh_search(few, one.where("false"), 5).count() == 0


def test_energy(spark):
    none = spark.createDataFrame([], "cluster int, mu array<double>, alpha double, kappa double")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r.energy for r in energy.splat_energy(v, none).collect()} == {10.0}
    mix = spark.createDataFrame([(0, [1.0, 0.0], 1.0, 5.0)], none.schema)
    got = {r.vec_id: r.energy for r in energy.splat_energy(v, mix).collect()}
    assert got[1] == pytest.approx(0) and got[2] == pytest.approx(5)
    assert one(spark, energy.confidence(F.lit(0.0)), energy.zone(F.lit(0.0)), energy.zone(F.lit(0.5)), energy.zone(F.lit(2.0))) == (1.0, "high_confidence", "moderate", "uncertain")
    same = spark.createDataFrame([(i, 2.0) for i in range(4)], "i int, kappa double")
    assert store.entropy(same, "kappa").first()[0] == pytest.approx(1.0)


def test_merges(spark):
    hits = spark.createDataFrame([("e1", 1, 0, 0.5), ("e1", 2, 1, 0.6), ("e2", 2, 0, 0.55), ("e2", 3, 1, 0.7)], "shard string, vec_id long, rank long, distance double")
    top = routing.merge_rrf(hits).orderBy(F.desc("score")).first()
    assert (top.vec_id, top.distance) == (2, 0.55) and top.score == pytest.approx(1 / 62 + 1 / 61)
    best = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.95), (1, 0.85)], "vec_id long, distance double")
    assert [tuple(r) for r in routing.merge_best(best, 3).collect()] == [(2, 0.8), (1, 0.85), (3, 0.95)]


def test_bm25(spark):
    d = spark.createDataFrame([("a", "hello world")], "doc_id string, text string")
    assert text.bm25(d, "hello hello").first().score == pytest.approx(2 * math.log(4 / 3))
    assert text.bm25(d, "").count() == 0 and text.bm25(d.where("false"), "hello").count() == 0
    d = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", None)], "doc_id string, text string")
    assert [r.doc_id for r in text.bm25(d, "x", 2).collect()] == ["a", "b"]  # a tie goes by id
    acc = spark.createDataFrame([("Áéñ 12",)], "t string").select(text.tokens(F.col("t"))).first()[0]
    assert acc == ["áéñ", "12"]


def test_categories(spark):
    rows = spark.createDataFrame([("We decided to use it",), ("There is a bug in the code",), ("random text xyz",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.category(F.col("t"))).collect()] == ["decision", "error", None, None]


def test_bfs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    got = {r.node: r.depth for r in graph.bfs(edges, spark.createDataFrame([(1,)], "node int"), 3).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_store(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 5)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 5), (1, "old", -1), (3, "d", 1)], "id int, v string, at int")
    assert sorted((r.id, r.v) for r in store.upsert(base, new, "id", "at").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    rows, fits = store.append(base, new, 4)
    assert not fits and rows.count() == 2
    assert store.tiers(base.where("false"), F.col("at"), "id").count() == 0


def test_ordered_windows(spark):
    """Blocks of three rows give the frames of whole groups."""
    from pyspark.sql import Window

    from lodestar.operators import ordered

    rows = spark.createDataFrame([("a" if i % 4 else "b", i, float(i * 7 % 5)) for i in range(40)] + [(None, 99, 1.0), (None, 98, 2.0)], "g string, i long, x double")
    number = ordered.numbered(rows.select("g", "i"), ["g", "i"], "n").orderBy("n").collect()
    assert [r.n for r in number] == list(range(1, 43)) and [(r.g or "", r.i) for r in number] == sorted((r.g or "", r.i) for r in number)
    w = Window.partitionBy("g").orderBy("i")
    want = {(r.g, r.i): tuple(r)[3:] for r in rows.select("*", F.sum("x").over(w.rowsBetween(-2, 0)), F.avg("x").over(w.rowsBetween(-2, -1)), F.sum("x").over(w), F.row_number().over(w), F.count("*").over(Window.partitionBy("g"))).collect()}
    at = lambda r: want[r.g, r.i]
    assert all(r.s == at(r)[0] for r in ordered.framed(rows, "g", ["i"], 2, {"s": lambda w: F.sum("x").over(w)}, block=3).collect())
    assert all(r.s == at(r)[1] for r in ordered.framed(rows, "g", ["i"], 2, {"s": lambda w: F.avg("x").over(w)}, until=-1, block=4).collect())
    assert all(r.s == at(r)[2] for r in ordered.running(rows, "g", ["i"], {"s": F.col("x")}).collect())
    assert all((r.i_, r.n_) == at(r)[3:] for r in ordered.placed(rows, "g", ["i"]).collect())
    assert ordered.framed(rows.where("false"), "g", ["i"], 2, {"s": lambda w: F.sum("x").over(w)}).count() == 0


def test_result_cache():
    now = [0.0]
    cache = routing.ResultCache(capacity=1, ttl=10, clock=lambda: now[0])
    assert [cache.get_or_run("a", lambda: 1), cache.get_or_run("a", lambda: 2)] == [1, 1]
    now[0] = 11.0
    assert cache.get_or_run("a", lambda: 3) == 3 and cache.get_or_run("b", lambda: 4) == 4 and cache.get_or_run("a", lambda: 5) == 5
    assert (cache.hits, cache.misses) == (1, 4)


def test_planner():
    assert [routing.index_for(n) for n in (14_999, 15_000, 100_000)] == ["bruteforce", "hrm2", "hnsw"]
    assert [routing.strategy(*x) for x in ((500, 10), (3000, 10), (3000, 50), (2000, 5, 8), (10, 5, 8))] == ["exact", "exact", "hrm2", "hrm2", "batch"]


@given(st.lists(st.sampled_from([0, 97, 255]), max_size=700).map(bytes) | st.binary(max_size=300))
def test_run_lengths(data):
    assert text.unrle(text.rle(data)) == data


def test_run_length_bytes():
    assert text.rle(b"aaaa") == bytes.fromhex("04000000ff6104") and text.rle(b"\xff") == bytes.fromhex("01000000ffff01")
    with pytest.raises(ValueError):
        text.unrle(bytes.fromhex("05000000ff6104"))


def test_dense_text():
    assert text.dense("The configuration of the database.  Please wait. please wait. Information") == "The config db. Plz wait. Info"
    assert text.dense("fast code. slow code. Fast code. end") == "fast code. slow code. end" and text.dense("") == ""


def test_names():
    assert text.names_in("Ministerio de Hacienda met Ana and The Ministerio de Hacienda") == {"ministerio de hacienda": ("Ministerio de Hacienda", 2), "ana": ("Ana", 1)}
    assert text.names_in("nothing here") == {}


def test_sketches():
    turn = sketches.rotation(16)
    assert np.abs(turn @ turn.T - np.eye(16)).max() < 1e-10
    x = np.random.default_rng(2).standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    est = sketches.sign_inner_product(sketches.sign_sketch(x, 4096), np.linalg.norm(x, axis=1), x[0])
    assert np.abs(est - x @ x[0]).max() < 0.1
    ip, d = sketches.two_stage(x, x[0], bits=8, m=256)
    assert np.abs(ip - x @ x[0]).max() < 0.05 and np.abs(d - np.linalg.norm(x - x[0], axis=1))[1:].max() < 0.1
    r, code = sketches.polar(x, 12)
    assert np.abs(sketches.unpolar(r, code, 12) - x).max() < 0.01
    assert sketches.fnv1a(b"") == 0xCBF29CE484222325 and sketches.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_binary_files(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(10)], "vec_id long, embedding array<float>")
    at = f"file://{tmp_path}/v"
    assert binary_vectors.write_vectors(df, at, files=3).agg(F.sum("n_rows")).first()[0] == 10
    got = {r.vec_id: list(r.embedding) for r in binary_vectors.read_vectors(spark, at).collect()}
    assert got == {i: [float(i), 0.5] for i in range(10)}
    for bad in (b"", b"\0" * 15, b"\xff" * 16, binary_vectors.encode_vectors(np.ones((2, 2)))[:-1]):
        with pytest.raises(ValueError):
            binary_vectors.decode_vectors(bad)
    for name in ("a/b", "..", "", "x\0"):
        with pytest.raises(ValueError):
            binary_vectors.safe_name(name)


def test_without_the_text_operators():
    """The entry module and the catalogue work where the optional parts are gone."""
    import builtins
    import importlib
    import sys

    import __spark_entry__

    real = builtins.__import__

    def blocked(name, *a, **k):
        if name == "corpus_pipeline" or name.endswith(".llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    sys.modules.pop("corpus_pipeline", None)
    builtins.__import__ = blocked
    try:
        entry = importlib.reload(__spark_entry__)
        assert entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    finally:
        builtins.__import__ = real
        importlib.reload(__spark_entry__)


def test_engine(spark, vectors):
    from lodestar.engine import Engine

    docs = spark.createDataFrame([(i, f"word{i % 4} text") for i in range(25)], "doc_id long, text string")
    e = Engine(vectors, docs, "simple").build_index()
    assert [r.vec_id for r in e.search([4, 4], 2).collect()] == [24, 19]
    assert [r.vec_id for r in e.search([4, 4], 1, F.col("label") == 1).collect()] == [19]
    q = spark.createDataFrame([(7, [4.0, 4.0])], "qid long, embedding array<float>")
    assert e.search_batch(q, 1, approximate=True).first().vec_id == e.search_batch(q, 1).first().vec_id == 24
    assert e.search_hybrid([4, 4], "word0", 3).count() == 3
    assert e.search_cached([0, 0], 1) == e.search_cached([0, 0], 1) and e.cache.hits == 1
    e.remove(spark.createDataFrame([(24,)], "vec_id long"))
    assert e.search([4, 4], 1).first().vec_id == 19 and e.stats()["n_vectors"] == 25 and e.stats()["n_documents"] == 24
    e.add(spark.createDataFrame([(19, [9.0, 9.0], 1)], vectors.schema))
    assert e.search([9, 9], 1).first().vec_id == 19 and e.vectors.count() == 25
    assert e.confidence().count() == 25


def test_odd_vectors(spark):
    """Null vectors and other dimensions get null; ties go to the smaller cluster."""
    from lodestar.operators import clustering

    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    centers = spark.createDataFrame([(5, [0.0, 1.0]), (3, [0.0, -1.0])], "cluster int, center array<double>")
    got = {r.vec_id: (r.cluster, r.distance) for r in clustering.assign(df, centers).collect()}
    assert got == {1: (5, 0.0), 2: (None, None), 3: (None, None), 4: (3, 1.0)}
    mix = spark.createDataFrame([(0, [0.0, 1.0], 1.0, 1.0)], "cluster int, mu array<double>, alpha double, kappa double")
    assert {r.vec_id: r.energy is None for r in energy.splat_energy(df, mix).collect()} == {1: False, 2: True, 3: True, 4: False}
    step = {r.cluster: (list(r.center), r.n) for r in clustering.lloyd_step(df, centers).collect()}
    assert step == {5: ([0.0, 1.0], 1), 3: ([0.0, 0.0], 1)}


def test_clusterings(spark):
    """Four well-separated groups are found by every method, and every row is assigned."""
    from lodestar.operators import clustering

    rng = np.random.default_rng(4)
    x = np.repeat([[0, 0], [10, 0], [0, 10], [10, 10]], 50, axis=0) + rng.uniform(-0.5, 0.5, (200, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")

    def pure(rows, c="cluster"):
        found = {r.vec_id: r[c] for r in rows.collect()}
        assert len(found) == 200
        return len({(i // 50, c) for i, c in found.items()}) == len(set(found.values())) == 4

    assert pure(clustering.assign(df, clustering.seeded(df, 4)))
    assert pure(clustering.map_reduce(df, 4))
    assert pure(clustering.leaders(df, 3.0))
    both = clustering.two_level(df, 4, 3).cache()
    assert pure(both, "coarse_id") and both.select("fine_id").distinct().count() == 3
    with pytest.raises(ValueError):
        clustering.leaders(df, 0.001, most=10)


def test_partial_centers(spark):
    """More partial leaders and centers than are merged at once: all of them enter the result."""
    from lodestar.operators import clustering

    rng = np.random.default_rng(4)
    x = np.repeat([[0, 0], [10, 0], [0, 10], [10, 10]], 100, axis=0) + rng.uniform(-0.5, 0.5, (400, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8, "vec_id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for out in (clustering.leaders(df, 3.0, most=20), clustering.map_reduce(df, 4, most=40)):
            found = {r.vec_id: r.cluster for r in out.collect()}
            assert len(found) == 400 and len({(i // 100, c) for i, c in found.items()}) == len(set(found.values())) == 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = spark.createDataFrame([([float(i % 4), 0.0], 1.0 + i) for i in range(300)], "center array<double>, n double")
    same = lambda x, n: (np.unique(x, axis=0), np.array([n[(x == u).all(1)].sum() for u in np.unique(x, axis=0)]))
    got = clustering.merged_levels(rows, same, 20).collect()
    assert len(got) <= 20 and sum(r.n for r in got) == sum(1.0 + i for i in range(300))


def test_rare_cluster(spark):
    """Two rows of 8,000, outside any bounded sample, have a center of their own."""
    from lodestar.operators import clustering

    far = F.col("id").isin(17, 4321)
    df = spark.range(8000).select(F.col("id").alias("vec_id"), F.when(far, F.array(F.lit(90.0), F.lit(90.0))).otherwise(F.array(F.rand(1), F.rand(2))).cast("array<float>").alias("embedding")).cache()
    assert not (clustering._sample(df, 2 * clustering.SAMPLE_PER_CENTER, "embedding", "vec_id") > 50).any()
    rows = clustering.assign(df, clustering.seeded(df, 2)).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in rows) == [2, 7998]
    centers = clustering.seeded(df, 2)
    step = {r.cluster: r.center for r in clustering.lloyd_step(df, centers).collect()}
    assert all(np.allclose(step[r.cluster], r.center, atol=1e-5) for r in centers.collect())


def test_exploration(spark):
    mix = spark.createDataFrame([(0, [0.0, 0.0], 0.9, 1.0), (1, [1.0, 0.0], 0.05, 1.0), (2, [5.0, 5.0], 0.05, 1.0)], "cluster int, mu array<double>, alpha double, kappa double")
    rows = energy.avalanche(mix).collect()
    assert sum(r.energy for r in rows) == pytest.approx(1.0) and {r.cluster for r in rows if r.step == 0} == {0}
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(12)], "vec_id long, embedding array<float>")
    found = energy.regions(v, mix, 3).collect()
    assert 1 <= len(found) <= 3 and [r.energy for r in found] == sorted((r.energy for r in found), reverse=True)
    scored = energy.splat_energy(v, mix)
    drawn = energy.boltzmann(scored, "energy", 5).collect()
    assert len({r.vec_id for r in drawn}) == 5 and energy.boltzmann(scored, "energy", 50).count() == 12


def test_multi_probe():
    x = np.random.default_rng(1).standard_normal((20, 8))
    own = sketches.cross_polytope(x, 2)
    for row, probes in zip(own.tolist(), sketches.multi_probe(x, 2, top=3, n=6)):
        assert probes[0] == row and len(probes) == 6 and len({tuple(p) for p in probes}) == 6


def odd_vectors(spark):
    """Forty good vectors of two components, and rows with null, short, long and not finite ones."""
    good = [(i, [float(i % 8), float(i // 8)]) for i in range(40)]
    bad = [(100, None), (101, [1.0]), (102, [1.0, 2.0, 3.0]), (103, [None, 1.0]), (104, [float("nan"), 1.0]), (105, [float("inf"), 0.0]), (106, [])]
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    return make(good + bad), make(good)


def test_odd_vectors_change_nothing(spark):
    """Rows without a usable vector are no neighbour of anything; all others have the result they have without them."""
    from lodestar.operators import clustering

    both, good = odd_vectors(spark)
    q = good.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    searches = {
        "knn": lambda t: knn.knn(t, [1.0, 2.0], 50),
        "cosine": lambda t: knn.knn(t, [1.0, 2.0], 50, "cosine"),
        "batch": lambda t: knn.knn_batch(t, q, 100),
        "lsh": lambda t: knn.lsh_search(t, q, 3),
        "buckets": lambda t: knn.sign_buckets(t, 2, 3),
        "group": lambda t: knn.similarities(t, q, "label"),
        "all": lambda t: knn.all_similarities(t, q),
        "graph": lambda t: graph_index.search(graph_index.build(t), q, 3),
        "packed": lambda t: graph_index.search(graph_index.packed(graph_index.build(t)), q, 3),
    }
    for name, f in searches.items():
        assert rows(f(both)) == rows(f(good)), name
    assert rows(searches["graph"](good)) == rows(searches["packed"](good))
    assert knn.knn(both, [1.0, 2.0], 50).count() == 40
    for name, f in {"map_reduce": lambda t: clustering.map_reduce(t, 3), "leaders": lambda t: clustering.leaders(t, 2.0), "two_level": lambda t: clustering.two_level(t, 2, 2)}.items():
        got = {r.vec_id: tuple(r)[1:] for r in f(both).collect()}
        assert {i for i, x in got.items() if x[0] is None} == {r.vec_id for r in both.where("vec_id >= 100").collect()}, name
    assert clustering.map_reduce(good, 3).where("cluster is null").count() == 0
    for wrong in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, None)], [(1, [float("nan"), 0.0])]):
        with pytest.raises(ValueError):
            knn.knn_batch(good, spark.createDataFrame(wrong, "qid long, embedding array<float>"), 3)


def test_removed_keys_of_an_index(spark):
    """A walk that meets only removed keys falls back to the rows that are left."""
    _, good = odd_vectors(spark)
    q = good.where("vec_id = 0").select(F.col("vec_id").alias("qid"), "embedding")
    index = graph_index.packed(graph_index.build(good))
    gone = good.where("vec_id < 35").select("vec_id")
    got = [r.vec_id for r in graph_index.search_live(index, gone, good, q, 3).orderBy("rank").collect()]
    assert got == [r.vec_id for r in knn.knn_batch(good.where("vec_id >= 35"), q, 3).orderBy("rank").collect()]


def test_word_index(spark):
    """Searches of a written index equal searches of the texts, with removed and allowed documents too."""
    rows = [(1, "hello world"), (2, "hello hello there"), (3, None), (4, ""), (5, "the world is wide wide wide"), (6, "hello " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = text.build_index(docs)
    same = lambda a, b: [(r.doc_id, round(r.score, 9)) for r in a.collect()] == [(r.doc_id, round(r.score, 9)) for r in b.collect()]
    for query in ("hello", "hello hello wide", "nothing here", "", "WORLD"):
        assert same(text.search_index(index, query), text.bm25(docs, query)), query
    gone = docs.where("doc_id = 6").select("doc_id")
    assert same(text.search_index(index, "hello wide", removed=gone), text.bm25(docs.where("doc_id <> 6"), "hello wide"))
    few = docs.where("doc_id in (1, 5)").select("doc_id")
    assert same(text.search_index(index, "hello wide", allowed=few), text.bm25(docs, "hello wide", allowed=few))
    plan = index.postings.where("folder = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan
    assert {(r.doc_id, r.term, r.tf) for r in text.postings(docs).collect()} >= {(2, "hello", 2), (5, "wide", 3), (6, "hello", 500)}


def test_word_index_keeps_lists(spark):
    """Postings are listed by term where the texts are: rows that are shuffled and written go by terms and batches, not by words of documents."""
    docs = spark.createDataFrame([(i % 299, " ".join(f"w{j}" for j in range(i % 40 + 1)) + " w0") for i in range(300)] + [(-1, None)], "doc_id long, text string").repartition(2)
    index = text.build_index(docs)
    assert index.postings.count() <= 2 * 41 and index.n == 301 and index.lengths.count() == 301
    want = {tuple(r) for r in text.postings(docs).where("term in ('w0', 'w39')").collect()}
    assert {tuple(r) for r in text.listed_postings(index, ["w0", "w39"]).collect()} == want and len(want) == 307


def test_sweep(spark, tmp_path, monkeypatch):
    """Written tables lie in a folder of the application, which a sweep empties."""
    from lodestar import session

    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    df = session.written(spark.range(3).toDF("n"), "numbers")
    assert df.count() == 3 and [p.name for p in (tmp_path / "lodestar").iterdir()] == [spark.sparkContext.applicationId]
    session.sweep(spark)
    assert not list((tmp_path / "lodestar").iterdir())


def test_scratch_needs_a_shared_folder(monkeypatch):
    """Off one machine a session without spark.checkpoint.dir is refused."""
    from types import SimpleNamespace

    from lodestar import session

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", applicationId="app-1", getConf=lambda: conf)
    with pytest.raises(RuntimeError):
        session.scratch_root(SimpleNamespace(conf=conf, sparkContext=context))


def table_of(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def run_query(spark, name):
    from lodestar import catalog

    return {tuple(r)[0]: tuple(r)[1:] for r in catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()}


def test_vector_queries_by_hand(spark):
    """Projection head, sign buckets and augmentation against numpy over all vectors."""
    import numpy as np

    from lodestar.functions import sketches

    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in table_of(spark, "embeddings").collect()}
    w = np.random.default_rng(45).standard_normal((32, 64)) * (2.0 / 64) ** 0.5
    for i, (got,) in run_query(spark, "v09_projection_head").items():
        y = w @ x[i]
        assert np.allclose(got, y / (np.linalg.norm(y) + 1e-8), atol=1e-6)
    planes = np.random.default_rng(7).standard_normal((64, 16 * 8))
    rows = knn.sign_buckets(table_of(spark, "embeddings")).collect()
    assert len(rows) == 16 * len(x)
    for r in rows:
        side = x[r.key] @ planes[:, r.table_id * 8 : r.table_id * 8 + 8]
        assert r.bucket == sum(1 << b for b in range(8) if side[b] >= 0)
    signs = []
    for i, (got,) in run_query(spark, "a09_augmentation").items():
        s = 1.0 if np.abs(np.array(got) - x[i]).max() <= 0.010001 else -1.0
        signs.append(s)
        d = s * np.array(got) - x[i]
        assert np.abs(d).max() <= 0.010001 and d.std() > 0.003
    assert 0.4 < np.mean(np.array(signs) > 0) < 0.6
    assert sketches.fnv1a(b"") == 0xCBF29CE484222325 and sketches.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_text_embedding_by_hand(spark):
    """Hashed features against the same hashes taken in Python."""
    import struct
    from collections import Counter

    import numpy as np
    import xxhash

    from lodestar.functions import encoders

    def place(f, seed):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=xxhash.xxh64_intdigest(f.encode(), seed=42))
        return h - (h >> 63 << 64)

    features = {r.doc_id: Counter(r.f) for r in table_of(spark, "documents").select("doc_id", encoders.features(F.col("text")).alias("f")).collect()}
    for i, (got,) in run_query(spark, "v29_text_embedding").items():
        want = np.zeros(64)
        for f, n in features[i].items():
            for band in range(3):
                want[place(f, band) % 64] += n * (1 if place(f, band + 10) % 2 == 0 else -1)
        assert np.allclose(got, want / (np.linalg.norm(want) + 1e-8), atol=1e-6)


def test_colours_come_from_a_table(spark):
    """Every cell of the cube from every own cell, by hand; the exponentials stand in the plan and none is taken for a row."""
    from lodestar.functions import encoders

    at = [F.col("id").cast("double") / 8 + 0.01, F.lit(2.0), F.lit(None).cast("double")]  # inside, beyond and without a value
    df = spark.range(8).select("id", encoders.colours(*at).alias("e"))
    for r in df.collect():
        assert np.allclose(r.e, [math.exp(-((i - r.id) ** 2 + (j - 7) ** 2 + k**2) / 4) for i in range(8) for j in range(8) for k in range(8)], rtol=1e-14)
    assert "exp(" not in df._jdf.queryExecution().executedPlan().toString().lower()


def shuffle_keys(df):
    """What each exchange of the plan hashes by, without expression ids."""
    import re

    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())]


def test_text_embedding_shuffles_places(spark):
    """Features are summed where they stand: nothing is shuffled by feature."""
    from lodestar import catalog

    keys = shuffle_keys(catalog.queries()["v29_text_embedding"](spark, "/root/testdata/sf0.001"))
    assert keys and not any("f" in k.split(", ") for k in keys)


def test_splats_of_found_clusters(spark):
    """Splats of clusterings: every row counts once, and each splat is the mean and weight of its own rows."""
    import numpy as np

    from lodestar.operators import clustering

    vectors = table_of(spark, "embeddings")
    rows = clustering.two_level(vectors, 10, 4)
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors.collect()}
    members = {}
    for r in rows.collect():
        members.setdefault(r.coarse_id * 4 + r.fine_id, []).append(x[r.vec_id])
    mix = energy.splats(vectors.join(rows, "vec_id").withColumn("both", F.col("coarse_id") * 4 + F.col("fine_id")), "both").collect()
    assert {r.cluster for r in mix} == set(members)
    for r in mix:
        own = np.array(members[r.cluster])
        assert r.n == len(own) and abs(r.alpha - len(own) / len(x)) < 1e-12 and np.allclose(r.mu, own.mean(axis=0), atol=1e-6)
        assert 0.1 <= r.kappa <= 100
    got = run_query(spark, "a17_ingest")
    assert sum(n for n, _, _ in got.values()) == len(x) and abs(sum(a for _, a, _ in got.values()) - 1) < 1e-9


def test_exploration_by_hand(spark):
    """Regions come by falling energy, and each one's five nearest vectors are the exact ones."""
    import numpy as np

    e = table_of(spark, "embeddings")
    found = energy.regions(e, energy.splats(e, "label"), 5).orderBy("region").collect()
    assert [r.energy for r in found] == sorted((r.energy for r in found), reverse=True) and len(found) <= 5
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in e.collect()}
    got = run_query(spark, "e13_exploration")
    for r in found:
        near = sorted(x, key=lambda i: (np.linalg.norm(x[i] - np.array(r.center)), i))[:5]
        assert got[r.region][1] == near


def test_avalanche_by_hand(spark):
    """A cascade over five splats on a line, against steps taken by hand."""
    rows = [(i, [float(i)], a, 1.0) for i, a in enumerate([0.05, 0.1, 0.6, 0.2, 0.05])]
    mix = spark.createDataFrame(rows, "cluster int, mu array<double>, alpha double, kappa double")
    got = {r.cluster: (round(r.energy, 9), r.step) for r in energy.avalanche(mix, share=0.5, near=2).collect()}
    # splat 2 gives 0.3 to 1 and 3: 0.25 and 0.35; only 3 passes 1.5 times the mean (0.3), and gives 0.175 to 2 and 4
    assert got == {0: (0.05, None), 1: (0.25, None), 2: (0.3875, 0), 3: (0.175, 1), 4: (0.1375, None)}
