import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.errors import InvalidArgument
from orrery.functions import distance as D
from orrery.functions import sq8
from orrery.operators import ann, graph
from orrery.operators.knn import filtered_knn, knn, knn_expression, radius, recall


def frame(spark, matrix, **more):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, vec array<float>")


def asked(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "qid long, qvec array<double>")


def truth(metric, queries, vectors, k):
    out = []
    for i, q in enumerate(queries):
        d = D.exact(metric, q, vectors)
        for rank, j in enumerate(np.lexsort((np.arange(len(vectors)), d))[:k]):
            out.append((i, int(j), rank + 1))
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1, 1, (300, 16)).astype(np.float32).astype(float)
    vectors[7] = vectors[3]  # ties
    vectors[11] = 0
    return vectors, vectors[[0, 3, 11, 20]] + np.array([0, 0, 0, 0.01])[:, None]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("k", [1, 10, 500])
def test_knn_is_exact(spark, points, metric, k):
    vectors, queries = points
    want = truth(metric, queries, vectors, k)
    rows, q = frame(spark, vectors), asked(spark, queries)
    got = sorted((r["qid"], r["rank"], r["id"]) for r in knn(rows, q, k, metric).collect())
    if metric == "l2" or k == 1:
        assert got == sorted((i, rank, j) for i, j, rank in want)
    assert len(got) == len(want)
    few = knn_expression(rows, q, k, metric, 16).collect()
    assert {(r["qid"], r["id"]) for r in few} == {(i, j) for i, _, j in got} or metric == "cosine"


def test_queries_come_in_blocks(spark, points, monkeypatch):
    from orrery.operators import knn as module

    vectors, queries = points
    rows, q = frame(spark, vectors), asked(spark, queries)
    whole = sorted(map(tuple, knn(rows, q, 5).collect()))
    monkeypatch.setattr(module.query_blocks, "__defaults__", (20,))
    assert sorted(map(tuple, knn(rows, q, 5).collect())) == whole


def test_odd_inputs(spark, points):
    vectors, queries = points
    rows, q = frame(spark, vectors), asked(spark, queries)
    with pytest.raises(InvalidArgument):
        knn(rows, q, 0)
    with pytest.raises(InvalidArgument):
        knn(rows, q, 3, "dot")
    assert knn(rows.limit(0), q, 3).count() == 0
    assert knn(rows, q.limit(0), 3).count() == 0
    odd = spark.createDataFrame([(None, [0.0] * 16), (1, None), (2, [1.0] * 16)], "id long, vec array<float>")
    assert {r["id"] for r in knn(odd, q, 3).collect()} == {2}


def test_zero_norm_is_last(spark, points):
    vectors, queries = points
    rows = knn(frame(spark, vectors), asked(spark, queries[:1]), 300, "cosine").collect()
    last = max(rows, key=lambda r: r["rank"])
    assert last["id"] == 11 and last["distance"] == float("inf")


def test_distance_columns(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    for dim in (None, 2):
        got = rows.select(D.distance("l2", F.col("a"), F.col("b"), dim), D.distance("cosine", F.col("a"), F.col("b"), dim)).collect()
        assert got[0][0] == 5 and got[0][1] == float("inf")
        assert got[1][0] == 1 and abs(got[1][1] - (1 - 2**-0.5)) < 1e-12
        assert got[2][0] == got[2][1] == float("inf")


def test_filter_costs_no_neighbours(spark, points):
    vectors, queries = points
    rows = frame(spark, vectors).withColumn("payload", F.when(F.col("id") % 50 == 0, F.lit('{"t":"a"}')))
    got = filtered_knn(rows, asked(spark, queries), 10, {"t": "a"}).collect()
    assert {r["id"] for r in got} == {0, 50, 100, 150, 200, 250} and len(got) == 24
    assert filtered_knn(rows, asked(spark, queries), 500, {"t": {"$exists": False}}).count() == 4 * 294


def test_radius(spark, points):
    vectors, queries = points
    got = {(r["qid"], r["id"]) for r in radius(frame(spark, vectors), asked(spark, queries), 1.9).collect()}
    assert got == {(i, int(j)) for i, q in enumerate(queries) for j in np.nonzero(D.exact("l2", q, vectors) <= 1.9)[0]}


def test_sq8(spark):
    rng = np.random.default_rng(0)
    vectors = np.vstack([rng.normal(size=(50, 8)), np.full((1, 8), 0.25)])
    rows = frame(spark, vectors).withColumn("code", sq8.encode(F.col("vec"))).withColumn("back", sq8.decode(F.col("code")))
    for r in rows.collect():
        v, b = np.array(r["vec"]), np.array(r["back"])
        assert np.abs(v - b).max() <= (v.max() - v.min()) / 255 / 2 + 1e-9
        assert all(0 <= q <= 255 for q in r["code"]["q8"])
        if r["id"] == 50:
            assert (v == b).all()


def test_graph_parts(spark, points):
    vectors, _ = points
    rows = frame(spark, vectors)
    edges = graph.knn_graph(rows, 5)
    assert edges.groupBy("src").count().where("count <> 5").count() == 0 and edges.where("src = dst").count() == 0
    both = graph.symmetrize(edges)
    assert both.join(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).count() == both.count()
    assert graph.cap_degree(both, 6).groupBy("src").count().agg(F.max("count")).first()[0] <= 6


def test_rng_prune(spark, points):
    vectors, _ = points
    rows = frame(spark, vectors)
    edges = graph.knn_graph(rows, 20)
    got = {}
    for r in graph.rng_prune(edges, rows, 6).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    for src, group in edges.toPandas().groupby("src"):
        kept = []
        for dst, dist in sorted(zip(group["dst"], group["dist"]), key=lambda x: (x[1], x[0])):
            if len(kept) < 6 and all(np.linalg.norm(vectors[dst] - vectors[x]) >= dist for x in kept):
                kept.append(dst)
        assert got[src] == set(kept)
    full = graph.rng_prune(edges, rows, 6, backfill=True).groupBy("src").count()
    assert full.where("count <> 6").count() == 0


def test_levels(spark):
    rows = spark.range(100_000).select("id")
    counts = {r["level"]: r["nodes"] for r in graph.layer_counts(graph.levels(rows, 8)).collect()}
    assert abs(counts[0] / 100_000 - 7 / 8) < 0.01 and abs(counts[1] / 100_000 - 7 / 64) < 0.01


def test_cells(spark, points):
    vectors, queries = points
    rows, q = frame(spark, vectors), asked(spark, queries)
    centres = ann.fit_cells(rows, 8)
    indexed = ann.assign_cells(rows, centres)
    assert indexed.count() == len(vectors)
    exact = sorted(map(tuple, knn(rows, q, 5).collect()))
    assert sorted(map(tuple, ann.cell_search(indexed, centres, q, 5, 8).collect())) == exact
    part = recall(ann.cell_search(indexed, centres, q, 5, 6), knn(rows, q, 5), 5, q).first()[0]
    assert part >= 0.7


def test_recall_counts_empty_queries(spark):
    true = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 1), (1, 4, 2)], "qid long, id long, rank int")
    got = spark.createDataFrame([(0, 1), (0, 9)], "qid long, id long")
    assert recall(got, true, 2, true.select("qid").distinct()).first()[0] == 0.25


def test_sign_codes(spark, points):
    vectors, queries = points
    rows, q = frame(spark, vectors), asked(spark, queries)
    planes = ann.projections(16, 16)
    assert sorted(map(tuple, ann.code_search(rows, q, 5, planes, 0).collect())) == sorted(map(tuple, knn(rows, q, 5).collect()))
    codes = {r["id"]: r["c"] for r in rows.select("id", ann.sign_code(F.col("vec"), planes).alias("c")).collect()}
    assert codes[20] == sum(1 << b for b, p in enumerate(planes) if p @ vectors[20] > 0)
    assert 0 < ann.least_collisions(32, 0.5) < 32
