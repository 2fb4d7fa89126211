"""What iterative plans leave on disk, and what exact graphs exchange."""

import pathlib

import numpy as np

from orrery import lineage
from orrery.operators import graph
from tests.test_search import frame


def shuffled(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data"))


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    rows = spark.range(200_000).repartition(8).selectExpr("id", "uuid() as text").groupBy("text").agg({"id": "max"})
    assert lineage.cut_lineage(rows, "rows").count() == 200_000
    assert shuffled(spark) - before < 1_000_000
    assert spark.conf.get(lineage._CLEAN) == "false"


def test_exact_graphs_exchange_no_copies_of_vectors(spark):
    """Blocks are crossed as they are: no row of a vector for each block that it meets."""
    vectors = np.random.default_rng(41).normal(size=(400, 8)).astype(np.float32)
    rows = frame(spark, vectors)
    whole = sorted(map(tuple, graph.knn_graph(rows, 5).collect()))
    made = graph.knn_graph(rows, 5, block_elements=200)  # 16 blocks of queries, 4 of candidates
    assert sorted(map(tuple, made.collect())) == whole
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan


def test_exact_graphs_of_doubles_among_floats(spark):
    vectors = np.random.default_rng(42).normal(size=(60, 4)).astype(np.float32)
    rows = frame(spark, vectors)
    doubles = rows.selectExpr("id", "cast(vec as array<double>) as vec")
    floats = rows.selectExpr("id", "cast(vec as array<float>) as vec")
    assert sorted(map(tuple, graph.knn_graph(floats, 3, of=doubles).collect())) == sorted(map(tuple, graph.knn_graph(doubles, 3).collect()))
