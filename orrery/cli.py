"""Load vector files, search them and report recall: python -m orrery.cli --base b.fvecs --query q.fvecs."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import METRICS
from .operators import ann
from .operators.knn import knn, recall
from .sources.vectors import read_vectors


def _asked(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def run(spark: SparkSession, base: str, query: str, truth: str | None = None, k: int = 10, metric: str = "l2", cells: int = 0, probes: int = 8, out: str | None = None) -> dict:
    """The number of vectors and queries, seconds, queries a second, and recall@k: against an ivecs
    file of true neighbours, or of the cells' search against the exact one."""
    vectors, queries = read_vectors(spark, base), _asked(read_vectors(spark, query))
    began = time.perf_counter()
    if cells:
        centres = ann.fit_cells(vectors, cells, metric)
        found = ann.cell_search(ann.assign_cells(vectors, centres, metric), centres, queries, k, probes, metric)
    else:
        found = knn(vectors, queries, k, metric)
    found = found.persist()
    n = found.count()
    seconds = time.perf_counter() - began
    report = {"vectors": vectors.count(), "queries": queries.count(), "results": n, "seconds": round(seconds, 3)}
    report["queries_per_second"] = round(report["queries"] / seconds, 1)
    if truth is not None:
        near = read_vectors(spark, truth).select(F.col("id").alias("qid"), F.posexplode("vec").alias("pos", "id"))
        near = near.select("qid", F.col("id").cast("long").alias("id"), (F.col("pos") + 1).alias("rank"))
        report["recall"] = recall(found, near, k, queries).first()[0]
    elif cells:
        report["recall"] = recall(found, knn(vectors, queries, k, metric), k, queries).first()[0]
    if out:
        found.orderBy("qid", "rank").write.mode("overwrite").json(out)
    found.unpersist()
    return report


def main(args: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("base", "query"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--truth")
    parser.add_argument("--out")
    parser.add_argument("--metric", choices=METRICS, default="l2")
    for name, value in (("k", 10), ("cells", 0), ("probes", 8)):
        parser.add_argument(f"--{name}", type=int, default=value)
    spark = SparkSession.builder.appName("orrery").getOrCreate()
    print(json.dumps(run(spark, **vars(parser.parse_args(args)))))


if __name__ == "__main__":
    main()
