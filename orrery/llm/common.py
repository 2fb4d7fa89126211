"""What the training-data operators share: tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage, fresh_path

__all__ = ["connected_components", "cut_lineage", "fresh_path", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v; the result has the same form."""
    if large:
        pairs = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("u", "mv").alias("m"))
    least = cut_lineage(least, "least")  # a side of its own, or the join couldn't be split on a hub
    linked = pairs.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of ``edges`` (long ids) the least node it is connected with.

    Alternating large-star and small-star steps. Every step aggregates per node with partial
    sums and joins the written result, which Spark may split on a hub, and a written table ends each
    round, so no component meets in one task or the driver.
    Nulls and self loops are ignored; an empty input gives an empty result.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where("_a is not null and _b is not null and _a <> _b")
        .select("u", "v")
        .distinct()
    )
    pairs = cut_lineage(pairs, "edges")
    before = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        pairs = cut_lineage(_star(_star(pairs, True), False), "star")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
