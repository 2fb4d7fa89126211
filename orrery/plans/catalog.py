"""The engine's queries over the driver's tables, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import sq8
from ..functions.predicate import compile_filter
from ..lineage import cut_lineage, fresh_path
from ..operators import ann, graph, mutation
from ..operators.knn import filtered_knn, knn, knn_expression, radius, recall

Query = Callable[[SparkSession, str], DataFrame]
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(rows: DataFrame) -> DataFrame:
    """The stated queries: the vectors of every id divisible by 50."""
    return rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def rounded(df: DataFrame, name: str = "distance", digits: int = 6) -> DataFrame:
    return df.withColumn(name, F.round(name, digits))


# Nearest neighbours


def _knn(spark: SparkSession, sf_dir: str, k: int, metric: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rounded(knn(rows, asked(rows), k, metric))


def _knn_expression(spark: SparkSession, sf_dir: str, k: int, metric: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "vec")
    return rounded(knn_expression(rows, asked(rows), k, metric, DIM))


def _radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rounded(radius(rows, asked(rows), 1.1))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a payload: the label, an array of it and its parity, and an object."""
    rows = vectors(spark, sf_dir)
    parity = F.when(F.col("label") % 2 == 0, "even").otherwise("odd")
    payload = F.to_json(F.struct("label", F.array(F.col("label").cast("string"), parity).alias("tags"), F.struct(parity.alias("parity")).alias("meta")))
    return rows.withColumn("payload", payload)


def _knn_filtered(spark: SparkSession, sf_dir: str, k: int, filter: dict, pushed: bool = False) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    columns = {"label": (F.col("label"), int)} if pushed else None
    return rounded(filtered_knn(rows, asked(rows), k, filter, columns=columns))


_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _lineitem_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features of line items; the ten nearest lines to three stated points, of returned lines."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    vec = F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    points = spark.createDataFrame([(0, [10.0, 20.0, 5.0, 2.0]), (1, [25.0, 40.0, 3.0, 4.0]), (2, [45.0, 60.0, 8.0, 6.0])], "qid long, qvec array<double>")
    scored = rows.select(*_KEY, vec.alias("vec")).join(F.broadcast(points)).select("qid", *_KEY, D.l2_squared(F.col("vec"), F.col("qvec"), 4).alias("d"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("d", 9), *_KEY))
    return scored.withColumn("rank", rank).where("rank <= 10").select("qid", *_KEY, "rank", F.round(F.sqrt("d"), 6).alias("distance"))


def _knn_sql(k: int, metric: str = "l2", where: str = "true", r: float | None = None) -> str:
    value = {"l2": "list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[])", "cosine": "list_cosine_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"}[metric]
    scored = f"SELECT q.vec_id AS qid, v.vec_id AS id, {value} AS d FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND ({where})"
    if r is not None:
        return f"SELECT qid, id, round(d, 6) AS distance FROM ({scored}) WHERE d <= {r}"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM ({scored})"
    return f"SELECT qid, id, rank, round(d, 6) AS distance FROM ({ranked}) WHERE rank <= {k}"


_LINEITEM_SQL = """
WITH p(qid, a, b, c, d) AS (VALUES (0, 10.0, 20.0, 5.0, 2.0), (1, 25.0, 40.0, 3.0, 4.0), (2, 45.0, 60.0, 8.0, 6.0)),
s AS (SELECT qid, l_orderkey, l_partkey, l_suppkey, l_linenumber,
  (l_quantity - a) ** 2 + (l_extendedprice / 1000 - b) ** 2 + (l_discount * 100 - c) ** 2 + (l_tax * 100 - p.d) ** 2 AS x
  FROM lineitem, p WHERE l_returnflag = 'R'),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9), l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rank FROM s)
SELECT qid, l_orderkey, l_partkey, l_suppkey, l_linenumber, rank, round(sqrt(x), 6) AS distance FROM r WHERE rank <= 10
"""


def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the majority label of each query's ten nearest others."""
    rows = vectors(spark, sf_dir)
    near = knn(rows, asked(rows), 11).where("qid <> id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where("rank <= 10")
    votes = near.join(rows.select("id", "label"), "id").groupBy("qid", "label").agg(F.count("*").alias("votes"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("votes"), "label"))
    return votes.withColumn("r", best).where("r = 1").select("qid", "label", "votes")


_CLASSIFY_SQL = f"""
WITH near AS (SELECT * FROM ({_knn_sql(100000)}) WHERE qid <> id),
ten AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM near),
votes AS (SELECT qid, label, count(*) AS votes FROM ten JOIN embeddings ON vec_id = id WHERE r <= 10 GROUP BY qid, label)
SELECT qid, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS b FROM votes) WHERE b = 1
"""

# Distance functions


def _pair(spark: SparkSession, sf_dir: str, name: str, value: Callable) -> DataFrame:
    """Each vector against the one of the next id, which starts at vec_id 0 again."""
    rows = vectors(spark, sf_dir).select("id", "vec")
    others = rows.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    return rows.join(others, "id").select("id", F.round(value(F.col("vec"), F.col("other")), 6).alias(name))


def _zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distances to vectors of which every fourth is set to zero."""
    zero = F.transform("other", lambda x: F.when(F.col("id") % 4 == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = vectors(spark, sf_dir).select("id", "vec")
    others = rows.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    d = D.cosine(F.col("vec"), zero, DIM)
    return rows.join(others, "id").select("id", F.when(d == float("inf"), F.lit("inf")).otherwise(F.round(d, 6).cast("decimal(12,6)").cast("string")).alias("distance"))


def _pair_sql(name: str, value: str) -> str:
    return f"SELECT a.vec_id AS id, round({value.format(a='a.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]')}, 6) AS {name} FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


_ZERO_SQL = """
SELECT a.vec_id AS id, CASE WHEN a.vec_id % 4 = 0 THEN 'inf'
  ELSE CAST(CAST(round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS DECIMAL(12,6)) AS VARCHAR) END AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""

# Filters


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, payload): documents with labels as payloads of scalars, an array, a nested object, a
    field that is missing for the unlabelled, and a JSON null for every seventh."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    five = F.when(F.col("doc_id") % 5 == 0, F.lit("5"))
    meta = F.struct("lang", F.struct(F.col("source").alias("name")).alias("origin"))
    text = F.to_json(F.struct("lang", "source", F.col("n_chars").alias("size"), "quality", F.array("lang", "source").alias("tags"), meta.alias("meta"), five.alias("five")))
    return docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.regexp_replace(text, r"\}$", ',"nul":null}')).otherwise(text).alias("payload"))


#: Name, filter and the same condition on plain columns.
FILTERS: dict[str, tuple[dict, str]] = {
    "filter_eq": ({"lang": "de"}, "lang = 'de'"),
    "filter_eq_null": ({"nul": None}, "d.doc_id % 7 = 0"),
    "filter_eq_array": ({"tags": ["en", "src3"]}, "lang = 'en' AND source = 'src3'"),
    "filter_eq_array_order": ({"$or": [{"tags": ["src3", "en"]}, {"lang": "es"}]}, "lang = 'es'"),
    "filter_eq_object": ({"meta": {"origin": {"name": "src1"}, "lang": "en"}}, "lang = 'en' AND source = 'src1'"),
    "filter_eq_double": ({"quality": {"$eq": 1.0}}, "quality = 1"),
    "filter_eq_bool_is_no_number": ({"$or": [{"quality": True}, {"lang": "fr"}]}, "lang = 'fr'"),
    "filter_ne_missing": ({"quality": {"$ne": 1}}, "quality IS NULL OR quality <> 1"),
    "filter_gt": ({"size": {"$gt": 3000}}, "n_chars > 3000"),
    "filter_gte": ({"size": {"$gte": 2000}}, "n_chars >= 2000"),
    "filter_lt": ({"size": {"$lt": 1000.5}}, "n_chars < 1000.5"),
    "filter_lte": ({"size": {"$lte": 900}}, "n_chars <= 900"),
    "filter_range": ({"size": {"$gte": 500, "$lt": 1500}, "lang": "en"}, "n_chars >= 500 AND n_chars < 1500 AND lang = 'en'"),
    "filter_string_range": ({"source": {"$gte": "src15", "$lt": "src3"}}, "source >= 'src15' AND source < 'src3'"),
    "filter_in": ({"lang": {"$in": ["de", "es", 5, None]}}, "lang IN ('de', 'es')"),
    "filter_in_empty": ({"$or": [{"lang": {"$in": []}}, {"lang": "es"}]}, "lang = 'es'"),
    "filter_nin_missing": ({"quality": {"$nin": [0, "1"]}}, "quality IS NULL OR quality <> 0"),
    "filter_exists_true": ({"quality": {"$exists": True}}, "quality IS NOT NULL"),
    "filter_exists_false": ({"quality": {"$exists": False}}, "quality IS NULL"),
    "filter_exists_null": ({"nul": {"$exists": True}}, "d.doc_id % 7 = 0"),
    "filter_contains_any": ({"tags": {"$contains_any": ["src1", "es"]}}, "source = 'src1' OR lang = 'es'"),
    "filter_contains_all": ({"tags": {"$contains_all": ["en", "src2"]}}, "lang = 'en' AND source = 'src2'"),
    "filter_contains_all_empty": ({"$and": [{"tags": {"$contains_all": []}}, {"lang": "fr"}]}, "lang = 'fr'"),
    "filter_contains_all_no_array": ({"$or": [{"lang": {"$contains_all": []}}, {"lang": "de"}]}, "lang = 'de'"),
    "filter_and_or_nested": (
        {"$or": [{"$and": [{"lang": "en"}, {"size": {"$gt": 4000}}]}, {"lang": "fr", "$or": [{"source": "src2"}, {"quality": 0}]}]},
        "(lang = 'en' AND n_chars > 4000) OR (lang = 'fr' AND (source = 'src2' OR coalesce(quality = 0, false)))",
    ),
    "filter_dotpath": ({"meta.origin.name": "src4"}, "source = 'src4'"),
    "filter_dotpath_no_index": ({"$or": [{"tags.0": "en"}, {"lang": "es"}]}, "lang = 'es'"),
    "filter_type_mismatch": ({"$or": [{"size": {"$gt": "100"}}, {"five": {"$lt": 9}}, {"five": "5"}]}, "d.doc_id % 5 = 0"),
    "filter_empty": ({}, "true"),
}


def _filter(spark: SparkSession, sf_dir: str, filter: dict) -> DataFrame:
    rows = described(spark, sf_dir)
    condition = compile_filter(filter, F.col("payload"))
    return (rows if condition is None else rows.where(condition)).select("doc_id")


# The mutation log


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all vectors with a payload; negate every seventh without one; set the payload of every
    eleventh to {}; delete every fifth; insert every 35th again, without a payload."""
    rows = vectors(spark, sf_dir)
    payload = F.to_json(F.struct("label"))
    none = F.lit(None).cast("string")
    negative = F.transform("vec", lambda x: (-x).cast("float"))
    log = mutation.upserts(rows.select("id", "vec", payload.alias("payload")), F.lit(1))
    log = log.unionByName(mutation.upserts(rows.where("id % 7 = 0").select("id", negative.alias("vec"), none.alias("payload")), F.lit(2)))
    log = log.unionByName(mutation.payloads(rows.where("id % 11 = 0").select("id", F.lit("{}").alias("payload")), F.lit(3)))
    log = log.unionByName(mutation.deletes(rows.where("id % 5 = 0"), F.lit(4)))
    return log.unionByName(mutation.upserts(rows.where("id % 35 = 0").select("id", "vec", none.alias("payload")), F.lit(5)))


#: The same state on plain columns: what is alive, which sign its vector has, what its payload is.
_STATE_SQL = """
SELECT vec_id AS id, embedding, CASE WHEN vec_id % 7 = 0 AND vec_id % 35 <> 0 THEN -1 ELSE 1 END AS sign,
  CASE WHEN vec_id % 35 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN '{}' ELSE '{"label":' || label || '}' END AS payload
FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 35 = 0
"""


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = mutation.current_view(mutations(spark, sf_dir))
    return view.select("id", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first"), "payload")


def _payload_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.get_payloads(mutation.current_view(mutations(spark, sf_dir)), vectors(spark, sf_dir))


def _alive_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = mutation.current_view(mutations(spark, sf_dir))
    return rounded(knn(view, asked(vectors(spark, sf_dir)), 10))


_ALIVE_KNN_SQL = f"""
WITH v AS (SELECT id, list_transform(embedding::DOUBLE[], lambda x: x * sign) AS vec FROM ({_STATE_SQL})),
s AS (SELECT q.vec_id AS qid, v.id, list_distance(v.vec, q.embedding::DOUBLE[]) AS d FROM v, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM s)
SELECT qid, id, rank, round(d, 6) AS distance FROM r WHERE rank <= 10
"""


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that replace, remove and add, nested too; keys are taken out of the results."""
    rows = vectors(spark, sf_dir)
    view = rows.select("id", F.to_json(F.struct("label", F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")).alias("meta"))).alias("payload"))
    patch = F.when(F.col("id") % 3 == 0, F.lit('{"label":null}')).when(F.col("id") % 3 == 1, F.lit('{"meta":{"y":99,"z":3}}')).otherwise(F.lit('{"meta":5,"new":"a"}'))
    merged = mutation.patch_payloads(view, rows.select("id", patch.alias("patch")))
    get = lambda p: F.get_json_object("payload", p)
    return merged.select("id", get("$.label").alias("label"), get("$.meta.x").alias("x"), get("$.meta.y").alias("y"), get("$.meta.z").alias("z"), get("$.new").alias("new"))


_MERGE_SQL = """
WITH p AS (SELECT vec_id AS id, json_merge_patch('{"label":' || label || ',"meta":{"x":1,"y":2}}',
  CASE vec_id % 3 WHEN 0 THEN '{"label":null}' WHEN 1 THEN '{"meta":{"y":99,"z":3}}' ELSE '{"meta":5,"new":"a"}' END) AS j FROM embeddings)
SELECT id, j->>'$.label' AS label, j->>'$.meta.x' AS x, j->>'$.meta.y' AS y, j->>'$.meta.z' AS z, j->>'$.new' AS new FROM p
"""


def _delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    view = rows.select("id", F.to_json(F.struct("label", F.struct(F.lit(1).alias("x")).alias("meta"), F.lit("k").alias("keep"))).alias("payload"))
    left = mutation.delete_payload_keys(view, ["label", "meta.x", "absent"])
    get = lambda p: F.get_json_object("payload", p)
    return left.select("id", get("$.label").alias("label"), get("$.meta.x").alias("x"), get("$.keep").alias("keep"))


# Quantisation


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", "vec", sq8.encode(F.col("vec")).alias("code"))


def _sq8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.transform("code.q8", lambda x: x.cast("int"))
    return _encoded(spark, sf_dir).select("id", F.array_join(codes, ",").alias("q8"))


def _sq8_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = F.array_max(F.zip_with("vec", sq8.decode(F.col("code")), lambda x, y: F.abs(x.cast("double") - y)))
    return _encoded(spark, sf_dir).select("id", F.round(worst, 6).alias("error"))


def _sq8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw query against the stored vectors."""
    stored = _encoded(spark, sf_dir).select("id", sq8.decode(F.col("code")).alias("vec"))
    return rounded(knn(stored, asked(vectors(spark, sf_dir)), 10))


_SQ8_SQL = """
SELECT vec_id AS id, embedding::DOUBLE[] AS vec, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi,
  list_transform(embedding::DOUBLE[], lambda x: least(255, greatest(0, floor((x - list_min(embedding)::DOUBLE)
    * (255.0::DOUBLE / greatest(list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE, 1e-10)) + 0.5)))::INTEGER) AS q8
FROM embeddings
"""
_DECODED_SQL = f"SELECT id, vec, list_transform(q8, lambda q: q * ((hi - lo) / 255.0::DOUBLE) + lo) AS back FROM ({_SQ8_SQL})"

# Graphs


def _graph(spark: SparkSession, sf_dir: str, m: int = 8) -> DataFrame:
    return graph.knn_graph(vectors(spark, sf_dir), m)


def _knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_graph(spark, sf_dir), "dist")


def _symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.symmetrize(_graph(spark, sf_dir)), "dist")


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.cap_degree(graph.symmetrize(_graph(spark, sf_dir)), 6), "dist")


_GRAPH_SQL = """
SELECT src, dst, d FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r <= 8
"""
_BOTH_SQL = f"WITH g AS ({_GRAPH_SQL}) SELECT src, dst, min(d) AS d FROM (SELECT * FROM g UNION ALL SELECT dst, src, d FROM g) GROUP BY src, dst"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return graph.layer_counts(graph.levels(rows, 8))


_LEVELS_SQL = (
    "SELECT level, count(*) AS nodes FROM (SELECT "
    + " + ".join(f"CAST(((o_orderkey * 2654435761 + 40503) % 2147483648) % {8**l} = 0 AS INTEGER)" for l in range(1, 11))
    + " AS level FROM orders) GROUP BY level"
)


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rounded(graph.rng_prune(graph.knn_graph(rows, 24), rows.select("id", "vec"), 8), "dist")


def _backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rounded(graph.rng_prune(graph.knn_graph(rows, 24), rows.select("id", "vec"), 8, backfill=True), "dist")


def _pruned_sql(backfill: bool = False) -> str:
    """The 24 nearest in order of distance: one stays unless one that stayed is nearer to it than the node is."""
    chosen = "QUALIFY row_number() OVER (PARTITION BY c.src ORDER BY NOT list_contains(kept, r), r) <= 8" if backfill else "WHERE list_contains(kept, r)"
    return f"""
WITH RECURSIVE s AS (SELECT q.vec_id AS src, v.vec_id AS dst, v.embedding::DOUBLE[] AS vec, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
  FROM embeddings q, embeddings v WHERE q.vec_id <> v.vec_id),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS r FROM s) WHERE r <= 24),
nearer AS (SELECT x.src, x.r, list(y.r) AS than FROM c x JOIN c y ON y.src = x.src AND y.r < x.r WHERE list_distance(x.vec, y.vec) < x.d GROUP BY x.src, x.r),
walk AS (SELECT DISTINCT src, 0::BIGINT AS step, []::BIGINT[] AS kept FROM c
  UNION ALL SELECT w.src, step + 1, CASE WHEN len(kept) < 8 AND NOT coalesce(list_has_any(kept, than), false) THEN list_append(kept, step + 1) ELSE kept END
  FROM walk w LEFT JOIN nearer n ON n.src = w.src AND n.r = step + 1 WHERE step < 24)
SELECT c.src, dst, round(d, 6) AS dist FROM c JOIN walk w ON w.src = c.src AND step = 24 {chosen}
"""


def _checked_recall(found: DataFrame, truth: DataFrame, k: int, queries: DataFrame, least: float) -> DataFrame:
    """The recall; a recall below ``least`` fails the query."""
    short = F.raise_error(F.lit(f"recall is below {least}")).cast("double")
    return recall(found, truth, k, queries).select(F.when(F.col("recall") < least, short).otherwise(F.round("recall", 3)).alias("recall"))


def _nearest_truth(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    queries = asked(rows)
    return queries, knn(rows, queries, k)


def _graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulk build of a layered graph: nodes and edges of each layer."""
    rows = vectors(spark, sf_dir).select("id", "vec")
    edges = graph.layered_graph(rows, 8, 24)
    return edges.groupBy("layer").agg(F.countDistinct("src").alias("nodes"), F.count("*").alias("edges"))


def _descent_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of true nearest neighbours that the descended graph has."""
    rows = vectors(spark, sf_dir).select("id", "vec")
    edges = graph.descend(rows, s=16, outer=2, r=32)
    true = graph.knn_graph(rows, 1)
    found = edges.select(F.col("src").alias("qid"), F.col("dst").alias("id"))
    truth = true.select(F.col("src").alias("qid"), F.col("dst").alias("id"), F.lit(1).alias("rank"))
    return _checked_recall(found, truth, 1, rows.select(F.col("id").alias("qid")), 0.9)


def _graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the graph that build_graph() makes."""
    rows = cut_lineage(vectors(spark, sf_dir).select("id", "vec"), "vectors")
    queries, truth = _nearest_truth(rows, 10)
    edges = cut_lineage(graph.layered_graph(rows, 8, 24), "edges")
    return _checked_recall(ann.graph_search(edges, rows, queries, 10, ef=64, dim=DIM), truth, 10, queries, 0.9)


def _graph_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(_labelled(spark, sf_dir).select("id", "vec", "payload"), "vectors")
    queries = asked(rows)
    even = {"meta.parity": "even"}
    truth = filtered_knn(rows, queries, 10, even)
    edges = cut_lineage(graph.layered_graph(rows.select("id", "vec"), 8, 24), "edges")
    return _checked_recall(ann.graph_search(edges, rows, queries, 10, ef=64, filter=even, max_scan=2000, dim=DIM), truth, 10, queries, 0.9)


def _cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "vec")
    queries, truth = _nearest_truth(rows, 10)
    centres = ann.fit_cells(rows, 16)
    return _checked_recall(ann.cell_search(ann.assign_cells(rows, centres), centres, queries, 10, 12), truth, 10, queries, 0.9)


def _all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every cell probed the answer is exact."""
    rows = vectors(spark, sf_dir).select("id", "vec")
    centres = ann.fit_cells(rows, 16)
    return rounded(ann.cell_search(ann.assign_cells(rows, centres), centres, asked(rows), 10, 16))


#: Planes of the codes of sign_code_recall, and in how many two have to agree: about a seventh of vectors at random do.
CODE_PLANES, CODE_LEAST = 512, 282


def _codes_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the vectors that the codes leave over."""
    rows = vectors(spark, sf_dir).select("id", "vec")
    queries, truth = _nearest_truth(rows, 10)
    return _checked_recall(ann.code_search(rows, queries, 10, ann.projections(DIM, CODE_PLANES), CODE_LEAST), truth, 10, queries, 0.9)


def _planes(dim: int, bits: int = 16):
    """Planes of -1 and 1, so that any engine gets the same sums."""
    return [[1.0 if (i * 7 + j * 13 + i * j) % 3 else -1.0 for j in range(dim)] for i in range(bits)]


def _collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", ann.sign_code(F.col("vec"), _planes(DIM)).alias("code"))
    first = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("code").alias("qcode"))
    return rows.join(F.broadcast(first)).select("qid", "id", ann.collisions(F.col("code"), F.col("qcode"), 16).cast("long").alias("collisions"))


def _collisions_sql() -> str:
    planes = "[" + ",".join("[" + ",".join(str(int(x)) for x in p) + "]" for p in _planes(DIM)) + "]"
    return f"""
WITH s AS (SELECT vec_id AS id, list_transform({planes}, lambda p: CAST(list_inner_product(embedding::DOUBLE[], p::DOUBLE[]) > 0 AS INTEGER)) AS bits FROM embeddings)
SELECT q.id AS qid, v.id, CAST(list_sum(list_transform(range(1, 17), lambda i: CAST(v.bits[i] = q.bits[i] AS INTEGER))) AS BIGINT) AS collisions
FROM s v, s q WHERE q.id % 50 = 0"""


def _recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantised vectors' neighbours against the true ones."""
    rows = vectors(spark, sf_dir)
    queries, truth = _nearest_truth(rows, 10)
    stored = _encoded(spark, sf_dir).select("id", sq8.decode(F.col("code")).alias("vec"))
    return recall(knn(stored, queries, 10), truth, 10, queries).select(F.round("recall", 6).alias("recall"))


def _fvecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as fvecs files and read again, with ids by position."""
    from ..sources.vectors import read_vectors, write_vectors

    folder = fresh_path(spark, "fvecs")
    write_vectors(vectors(spark, sf_dir), folder, "fvecs", partitions=3)
    back = read_vectors(spark, folder, "fvecs")
    return back.select("id", F.size("vec").cast("long").alias("dim"), F.round(D.norm(F.col("vec")), 6).alias("norm"))


def _index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the index: create, bulk insert, delete, update payloads by filter, search."""
    from .index import Index

    index = Index.create(spark, fresh_path(spark, "index"), DIM)
    rows = _labelled(spark, sf_dir)
    index.insert_many(rows.select("id", "vec", "payload"))
    index.delete_many(rows.where("id % 4 = 0").select("id"))
    return rounded(index.search_many(asked(rows), 5, {"label": {"$lt": 5}}))


def _written(spark: SparkSession, sf_dir: str, build: str):
    """An index whose cells or graph were built before deletes, updates and inserts."""
    from .index import Index

    index = Index.create(spark, fresh_path(spark, "index"), DIM)
    rows = _labelled(spark, sf_dir)
    index.insert_many(rows.where("id % 10 <> 3").select("id", "vec", "payload"))
    index.build_cells(16) if build == "cells" else index.build_graph()
    index.delete_many(rows.where("id % 5 = 0").select("id"))
    index.insert_many(rows.where("id % 7 = 0").select("id", F.transform("vec", lambda x: (-x).cast("float")).alias("vec")))
    index.insert_many(rows.where("id % 10 = 3").select("id", "vec", "payload"))
    return index, rows


def _cells_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all cells probed, the state after the writes in full."""
    index, rows = _written(spark, sf_dir, "cells")
    return rounded(index.search_cells(asked(rows), 10, 16))


def _graph_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, rows = _written(spark, sf_dir, "graph")
    queries = asked(rows)
    truth = index.search_many(queries, 10)
    index.extend_graph()
    return _checked_recall(index.search_graph(queries, 10, 64), truth, 10, queries, 0.9)


_AFTER_WRITES_SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN vec_id % 7 = 0 AND vec_id % 10 <> 3 THEN -x ELSE x END) AS vec
  FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 7 = 0),
s AS (SELECT q.vec_id AS qid, v.id, list_distance(v.vec, q.embedding::DOUBLE[]) AS d FROM v, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM s)
SELECT qid, id, rank, round(d, 6) AS distance FROM r WHERE rank <= 10
"""


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows that share an id in one insert the greatest vector wins, with its own payload."""
    from .index import Index

    index = Index.create(spark, fresh_path(spark, "index"), DIM)
    rows = _labelled(spark, sf_dir).select("id", "vec", F.lit('{"of":"plain"}').alias("payload"))
    other = rows.select("id", F.transform("vec", lambda x: (-x).cast("float")).alias("vec"), F.lit('{"of":"negated"}').alias("payload"))
    index.insert_many(rows.unionByName(other).unionByName(rows))
    return index.vectors.select("id", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first"), "payload")


_DUPLICATES_SQL = """
SELECT vec_id AS id, round(abs(embedding[1])::DOUBLE, 6) AS first, CASE WHEN embedding[1] >= 0 THEN '{"of":"plain"}' ELSE '{"of":"negated"}' END AS payload
FROM embeddings
"""


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "knn_l2_top10": partial(_knn, k=10, metric="l2"),
        "knn_cosine_top10": partial(_knn, k=10, metric="cosine"),
        "knn_l2_k1": partial(_knn, k=1, metric="l2"),
        "knn_batch50": partial(_knn, k=10, metric="l2"),
        "knn_k_gt_n": partial(_knn, k=100_000, metric="l2"),
        "knn_expression_l2": partial(_knn_expression, k=10, metric="l2"),
        "knn_expression_cosine": partial(_knn_expression, k=10, metric="cosine"),
        "knn_filtered_label": partial(_knn_filtered, k=10, filter={"label": 3}),
        "knn_filtered_pushed": partial(_knn_filtered, k=10, filter={"label": {"$in": [1, 2]}}, pushed=True),
        "knn_filtered_selective": partial(_knn_filtered, k=5, filter={"tags": {"$contains_all": ["odd"]}, "label": {"$gte": 7}}),
        "knn_filtered_few": partial(_knn_filtered, k=1000, filter={"label": 9}),
        "lineitem_knn_filtered": _lineitem_knn,
        "radius_l2": _radius,
        "knn_classify": _classify,
        "dist_dot": partial(_pair, name="dot", value=lambda a, b: D.dot(a, b, DIM)),
        "dist_norm": partial(_pair, name="norm", value=lambda a, b: D.norm(a, DIM) + D.norm(b)),
        "dist_l2sq": partial(_pair, name="d", value=lambda a, b: D.l2_squared(a, b, DIM)),
        "dist_l2": partial(_pair, name="d", value=lambda a, b: D.distance("l2", a, b)),
        "dist_cosine": partial(_pair, name="d", value=lambda a, b: D.distance("cosine", a, b, DIM)),
        "dist_cosine_zero_vector": _zero,
        "log_current_view": _view,
        "payload_get_default": _payload_default,
        "knn_after_deletes": _alive_knn,
        "payload_merge_patch": _merge,
        "payload_delete_keys": _delete_keys,
        "vector_count": lambda s, d: mutation.vector_count(mutations(s, d)),
        "delete_stats": lambda s, d: mutation.delete_stats(mutations(s, d)).withColumn("tombstone_ratio", F.round("tombstone_ratio", 6)),
        "sq8_encode": _sq8_encode,
        "sq8_roundtrip_error": _sq8_error,
        "knn_sq8": _sq8_knn,
        "recall_at_k": _recall_at_k,
        "knn_graph_m8": _knn_graph,
        "graph_symmetrize": _symmetric,
        "graph_degree_cap": _capped,
        "level_histogram": _levels,
        "simhash_collisions": _collisions,
        "cell_search_all": _all_cells,
        "fvecs_roundtrip": _fvecs,
        "index_search": _index_search,
        "cell_search_after_deletes": _cells_after_writes,
        "graph_search_after_deletes": _graph_after_writes,
        "insert_duplicates": _duplicates,
        "graph_build": _graph_build,
        "rng_prune": _pruned,
        "rng_prune_backfill": _backfilled,
        "descent_recall": _descent_recall,
        "graph_search_recall": _graph_recall,
        "graph_search_filtered_recall": _graph_filtered,
        "cell_search_recall": _cells_recall,
        "sign_code_recall": _codes_recall,
    }
    return found | {name: partial(_filter, filter=f) for name, (f, _) in FILTERS.items()}


def oracle_sql() -> dict[str, str]:
    exact_sq8 = f"WITH c AS ({_DECODED_SQL}), s AS (SELECT q.vec_id AS qid, c.id, list_distance(c.back, q.embedding::DOUBLE[]) AS d FROM c, embeddings q WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM s)"
    found = {
        "knn_l2_top10": _knn_sql(10),
        "knn_cosine_top10": _knn_sql(10, "cosine"),
        "knn_l2_k1": _knn_sql(1),
        "knn_batch50": _knn_sql(10),
        "knn_k_gt_n": _knn_sql(100_000),
        "knn_expression_l2": _knn_sql(10),
        "knn_expression_cosine": _knn_sql(10, "cosine"),
        "knn_filtered_label": _knn_sql(10, where="v.label = 3"),
        "knn_filtered_pushed": _knn_sql(10, where="v.label IN (1, 2)"),
        "knn_filtered_selective": _knn_sql(5, where="v.label % 2 = 1 AND v.label >= 7"),
        "knn_filtered_few": _knn_sql(1000, where="v.label = 9"),
        "lineitem_knn_filtered": _LINEITEM_SQL,
        "radius_l2": _knn_sql(0, r=1.1),
        "knn_classify": _CLASSIFY_SQL,
        "dist_dot": _pair_sql("dot", "list_inner_product({a}, {b})"),
        "dist_norm": _pair_sql("norm", "sqrt(list_inner_product({a}, {a})) + sqrt(list_inner_product({b}, {b}))"),
        "dist_l2sq": _pair_sql("d", "list_distance({a}, {b}) ** 2"),
        "dist_l2": _pair_sql("d", "list_distance({a}, {b})"),
        "dist_cosine": _pair_sql("d", "list_cosine_distance({a}, {b})"),
        "dist_cosine_zero_vector": _ZERO_SQL,
        "log_current_view": f"SELECT id, round(embedding[1]::DOUBLE * sign, 6) AS first, payload FROM ({_STATE_SQL})",
        "payload_get_default": f"SELECT vec_id AS id, coalesce(s.payload, '{{}}') AS payload FROM embeddings LEFT JOIN ({_STATE_SQL}) s ON s.id = vec_id",
        "knn_after_deletes": _ALIVE_KNN_SQL,
        "payload_merge_patch": _MERGE_SQL,
        "payload_delete_keys": "SELECT vec_id AS id, CAST(NULL AS VARCHAR) AS label, '1' AS x, 'k' AS keep FROM embeddings",
        "vector_count": f"SELECT count(*) AS vectors FROM ({_STATE_SQL})",
        "delete_stats": """
WITH c AS (SELECT count(*) + count(*) FILTER (WHERE vec_id % 7 = 0) + count(*) FILTER (WHERE vec_id % 35 = 0) AS inserts,
  count(*) FILTER (WHERE vec_id % 5 <> 0 OR vec_id % 35 = 0) AS alive,
  count(*) FILTER (WHERE vec_id % 7 = 0 AND (vec_id % 5 <> 0 OR vec_id % 35 = 0)) AS updated_ids FROM embeddings)
SELECT inserts, inserts - alive AS tombstones, updated_ids, round((inserts - alive) / inserts, 6) AS tombstone_ratio FROM c""",
        "sq8_encode": f"SELECT id, array_to_string(q8, ',') AS q8 FROM ({_SQ8_SQL})",
        "sq8_roundtrip_error": f"SELECT id, round(list_max(list_transform(range(1, len(vec) + 1), lambda i: abs(vec[i] - back[i]))), 6) AS error FROM ({_DECODED_SQL})",
        "knn_sq8": exact_sq8 + " SELECT qid, id, rank, round(d, 6) AS distance FROM r WHERE rank <= 10",
        "recall_at_k": exact_sq8 + f", t AS ({_knn_sql(10)}) SELECT round((SELECT count(*) FROM r JOIN t ON r.qid = t.qid AND r.id = t.id WHERE r.rank <= 10) / (10.0 * (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0)), 6) AS recall",
        "knn_graph_m8": f"SELECT src, dst, round(d, 6) AS dist FROM ({_GRAPH_SQL})",
        "graph_symmetrize": f"SELECT src, dst, round(d, 6) AS dist FROM ({_BOTH_SQL})",
        "graph_degree_cap": f"SELECT src, dst, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS r FROM ({_BOTH_SQL})) WHERE r <= 6",
        "rng_prune": _pruned_sql(),
        "rng_prune_backfill": _pruned_sql(backfill=True),
        "level_histogram": _LEVELS_SQL,
        "simhash_collisions": _collisions_sql(),
        "cell_search_all": _knn_sql(10),
        "fvecs_roundtrip": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, len(embedding) AS dim, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
        "cell_search_after_deletes": _AFTER_WRITES_SQL,
        "insert_duplicates": _DUPLICATES_SQL,
        "index_search": _knn_sql(5, where="v.vec_id % 4 <> 0 AND v.label < 5"),
    }
    docs = "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE "
    return found | {name: docs + f"({condition})" for name, (_, condition) in FILTERS.items()}
