"""An index: a folder with a mutation log, its metadata, and the operations of the public interface."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotFound
from ..functions import distance as D
from ..functions import sq8
from ..functions.jsonops import MAX_PAYLOAD_BYTES
from ..lineage import cut_lineage
from ..operators import ann, mutation
from ..operators.ann import attach
from ..operators.graph import layered_graph
from ..operators.knn import filtered_knn, ranked

#: Option defaults.
DEFAULTS = {"m": 8, "m_max": 24, "ef_search": 128, "k": 10, "storage": "float32"}
STORAGES = ("float32", "sq8")


class Index:
    """Vectors of one dimension and metric, with JSON payloads.

    Everything is a table under ``path``: ``log`` (mutations, appended), ``meta`` (one JSON line) and
    what build() adds. The state is the current view of the log: the last write of an id wins.
    Distances under the storage ``sq8`` are those of the raw query to the quantised vectors.
    """

    def __init__(self, spark: SparkSession, path: str, meta: Mapping[str, Any]):
        self.spark, self.path, self.meta = spark, path.rstrip("/"), dict(meta)
        self.dim, self.metric = meta["dim"], meta["metric"]

    # Life cycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, metric: str = "l2", reinit: bool = False, **options) -> Index:
        """A new, empty index. InvalidArgument if there is one already and it isn't to be replaced."""
        if dim <= 0:
            raise InvalidArgument("dim must be positive")
        D.check_metric(metric)
        unknown = set(options) - set(DEFAULTS)
        if unknown or options.get("storage", "float32") not in STORAGES:
            raise InvalidArgument(f"unknown option {', '.join(unknown) or options['storage']}")
        index = cls(spark, path, {"dim": dim, "metric": metric, **DEFAULTS, **options})
        if index._exists() and not reinit:
            raise InvalidArgument(f"there is an index at {path}")
        spark.createDataFrame([], mutation.LOG_SCHEMA).withColumn("batch", F.lit("")).write.mode("overwrite").partitionBy("batch").parquet(f"{index.path}/log")
        for table in ("cells", "graph", "batches", "log-before", "log-compacted"):
            index._delete(table)
        spark.createDataFrame([(json.dumps(index.meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{index.path}/meta")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        index = cls(spark, path, {"dim": 0, "metric": "l2"})
        if not index._exists():
            raise NotFound(f"no index at {path}")
        index._recover()
        return cls(spark, path, json.loads(spark.read.text(f"{index.path}/meta").first()[0]))

    def drop(self) -> None:
        for table in ("log", "meta", "cells", "graph", "batches", "log-before", "log-compacted"):
            self._delete(table)

    def describe(self) -> dict[str, Any]:
        return {"path": self.path, **self.meta}

    def _hadoop(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, name: str = "meta") -> bool:
        system, where = self._hadoop(name)
        return system.exists(where)

    def _delete(self, name: str) -> None:
        system, where = self._hadoop(name)
        system.delete(where, True)

    # State

    @property
    def log(self) -> DataFrame:
        return self.spark.read.schema(mutation.LOG_SCHEMA + ", batch string").parquet(f"{self.path}/log").drop("batch")

    @property
    def vectors(self) -> DataFrame:
        """(id, vec, payload) of what is alive; vec as stored."""
        view = mutation.current_view(self.log)
        if self.meta.get("storage") == "sq8":
            view = view.withColumn("vec", sq8.decode(sq8.encode(F.col("vec"))))
        return view

    def stats(self) -> DataFrame:
        return mutation.delete_stats(self.log)

    def count(self) -> int:
        return mutation.vector_count(self.log).first()[0]

    # Mutation

    def validated(self, items: DataFrame) -> DataFrame:
        return mutation.validated(self._items(items), self.dim)

    def _items(self, items: DataFrame, order_col: str | None = None) -> DataFrame:
        payload = F.col("payload").cast("string") if "payload" in items.columns else F.lit(None).cast("string")
        kept = [F.col("ts")] if "ts" in items.columns else []
        kept += [F.col(order_col).cast("long").alias("_order")] if order_col else []
        return items.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"), payload.alias("payload"), *kept)

    def _next(self) -> int:
        return (self.log.agg(F.max("seq")).first()[0] or 0) + 1

    def _append(self, rows: DataFrame, batch: str) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{self.path}/log")

    def _rows(self, rows: Iterable[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    def insert(self, id: int, vec: Sequence[float], payload: str | Mapping | None = None) -> None:
        """Insert or replace one vector. Without a payload the old one stays."""
        self.insert_many(self._rows([(id, [float(x) for x in vec], _json(payload))], "id long, vec array<float>, payload string"))

    update = upsert = insert

    def insert_many(self, items: DataFrame, order_col: str | None = None) -> None:
        """Insert a table (id, vec[, payload]). All rows are checked before any is written. Rows of one
        id count in the order of ``order_col``; of those that are equal in it (all, without one) the
        greatest by vector, then payload, counts alone."""
        rows = self._items(items, order_col)
        mutation.check(rows.select("id", "vec", "payload"), self.dim)
        keys = ["id", "_order"] if order_col else ["id"]
        one = rows.groupBy(*keys).agg(F.max(F.struct("vec", "payload")).alias("one")).select(*keys, "one.vec", "one.payload")
        self._write_upserts(one, F.col("_order") if order_col else F.lit(0), "batch")

    def bulk_build(self, items: DataFrame, order_col: str | None = None) -> None:
        """Insert a table into an index without vectors and build its graph."""
        if self.log.where("op = 'upsert'").limit(1).count():
            raise InvalidArgument("a bulk build needs an empty index")
        self.insert_many(items, order_col)
        self.build_graph()

    def _write_upserts(self, rows: DataFrame, order, batch: str) -> None:
        seq = F.lit(self._next()).cast("long") + order
        self._append(mutation.upserts(rows.withColumn("seq_", seq), F.col("seq_")), batch)

    def append_batch(self, items: DataFrame, batch: str, order: str | None = None) -> None:
        """Append checked items under a batch name, once: a batch that is there already is left as it is."""
        if self._exists(f"log/batch={batch}") or self._exists(f"batches/{batch}"):
            return
        position = F.unix_micros(order) if order else F.pmod(F.xxhash64("vec"), F.lit(1 << 20))
        base = self._next()
        low = items.agg(F.min(position)).first()[0]
        if low is not None:
            seq = F.lit(base).cast("long") + position - F.lit(low)
            self._append(mutation.upserts(items, seq), batch)

    def compact(self) -> None:
        """Replace the log by the current view: what many small writes and dead versions cost readers
        goes, and so do the counts of versions. Nothing may be written meanwhile. The log is set aside
        before the new one takes its place, and goes last; open() ends what a crash has left."""
        view = mutation.current_view(self.log)
        rows = mutation.upserts(view, F.lit(self._next() - 1)).withColumn("batch", F.lit("compacted"))
        rows.write.mode("overwrite").partitionBy("batch").parquet(f"{self.path}/log-compacted")
        system, log = self._hadoop("log")
        for status in system.listStatus(log):  # a stream must still find the batches it has written
            name = status.getPath().getName().removeprefix("batch=")
            if name.startswith("stream-"):
                system.mkdirs(self._hadoop(f"batches/{name}")[1])
        self._delete("log-before")
        system.rename(log, self._hadoop("log-before")[1])
        self._recover()

    def _recover(self) -> None:
        if not self._exists("log") and self._exists("log-compacted"):
            system, log = self._hadoop("log")
            system.rename(self._hadoop("log-compacted")[1], log)
        if self._exists("log"):
            self._delete("log-before")

    def delete(self, *ids: int) -> None:
        """Delete ids; those that aren't alive don't matter."""
        self._append(mutation.deletes(self._rows([(i,) for i in ids], "id long"), F.lit(self._next())), "batch")

    def delete_many(self, ids: DataFrame) -> None:
        self._append(mutation.deletes(ids.select(F.col("id").cast("long").alias("id")), F.lit(self._next())), "batch")

    # Payloads

    def get_payload(self, id: int) -> str:
        found = self.vectors.where(F.col("id") == id).select("payload").first()
        return found["payload"] if found and found["payload"] is not None else "{}"

    def _alive(self, items: DataFrame) -> None:
        gone = items.select("id").join(self.vectors.select("id"), "id", "left_anti").first()
        if gone:
            raise NotFound(f"id {gone['id']} isn't alive")

    def set_payloads(self, items: DataFrame) -> None:
        """Replace payloads of a table (id, payload): all or none."""
        self._alive(items)
        bad = items.where(mutation.payload_error(F.col("payload")).isNotNull() | F.col("payload").isNull()).first()
        if bad:
            raise InvalidArgument(f"id {bad['id']}: a payload must be a JSON object of at most {MAX_PAYLOAD_BYTES} bytes")
        self._append(mutation.payloads(items.select(F.col("id").cast("long").alias("id"), "payload"), F.lit(self._next())), "batch")

    def set_payload(self, id: int, payload: str | Mapping) -> None:
        self.set_payloads(self._rows([(id, _json(payload))], "id long, payload string"))

    def update_payload(self, id: int, patch: str | Mapping) -> None:
        """Merge patch on one payload."""
        self._alive(self._rows([(id,)], "id long"))
        patches = self._rows([(id, _json(patch))], "id long, patch string")
        own = self.vectors.where(F.col("id") == id)
        self.set_payloads(self._rows([tuple(r) for r in mutation.patch_payloads(own, patches).collect()], "id long, payload string"))

    def delete_payload_keys(self, id: int, keys: list[str]) -> None:
        """Remove top-level keys of one payload; NotFound if it has none."""
        own = mutation.delete_payload_keys(self.vectors.where(F.col("id") == id), keys).collect()
        if not own:
            raise NotFound(f"id {id} has no payload")
        self.set_payloads(self._rows([tuple(r) for r in own], "id long, payload string"))

    # Reading and search

    def get(self, id: int) -> list[float]:
        found = self.vectors.where(F.col("id") == id).select("vec").first()
        if found is None:
            raise NotFound(f"id {id} isn't alive")
        return list(found["vec"])

    def get_many(self, ids: DataFrame) -> DataFrame:
        return self.vectors.join(ids.select("id").distinct(), "id", "left_semi")

    def search(self, query: Sequence[float], k: int | None = None, filter: str | Mapping | None = None, ef_search: int | None = None, max_scan: int = 0) -> list[dict[str, Any]]:
        """The k nearest as [{id, distance}]; NotFound if nothing qualifies. Exact, so that ef_search
        and max_scan are accepted and without effect."""
        self._check_query(query, k)
        queries = self._rows([(0, [float(x) for x in query])], "qid long, qvec array<double>")
        rows = self.search_many(queries, k, filter).orderBy("rank").collect()
        if not rows:
            raise NotFound("no neighbours")
        return [{"id": r["id"], "distance": r["distance"]} for r in rows]

    def _check_query(self, query: Sequence[float], k: int | None) -> None:
        if len(query) != self.dim:
            raise InvalidArgument(f"query must have {self.dim} elements")
        if k is not None and k <= 0:
            raise InvalidArgument("k must be positive")

    def search_many(self, queries: DataFrame, k: int | None = None, filter: str | Mapping | None = None) -> DataFrame:
        """(qid, id, rank, distance) of a table of queries (qid, qvec)."""
        return filtered_knn(self.vectors, queries, k or self.meta["k"], filter, self.metric)

    # Approximate search

    def _touched(self, seq: int) -> DataFrame:
        """The ids that were written after ``seq``."""
        return self.log.where(F.col("seq") > seq).select("id").distinct()

    def _with_fresh(self, found: DataFrame, touched: DataFrame, queries: DataFrame, k: int, filter: str | Mapping | None) -> DataFrame:
        """The k nearest of what an index of older vectors found and of the vectors written since, which are scanned."""
        fresh = mutation.current_view(self.log.join(touched, "id", "left_semi"))
        if self.meta.get("storage") == "sq8":
            fresh = fresh.withColumn("vec", sq8.decode(sq8.encode(F.col("vec"))))
        both = found.select("qid", "id", "distance").unionByName(filtered_knn(fresh, queries, k, filter, self.metric).select("qid", "id", "distance"))
        return ranked(both, k)

    def build_cells(self, cells: int) -> None:
        """Cluster the vectors into cells, each a partition of a table."""
        vectors, seq = self.vectors, self._next() - 1
        centres = ann.fit_cells(vectors, cells, self.metric)
        ann.assign_cells(vectors, centres, self.metric).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/cells/rows")
        self.spark.createDataFrame([(i, c.tolist(), seq) for i, c in enumerate(centres)], "cell int, centre array<double>, seq long").write.mode("overwrite").parquet(f"{self.path}/cells/centres")

    def search_cells(self, queries: DataFrame, k: int, probes: int, filter: str | Mapping | None = None) -> DataFrame:
        """(qid, id, rank, distance): the k nearest in the ``probes`` nearest cells and among all that was
        written since build_cells(). Deleted and replaced vectors are no candidates."""
        import numpy as np

        centres = self.spark.read.parquet(f"{self.path}/cells/centres").orderBy("cell").collect()
        if not centres:
            return self.search_many(queries, k, filter)
        touched = self._touched(centres[0]["seq"])
        rows = self.spark.read.parquet(f"{self.path}/cells/rows").join(touched, "id", "left_anti")
        found = ann.cell_search(rows, np.array([r["centre"] for r in centres]), queries, k, probes, self.metric, filter)
        return self._with_fresh(found, touched, queries, k, filter)

    def _write_graph(self, edges: DataFrame, nodes: DataFrame, seq: int) -> None:
        """A version of its own; the graph is the one of the greatest seq that is whole (its edges come last)."""
        nodes.select("id", "vec").write.mode("overwrite").parquet(f"{self.path}/graph/nodes/seq={seq}")
        edges.write.mode("overwrite").parquet(f"{self.path}/graph/edges/seq={seq}")

    def _graph(self) -> tuple[DataFrame, DataFrame, int]:
        edges = self.spark.read.parquet(f"{self.path}/graph/edges")
        seqs = [int(s.getPath().getName()[4:]) for s in self._listed("graph/edges") if self._exists(f"graph/edges/{s.getPath().getName()}/_SUCCESS")]
        seq = max(seqs)
        return edges.where(F.col("seq") == seq).drop("seq"), self.spark.read.parquet(f"{self.path}/graph/nodes/seq={seq}"), seq

    def _listed(self, name: str) -> list:
        system, where = self._hadoop(name)
        return [s for s in system.listStatus(where) if s.getPath().getName().startswith("seq=")]

    def build_graph(self) -> None:
        """A layered graph of all vectors."""
        seq, nodes = self._next() - 1, cut_lineage(self.vectors.select("id", "vec"), "nodes")
        self._write_graph(layered_graph(nodes, self.meta["m"], self.meta["m_max"], self.metric), nodes, seq)

    def extend_graph(self) -> None:
        """Attach the vectors written since the graph was built or last extended: each is linked with its
        nearest, or in large graphs with diverse ones of the nodes that a search finds. What was deleted or replaced
        leaves the graph, and its neighbours are linked with one another's nearest."""
        edges, nodes, since = self._graph()
        seq, touched = self._next() - 1, cut_lineage(self._touched(since), "touched")
        fresh = cut_lineage(mutation.current_view(self.log.join(touched, "id", "left_semi")).select("id", "vec"), "fresh")
        edges, nodes = attach(edges, nodes, touched, fresh, self.meta["m"], self.meta["m_max"], self.meta["ef_search"], self.metric)
        self._write_graph(edges, nodes, seq)

    def search_graph(self, queries: DataFrame, k: int, ef_search: int | None = None, filter: str | Mapping | None = None, max_scan: int = 0) -> DataFrame:
        """(qid, id, rank, distance) by walks on the graph, and among all that was written since it was
        built or extended. Vectors deleted or replaced since are walked through, but not returned. Without a filter a beam of
        ``ef_search`` is the first of a few, each wider, until a query's nearest stay the same."""
        edges, nodes, seq = self._graph()
        touched = self._touched(seq)
        payloads = self.vectors.select("id", "payload") if filter is not None else None
        rows = nodes.join(touched.withColumn("_gone", F.lit(True)), "id", "left").withColumn("alive", F.col("_gone").isNull()).drop("_gone")
        if payloads is not None:
            rows = rows.join(payloads, "id", "left")
        found = ann.graph_search(edges, rows, queries, k, ef_search or self.meta["ef_search"], self.metric, filter, max_scan, self.dim, steady=True)
        return self._with_fresh(found, touched, queries, k, filter)


def _json(payload: str | Mapping | None) -> str | None:
    """Text as it is; an object as JSON; None is no payload, and so is empty text."""
    if payload is None or payload == "":
        return None
    return payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
