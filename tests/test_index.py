import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.errors import InvalidArgument, NotFound
from orrery.functions.jsonops import merged
from orrery.operators import mutation
from orrery.plans.index import Index
from orrery.sources.vectors import dimension, read_blob, read_items, read_vectors, write_vectors


def log_of(spark, rows):
    full = [(i, s, op, v, p, p is not None) for i, s, op, v, p in rows]
    return spark.createDataFrame(full, mutation.LOG_SCHEMA)


def view_of(spark, rows):
    return {r["id"]: (list(r["vec"]), r["payload"]) for r in mutation.current_view(log_of(spark, rows)).collect()}


def test_latest_wins(spark):
    got = view_of(spark, [
        (1, 1, "upsert", [1.0], '{"a":1}'), (1, 2, "upsert", [2.0], None),  # keeps the payload
        (2, 1, "upsert", [1.0], '{"a":1}'), (2, 2, "upsert", [3.0], "{}"),  # replaces it
        (3, 1, "upsert", [1.0], '{"a":1}'), (3, 2, "delete", None, None),
        (4, 1, "upsert", [1.0], '{"a":1}'), (4, 2, "delete", None, None), (4, 3, "upsert", [4.0], None),  # the old one is gone
        (5, 1, "payload", None, '{"a":1}'), (5, 2, "upsert", [5.0], None),  # set on what wasn't alive
        (6, 1, "upsert", [6.0], None), (6, 2, "payload", None, '{"b":2}'),
        (7, 1, "delete", None, None),
    ])
    assert got == {1: ([2.0], '{"a":1}'), 2: ([3.0], "{}"), 4: ([4.0], None), 5: ([5.0], None), 6: ([6.0], '{"b":2}')}


def test_stats(spark):
    rows = [(i, 1, "upsert", [1.0], None) for i in range(10)] + [(3, 2, "upsert", [2.0], None), (5, 2, "delete", None, None)]
    got = mutation.delete_stats(log_of(spark, rows)).first()
    assert (got["inserts"], got["tombstones"], got["updated_ids"]) == (11, 2, 1) and abs(got["tombstone_ratio"] - 2 / 11) < 1e-9
    empty = mutation.delete_stats(log_of(spark, [])).first()
    assert (empty["inserts"], empty["tombstones"], empty["tombstone_ratio"]) == (0, 0, 0)


def test_merge_patch():
    assert merged({"a": 1}, {"b": 2}) == {"a": 1, "b": 2}
    assert merged({"a": 1, "b": 2}, {"a": None}) == {"b": 2}
    assert merged({"meta": {"x": 1, "y": 2}}, {"meta": {"y": 99, "z": 3}}) == {"meta": {"x": 1, "y": 99, "z": 3}}
    assert merged({"a": {"b": 1}}, {"a": 5}) == {"a": 5} and merged({"a": 5}, {"a": {"b": None}}) == {"a": {}}


@pytest.fixture
def index(spark, tmp_path):
    return Index.create(spark, f"file://{tmp_path}/index", 4)


def test_life_of_an_index(spark, index):
    index.insert(1, [1, 0, 0, 0], {"tenant": "acme", "count": 7})
    index.insert(2, [0, 1, 0, 0])
    index.insert(3, [0, 0, 1, 0], {"tags": ["py", "ml"]})
    assert index.count() == 3
    assert [r["id"] for r in index.search([1, 0, 0, 0], k=2)] == [1, 2]
    assert [r["id"] for r in index.search([1, 0, 0, 0], k=5, filter={"tenant": {"$exists": False}})] == [2, 3]
    with pytest.raises(NotFound):
        index.search([1, 0, 0, 0], filter={"tenant": "none"})
    index.update_payload(1, {"count": None, "new": {"a": 1}})
    assert json.loads(index.get_payload(1)) == {"tenant": "acme", "new": {"a": 1}}
    index.delete_payload_keys(1, ["tenant", "absent", "new.a"])
    assert json.loads(index.get_payload(1)) == {"new": {"a": 1}}
    index.set_payload(2, "{}")
    assert index.get_payload(2) == index.get_payload(99) == "{}"
    index.delete(3, 77)
    for call in (lambda: index.get(3), lambda: index.set_payload(3, {}), lambda: index.delete_payload_keys(3, ["a"]), lambda: index.update_payload(3, {})):
        with pytest.raises(NotFound):
            call()
    index.update(3, [0, 0, 0, 1])
    again = Index.open(spark, index.path)
    assert again.get(3) == [0, 0, 0, 1] and again.get_payload(3) == "{}" and again.describe()["dim"] == 4
    again.drop()
    with pytest.raises(NotFound):
        Index.open(spark, index.path)


@pytest.mark.parametrize("vec, payload, id_", [
    ([1, 2, 3], None, 0), ([1, 2, 3, float("nan")], None, 0), ([1, 2, 3, 4], "[]", 0), ([1, 2, 3, 4], "{", 0), ([1, 2, 3, 4], None, -1),
    ([1, 2, 3, 4], json.dumps({"a": "x" * 70_000}), 0),
])
def test_rejected_before_any_write(index, vec, payload, id_):
    with pytest.raises(InvalidArgument):
        index.insert(id_, vec, payload)
    assert index.count() == 0


def test_bad_requests(spark, index, tmp_path):
    with pytest.raises(InvalidArgument):
        Index.create(spark, index.path, 4)
    for call in (lambda: Index.create(spark, f"file://{tmp_path}/x", 0), lambda: Index.create(spark, f"file://{tmp_path}/x", 3, "dot"), lambda: Index.create(spark, f"file://{tmp_path}/x", 3, speed=1)):
        with pytest.raises(InvalidArgument):
            call()
    for call in (lambda: index.search([1, 2]), lambda: index.search([1, 2, 3, 4], k=0), lambda: index.search([1, 2, 3, 4], filter="{")):
        with pytest.raises(InvalidArgument):
            call()


def test_quantised_storage(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/q", 3, storage="sq8")
    index.insert(1, [0.1, 0.5, 0.9])
    assert np.abs(np.array(index.get(1)) - [0.1, 0.5, 0.9]).max() <= 0.8 / 255 / 2 + 1e-6


def test_batches_of_one_id(spark, index):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 0), (1, [2.0, 0.0, 0.0, 0.0], 1)], "id long, vec array<float>, pos long")
    index.insert_many(rows, "pos")
    assert index.get(1) == [2, 0, 0, 0] and index.count() == 1


def test_cells_of_an_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(100, 4)))], "id long, vec array<float>")
    index = Index.create(spark, f"file://{tmp_path}/c", 4, "cosine")
    index.insert_many(rows)
    index.build_cells(4)
    queries = rows.where("id < 5").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    exact = sorted((r["qid"], r["rank"], r["id"]) for r in index.search_many(queries, 3).collect())
    assert sorted((r["qid"], r["rank"], r["id"]) for r in index.search_cells(queries, 3, 4).collect()) == exact


@pytest.mark.parametrize("format, values", [("fvecs", [0.5, -1.25, 3.0]), ("bvecs", [0.0, 7.0, 255.0]), ("ivecs", [1, -2, 3])])
def test_vector_files(spark, tmp_path, format, values):
    kind = "int" if format == "ivecs" else "float"
    rows = spark.createDataFrame([(i, [values[(i + j) % 3] for j in range(3)]) for i in range(25)], f"id long, vec array<{kind}>")
    folder = f"file://{tmp_path}/{format}"
    write_vectors(rows, folder, format, partitions=3)
    assert dimension(spark, folder) == 3
    back = read_vectors(spark, folder, format)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_one_file_and_no_file(spark, tmp_path):
    path = tmp_path / "a.fvecs"
    path.write_bytes(b"".join(struct.pack("<i2f", 2, i, -i) for i in range(9)))
    assert [(r["id"], list(r["vec"])) for r in read_vectors(spark, str(path)).orderBy("id").collect()] == [(i, [i, -i]) for i in range(9)]
    (tmp_path / "b.fvecs").write_bytes(b"")
    assert read_vectors(spark, str(tmp_path / "b.fvecs")).count() == 0
    with pytest.raises(InvalidArgument):
        read_vectors(spark, str(tmp_path / "c.fvecs"))
    with pytest.raises(InvalidArgument):
        read_vectors(spark, str(tmp_path / "c.bin"))


def test_blob_and_items(spark, tmp_path):
    blob = tmp_path / "blob"
    blob.write_bytes(np.arange(6, dtype="<f4").tobytes() + b'[{"a":1},null,{}]')
    got = [(r["id"], list(r["vec"]), r["payload"]) for r in read_blob(spark, str(blob), 2, 3).orderBy("id").collect()]
    assert got == [(0, [0, 1], '{"a": 1}'), (1, [2, 3], None), (2, [4, 5], "{}")]
    items = tmp_path / "items.json"
    items.write_text("\n".join([
        '{"id":1,"vector":[1,2],"metadata":{"a":1}}', '{"id":2,"vector":[1,2],"metadata":"{\\"b\\":2}"}', '{"id":3,"vector":[1]}',
        '{"id":-4,"vector":[1,2]}', '{"id":5,"vector":[1,2],"metadata":""}', '{"id":6,"vector":[1,2],"metadata":null}', "not json",
    ]))
    rows = {r["id"]: r for r in read_items(spark, str(items), 2).collect()}
    assert json.loads(rows[1]["payload"]) == {"a": 1} and json.loads(rows[2]["payload"]) == {"b": 2} and rows[5]["payload"] is None
    assert all(rows[i]["error"] is None for i in (1, 2, 5)) and all(rows[i]["error"] for i in (3, -4, 6, None))


def test_stream(spark, index, tmp_path):
    from orrery.streaming.ingest import upsert_stream, windowed_counts

    rows = [(1, [1.0, 0.0, 0.0, 0.0], '{"v":1}'), (2, [0.0, 1.0], None), (3, [0.0, 0.0, 1.0, 0.0], None)]
    source = f"{tmp_path}/in"
    spark.createDataFrame(rows, "id long, vec array<float>, payload string").write.parquet(source)
    stream = spark.readStream.schema("id long, vec array<float>, payload string").parquet(source)
    query = upsert_stream(stream, index, f"{tmp_path}/state", f"{tmp_path}/bad")
    query.awaitTermination(60)
    assert index.count() == 2 and json.loads(index.get_payload(1)) == {"v": 1}
    assert spark.read.json(f"{tmp_path}/bad").count() == 1
    index.append_batch(spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.0], None)], "id long, vec array<float>, payload string"), "stream-0")
    assert index.count() == 2
    before = sorted(map(str, index.vectors.collect()))
    index.compact()
    assert sorted(map(str, index.vectors.collect())) == before and index.stats().first()["tombstones"] == 0
    index.append_batch(spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.0], None)], "id long, vec array<float>, payload string"), "stream-0")
    assert index.count() == 2
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(1).write.parquet(f"{tmp_path}/events")
    live = windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), "30 days", "1 day")
    running = live.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert spark.sql("select sum(n) from counted").first()[0] == events.count()


def test_command_line(spark, tmp_path):
    from orrery.cli import run

    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 8)).astype(np.float32)
    (tmp_path / "b.fvecs").write_bytes(b"".join(struct.pack("<i", 8) + v.tobytes() for v in base))
    (tmp_path / "q.fvecs").write_bytes(b"".join(struct.pack("<i", 8) + v.tobytes() for v in base[:5] + np.float32(0.01)))
    near = [np.argsort(((base - q) ** 2).sum(axis=1), kind="stable")[:3].astype("<i4") for q in base[:5] + np.float32(0.01)]
    (tmp_path / "t.ivecs").write_bytes(b"".join(struct.pack("<i", 3) + v.tobytes() for v in near))
    paths = [str(tmp_path / f) for f in ("b.fvecs", "q.fvecs", "t.ivecs")]
    report = run(spark, *paths, k=3, out=f"{tmp_path}/out")
    assert report["recall"] == 1.0 and report["results"] == 15 and spark.read.json(f"{tmp_path}/out").count() == 15
    assert run(spark, *paths[:2], k=3, cells=4, probes=4)["recall"] == 1.0


def test_written_tables_can_be_cleared(spark):
    from orrery.lineage import clear, cut_lineage, fresh_path

    rows = cut_lineage(spark.range(5).toDF("id"), "rows")
    assert rows.count() == 5 and spark.sparkContext.applicationId in fresh_path(spark, "x")
    path = rows.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    clear(spark)
    assert not os.path.exists(path)


def split_joins(spark, run):
    """The plan that ran, with joins that may not be broadcast and partitions that count as skewed early."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = run()
        out.collect()
        return out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_hot_id_of_the_log_is_split(spark):
    hot = spark.range(0, 40_000, 1, 8).selectExpr("if(id % 3 > 0, 7L, id) id", "id seq", "if(id % 1000 = 1, 'delete', 'upsert') op", "array(float(id)) vec", "string(null) payload", "false payload_set")
    assert "skew=true" in split_joins(spark, lambda: mutation._since_delete(hot))


def test_a_crash_between_the_renames_of_a_compaction(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/i", 2)
    index.insert(1, [1, 2])
    index.insert(1, [3, 4])
    index.insert(2, [5, 6])
    index.compact()
    assert index.get(1) == [3, 4] and index.count() == 2 and index.log.count() == 2
    (tmp_path / "i/log").rename(tmp_path / "i/log-compacted")
    again = Index.open(spark, f"file://{tmp_path}/i")
    assert again.get(2) == [5, 6] and again.count() == 2
    again.insert(3, [7, 8])
    assert again.log.agg({"seq": "max"}).first()[0] == 4


def test_duplicates_bulk_builds_and_extended_graphs(spark, tmp_path):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(120, 4)).astype(float).tolist()
    rows = spark.createDataFrame([(i, p, None) for i, p in enumerate(points[:100])], "id long, vec array<double>, payload string")
    index = Index.create(spark, f"file://{tmp_path}/i", 4, m=4, m_max=8)
    index.bulk_build(rows)
    with pytest.raises(InvalidArgument):
        index.bulk_build(rows)
    index.delete(*range(0, 20))
    index.insert_many(spark.createDataFrame([(i, p, "{}") for i, p in enumerate(points[100:], 100)] + [(30, [9.0] * 4, None), (30, [8.0, 9.0, 9.0, 9.0], "{}")], "id long, vec array<double>, payload string"))
    assert index.get(30) == [9, 9, 9, 9] and index.get_payload(30) == "{}"
    queries = spark.createDataFrame([(0, points[0]), (1, points[105]), (2, [9.0] * 4)], "qid long, qvec array<double>")
    truth = {(r["qid"], r["id"]) for r in index.search_many(queries, 5).collect()}
    for _ in ("before", "after the graph is extended"):
        found = {(r["qid"], r["id"]) for r in index.search_graph(queries, 5, 32).collect()}
        assert len(found & truth) >= 13 and not any(i < 20 for _, i in found) and (2, 30) in found and (1, 105) in found
        index.extend_graph()
    cells = {(r["qid"], r["id"]) for r in (index.build_cells(4), index.delete(105), index.search_cells(queries, 5, 4))[2].collect()}
    assert cells == {(r["qid"], r["id"]) for r in index.search_many(queries, 5).collect()} and (1, 105) not in cells
