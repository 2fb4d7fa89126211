"""Vector files: fvecs, bvecs and ivecs (a little-endian int32 length before each record's elements),
raw float32 blobs, and JSON items."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators.mutation import validated

#: The element type of each format.
FORMATS = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}


def format_of(path: str) -> str:
    for name in FORMATS:
        if path.rstrip("/").endswith("." + name):
            return name
    raise InvalidArgument(f"the format of {path} must be told; there are {', '.join(FORMATS)}")


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files at a path: itself, or the data files of a folder, in order of name."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise InvalidArgument(f"no such path: {path}")
    if not system.getFileStatus(where).isDirectory():
        return [path]
    found = [s.getPath() for s in system.listStatus(where) if s.isFile()]
    return sorted(p.toString() for p in found if not p.getName().startswith(("_", ".")))


def dimension(spark: SparkSession, path: str) -> int:
    """The length of the first record; 0 for a file without any."""
    jvm = spark.sparkContext._jvm
    for file in _files(spark, path):
        where = jvm.org.apache.hadoop.fs.Path(file)
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            head = [stream.read() for _ in range(4)]
        finally:
            stream.close()
        if min(head) >= 0:
            return struct.unpack("<i", bytes(head))[0]
    return 0


def read_vectors(spark: SparkSession, path: str, format: str | None = None, first_id: int = 0) -> DataFrame:
    """(id long, vec array) of a file or folder; ids are the records' ordinals in file order.

    All records have one length, so files are split at record boundaries and read in parallel from
    any file system that Spark reaches. Elements are floats (fvecs, bvecs) or ints (ivecs).
    """
    format = format or format_of(path)
    dim, kind = dimension(spark, path), np.dtype(FORMATS[format])
    element = "int" if format == "ivecs" else "float"
    schema = f"id long, vec array<{element}>"
    if dim <= 0:
        return spark.createDataFrame([], schema)
    size = 4 + dim * kind.itemsize
    out, start = None, first_id
    for file in _files(spark, path):
        part = _records(spark, file, size, start).toDF("id long, data binary").mapInArrow(_decoder(dim, kind, element), schema)
        out = part if out is None else out.unionByName(part)
        start += _length(spark, file) // size
    return out


def _length(spark: SparkSession, file: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def _records(spark: SparkSession, file: str, size: int, start: int):
    """(ordinal, bytes) of fixed-size records: the one input format that splits such files."""
    rdd = spark.sparkContext.newAPIHadoopFile(
        file, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(size)},
    )
    return rdd.map(lambda kv: (start + kv[0], bytes(kv[1])))


def _decoder(dim: int, kind: np.dtype, element: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join(batch.column(1).to_pylist())
            rows = np.frombuffer(data, dtype=np.uint8).reshape(batch.num_rows, -1)
            if (rows[:, :4].copy().view("<i4").ravel() != dim).any():
                raise ValueError("records differ in length")
            values = rows[:, 4:].copy().view(kind).astype(np.int32 if element == "int" else np.float32).ravel()
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["id", "vec"])

    return decode


def write_vectors(df: DataFrame, folder: str, format: str = "fvecs", id_col: str = "id", vec_col: str = "vec", partitions: int | None = None) -> None:
    """Write vectors in the order of their ids as files part-00000.<format> ... in ``folder``, a URI
    that executors reach. Each task writes under a name of its own and renames when it is done."""
    if format not in FORMATS:
        raise InvalidArgument(f"unknown format {format!r}")
    kind = np.dtype(FORMATS[format])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"{path}/part-{context.partitionId():05d}.{format}"
        temporary, n = f"{path}/_part-{context.partitionId():05d}.{context.taskAttemptId()}", 0
        with system.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                for vec in batch.column(0):
                    own = np.asarray(vec.as_py(), dtype=kind)
                    out.write(struct.pack("<i", len(own)) + own.tobytes())
                    n += 1
        if n:
            system.move(temporary, name)
        else:
            system.delete_file(temporary)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    rows = rows.repartitionByRange(partitions, id_col) if partitions else rows.repartitionByRange(id_col)
    rows.sortWithinPartitions(id_col).select(F.col(vec_col)).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_blob(spark: SparkSession, path: str, dim: int, n: int | None = None) -> DataFrame:
    """(id, vec, payload) of blobs of n * dim float32, each optionally followed by a JSON array of n
    objects or nulls: the payloads. Without ``n`` all bytes are vectors. Ids are positions in a blob."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                count = n if n is not None else len(data) // (4 * dim)
                values, tail = np.frombuffer(data[: count * dim * 4], dtype="<f4"), data[count * dim * 4 :].strip()
                if len(values) != count * dim or (n is None and tail):
                    raise ValueError("the blob's size doesn't fit")
                given = json.loads(tail) if tail else [None] * count
                if len(given) != count or not all(x is None or isinstance(x, dict) for x in given):
                    raise ValueError("payloads must be one object or null for each vector")
                text = [None if x is None else json.dumps(x, ensure_ascii=False) for x in given]
                offsets = pa.array(np.arange(count + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(count)), pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(text, pa.string())], names=["id", "vec", "payload"]
                )

    blobs = spark.read.format("binaryFile").load(path).select("content")
    return blobs.mapInArrow(rows, "id long, vec array<float>, payload string")


def read_items(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, vec, payload, error) of JSON lines {"id": .., "vector": [..], "metadata": {..}}: error is
    null for items that may be inserted. A metadata string is taken as JSON text, the empty string as
    absent."""
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("item"), "value").where("trim(value) <> ''")
    get = lambda p, t: F.try_variant_get("item", p, t)
    metadata = get("$.metadata", "variant")
    is_text = F.schema_of_variant(metadata) == "STRING"
    payload = F.when(is_text, F.nullif(get("$.metadata", "string"), F.lit(""))).otherwise(F.to_json(metadata))
    rows = lines.select(get("$.id", "bigint").alias("id"), get("$.vector", "array<float>").alias("vec"), payload.alias("payload"))
    return validated(rows, dim)
