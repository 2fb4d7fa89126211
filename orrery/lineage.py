"""Tables that iterative plans write between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidArgument

_own: dict[str, str] = {}

#: Bytes of the older tables of a walk that are kept.
KEEP_BYTES = 1 << 28
#: Spark's setting by which shuffle files go when the query that wrote them ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the setting is absent a temporary folder of this
    process stands in if driver and executors are that one process; on a cluster it's an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise InvalidArgument("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


def _own_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/orrery/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_path(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written between rounds. Tables that were read back from
    there can't be computed any more: call it when their results have been written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_path(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start at the written table,
    so it is computed once and survives the loss of any executor. What Spark shuffled for it is deleted then."""
    path, spark = fresh_path(df.sparkSession, name), df.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def keep_newest(written: list[tuple[str, int]], table: DataFrame) -> list[tuple[str, int]]:
    """(folder, bytes) of the tables that cut_lineage() wrote one from the other, ``table`` last, of which the oldest are
    deleted until the older ones have KEEP_BYTES at most."""
    files = table.inputFiles()
    if not files:
        return written
    jvm, folder = table.sparkSession.sparkContext._jvm, files[0].rsplit("/", 1)[0]
    system = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration())
    while sum(size for _, size in written) > KEEP_BYTES:
        system.delete(jvm.org.apache.hadoop.fs.Path(written.pop(0)[0]), True)
    return [*written, (folder, system.getContentSummary(jvm.org.apache.hadoop.fs.Path(folder)).getLength())]
