"""The mutation log of an index and what follows from it: the current view, payloads, counts.

The log has (id, seq, op, vec, payload, payload_set): op is upsert, delete or payload; payload_set
tells whether the row carries a payload, {} included. The row of the greatest seq wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.jsonops import delete_keys, merge_patch, payload_error
from ..lineage import cut_lineage

LOG_SCHEMA = "id long, seq long, op string, vec array<float>, payload string, payload_set boolean"
_COLUMNS = ("id", "seq", "op", "vec", "payload", "payload_set")


def vector_error(vec: Column, dim: int) -> Column:
    """Why a vector can't be stored; null if it can."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vec.isNull(), F.lit("vector is missing"))
        .when(F.size(vec) != dim, F.lit(f"vector must have {dim} elements"))
        .when(odd, F.lit("vector has an element that isn't finite"))
    )


def id_error(id_: Column) -> Column:
    return F.when(id_.isNull() | (id_ < 0), F.lit("id must be 0 or more"))


def validated(items: DataFrame, dim: int) -> DataFrame:
    """``items`` (id, vec, payload) with error, null for rows that may be inserted."""
    return items.withColumn("error", F.coalesce(id_error(F.col("id")), vector_error(F.col("vec"), dim), payload_error(F.col("payload"))))


def check(items: DataFrame, dim: int) -> None:
    """Raise InvalidArgument with the first errors if any of ``items`` is invalid: all are checked
    before any is written."""
    bad = validated(items, dim).where("error is not null").select("id", "error").limit(3).collect()
    if bad:
        raise InvalidArgument("; ".join(f"id {r['id']}: {r['error']}" for r in bad))


def upserts(items: DataFrame, seq: Column) -> DataFrame:
    """Log rows of (id, vec, payload): a null payload keeps the old one."""
    return items.select("id", seq.cast("long").alias("seq"), F.lit("upsert").alias("op"), "vec", "payload", F.col("payload").isNotNull().alias("payload_set"))


def deletes(ids: DataFrame, seq: Column) -> DataFrame:
    none = F.lit(None)
    return ids.select("id", seq.cast("long").alias("seq"), F.lit("delete").alias("op"), none.cast("array<float>").alias("vec"), none.cast("string").alias("payload"), F.lit(False).alias("payload_set"))


def payloads(items: DataFrame, seq: Column) -> DataFrame:
    """Log rows that replace payloads, of (id, payload)."""
    return items.select("id", seq.cast("long").alias("seq"), F.lit("payload").alias("op"), F.lit(None).cast("array<float>").alias("vec"), "payload", F.lit(True).alias("payload_set"))


def _since_delete(log: DataFrame) -> DataFrame:
    """The rows of each id after its last delete.

    The last deletes are sums of partial sums, and a written table: a side of its own, or the join
    couldn't be split on a hot id."""
    last = cut_lineage(log.where("op = 'delete'").groupBy("id").agg(F.max("seq").alias("_deleted")), "last-deletes")
    return log.join(last, "id", "left").where("_deleted is null or seq > _deleted").drop("_deleted")


def current_view(log: DataFrame) -> DataFrame:
    """(id, vec, payload) of the ids that are alive: the vector of the last upsert, and the last
    payload that was set since the last delete while the id was alive (null if there is none)."""
    rows = _since_delete(log.select(*_COLUMNS))
    upsert = F.col("op") == "upsert"
    # A payload that comes before the first upsert was set on an id that wasn't alive: it counts for nothing.
    return (
        rows.groupBy("id")
        .agg(
            F.max_by("vec", F.when(upsert, F.col("seq"))).alias("vec"),
            F.max_by(F.struct("payload", "seq"), F.when(F.col("payload_set"), F.col("seq"))).alias("_set"),
            F.min(F.when(upsert, F.col("seq"))).alias("_first"),
        )
        .where("_first is not null")
        .select("id", "vec", F.when(F.col("_set.seq") >= F.col("_first"), F.col("_set.payload")).alias("payload"))
    )


def get_payloads(view: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, payload) of each requested id; {} for one without payload and for one that isn't alive."""
    own = view.select("id", "payload")
    return ids.select("id").join(own, "id", "left").select("id", F.coalesce("payload", F.lit("{}")).alias("payload"))


def patch_payloads(view: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, payload) after merge patches (id, patch) on ids that are alive."""
    both = view.select("id", "payload").join(patches.select("id", "patch"), "id")
    return both.select("id", merge_patch(F.col("payload"), F.col("patch")).alias("payload"))


def delete_payload_keys(view: DataFrame, keys: list[str]) -> DataFrame:
    """(id, payload) of the rows with a payload, without these top-level keys."""
    return view.where("payload is not null").select("id", delete_keys(F.col("payload"), keys).alias("payload"))


def vector_count(log: DataFrame) -> DataFrame:
    return current_view(log).agg(F.count("*").alias("vectors"))


def delete_stats(log: DataFrame) -> DataFrame:
    """One row: inserts (all versions written), tombstones (versions that aren't current), updated
    ids (alive, of more than one version since the last delete) and the ratio of tombstones."""
    written = F.sum((F.col("op") == "upsert").cast("long"))
    all_ = log.groupBy("id").agg(written.alias("n"))
    live = _since_delete(log).groupBy("id").agg(written.alias("m")).where("m > 0")
    both = all_.join(live, "id", "left")
    inserts, alive = F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.when(F.col("m").isNotNull(), 1).otherwise(0))
    tombstones = inserts - F.coalesce(alive, F.lit(0))
    updated = F.coalesce(F.sum(F.when(F.col("n") > 1, F.when(F.col("m").isNotNull(), 1)).otherwise(0)), F.lit(0))
    return both.agg(inserts.alias("inserts"), tombstones.alias("tombstones"), updated.alias("updated_ids")).withColumn(
        "tombstone_ratio", F.when(F.col("inserts") > 0, F.col("tombstones") / F.col("inserts")).otherwise(F.lit(0.0))
    )
