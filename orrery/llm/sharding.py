"""Shard placement through a prime-sized lookup table that shards fill in turns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default size of the table: a prime, over 500 slots for each of up to 128 shards.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, use: str) -> int:
    return int.from_bytes(hashlib.md5(f"{use}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[float] | None = None) -> list[int]:
    """The shard (its place in ``shards``) of each slot.

    Each shard has a permutation of the slots, (offset + j * skip) mod size, from hashes of its name.
    In turns, each claims the first free slot of its own. A shard of less weight than the heaviest
    passes over turns in proportion. Raises ValueError for no shard, repeated names, a weight that
    isn't positive, or a size that isn't a prime above the number of shards.
    """
    weights = list(weights) if weights is not None else [1.0] * len(shards)
    if not shards or len(set(shards)) < len(shards) or len(weights) != len(shards) or min(weights) <= 0:
        raise ValueError("shards need distinct names and positive weights")
    if not _is_prime(size) or size <= len(shards):
        raise ValueError("size must be a prime above the number of shards")
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    share, credit = [w / max(weights) for w in weights], [0.0] * len(shards)
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            credit[k] += share[k]
            if credit[k] < 1 - 1e-9:
                continue
            credit[k] -= 1
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 52 bits of the MD5 of its text, modulo ``size``. A null key has
    the slot of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % size


def place(rows: DataFrame, key_cols: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[float] | None = None) -> DataFrame:
    """(key columns, slot, shard): the shard of every row by its key.

    The table has ``size`` rows whatever the data: it is broadcast, and placing a row is one look-up
    without a shuffle. Several key columns are joined by a unit separator, so that a hot value of one
    is spread by the others. Other columns stay behind; repeated rows stay repeated.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(slot, shards[k]) for slot, k in enumerate(fill_table(shards, size, weights))], "slot long, shard string"
    )
    key = F.concat_ws("\x1f", *(F.col(c).cast("string") for c in key_cols)) if len(key_cols) > 1 else F.col(key_cols[0])
    keyed = rows.select(*key_cols).withColumn("slot", slot_of(key, size))
    return keyed.join(F.broadcast(table), "slot").select(*key_cols, "slot", "shard")
