"""SimHash near-duplicates found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut_lineage
from .golay import decode_table, nearby_indices

SHINGLE, SEED, RADIUS = 3, 42, 3
_SLICE = 1 << 15
#: (shift, bits) of the three segments of a fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the whole text: A-Z lower-cased, words split at space and \\t-\\r, three-word
    shingles with repeats (fewer words: the whole sequence), a bit set if over half the XXH64 have it.
    Null, empty and blank texts give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _SLICE):
        part = words[at : at + _SLICE + SHINGLE - 1]
        grams = map(join, zip(*(part[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [join(part)]
        hashes = np.array([digest(g, SEED) for g in grams], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row for each row of ``docs``, fp as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _emit(pattern: int, parts: list[tuple[np.ndarray, np.ndarray, int]], fp: np.ndarray, left: bool):
    """Rows of one pattern: the product of (row, value) lists, each list sorted by row."""
    row, key = np.arange(len(fp)), np.full(len(fp), pattern, dtype=np.int64)
    for of, value, bits in parts:
        first, last = np.searchsorted(of, row, "left"), np.searchsorted(of, row, "right")
        count = last - first
        take = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        key = (np.repeat(key, count) << bits) | value[take].astype(np.int64)
        row = np.repeat(row, count)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(fp[row]), pa.array(np.full(len(row), left))], names=["key", "fp", "is_left"]
    )


def _golay_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of both sides of the candidate join.

    At most 3 errors over three segments leave one of two cases. Some segment has none, and then
    one of the others has one at most: an exact segment with a decoded one, for each ordered pair.
    Or each segment has one: all three decoded. Where a segment may have an error, one side gives
    the index of its own word and the other the indices of its word and all words one bit away.
    """
    table = decode_table()
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            fp = whole.column(0).slice(at, 2048).to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            words = [((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int32) for s, n in SEGMENTS]
            here = np.arange(len(fp))
            exact = [(here, w, 23) for w in words]
            own = [(here, table[w], 12) for w in words]
            near = [(*nearby_indices(w, n), 12) for w, (_, n) in zip(words, SEGMENTS)]
            pattern = 1
            for i in range(3):
                for j in range(3):
                    if i != j:
                        yield _emit(pattern, [exact[i], near[j]], fp, True)
                        yield _emit(pattern, [exact[i], own[j]], fp, False)
                        pattern += 1
            yield _emit(pattern, [near[0], own[1], near[2]], fp, True)
            yield _emit(pattern, [own[0], near[1], own[2]], fp, False)


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct values of ``prints.fp`` that differ in 1 to 3 bits."""
    keys = prints.select("fp").mapInArrow(_golay_keys, "key long, fp long, is_left boolean")
    keys = cut_lineage(keys, "golay-keys")
    left = keys.where("is_left").select("key", F.col("fp").alias("a"))
    right = keys.where("not is_left").select("key", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return left.join(right, (left["key"] == right["key"]) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Documents whose fingerprints differ in 3 bits or fewer are linked; component_id is the smallest
    id that a document reaches. Copies meet first (one row a fingerprint, by partial aggregation),
    so that neither the candidate join nor the components see a group of equal fingerprints.
    Repeated rows stay repeated; a null id is passed over when the smallest is sought (a component
    without any id has a null component_id); an empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = connected_components(links(groups), "a", "b").withColumnsRenamed({"node": "fp"})
    rooted = groups.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted, "rooted")
    moved = rooted.where("fp <> root").groupBy("root").agg(F.min("least_id").alias("least_moved"))
    own = groups.select(F.col("fp").alias("root"), F.col("least_id").alias("own"))
    least = moved.join(own, "root").select("root", F.least("least_moved", "own").alias("component_id"))
    least = cut_lineage(least, "least-ids")  # a side of its own, or the join couldn't be split on a large component
    of_print = (
        rooted.join(least, "root", "left")
        .select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    )
    return prints.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are near-duplicates of one with a smaller id.

    Rows without an id stay, as do repeated rows of a kept id."""
    found = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    found = found.distinct()
    return docs.join(found, docs[id_col] == found["_gone"], "left_anti")
