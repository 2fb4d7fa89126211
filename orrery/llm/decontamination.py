"""Benchmark decontamination with SimHash windows, multi-index Hamming blocks and exact verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which the fingerprints of an item and a window of that similarity may differ.
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
#: Of RADIUS differing bits, one block has no more than this.
NEAR = RADIUS // BLOCKS
#: Bytes of benchmark text that one pass over the documents holds in each task.
BYTES_PER_PASS = 8 << 20
_FILTER_BITS = 22
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 1 << 18


class _Words(dict):
    """Hash of each word, kept for the most recent words; emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, marks and digits."""
    return _WORD.findall(text.lower())


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """One hash for each run of ``width`` words."""
    n = len(words) - width + 1
    if n < 1:
        return words[:0]
    h = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        h = (h ^ words[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def window_prints(hashes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every run of ``width`` shingles, repeats included."""
    sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(_bits(hashes), axis=0, out=sums[1:])
    ones = sums[width:] - sums[:-width]
    return np.packbits(ones * 2 > width, axis=1).view(">u8").ravel().astype(np.uint64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater weights; a shingle's weight is its count."""
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(inverse[: len(a)], minlength=len(values))
    y = np.bincount(inverse[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def indexes(items: list[tuple[int, str]], cache: _Words) -> list[BenchmarkIndex]:
    """An index of the items of five words or more, and one for each lesser number of words, whose
    items are one shingle."""
    by_width: dict[int, list] = defaultdict(list)
    for item, text in items:
        words = np.array([cache[w] for w in words_of(text or "")], dtype=np.uint64)
        if len(words):
            by_width[min(SHINGLE, len(words))].append((item, words))
    return [BenchmarkIndex(own, width) for width, own in sorted(by_width.items())]


class BenchmarkIndex:
    """A bounded part of the benchmark: fingerprints in Hamming blocks, and the shingles of its items.

    Items of one number of shingles are a width, and windows of that width look them up: an item lies
    under every value of each 8-bit block that differs from its own in NEAR bits or fewer. Fingerprints
    that differ in RADIUS bits or fewer do so in one block at least, so that a look-up of a window's
    BLOCKS values finds every such item.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], shingle: int):
        """items: (id, word hashes), all of ``shingle`` words or more."""
        self.shingle = shingle
        self.ids = [item for item, _ in items]
        self.shingles = [shingle_hashes(words, shingle) for _, words in items]
        self.prints = np.array([window_prints(h, len(h))[0] for h in self.shingles], dtype=np.uint64)
        lengths = np.array([len(h) for h in self.shingles])
        self.widths, self.width_of = np.unique(lengths, return_inverse=True)
        near = np.array([sum(1 << i for i in c) for r in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), r)])
        own = block_values(self.prints)[:, :, None] ^ near
        bucket = (self.width_of[:, None, None] * BLOCKS + np.arange(BLOCKS)[:, None]) * (1 << BLOCK_BITS) + own
        order = np.argsort(bucket.ravel(), kind="stable")
        self.members = np.repeat(np.arange(len(items)), BLOCKS * len(near))[order]
        self.bounds = np.searchsorted(bucket.ravel()[order], np.arange(len(self.widths) * BLOCKS * (1 << BLOCK_BITS) + 1))
        # which widths have an item with a shingle
        pairs = np.unique(np.stack((np.concatenate(self.shingles), np.repeat(self.width_of, lengths).astype(np.uint64))), axis=1)
        self.known, first = np.unique(pairs[0], return_index=True)
        self.known_width, self.known_bounds = pairs[1].astype(np.int64), np.append(first, pairs.shape[1])
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.known >> np.uint64(64 - _FILTER_BITS)] = True

    def candidates(self, prints: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item), sorted: what shares a bucket of a block, for fingerprints of windows of the
        ``width``-th width."""
        bucket = (width * BLOCKS + np.arange(BLOCKS)) * (1 << BLOCK_BITS) + block_values(prints)
        low, count = self.bounds[bucket].ravel(), (self.bounds[bucket + 1] - self.bounds[bucket]).ravel()
        window = np.repeat(np.arange(len(prints)).repeat(BLOCKS), count)
        item = self.members[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        found = np.unique(window * len(self.ids) + item)
        return found // len(self.ids), found % len(self.ids)

    def places(self, hashes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """For each width the places of shingles that an item of that width has."""
        near = np.nonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])[0]
        k = np.searchsorted(self.known, hashes[near])
        k[k == len(self.known)] = 0
        same = self.known[k] == hashes[near]
        at: dict[int, list[int]] = defaultdict(list)
        for p, i in zip(near[same].tolist(), k[same].tolist()):
            for w in self.known_width[self.known_bounds[i] : self.known_bounds[i + 1]].tolist():
                at[w].append(p)
        yield from at.items()

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, differing bits) of the best window for each item
        that has a window of SIMILARITY or more. A window so similar to an item shares a shingle with it. So of
        each width only the windows with a shingle of an item of that width are fingerprinted, which
        loses nothing; which items a window may match, the blocks alone say."""
        hashes = shingle_hashes(words, self.shingle)
        best: dict[int, tuple[float, int, int, int]] = {}
        for w, at in self.places(hashes):
            width = min(int(self.widths[w]), len(hashes))
            for low, high in _runs(at, width, len(hashes)):
                prints = window_prints(hashes[low:high], width)
                window, item = self.candidates(prints, w)
                bits = np.bitwise_count(prints[window] ^ self.prints[item])
                close = bits <= RADIUS
                for s, k, n in zip(window[close].tolist(), item[close].tolist(), bits[close].tolist()):
                    alike = weighted_similarity(hashes[low + s : low + s + width], self.shingles[k])
                    if alike >= SIMILARITY and (k not in best or alike > best[k][0]):
                        best[k] = (alike, low + s, width, n)
        return [(self.ids[k], first, width + self.shingle - 1, alike, n) for k, (alike, first, width, n) in sorted(best.items())]


def block_values(prints: np.ndarray) -> np.ndarray:
    """The BLOCKS values of each fingerprint."""
    return (prints[:, None] >> np.arange(0, 64, BLOCK_BITS).astype(np.uint64)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)


def _runs(at: list[int], width: int, n: int) -> Iterator[tuple[int, int]]:
    """Spans of shingles that hold all windows over the places ``at``, in order, without overlap of windows."""
    low = high = None
    for p in at:
        first, last = max(0, p - width + 1), min(n, p + width)
        if high is not None and first <= high - width + 1:
            high = last
        else:
            if high is not None:
                yield low, high
            low, high = first, last
    if high is not None:
        yield low, high


def _passes(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of about ``most`` bytes of text, each read on its own."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // most)
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else benchmark
        yield [(r["item_id"], r["text"]) for r in part.distinct().toLocalIterator()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity, hamming): for each document and each
    benchmark item (item_id, text) that it holds, the best matching window.

    A window has as many five-word shingles as the item (a shorter document: all it has; an item of
    fewer words is one shingle); it
    matches at a weighted shingle similarity of 0.8 or more. All windows of the whole text compete;
    the first of equals wins. The benchmark is the query set: it is read in blocks of
    ``bytes_per_pass`` bytes of text, each in every task of one pass over the documents, so that what a
    task holds is bounded however large the benchmark is.
    Null and empty texts and items match nothing. Repeated documents give repeated results; repeated items
    count once, and items that share an id but not their text each give their own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    kind = "doc_id long, item_id long, first_word int, n_words int, similarity double, hamming int"
    out = None
    for block in _passes(items, bytes_per_pass):
        index = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(_scanner(index), kind)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], kind)


class _Scan:
    """What a task looks texts up in."""

    def __init__(self, items: list[tuple[int, str]]):
        self.cache = _Words()
        self.indexes = indexes(items, self.cache)

    def matches(self, text: str | None) -> list[tuple[int, int, int, float, int]]:
        words = words_of(text or "")
        hashes = np.array(list(map(self.cache.__getitem__, words)), dtype=np.uint64)
        return [m for index in self.indexes for m in index.matches(hashes)] if words else []


def _scanner(block):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = _Scan(block.value)
        for batch in batches:
            found = [(doc.as_py(), *m) for doc, text in zip(batch.column(0), batch.column(1)) for m in within.matches(text.as_py())]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            columns = list(zip(*found)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "item_id", "first_word", "n_words", "similarity", "hamming"],
            )

    return scan


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, by the rule of find_leaks(). Each
    row is judged by its own text where it is read, so that nothing is shuffled or joined."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    at = docs.columns.index(text_col)

    def kept(block):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            within = _Scan(block.value)
            for batch in batches:
                yield batch.filter(pa.array([not within.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return scan

    for block in _passes(items, BYTES_PER_PASS):
        docs = docs.mapInArrow(kept(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
