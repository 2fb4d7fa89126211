"""Cross-entropy difference of two n-gram models over one vocabulary."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Words of the shared vocabulary; all others are one unknown word.
VOCABULARY = 1 << 15
#: Cells that count the pairs of following words.
CELLS = 1 << 18
#: Pseudo-counts of a word's and a pair's lower-order estimate.
WORD_PRIOR, PAIR_PRIOR = 0.5, 4.0
#: Target ids that are sent to every task; more are joined.
BROADCAST_IDS = 1_000_000
#: Text that is counted, and later scored, at once.
BLOCK_BYTES = 8 << 20
_FLUSH = 1 << 18


def words_of(text: bytes) -> list[bytes]:
    return text.split()


@dataclass(frozen=True)
class Models:
    """word_loss and pair counts of the target (0) and background (1) models. Bounded by VOCABULARY
    and CELLS alone. Words have ids 1 ..; 0 is the unknown word and the start of a text."""

    ids: dict[bytes, int]
    words: np.ndarray  # 2 x (vocabulary + 1)
    cells: np.ndarray  # 2 x cells

    def losses(self, text: bytes) -> np.ndarray:
        """2 x tokens: the loss in bits of each token under both models, given the token before it.

        p(w | v) = (c(v, w) + k p(w)) / (c(v) + k), where c(v, w) is the least of the count of the
        pair's cell and the counts of its words, and p(w) = (c(w) + a) / (n + a |V|).
        """
        tokens = words_of(text)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in tokens), dtype=np.int64, count=len(tokens))
        before = np.concatenate(([0], ids[:-1])) if len(ids) else ids
        pair = self.cells[:, cell_of(before, ids, self.cells.shape[1])]
        word, prior = self.words[:, ids], self.words[:, before]
        total = self.words.sum(axis=1, keepdims=True)
        single = (word + WORD_PRIOR) / (total + WORD_PRIOR * self.words.shape[1])
        pair = np.minimum(pair, np.minimum(word, prior))
        return -np.log2((pair + PAIR_PRIOR * single) / (prior + PAIR_PRIOR))


def cell_of(before: np.ndarray, ids: np.ndarray, cells: int) -> np.ndarray:
    h = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(cells)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) >= _FLUSH:
                yield rows(counts)
                counts = Counter()
    if counts:
        yield rows(counts)


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> list[bytes]:
    """The most frequent words of all ``texts`` (text binary), by count and then by word: all that
    have the least count or more which leaves ``size`` of them or fewer. So words of one count are in
    or out together, no order over all words is needed, and the driver gets these words alone and
    how many words have each count."""
    counts = texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts, "words")
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).toArrow().to_pydict()
    least, kept = None, 0
    for n, words in sorted(zip(by_count["n"], by_count["words"]), reverse=True):
        kept += words
        if kept > size:
            break
        least = n
    if least is None:
        return []
    found = counts.where(F.col("n") >= least).toArrow().to_pydict()
    return [w for _, w in sorted((-n, w) for n, w in zip(found["n"], found["word"]))]


def _counter(ids, cells: int, wanted=None):
    """Counts of (text, target), or of (text, id) with the target's ids in ``wanted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids.value
        words = np.zeros((2, len(known) + 1), dtype=np.int64)
        pairs = np.zeros((2, cells), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                tokens = [words_of(t.as_py()) for t in batch.column(0).slice(at, 1024)]
                told = batch.column(1).slice(at, 1024)
                if wanted is None:
                    target = np.array([bool(t) for t in told.to_pylist()], dtype=bool)
                else:
                    target = np.isin(told.fill_null(-1).to_numpy(), wanted.value) & ~told.is_null().to_numpy(zero_copy_only=False)
                size = [len(t) for t in tokens]
                own = np.fromiter((known.get(w, 0) for t in tokens for w in t), dtype=np.int64, count=sum(size))
                before = np.concatenate(([0], own[:-1])) if len(own) else own
                starts = np.cumsum([0, *size[:-1]])[np.array(size) > 0]
                before[starts] = 0
                cell, good = cell_of(before, own, cells), np.repeat(target, size)
                for model, chosen in ((0, good), (1, slice(None))):
                    words[model] += np.bincount(own[chosen], minlength=words.shape[1])
                    pairs[model] += np.bincount(cell[chosen], minlength=cells)
        for pair, table in ((False, words), (True, pairs)):
            at = np.nonzero(table[1])[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), pair)), pa.array(at.astype(np.int32)), pa.array(table[0, at]), pa.array(table[1, at])],
                names=["pair", "at", "target", "background"],
            )

    return count


def train(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = VOCABULARY, cells: int = CELLS) -> Models:
    """Both models from all of ``docs``: the background from every text, the target from the texts
    whose id is in ``target_ids`` (doc_id).

    Counts of words, and then of words and pairs within the vocabulary, are summed up in Spark; the
    driver gets the vocabulary and the two tables, whose sizes are parameters. Up to BROADCAST_IDS
    target ids go to the tasks, so that no text is shuffled; more are joined with the texts. The models are
    matched: one vocabulary, order and smoothing, and the background counts are scaled to the number
    of tokens of the target. Null texts and ids count for nothing in the target.
    """
    text = F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text")
    words = vocabulary(docs.select(text), size)
    ids = {w: i for i, w in enumerate(words, 1)}
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ids)
    chosen = target_ids.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    few = chosen.limit(BROADCAST_IDS + 1).toArrow().column(0).to_numpy()
    rows = docs.select(text, F.col(id_col).cast("long").alias("_id"))
    if len(few) <= BROADCAST_IDS:
        counter = _counter(held, cells, spark.sparkContext.broadcast(np.sort(few)))
    else:
        rows = rows.join(chosen.withColumn("target", F.lit(True)), "_id", "left").select("text", "target")
        counter = _counter(held, cells)
    counts = rows.mapInArrow(counter, "pair boolean, at int, target long, background long")
    counts = counts.groupBy("pair", "at").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toArrow().to_pandas()
    tables = []
    for pair, n in ((False, len(ids) + 1), (True, cells)):
        own, table = counts[counts["pair"] == pair], np.zeros((2, n))
        table[:, own["at"]] = own[["target", "background"]].to_numpy().T
        tables.append(table)
    scale = tables[0].sum(axis=1)
    share = scale[0] / scale[1] if scale[1] else 1.0
    for table in tables:
        table[1] *= share
    return Models(ids, *tables)


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score, best_token, worst_token) of each row.

    Losses are means over the tokens of the whole text, in bits; score is the mean of the per-token
    differences, target less background: the lower, the more like the target. best_token and
    worst_token are the positions of the least and greatest difference (the first of equals). A null
    or blank text has no tokens and nulls in their place.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["n_tokens", "target_loss", "background_loss", "score", "best_token", "worst_token"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        for batch in batches:
            found = []
            for text in batch.column(1):
                losses = models.losses(text.as_py())
                if losses.shape[1]:
                    apart = losses[0] - losses[1]
                    found.append((len(apart), *losses.mean(axis=1).tolist(), float(apart.mean()), int(apart.argmin()), int(apart.argmax())))
                else:
                    found.append((0, None, None, None, None, None))
            columns = zip(*found) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    text = F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text")
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double, best_token long, worst_token long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(rows, schema)


def mix(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The 64-bit key of each pair of word keys."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + own
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Block:
    """Distinct words and pairs of some texts. Word 0 is the start of a text, whose count is that of
    the texts with tokens. ``keys`` (odd for words alone) and ``counts`` (2 x keys: target, all) have
    the words first."""

    def __init__(self, texts: list[bytes], target: list[bool]):
        import xxhash

        known: dict[bytes, int] = {}
        parts = []
        for text in texts:
            tokens = words_of(text)
            for w in tokens:
                if w not in known:
                    known[w] = len(known) + 1
            parts.append(np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.own = np.concatenate(parts)
        self.before = np.concatenate(([0], self.own[:-1])) if len(self.own) else self.own
        full, good, n = self.sizes > 0, np.array(target, dtype=bool), len(known) + 1
        self.before[(np.cumsum(self.sizes) - self.sizes)[full]] = 0
        pairs, self.pair = np.unique(self.before * n + self.own, return_inverse=True)
        words = np.array([0, *(xxhash.xxh3_64_intdigest(w) for w in known)], dtype=np.uint64)
        words[1:] |= np.uint64(1)
        self.n_words = n
        self.keys = np.concatenate((words, mix(words[pairs // n], words[pairs % n]) & ~np.uint64(1)))
        self.counts = np.zeros((2, len(self.keys)), dtype=np.int64)
        for row, chosen in zip(self.counts, (np.repeat(good, self.sizes), slice(None))):
            row[:n] = np.bincount(self.own[chosen], minlength=n)
            row[n:] = np.bincount(self.pair[chosen], minlength=len(pairs))
        self.counts[:, 0] = (full & good).sum(), full.sum()


def _bytes_of(values: np.ndarray) -> bytes:
    """Non-negative values, byte by byte, as many bytes each as the greatest needs."""
    m = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([m]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :m].T).tobytes()


def _values_of(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _deal(block_bytes: int):
    """Numbers the rows, and gives following rows of one task with about ``block_bytes`` of text one block."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, size, n = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            lengths = np.array([len(t) for t in batch.column(1).to_pylist()], dtype=np.int64)
            at = size + np.cumsum(lengths) - lengths
            rows = first + n + np.arange(len(lengths))
            size, n = size + int(lengths.sum()), n + len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(first + at // block_bytes), pa.array(rows), *batch.columns], names=["raw", "row", "doc_id", "text", "target"])

    return deal


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.nonzero(np.diff(values))[0] + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _ask(buckets: int):
    """(block, row, text, target) to (bucket, block, row, keys, counts): the sorted keys of each run of
    following rows of a block, which its first row names, by ranges of keys."""

    def asked(block: int, row: int, texts: list[bytes], target: list[bool]) -> pa.RecordBatch:
        found = _Block(texts, target)
        order = np.argsort(found.keys)
        keys, counts = found.keys[order], found.counts[:, order]
        bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        runs = _runs(bucket)
        columns = [
            pa.array([int(bucket[a]) for a, _ in runs], pa.int32()), pa.array([block] * len(runs), pa.int32()), pa.array([row] * len(runs), pa.int64()),
            pa.array([keys[a:a + 1].tobytes() + _bytes_of(np.diff(keys[a:b])) for a, b in runs], pa.binary()),
            pa.array([zlib.compress(_bytes_of(counts[:, a:b].ravel()), 1) for a, b in runs], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "row", "keys", "counts"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, last, texts, target = None, None, None, [], []
        for batch in batches:
            for b, row, text, good in zip(*(c.to_pylist() for c in batch.columns)):
                if texts and (b != block or row != last + 1):
                    yield asked(block, first, texts, target)
                    texts, target = [], []
                if not texts:
                    block, first = b, row
                last = row
                texts.append(text)
                target.append(good)
        if texts:
            yield asked(block, first, texts, target)

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _ask sorted by bucket to (block, row, bucket, counts, words, target, background): the sums
    over all blocks in the order of the keys, and a row a bucket with its words and their counts."""

    def answered(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        keys = [np.cumsum(np.concatenate((np.frombuffer(k, "<u8", 1), _values_of(k[8:]))), dtype=np.uint64) for _, _, k, _ in rows]
        ends = np.cumsum([len(k) for k in keys])
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros((2, len(known)), dtype=np.int64)
        for start, end, (_, _, _, counts) in zip([0, *ends], ends, rows):
            sums[:, at[start:end]] += _values_of(zlib.decompress(counts)).reshape(2, -1).astype(np.int64)  # a run's keys are distinct
        word = (known & np.uint64(1)).astype(bool)
        told = [zlib.compress(_bytes_of(sums[:, at[start:end]].ravel()), 1) for start, end in zip([0, *ends], ends)]
        blank = [None] * len(rows)
        columns = [[*(r[0] for r in rows), -1], [*(r[1] for r in rows), -1], [bucket] * (len(rows) + 1), [*told, None]]
        columns += [[*blank, int(n)] for n in (word.sum(), *sums[:, word].sum(axis=1))]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["block", "row", "bucket", "counts", "words", "target", "background"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and bucket != now:
                yield answered(now, rows)
                rows = []
            now = bucket
            rows.append(row)
    if rows:
        yield answered(now, rows)


def _score_blocks(words: int, target_tokens: int, tokens: int):
    """Rows of texts and of _answer, sorted by block and row, a run's answers before its texts, to scores."""
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score", "best_token", "worst_token"]
    share = target_tokens / tokens if tokens else 1.0

    def scored(told: list[bytes], ids: list, texts: list[bytes]) -> pa.RecordBatch:
        block = _Block(texts, [False] * len(texts))
        counts = np.zeros(block.counts.shape)
        sums = [_values_of(zlib.decompress(t)).reshape(2, -1) for t in told]
        counts[:, np.argsort(block.keys)] = np.concatenate(sums, axis=1)
        counts[1] *= share
        word, pair = counts[:, : block.n_words], counts[:, block.n_words :]
        single = (word + WORD_PRIOR) / (target_tokens + WORD_PRIOR * words)
        rows, ends = [], np.cumsum(block.sizes)
        for doc, start, end in zip(ids, ends - block.sizes, ends):
            if start == end:
                rows.append((doc, 0, None, None, None, None, None))
                continue
            at = slice(start, end)
            own = -np.log2((pair[:, block.pair[at]] + PAIR_PRIOR * single[:, block.own[at]]) / (word[:, block.before[at]] + PAIR_PRIOR))
            apart = own[0] - own[1]
            rows.append((doc, len(apart), *own.mean(axis=1).tolist(), float(apart.mean()), int(apart.argmin()), int(apart.argmax())))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, ids, texts = [], [], []
        for batch in batches:
            for counts, doc, text in zip(*(batch.column(c).to_pylist() for c in ("counts", "doc_id", "text"))):
                if text is None:
                    if texts:
                        yield scored(told, ids, texts)
                        told, ids, texts = [], [], []
                    told.append(counts)
                else:
                    ids.append(doc)
                    texts.append(text)
        if texts:
            yield scored(told, ids, texts)

    return score


def score_exactly(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``score`` under models that have every word and every pair of following words of
    ``docs``, with their counts in the target (the texts whose id is in ``target_ids``) and in all texts.

    Words and pairs are known by 63-bit hashes. Texts are dealt into blocks of bounded size. Each
    block's distinct keys with their counts go, as packed ranges of keys, to as many buckets as there
    are blocks, so that a key has one entry a block however frequent it is; the sums over all blocks go back in
    the order of the block's keys, and its texts are scored. Nothing of the models is in the driver
    but three totals. p(w | v) is that of ``Models.losses``, with no unknown word; the start of a text
    counts as often as there are texts with tokens.
    """
    text = F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    chosen = target_ids.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    chosen = chosen.withColumn("target", F.lit(True))
    if chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    rows = rows.join(chosen, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    dealt = rows.mapInArrow(_deal(block_bytes), "raw long, row long, doc_id long, text binary, target boolean")
    dealt = cut_lineage(dealt, "dealt")
    raw = sorted(r[0] for r in dealt.select("raw").distinct().toLocalIterator())
    n = max(1, len(raw))
    index = F.broadcast(docs.sparkSession.createDataFrame(list(zip(raw, range(n))), "raw long, block int"))
    dealt = dealt.join(index, "raw").drop("raw")
    asked = dealt.select("block", "row", "text", "target").mapInArrow(_ask(n), "bucket int, block int, row long, keys binary, counts binary")
    asked = asked.repartitionById(n, "bucket").sortWithinPartitions("bucket")
    told = asked.mapInArrow(_answer, "block int, row long, bucket int, counts binary, words long, target long, background long")
    told = cut_lineage(told, "counts")
    totals = told.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "target", "background"))).first()
    told = told.where("block >= 0").select("block", "row", "bucket", "counts", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("text"))
    texts = dealt.select("block", "row", F.lit(n).alias("bucket"), F.lit(None).cast("binary").alias("counts"), "doc_id", "text")
    met = told.unionByName(texts).repartitionById(n, "block").sortWithinPartitions("block", "row", "bucket")
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double, best_token long, worst_token long"
    return met.mapInArrow(_score_blocks(*totals), schema)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all ``docs`` with the documents that ``labels`` call good and not toxic as the target."""
    return score_exactly(docs, labels.where("quality = 1 and toxic = 0"))
