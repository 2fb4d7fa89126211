"""Exact removal of repeated passages by hashing lines and the parts of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

LINES, PARAGRAPHS = r"\n", r"\n[^\S\n]*\n\s*"
#: Words of a unit at least, and of a run of repeated units that is removed.
UNIT_WORDS, RUN_WORDS = 16, 30
#: A boundary inside a line is the least of the hashes of this many following pairs of words.
WINDOW = 12
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20
_CJK = "぀-ヿ㐀-鿿가-힯"
_WORD = regex.compile(f"[{_CJK}]|[^ \\t\\n\\r\\f\\v{_CJK}]+")
_CACHE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Hashes(dict):
    """The first 64 bits of each word's MD5, kept for the most recent words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "big")
        return value


class _Powers:
    """The powers of a number modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.known):
            factors = np.full(2 * n, self.base, dtype=np.uint64)
            factors[0] = 1
            self.known = np.cumprod(factors)
        return self.known[:n]


def boundaries(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word indices at which units begin or end, sorted: 0, the number of words, where lines begin, and within lines what the words
    around decide alone: of each WINDOW following gaps between words, the one with the least hash of
    its two words (the first of equals). So equal passages have equal boundaries, but for a few words
    at their ends, whatever surrounds them."""
    h = (words >> np.uint64(33)).astype(np.int64)
    gap = (h[:-1] * 48271 + h[1:] * 39373) % 2147483647
    own = np.array([0, len(words)])
    if len(gap) >= WINDOW:
        least, width = (gap << 32) | np.arange(1, len(gap) + 1), 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        own = np.concatenate((own, least & 0xFFFFFFFF))
    return np.unique(np.concatenate((own, starts)))


class Units:
    """Cuts texts into units and hashes them."""

    def __init__(self, separator: str = LINES, unit_words: int = UNIT_WORDS):
        self.separator, self.unit_words = regex.compile(separator), unit_words
        self.hashes, self.up, self.down = _Hashes(), _Powers(_BASE), _Powers(_INVERSE)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digests, first words, ends) of a text's units, sorted by place. A unit begins at any
        boundary and ends at the next that is ``unit_words`` words away or more; the end of each line
        also ends the shortest such unit before it."""
        lines = [_WORD.findall(line) for line in self.separator.split(text.lower())]
        n = sum(map(len, lines))
        if n < self.unit_words:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        words = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(lines)), dtype=np.uint64, count=n)
        ends = np.cumsum([len(line) for line in lines])
        cuts = boundaries(words, ends)
        to = np.searchsorted(cuts, cuts + self.unit_words)
        forward = to < len(cuts)
        back = np.searchsorted(cuts, ends - self.unit_words, "right") - 1
        spans = np.concatenate(((cuts[forward] << 32) | cuts[to[forward]], (cuts[back[back >= 0]] << 32) | ends[back >= 0]))
        spans = np.unique(spans)
        first, last = spans >> 32, spans & 0xFFFFFFFF
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * self.up.upto(n), out=sums[1:])
        digests = (sums[last] - sums[first]) * self.down.upto(n)[first] + (last - first).astype(np.uint64)
        digests = (digests ^ (digests >> np.uint64(31))) * np.uint64(_BASE)
        return digests ^ (digests >> np.uint64(29)), first, last


_ASKED = "bucket int, keys binary, row binary, first binary, last binary, doc_id binary, text_key binary"
_TOLD = "doc_id long, text_key long, first int, last int"


def _asked(bucket: int, *arrays: np.ndarray) -> tuple:
    kinds = ("<u8", "<u4", "<u4", "<u4", "<i8", "<i8")
    return (bucket, *(np.ascontiguousarray(x.astype(k)).tobytes() for x, k in zip(arrays, kinds)))


def _ask(separator: str, unit_words: int, block_bytes: int, buckets: int):
    """Rows (doc_id, text_key, text) to the units of blocks of following rows: of equal units the first
    goes to the bucket of its digest, so that a digest has one entry a block however frequent it is.
    The others are repeats for certain; they go, as bucket -1 - b, past the buckets."""

    def asked(ids: list[int], keys: list[int], found: list[tuple]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i], keys[i]))
        doc, key = np.array([ids[i] for i in order], dtype=np.int64), np.array([keys[i] for i in order], dtype=np.int64)
        found = [found[i] for i in order]
        row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        digest, first, last = (np.concatenate(c) for c in zip(*found))
        by = np.lexsort((first, row, digest))
        digest, row, first, last = digest[by], row[by], first[by], last[by]
        new = np.ones(len(digest), dtype=bool)
        new[1:] = digest[1:] != digest[:-1]
        rows = []
        if not new.all():
            rest = ~new
            used, own = np.unique(row[rest], return_inverse=True)
            rows.append(_asked(-1 - int(key[0]) % buckets, digest[:0], own, first[rest], last[rest], doc[used], key[used]))
        digest, row, first, last = digest[new], row[new], first[new], last[new]
        bucket = (digest >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = [0, *(np.nonzero(np.diff(bucket))[0] + 1).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                used, own = np.unique(row[a:b], return_inverse=True)
                rows.append(_asked(int(bucket[a]), digest[a:b], own, first[a:b], last[a:b], doc[used], key[used]))
        names = [x.split()[0] for x in _ASKED.split(", ")]
        kinds = [pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, seen, ids, keys, found, size = Units(separator, unit_words), set(), [], [], [], 0
        for batch in batches:
            for doc, key, text in zip(*batch.columns):
                doc, key = doc.as_py(), key.as_py()
                if (doc, key) in seen:
                    continue
                text = text.as_py()
                size += len(text)
                own = units.of(text)
                if len(own[0]):
                    seen.add((doc, key))
                    ids.append(doc)
                    keys.append(key)
                    found.append(own)
                if size >= block_bytes:
                    if ids:
                        yield asked(ids, keys, found)
                    seen, ids, keys, found, size = set(), [], [], [], 0
        if ids:
            yield asked(ids, keys, found)

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _ask, sorted by bucket, to the units that aren't the first of their digest."""

    def answered(rows: list[tuple], past: bool) -> pa.RecordBatch:
        kinds = ("<u8", "<u4", "<u4", "<u4", "<i8", "<i8")
        unpacked = [[np.frombuffer(x, k) for x, k in zip(r, kinds)] for r in rows]
        digest, first, last = (np.concatenate([u[i] for u in unpacked]) for i in (0, 2, 3))
        doc, key = (np.concatenate([u[i][u[1]] for u in unpacked]) for i in (4, 5))
        if not past:
            by = np.lexsort((first, key, doc, digest))
            digest, first, last, doc, key = digest[by], first[by], last[by], doc[by], key[by]
            start = np.ones(len(digest), dtype=bool)
            start[1:] = digest[1:] != digest[:-1]
            least = np.nonzero(start)[0][np.cumsum(start) - 1]
            gone = (doc != doc[least]) | (key != key[least]) | (first != first[least])
            first, last, doc, key = first[gone], last[gone], doc[gone], key[gone]
        columns = [pa.array(doc), pa.array(key), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "first", "last"])

    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and (bucket != now or bucket < 0):
                yield answered(rows, now < 0)
                rows = []
            now = bucket
            rows.append(row)
    if rows:
        yield answered(rows, now < 0)


def repeated_units(docs: DataFrame, separator: str = LINES, unit_words: int = UNIT_WORDS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text_key, first, last): every unit of ``docs`` (doc_id, text_key, text) that occurs at an
    earlier place too, with the indices of its first word and of the word after it.

    Digests are grouped over all documents. Places are ranked by doc_id, text_key and first word; the
    earliest of a digest stays. Tasks cut blocks of ``block_bytes`` of text into units; each block's distinct
    digests go, packed, to buckets by ranges of digests, so that no bucket grows with the copies of a passage.
    Rows without an id or a text have no units; rows with equal id and text are one document.
    """
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text_key", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    asked = rows.mapInArrow(_ask(separator, unit_words, block_bytes, buckets), _ASKED)
    asked = asked.repartitionById(buckets, F.pmod("bucket", F.lit(buckets))).sortWithinPartitions("bucket")
    return asked.mapInArrow(_answer, _TOLD)


def runs_to_remove(text: str, units: list[tuple[int, int]], run_words: int) -> list[tuple[int, int]]:
    """The code point spans of the runs of ``run_words`` words or more that ``units`` (first word, word
    after the last) cover."""
    runs: list[list[int]] = []
    for first, last in sorted(units):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    runs = [r for r in runs if r[1] - r[0] >= run_words]
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[first][0], places[last - 1][1]) for first, last in runs]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans. Of the white space on both sides that after the span goes too, or
    if only that has a line break, that before."""
    parts, at = [], 0
    for start, end in spans:
        before, after = start, end
        while before > at and text[before - 1] in " \t\n\r\f\v":
            before -= 1
        while after < len(text) and text[after] in " \t\n\r\f\v":
            after += 1
        if before > 0 and (after == len(text) or "\n" in text[end:after] and "\n" not in text[before:start]):
            start, after = before, end
        parts.append(text[at:start])
        at = after
    return "".join([*parts, text[at:]])


def _remover(run_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, removed = [], []
            for text, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = runs_to_remove(text, [(u["first"], u["last"]) for u in units], run_words) if units else []
                texts.append(without(text, spans) if spans else text)
                removed.append([{"start": a, "end": b} for a, b in spans] or None)
            columns = [batch.column(2), pa.array(texts, pa.string()), pa.array(removed, kind), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "removed", *batch.schema.names[3:]])

    return cut


def remove_repeats(docs: DataFrame, separator: str = LINES, unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **sizes: int) -> DataFrame:
    """(doc_id, text, removed, then the columns in ``keep``): each row's text without its repeated
    passages, and what was removed: an array of structs (start, end) with code point offsets into the
    original text, null where nothing was.

    Lines (or what ``separator`` parts) and, within lines, parts of lines are units of ``unit_words``
    words or more; see ``Units``. A unit whose digest (lower case, any white space alike) occurs at an
    earlier place, by doc_id and position, is repeated, in the same text too; adjacent and overlapping repeated
    units that have ``run_words`` words or more together are removed. A passage of more than
    ``run_words`` + 2 x WINDOW words that occurs earlier is found wherever it begins in a line, all of it
    but WINDOW words at either end; lines that repeat are found whole. Of a text that goes on repeating
    itself the first period stays.

    Words are runs without white space; a Chinese or Japanese character or Hangul syllable is one. Null
    texts stay null and rows without an id keep their text. Rows that share an id but not their
    text are documents of their own, each cut by its own units; equal rows are one document and stay equal.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"), *(F.col(k).alias(f"_keep_{k}") for k in keep))
    gone = repeated_units(base, separator, unit_words, **sizes).distinct()
    gone = gone.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("units"))
    gone = cut_lineage(gone, "repeated-units")  # a side of its own, or the join couldn't be split on a hot id
    both = base.join(gone, ["doc_id", "text_key"], "left").select("text", "units", "doc_id", *(F.col(f"_keep_{k}").alias(k) for k in keep))
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields[3:])
    return both.mapInArrow(_remover(run_words), "doc_id long, text string, removed array<struct<start: int, end: int>>" + kinds)
