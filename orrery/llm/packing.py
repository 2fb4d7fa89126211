"""Token packing: best fit, then a local search that exchanges documents between underfull bins."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

CAPACITY = 2048
#: Pieces that are packed together in one task.
PIECES_PER_GROUP = 20_000
END_ID = 0
_CACHE = 1 << 20
#: What the split below isn't made for: characters beyond Latin, odd controls, special tokens.
_OTHER = re.compile("[^\\x00-\\x1b -\\x84\\x86-\\u012f\\u0131-\\u024f]|<\\|")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class Tokenizer:
    """The ids that the tokenizers library gives, with the ids of each distinct pre-token kept.

    Pre-tokens don't see each other, so the library's model encodes each distinct one once. Texts of
    Latin letters are split here by the vocabulary's own rule; any other text, and one that holds the
    mark of a special token, goes through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Library.from_file(path)
        self.model, self.level = self.library.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    def _learn(self, piece: str) -> bytes:
        if len(self.known) >= _CACHE:
            self.known.clear()
        level = piece if piece.isascii() and piece.isprintable() else self.level.pre_tokenize_str(piece)[0][0]
        ids = np.array([t.id for t in self.model.tokenize(level)], dtype="<u4").tobytes()
        self.known[piece] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if _OTHER.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        pieces, known = _PIECE.findall(text.lower()), self.known
        try:
            joined = b"".join(map(known.__getitem__, pieces))
        except KeyError:
            joined = b"".join([known.get(p) or self._learn(p) for p in pieces])
        return np.frombuffer(joined, dtype="<u4")


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each whole text's ids and then id 0, cut
    into pieces of ``capacity`` only where longer. A null text counts as empty: one piece of one id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(tokenizer_path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch, rows = whole.slice(at, 1024), []
                for doc, text in zip(batch.column(0), batch.column(1)):
                    ids = np.append(tokenizer.ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        row = (doc.as_py(), k, start, len(own), zlib.crc32(own.tobytes()))
                        rows.append((*row, own.astype(np.int32)) if with_ids else row)
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: each in turn into the fullest bin that has room. A start for local_search()."""
    bins: list[list[int]] = []
    room: list[int] = []  # distinct rooms, sorted
    at: dict[int, list[int]] = {}  # the bins of each room
    for i, size in enumerate(sizes.tolist()):
        k = bisect_left(room, size)
        if k < len(room):
            left = room[k]
            b = at[left].pop()
            if not at[left]:
                del at[left], room[k]
        else:
            b, left = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        left -= size
        if left:
            if left not in at:
                insort(room, left)
                at[left] = []
            at[left].append(b)
    return bins


class _Open:
    """The underfull bins that may take documents, by the total that each can give back: nothing or
    one document (``few``), or two (``pairs``); each total has its (room, bin), sorted."""

    def __init__(self) -> None:
        self.few: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, list[tuple[int, int]]] = {}

    def change(self, b: int, own: list[int], room: int, add: bool) -> None:
        for table, totals in ((self.few, {0, *own}), (self.pairs, _pairs(own))):
            for total in totals:
                places = table.setdefault(total, [])
                if add:
                    insort(places, (room, b))
                else:
                    del places[bisect_left(places, (room, b))]
                    if not places:
                        del table[total]

    def step(self, own: list[int], most: int):
        """(gain, given, total given back, two) of the greatest gain, and its bin: one whose room has
        the gain and isn't over ``most``, the fullest such; None if there is none."""
        best = None
        for given, tables in (({(x,) for x in own}, (self.few, self.pairs)), (_pairs(own).values(), (self.few,))):
            for give in given:
                total = sum(give)
                for table in tables:
                    most_gain, least_gain = min(most, total), best[0] if best else 0
                    gains = range(most_gain, least_gain, -1)
                    if len(table) < len(gains):
                        gains = sorted((total - t for t in table if least_gain < total - t <= most_gain), reverse=True)
                    for gain in gains:
                        places = table.get(total - gain)
                        if places and (total > gain or len(give) == 1):
                            k = bisect_left(places, (gain, -1))
                            if k < len(places) and places[k][0] <= most:
                                best = (gain, give, total - gain, table is self.pairs, places[k][1])
                                break
        return best


def _pairs(own: list[int]) -> dict[int, tuple[int, int]]:
    """Two sizes for each total of two of ``own``."""
    sizes = sorted(set(own))
    found = {x + y: (x, y) for i, x in enumerate(sizes) for y in sizes[i + 1 :]}
    return found | {2 * x: (x, x) for x in sizes if own.count(x) > 1}


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange between all underfull bins as long as the sum of squared fills increases.

    From the emptiest upwards: move a document into a fuller bin, exchange one for a smaller one,
    or between one and two, so that the fuller bin gains what the emptier loses. Each step takes
    the greatest gain that any fuller bin has room for. Bins that get empty go. It ends with as few
    bins as the total allows, or when no bin has such a step.
    """
    bins, sizes_of = [list(b) for b in bins], sizes.tolist()
    held = [[sizes_of[i] for i in b] for b in bins]
    fill = [sum(h) for h in held]
    fewest, left = -(-sum(fill) // capacity), sum(map(bool, bins))
    if left <= fewest:
        return [b for b in bins if b]
    places = _Open()

    def change(b: int, add: bool) -> None:
        if bins[b] and fill[b] < capacity:
            places.change(b, held[b], capacity - fill[b], add)

    def pass_on(giver: int, taker: int, size: int) -> None:
        k = held[giver].index(size)
        held[taker].append(held[giver].pop(k))
        bins[taker].append(bins[giver].pop(k))

    for b in range(len(bins)):
        change(b, True)
    changed = True
    while changed and left > fewest:
        changed = False
        for donor in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b)):
            if fill[donor] == capacity or left <= fewest:
                continue
            change(donor, False)
            while bins[donor] and (step := places.step(held[donor], capacity - fill[donor])):
                gain, give, back, two, taker = step
                change(taker, False)
                back = (_pairs(held[taker])[back] if two else (back,)) if back else ()
                for size in give:
                    pass_on(donor, taker, size)
                for size in back:
                    pass_on(taker, donor, size)
                fill[donor] -= gain
                fill[taker] += gain
                change(taker, True)
                changed = True
            change(donor, True)
            left -= not bins[donor]
    return [b for b in bins if b]


def _pack_group(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "start", "length"], kind="stable").reset_index(drop=True)
        sizes = group["length"].to_numpy()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        of, offset = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
        fill = np.zeros(len(bins), dtype=np.int64)
        for b, own in enumerate(bins):
            own = sorted(own)
            of[own] = b
            offset[own] = np.cumsum([0, *sizes[own][:-1]])
            fill[b] = sizes[own].sum()
        group["sequence_id"] = (group["grp"].to_numpy() << 24) | of
        group["offset"] = offset
        group["fill"] = fill[of]
        return group.drop(columns="grp")

    return pack


def pack(rows: DataFrame, capacity: int = CAPACITY, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are dealt by hash into groups of about ``per_group``, however many there are (repeated rows by
    their place in ``rows``, which must be a written table), and each
    group is packed in its own task: best fit in the order given, then the exchanges. Then the pieces of underfull
    bins are dealt anew and packed together, until one group remains or a round frees no bin; such
    a round doesn't count. Only the length of a piece counts. Full pieces are bins of their own.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
    done, rest, first, round_ = [], rows.select(*columns), 0, 0
    before, bins = None, 0
    while True:
        n = rest.count()
        groups = max(1, -(-n // per_group))
        salt = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(round_))
        dealt = rest.withColumn("grp", F.pmod(salt, F.lit(groups)) + first)
        packed = dealt.groupBy("grp").applyInPandas(_pack_group(capacity), kind)
        packed = cut_lineage(packed, "packed")
        if before is not None and packed.select("sequence_id").distinct().count() >= bins:
            done.append(before)
            break
        if groups == 1:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") == capacity))
        before = packed.where(F.col("fill") < capacity)
        bins = before.select("sequence_id").distinct().count()
        rest = before.select(*columns)
        first += groups
        round_ += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents.

    Null texts count as empty; repeated rows and null ids are packed like others; an empty table
    gives no rows."""
    cut = cut_lineage(pieces(docs, tokenizer_path, capacity=capacity, with_ids=False), "pieces")
    return pack(cut, capacity)
