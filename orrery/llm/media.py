"""Media columns: baseline JPEG. A numpy reader (markers, Huffman scans, DC-only luminance thumbnails)
and a writer that keeps arbitrary bytes as quantised coefficients."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
#: Blocks between restart markers, which the reader decodes side by side.
RESTART = 16
_STEP = 1 << 22


class JpegError(ValueError):
    pass


@dataclass
class Component:
    id: int
    h: int
    v: int
    q: int
    dc: int = 0
    ac: int = 0


@dataclass
class Header:
    width: int = 0
    height: int = 0
    restart: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    payload_bytes: int | None = None
    scan: tuple[int, int] = (0, 0)

    @property
    def mcu(self) -> tuple[int, int]:
        """(columns, rows) of minimum coded units."""
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


#: Fixed value: the name in the application segment that holds the number of payload bytes.
_APP = b"bytes64\0"


def parse(data: bytes) -> Header:
    """Read the markers up to the scan of a baseline JPEG with one scan."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    head, at = Header(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                head.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else "u1").astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                head.huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, head.height, head.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise JpegError("8-bit samples only")
            head.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise JpegError("not baseline")
        elif marker == 0xDD:
            head.restart = int.from_bytes(body, "big")
        elif marker == 0xEB and body.startswith(_APP):
            head.payload_bytes = int.from_bytes(body[len(_APP) :], "big")
        elif marker == 0xDA:
            by_id = {c.id: c for c in head.components}
            if body[0] != len(by_id) or not by_id:
                raise JpegError("one interleaved scan only")
            for i in range(1, 1 + 2 * body[0], 2):
                by_id[body[i]].dc, by_id[body[i]].ac = body[i + 1] >> 4, body[i + 1] & 15
            end = data.rfind(b"\xff\xd9")
            if end < at:
                raise JpegError("no end of image")
            head.scan = (at, end)
            return head


def _intervals(scan: bytes) -> list[bytes]:
    """The restart intervals of a scan, without stuffed zeros."""
    if b"\xff" not in scan:
        return [scan]
    found = np.frombuffer(scan, dtype=np.uint8)
    at = np.nonzero((found[:-1] == 0xFF) & (found[1:] >= 0xD0) & (found[1:] <= 0xD7))[0].tolist()
    starts, ends = [0, *(a + 2 for a in at)], [*at, len(scan)]
    return [scan[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(starts, ends)]


def _lookup(spec: bytes) -> np.ndarray:
    """For each next 16 bits, code length << 8 | symbol; 0 for no code."""
    table, code, at = np.zeros(1 << 16, dtype=np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            first = code << (16 - length)
            table[first : first + (1 << (16 - length))] = (length << 8) | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def decode_batch(images: list[bytes]) -> list[tuple[Header, list[np.ndarray]]]:
    """(header, quantised coefficients of each component: blocks x 64 in zigzag order).

    The restart intervals of all images run side by side: each step reads one Huffman symbol of
    each, with its extra bits, through tables of the next 16 bits. Blocks of a component come in
    the order of the scan. Components must not be subsampled against each other within a block
    order that isn't 1x1, except for one component alone; others raise JpegError.
    """
    heads = [parse(d) for d in images]
    tables: dict[bytes, int] = {}
    lanes: list[tuple[int, int, int, bytes]] = []  # image, first MCU, MCUs, data
    for k, (head, data) in enumerate(zip(heads, images)):
        total = head.mcu[0] * head.mcu[1]
        step = head.restart or total
        parts = _intervals(data[head.scan[0] : head.scan[1]])
        if len(parts) != -(-total // step):
            raise JpegError("wrong number of restart intervals")
        lanes += [(k, i * step, min(step, total - i * step), p) for i, p in enumerate(parts)]
        for spec in head.huffman.values():
            tables.setdefault(spec, len(tables))
    flat = np.concatenate([_lookup(s) for s in tables]) if tables else np.zeros(0, dtype=np.int32)

    per_mcu, table_of, blocks_of = [], [], []
    for head in heads:
        many = len(head.components) > 1
        order = [c for c, x in enumerate(head.components) for _ in range(x.h * x.v if many else 1)]
        per_mcu.append(order)
        table_of.append([(tables[head.huffman[head.components[c].dc]], tables[head.huffman[16 + head.components[c].ac]]) for c in order])
        blocks_of.append(head.mcu[0] * head.mcu[1] * len(order))
    first_block = np.concatenate(([0], np.cumsum(blocks_of)))
    out = np.zeros((int(first_block[-1]) + 1, 64), dtype=np.int16)

    pad = b"\0" * 8
    joined = np.frombuffer(b"".join(d + pad for *_, d in lanes), dtype=np.uint8).astype(np.uint32)
    window = (joined[:-4] << 24) | (joined[1:-3] << 16) | (joined[2:-2] << 8) | joined[3:-1]
    window = window.astype(np.int64) << 8 | joined[4:].astype(np.int64)  # 40 bits from each byte
    size = np.array([len(d) + len(pad) for *_, d in lanes], dtype=np.int64)
    bit = (np.cumsum(size) - size) * 8
    last = bit + (size - len(pad)) * 8

    width = max((len(o) for o in per_mcu), default=1)
    kinds = np.zeros((len(images), width, 2), dtype=np.int64)
    component = np.zeros((len(images), width), dtype=np.int64)
    for k, (pairs, order) in enumerate(zip(table_of, per_mcu)):
        kinds[k, : len(pairs)], component[k, : len(order)] = pairs, order
    kinds <<= 16
    image = np.array([k for k, *_ in lanes], dtype=np.int64)
    units = np.array([len(o) for o in per_mcu], dtype=np.int64)[image] if lanes else np.zeros(0, dtype=np.int64)
    block = first_block[image] + np.array([m for _, m, *_ in lanes], dtype=np.int64) * units
    stop = block + np.array([n for *_, n, _ in lanes], dtype=np.int64) * units
    place, k = np.zeros(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
    pred = np.zeros((len(lanes), max((len(h.components) for h in heads), default=1)), dtype=np.int64)
    lane = np.nonzero(block < stop)[0]
    bit, last, image, units, block, stop, place, k = (x[lane] for x in (bit, last, image, units, block, stop, place, k))
    pred = pred[lane]
    single = width == 1
    while len(bit):
        is_dc = k == 0
        if single:
            kind = np.where(is_dc, kinds[image, 0, 0], kinds[image, 0, 1])
        else:
            kind = np.where(is_dc, kinds[image, place, 0], kinds[image, place, 1])
        word = window[bit >> 3] << (bit & 7)
        entry = flat[kind + ((word >> 24) & 0xFFFF)]
        length, symbol = entry >> 8, entry & 0xFF
        if not length.all():
            raise JpegError("no such code")
        run, bits = symbol >> 4, symbol & 15
        bit = bit + length
        extra = ((window[bit >> 3] << (bit & 7)) >> (40 - bits)) & ((1 << bits) - 1)
        bit = bit + bits
        value = np.where((bits > 0) & (extra < (1 << np.maximum(bits - 1, 0))), extra - (1 << bits) + 1, extra)
        if is_dc.any():
            d = np.nonzero(is_dc)[0]
            of = 0 if single else component[image[d], place[d]]
            value[d] += pred[d, of]
            pred[d, of] = value[d]
        at = np.where(is_dc, 0, k + run)
        if (at > 63).any():
            raise JpegError("coefficient out of block")
        put = is_dc | (bits > 0)
        out[np.where(put, block, len(out) - 1), at] = value
        k = np.where(put, at + 1, np.where(run == 15, k + 16, 64))
        full = k >= 64
        if full.any():
            block, k = block + full, np.where(full, 0, k)
            if not single:
                place = np.where(full, (place + 1) % units, place)
            over = block >= stop
            if (bit > last).any():
                raise JpegError("data ends early")
            if over.any():
                keep = ~over
                bit, last, image, units, block, stop, place, k = (x[keep] for x in (bit, last, image, units, block, stop, place, k))
                pred = pred[keep]
    result = []
    for i, head in enumerate(heads):
        own = out[first_block[i] : first_block[i + 1]]
        order = np.array(per_mcu[i])
        own = own.reshape(-1, len(order), 64)
        result.append((head, [own[:, order == c].reshape(-1, 64) for c in range(len(head.components))]))
    return result


def thumbnail(head: Header, blocks: np.ndarray) -> np.ndarray:
    """Luminance, one sample a block, from the DC coefficients alone: 8-bit rows and columns."""
    y = head.components[0]
    dc = np.clip(np.rint(blocks[:, 0] * head.quant[y.q][0] / 8 + 128), 0, 255).astype(np.uint8)
    columns, rows = head.mcu
    if len(head.components) == 1:
        return dc.reshape(rows, columns)
    return dc.reshape(rows, columns, y.v, y.h).transpose(0, 2, 1, 3).reshape(rows * y.v, columns * y.h)


def difference_hash(image: np.ndarray) -> int:
    """64-bit dHash of an image averaged to 8 rows of 9 samples."""
    def means(x: np.ndarray, n: int) -> np.ndarray:
        edge = np.arange(n + 1) * x.shape[0] / n
        low = np.floor(edge[:-1]).astype(int)
        high = np.maximum(np.ceil(edge[1:]).astype(int), low + 1)
        sums = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)))
        return (sums[high] - sums[low]) / (high - low)[:, None]

    small = means(means(image.astype(float), 8).T, 9).T
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    """A DHT body from the code length of each symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([kind, *(sum(lengths[s] == n for s in symbols) for n in range(1, 17)), *symbols])


#: DC category s has a code of 9 - s bits and s extra bits; the only AC symbol in use, 8 bits after
#: no run, has one bit. So each coefficient takes 9 bits and each block 72 bytes before stuffing.
_DC_LENGTH = {s: 9 - s for s in range(9)}
_AC_LENGTH = {0x08: 1, 0x00: 2}
_DC_SPEC, _AC_SPEC = _table(0x00, _DC_LENGTH), _table(0x10, _AC_LENGTH)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def store(payload: bytes, n_bytes: int) -> bytes:
    """A greyscale baseline JPEG that holds ``payload``, a multiple of 64 bytes, without loss.

    Each 64 bytes are one block. Byte 0 less 128 is the DC coefficient (quantiser 8: it is the
    block's mean luminance); byte b of the others is an AC coefficient of 8 bits, b for b >= 128
    and b - 255 below (quantiser 1). Blocks fill a near-square picture row by row; blocks beyond the
    payload repeat the last. An application segment holds n_bytes.
    """
    blocks = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    n = len(blocks)
    columns = min(8191, int(np.ceil(np.sqrt(n))))
    rows = -(-n // columns)
    if rows > 8191:
        raise JpegError("payload too large")
    if rows * columns > n:
        blocks = np.concatenate([blocks, np.repeat(blocks[-1:], rows * columns - n, axis=0)])
    out = [
        b"\xff\xd8",
        _segment(0xEB, _APP + n_bytes.to_bytes(8, "big")),
        _segment(0xDB, bytes([0, 8, *[1] * 63])),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, _DC_SPEC),
        _segment(0xC4, _AC_SPEC),
        _segment(0xDD, struct.pack(">H", RESTART)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ]
    step, mark = RESTART * 64, 0
    for at in range(0, len(blocks), step):
        coded = _code_blocks(blocks[at : at + step]).tobytes()
        for a in range(0, len(coded), RESTART * 72):
            if at or a:
                out.append(bytes([0xFF, 0xD0 + mark]))
                mark = (mark + 1) % 8
            out.append(coded[a : a + RESTART * 72].replace(b"\xff", b"\xff\x00"))
    out.append(b"\xff\xd9")
    return b"".join(out)


def _code_blocks(blocks: np.ndarray) -> np.ndarray:
    dc = blocks[:, 0].astype(np.int32) - 128
    before = np.concatenate(([0], dc[:-1]))
    before[::RESTART] = 0
    diff = dc - before
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int32)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    word = ((1 << (9 - size)) - 2 << size) | extra  # a code of 9 - size bits: ones and a last zero
    bits = np.zeros((len(blocks), UNIT, 9), dtype=np.uint8)
    bits[:, 1:, 1:] = np.unpackbits(blocks[:, 1:], axis=1).reshape(len(blocks), UNIT - 1, 8)
    bits[:, 0] = (word[:, None] >> np.arange(8, -1, -1)) & 1
    return np.packbits(bits.reshape(len(blocks), -1), axis=1)


def recover(head: Header, blocks: np.ndarray) -> bytes:
    """The payload that store() was given."""
    if head.payload_bytes is None:
        raise JpegError("no payload length")
    size = max(1, -(-head.payload_bytes // UNIT))
    kept = blocks[:size].astype(np.int32)
    kept[:, 1:] = np.where(kept[:, 1:] < 0, kept[:, 1:] + 255, kept[:, 1:])
    kept[:, 0] += 128
    return kept.astype(np.uint8).tobytes()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary): each whole text in UTF-8 (null: empty), followed by zero bytes up to a
    positive multiple of 64, as a JPEG."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _parts(batches):
            media = [store(t + bytes(-len(t) % UNIT if t else UNIT), len(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary())], names=["doc_id", "media"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(rows, "doc_id long, media binary")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Batches of about four megabytes, or one value."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        edge = np.searchsorted(np.cumsum(size), np.arange(_STEP, size.sum() + _STEP, _STEP)).tolist()
        at = 0
        for upto in [*(e + 1 for e in edge), batch.num_rows]:
            upto = min(upto, batch.num_rows)
            if upto > at:
                yield batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at).to_pylist()
                at = upto


def _described(data: bytes, decoded) -> tuple:
    """The features of one image but its id."""
    head, (blocks,) = decoded
    payload = recover(head, blocks)
    look = f"{difference_hash(thumbnail(head, blocks)):016x}"
    return (
        head.payload_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
        len(data), hashlib.sha256(data).hexdigest(), f"{head.width}x{head.height}:{look}", head.width, head.height, look, None,
    )


def _alone(data: bytes) -> tuple:
    """The features of an image that may be broken."""
    try:
        return _described(data, next(iter(decode_batch([data]))))
    except (ValueError, IndexError, KeyError, OverflowError, struct.error) as e:
        return (None,) * 4 + (len(data), hashlib.sha256(data).hexdigest()) + (None,) * 4 + (f"{type(e).__name__}: {e}"[:200],)


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, media) give when they are read again: the payload's length,
    digest and tail, the media's length and digest, width, height, and the dHash of the thumbnail,
    joined in ``feature``, and ``error``. Of bytes that aren't a baseline JPEG of store() only the media's length and
    digest are known, and ``error`` says why; a null ``media`` gives nulls."""
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_hash string, error string"
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [x.split()[0] for x in kind.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, images in _parts(batches):
            known = [x for x in images if x is not None]
            try:
                told = iter([_described(x, d) for x, d in zip(known, decode_batch(known))] if known else [])
            except (ValueError, IndexError, KeyError, OverflowError, struct.error):
                told = iter([_alone(x) for x in known])
            found = [next(told) if x is not None else (None,) * len(kinds[1:]) for x in images]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), t) for c, t in zip(zip(*found), kinds[1:]))], names=names)

    return media.mapInArrow(rows, kind)
