import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from orrery.llm import media as M


def padded(data):
    return data + bytes(-len(data) % 64 if data else 64)


PAYLOADS = [b"", b"a", bytes(range(256)) * 5, b"\xff" * 1000, b"\0" * 64, random.Random(0).randbytes(70_001), "é世界😀".encode() * 40]


def test_round_trip():
    images = [M.store(padded(p), len(p)) for p in PAYLOADS]
    for p, (head, (blocks,)) in zip(PAYLOADS, M.decode_batch(images)):
        assert M.recover(head, blocks) == padded(p) and head.payload_bytes == len(p)
        thumb = M.thumbnail(head, blocks)
        assert thumb.shape == (head.height // 8, head.width // 8)
        assert thumb.ravel()[: len(padded(p)) // 64].tolist() == list(padded(p)[::64])


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def data(self):
        whole = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\0")


def codes(lengths):
    code, last, out = 0, 0, {}
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    return out


def plain_jpeg(components, order, mcus, restart, width, height, sampling):
    """One symbol after the other, with runs, end-of-block and three components."""
    dc_lengths, ac_lengths = {s: 4 for s in range(12)}, {r << 4 | s: 9 for r in range(16) for s in range(11)}
    dc_lengths.update({s: 5 for s in (10, 11)})
    dc, ac = codes(dc_lengths), codes(ac_lengths)
    size = lambda v: int(abs(v)).bit_length()
    extra = lambda v, n: v if v >= 0 else v + (1 << n) - 1
    scan, bits, used, pred = b"", Bits(), [0] * len(components), [0] * len(components)
    for m in range(mcus):
        if restart and m and m % restart == 0:
            scan += bits.data() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, pred = Bits(), [0] * len(components)
        for c in order:
            block = components[c][used[c]]
            used[c] += 1
            d = int(block[0]) - pred[c]
            pred[c] = int(block[0])
            bits.put(*dc[size(d)])
            bits.put(extra(d, size(d)), size(d))
            run = 0
            for v in map(int, block[1:]):
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits.put(*ac[0xF0])
                    run -= 16
                bits.put(*ac[run << 4 | size(v)])
                bits.put(extra(v, size(v)), size(v))
                run = 0
            if run:
                bits.put(*ac[0])
    scan += bits.data()
    seg = M._segment
    out = b"\xff\xd8" + seg(0xDB, bytes([0, *[16] * 64])) + seg(0xC4, M._table(0, dc_lengths)) + seg(0xC4, M._table(16, ac_lengths))
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([c + 1, s, 0]) for c, s in enumerate(sampling)))
    out += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    out += seg(0xDA, bytes([len(components), *(x for c in range(len(components)) for x in (c + 1, 0)), 0, 63, 0]))
    return out + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_reader_of_other_jpegs(restart):
    rng = np.random.default_rng(4)
    sparse = lambda n: np.where(rng.random((n, 64)) < 0.2, rng.integers(-900, 900, (n, 64)), 0)
    grey = [sparse(6)]
    colour = [sparse(4 * 6), sparse(6), sparse(6)]
    images = [
        plain_jpeg(grey, [0], 6, restart, 20, 12, [0x11]),
        plain_jpeg(colour, [0, 0, 0, 0, 1, 2], 6, restart, 48, 20, [0x22, 0x11, 0x11]),
    ]
    (h1, got1), (h2, got2) = M.decode_batch(images)
    assert (h1.width, h1.height, h2.width, h2.height) == (20, 12, 48, 20)
    for want, got in zip(grey + colour, got1 + got2):
        assert (want == got).all()
    thumb = M.thumbnail(h2, got2[0])
    assert thumb.shape == (4, 6)
    level = lambda b: min(255, max(0, round(float(b[0]) * 16 / 8 + 128)))
    assert thumb[0, 0] == level(colour[0][0]) and thumb[1, 0] == level(colour[0][2]) and thumb[0, 3] == level(colour[0][5])


def test_broken_bytes():
    good = M.store(padded(b"hello"), 5)
    for bad in (b"", b"GIF89a", good[:-2], good[:40], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(M.JpegError):
            M.decode_batch([bad])


def test_query_columns(spark):
    texts = [None, "", "abc", "abc", "x" * 64, "é" * 5000, "\0\0"]
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r["doc_id"]: r for r in M.features(M.to_media(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded(data)))
        assert r["payload_sha256"] == hashlib.sha256(padded(data)).hexdigest() and r["tail_crc32"] == zlib.crc32(padded(data)[-64:])
    assert rows[2]["feature"] == rows[3]["feature"] and rows[2]["media_sha256"] == rows[3]["media_sha256"]
    assert rows[0]["media_sha256"] == rows[1]["media_sha256"]
    assert M.features(M.to_media(docs.limit(0))).count() == 0


def test_null_and_broken_media(spark):
    good = M.store(b"some text".ljust(64, b"\0"), 9)
    rows = [(1, good), (2, None), (3, b""), (4, b"no image"), (5, good[: len(good) // 2]), (None, good), (1, good), (6, good.replace(b"\xff\xc0", b"\xff\xc9"))]
    got = M.features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert [r["doc_id"] for r in got].count(1) == 2 and len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["error"] is None and by_id[1]["n_bytes"] == 9 and by_id[None]["feature"] == by_id[1]["feature"]
    assert by_id[2]["media_bytes"] is None and by_id[2]["error"] is None
    assert all(by_id[i]["error"] and by_id[i]["n_bytes"] is None for i in (3, 4, 5, 6)) and by_id[4]["media_bytes"] == 8
    assert M.features(spark.createDataFrame([], "doc_id long, media binary")).count() == 0
