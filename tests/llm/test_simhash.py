import random

import numpy as np
import xxhash

from orrery.llm.golay import decode_table, nearby_indices
from orrery.llm.simhash_dedup import fingerprint, keep_first, links, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component_id string"  # names that clash with the operator's own


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \t\n", "a", "A b", "One two THREE", "é É x\x0by\x85z \xa0 w", "a a a a a a", "x " * 70_000]
    texts += [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(n)) for n in (3, 4, 50, 500)]
    for t in texts:
        assert fingerprint(t.encode()) == plain_fingerprint(t)
    assert fingerprint(None) == 0


def test_golay_code():
    table = decode_table()
    assert (np.bincount(table, minlength=4096) == 2048).all()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 500).astype(np.int32)
    row, index = nearby_indices(words, 23)
    for i, w in enumerate(words):
        want = {table[w], *(table[w ^ (1 << b)] for b in range(23))}
        assert set(index[row == i]) == want and len(want) in (1, 6)


def test_links_lose_no_pair(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(6):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100


def components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def test_components_with_odd_rows(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    long = [rng.choice(words) for _ in range(400)]
    rows = [(i, " ".join(long[: 395 + i])) for i in range(6)] + [(50, " ".join(long)), (50, " ".join(long)), (7, None), (8, ""), (9, " \n"), (None, "only here"), (None, " ".join(long))]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect()), key=repr)
    assert got == components(rows)
    kept = [r["doc_id"] for r in keep_first(docs).collect()]
    first = {c for _, _, c in got}
    assert all(d is None or d in first for d in kept) and kept.count(None) == 2 and 7 in kept and 8 not in kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0 and keep_first(docs).columns == docs.columns
