import hashlib
import math
import operator
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orrery.llm import decontamination as DC
from orrery.llm import language_id as L
from orrery.llm import lm_scoring as LM
from orrery.llm.common import table
from orrery.llm import substring_dedup as SD
from orrery.llm.substring_dedup import remove_repeats


def test_codewords():
    for k in (2, 3, 4, 7, 20):
        code = L.codewords(k)
        assert len({tuple(r) for r in code}) == k and set(np.unique(code)) <= {-1, 1}
        assert all(abs(c.sum()) < k for c in code.T) or k > 7


def test_language_on_held_out_rows(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.98


def test_language_of_odd_texts(spark):
    train = [(i, t * 20, lang) for i, (t, lang) in enumerate([("the and of ", "en"), ("der die und ", "de")] * 3)]
    odd = [(100, None, "en"), (101, "", None), (102, " 12 .,;\n", "en"), (103, "the and of", None), (None, "der und die", None), (103, "the and of", None)]
    docs = spark.createDataFrame([(*r, "x") for r in train + odd], "doc_id long, text string, lang string, score string")
    rows = L.predict(docs, L.train(docs, "text", "lang")).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert len(rows) == len(train) + len(odd)
    assert got[100] == got[101] == got[102] == "und" and got[103] == "en" and got[None] == "de"
    nothing = L.train(docs.where("lang = 'xx'"), "text", "lang")
    assert {r["lang_pred"] for r in L.predict(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0


def test_long_texts_count_whole(monkeypatch):
    text = ("the quick brown fox éß " * 3000).encode()
    whole = L.ngram_counts([text, b"abc", b""], 1 << 10)
    monkeypatch.setattr(L, "_SLICE", 1000)
    assert (L.ngram_counts([text, b"abc", b""], 1 << 10) == whole).all() and whole[2].sum() == 0


GRAM_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def plain_grams(text, bits):
    """Hashed grams by definition: two, three and four bytes from each byte that a letter follows."""
    s = b"   " + bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()) + b"   "
    found = Counter()
    for i in range(len(s) - 3):
        for n in (2, 3, 4) if s[i + 1] != 32 else ():
            h = sum(a * b for a, b in zip(s[i : i + n], GRAM_FACTORS)) % 2**32
            found[(h ^ h >> 15) * 0x2C1B3C6D % 2**32 >> 32 - bits] += 1
    return found


def test_language_by_definition(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: (r["text"], r["lang"], plain_grams(r["text"], 13)) for r in docs.collect()}
    told = {}
    for doc_id, (_, lang, grams) in texts.items():
        if zlib.crc32(str(doc_id).encode()) % 4 != 2:
            told.setdefault(lang, Counter()).update(grams)
    names = sorted(told)
    share = {x: [(told[x][f] + 0.5) / (told[x].total() + 0.5 * 2**13) for f in range(2**13)] for x in names}
    code = dict(zip(names, L.codewords(len(names)).tolist()))
    bits = range(len(code[names[0]]))

    def side(bit, sign):
        own = [share[x] for x in names if code[x][bit] == sign]
        return [sum(column) / len(own) for column in zip(*own)]

    weights = [[math.log(a / b) for a, b in zip(side(bit, 1), side(bit, -1))] for bit in bits]
    usual = {x: [code[x][b] * sum(map(operator.mul, share[x], weights[b])) for b in bits] for x in names}
    scale = [sum(abs(usual[x][b]) for x in names) / len(names) for b in bits]
    trust = {x: [max(usual[x][b] / scale[b], 0.05) for b in bits] for x in names}

    def loss(grams, x):
        total = 0.0
        for b in bits:
            margin = sum(n * weights[b][f] for f, n in grams.items()) / grams.total() / scale[b]
            total += trust[x][b] / sum(trust[x]) * math.log1p(math.exp(-2 * code[x][b] * max(-4, min(4, margin))))
        return total

    found = L.identify(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        text, _, grams = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(map(str.isalpha, text)):
            assert r["lang_pred"] == "und"
            continue
        losses = {x: loss(grams, x) for x in names}
        least = min(losses.values())
        assert losses[r["lang_pred"]] <= least + 1e-4
        assert r["score"] == pytest.approx(1 / sum(math.exp(-L.SHARPNESS * (v - least)) for v in losses.values()), abs=1e-3)
        assert r["ambiguous"] == (r["score"] < L.AMBIGUOUS)


def plain_cuts(words, breaks):
    """Boundaries by their definition, one window at a time."""
    h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) // 2 for w in words]
    gap = [(a * 48271 + b * 39373) % 2147483647 for a, b in zip(h, h[1:])]
    found = {0, len(words), *breaks}
    for a in range(len(gap) - SD.WINDOW + 1):
        own = gap[a : a + SD.WINDOW]
        found.add(a + own.index(min(own)) + 1)
    return sorted(found)


def plain_removal(rows, separator, unit_words, run_words):
    """The spans to remove from each (id, text), from a dictionary of whole units."""
    texts = sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda r: (r[0], text_keys[r[1]]))
    first, out = set(), {}
    for doc, text in texts:
        places = [m.span() for m in re.finditer(r"\S+", text)]
        words = [text[a:b].lower() for a, b in places]
        ends = [m.start() for m in re.finditer(separator, text)] + [len(text)]
        breaks = [sum(b <= e for _, b in places) for e in ends]
        cuts = plain_cuts(words, breaks) if len(words) >= unit_words else []
        units = {(c, min((e for e in cuts if e - c >= unit_words), default=None)) for c in cuts}
        units |= {(max((c for c in cuts if e - c >= unit_words), default=None), e) for e in breaks if cuts}
        gone = [False] * len(words)
        for a, b in sorted(u for u in units if None not in u):
            if tuple(words[a:b]) in first:
                gone[a:b] = [True] * (b - a)
            first.add(tuple(words[a:b]))
        spans, k = [], 0
        while k < len(words):
            e = k
            while e < len(words) and gone[e]:
                e += 1
            if e - k >= run_words:
                spans.append((places[k][0], places[e - 1][1]))
            k = max(e, k + 1)
        out[doc, text] = spans
    return out


text_keys: dict = {}


@pytest.mark.parametrize("separator,sizes", [(SD.LINES, {}), (SD.PARAGRAPHS, {}), (SD.LINES, {"block_bytes": 300, "bucket_bytes": 500})])
def test_substring_removal(spark, separator, sizes):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["a", "B", "cc", "é", "dd", "Ee", "f"]) + rng.choice(["", "x", "Y", "zz", "."]) for _ in range(n))
    passages = [words(rng.randint(5, 60)).replace(" ", rng.choice([" ", "\n", " \t "]), 3) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice([words(rng.randint(0, 30)), rng.choice(passages)]) for _ in range(rng.randint(1, 6))]
        rows.append((i // 2 if i % 5 == 0 else i, rng.choice(["\n", "\n\n", " "]).join(parts)))
    rows += [(70, ""), (71, "\n\n"), (72, passages[0].upper() + "  \n"), (73, "again " * 200), (74, " \n" + passages[1] + "\n" + words(3)), rows[7], rows[7]]
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows] + [(80, None, "x", 1, 2), (None, passages[0], "x", 1, 2)], "doc_id long, text string, removed string, first int, text_key int")
    text_keys.update({r["t"]: r["k"] for r in docs.selectExpr("text t", "xxhash64(text) k").collect()})
    out = remove_repeats(docs, separator, 8, 12, keep=("first", "text_key"), **sizes).collect()
    want = plain_removal(rows, separator, 8, 12)
    left = Counter()
    for (doc, text), spans in want.items():
        left[doc, SD.without(text, spans), tuple(spans)] += rows.count((doc, text))
    left[80, None, ()] += 1
    left[None, passages[0], ()] += 1
    assert Counter((r["doc_id"], r["text"], tuple((x["start"], x["end"]) for x in r["removed"] or [])) for r in out) == left
    assert sum(bool(s) for s in want.values()) > 10 and out[0].asDict().keys() == {"doc_id", "text", "removed", "first", "text_key"}
    assert remove_repeats(docs.limit(0)).count() == 0


def test_rows_are_cut_by_their_own_units(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, same), (2, same + "\ny"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ wholly different text")]
    got = {(r["doc_id"], r["text"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[0], (2, "y"), rows[2]}


def test_long_passages_go_wherever_they_begin_and_clean_texts_stay(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    n, seen, covered, copies, texts = 50, set(), {}, set(), set()
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    for doc, text in rows:
        words = text.lower().split()
        held = [" ".join(words[a : a + n]) for a in range(len(words) - n + 1)]
        covered[doc] = 0
        for h in held:
            covered[doc] += h in seen
            seen.add(h)
        if " ".join(words) in texts:
            copies.add(doc)
        texts.add(" ".join(words))
    removed = {r["doc_id"]: r["removed"] for r in remove_repeats(docs).collect()}
    holds = [d for d, c in covered.items() if c and d not in copies]
    clean = [d for d, c in covered.items() if not c and d not in copies]
    assert len(holds) > 50 and all(removed[d] for d in holds)
    assert sum(not removed[d] for d in clean) >= 0.97 * len(clean)


def plain_leaks(docs, items):
    found = set()
    for doc, text in docs:
        words = DC.words_of(text or "")
        for item, passage in items:
            own = DC.words_of(passage or "")
            width = min(5, len(own))
            if not own or len(words) < width:
                continue
            grams = lambda w: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
            a, b = grams(own), grams(words)
            n = min(len(a), len(b))
            want = Counter(a)
            for s in range(len(b) - n + 1):
                have = Counter(b[s : s + n])
                if sum((want & have).values()) / sum((want | have).values()) >= 0.8:
                    found.add((doc, item))
                    break
    return found


def test_leaks(spark):
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, words(rng.randint(15, 60))) for i in range(30)]
    docs = []
    for i in range(150):
        text = words(rng.randint(0, 200))
        if i % 2:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                passage[rng.randrange(len(passage))] = "changed"
            if rng.random() < 0.2:
                del passage[rng.randrange(len(passage))]
            at = rng.randint(0, len(text))
            text[at:at] = passage
        docs.append((i, (" " if i % 3 else ", ").join(w.upper() if i % 5 == 0 else w for w in text)))
    items = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "tiny item here"), (93, "word")]
    docs += [(200, None), (201, ""), (202, "a Tiny, ITEM here!"), (203, "nothing"), (203, "tiny item here"), (None, "tiny item here")]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in DC.find_leaks(table, bench).collect()}
    want = plain_leaks(docs, items)
    assert got <= want and {x for x in want if x[1] >= 90} <= got
    assert len(want - got) <= 0.02 * len(want), "windows of 0.8 similarity whose fingerprints are further apart than the radius"
    blocks = {(r["doc_id"], r["item_id"]) for r in DC.find_leaks(table, bench, bytes_per_pass=2000).collect()}
    assert blocks == got
    kept = [(r["doc_id"], r["text"]) for r in DC.remove_leaks(table, bench).collect()]
    held = [any((d, i) in got for i, _ in items) and bool(plain_leaks([(d, t)], items)) for d, t in docs]
    assert sorted(kept, key=repr) == sorted([r for r, h in zip(docs, held) if not h], key=repr)
    assert DC.find_leaks(table.limit(0), bench).count() == DC.find_leaks(table, bench.limit(0)).count() == 0


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(7)
    items = [(i, rng.integers(0, 1 << 63, 40 + i % 3).astype(np.uint64)) for i in range(30)]
    index = DC.BenchmarkIndex(items, 5)
    for _ in range(2000):
        k = int(rng.integers(30))
        bits = rng.choice(64, rng.integers(0, DC.RADIUS + 1), replace=False)
        other = index.prints[k : k + 1] ^ np.uint64(sum(1 << int(b) for b in bits))
        assert k in index.candidates(other, int(index.width_of[k]))[1]
    assert DC.NEAR * DC.BLOCKS + DC.BLOCKS > DC.RADIUS


def test_blocks_alone_name_the_items(spark, sf, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    index = DC.indexes([(r["item_id"], r["text"]) for r in bench.collect()], DC._Words())
    cache, texts = DC._Words(), [r["text"] for r in docs.collect()]
    hashes = [np.array([cache[w] for w in DC.words_of(t)], dtype=np.uint64) for t in texts]
    found = [i.matches(h) for h in hashes for i in index]
    assert sum(map(bool, found)) > 2
    none = np.zeros(0, dtype=np.int64)
    monkeypatch.setattr(DC.BenchmarkIndex, "candidates", lambda self, prints, width: (none, none))
    assert not any(i.matches(h) for h in hashes for i in index)


def test_equal_item_ids_and_repeated_items(spark):
    one, two = ("alpha beta gamma delta epsilon zeta eta theta".split(), "one two three four five six seven eight".split())
    bench = spark.createDataFrame([(1, " ".join(one)), (1, " ".join(two)), (1, " ".join(two)), (1, "-".join(two))], "item_id long, text string")
    docs = spark.createDataFrame([(7, "xx " + ", ".join(two) + " yy"), (8, "-".join(one))], "doc_id long, text string")
    for size in (1 << 20, 20):
        got = sorted((r["doc_id"], r["item_id"]) for r in DC.find_leaks(docs, bench, bytes_per_pass=size).collect())
        assert got == [(7, 1), (7, 1), (8, 1)]


def plain_losses(docs, target, size, cells):
    """The two models from dictionaries."""
    tokens = {d: (t or "").lower().encode().split() for d, t in docs}
    counts = Counter(w for ws in tokens.values() for w in ws)
    least = min(n for n in counts.values() if sum(m >= n for m in counts.values()) <= size)
    known = {w: i for i, w in enumerate(sorted((w for w in counts if counts[w] >= least), key=lambda w: (-counts[w], w)), 1)}
    models = []
    for ids in (target, set(tokens)):
        word, pair = Counter(), Counter()
        for d in ids:
            own = [known.get(w, 0) for w in tokens[d]]
            word.update(own)
            pair.update(int(LM.cell_of(np.array([a]), np.array([b]), cells)[0]) for a, b in zip([0, *own], own))
        models.append((word, pair))
    scale = sum(models[0][0].values()) / sum(models[1][0].values())
    out = {}
    for d, ws in tokens.items():
        own, losses = [known.get(w, 0) for w in ws], []
        for (word, pair), s in zip(models, (1, scale)):
            total = sum(word.values()) * s
            loss = []
            for a, b in zip([0, *own], own):
                single = (word[b] * s + LM.WORD_PRIOR) / (total + LM.WORD_PRIOR * (len(known) + 1))
                c = min(pair[int(LM.cell_of(np.array([a]), np.array([b]), cells)[0])], word[a], word[b]) * s
                loss.append(-np.log2((c + LM.PAIR_PRIOR * single) / (word[a] * s + LM.PAIR_PRIOR)))
            losses.append(loss)
        out[d] = losses
    return out


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_cross_entropy_difference(spark, monkeypatch, most):
    monkeypatch.setattr(LM, "BROADCAST_IDS", most)
    rng = random.Random(8)
    good, bad = "alpha beta gamma delta".split(), "eins zwei drei alpha".split()
    docs = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(1, 40)))) for i in range(60)] + [(100, None), (101, " \n")]
    target = {i for i in range(0, 60) if i % 2 and i < 30}
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string")
    ids = spark.createDataFrame([(i,) for i in target] + [(7,), (None,), (999,)], "doc_id long")
    models = LM.train(table, ids, size=5, cells=64)
    want = plain_losses(docs, target, 5, 64)
    for r in LM.score(table, models).collect():
        a, b = want[r["doc_id"]]
        assert r["n_tokens"] == len(a)
        if a:
            assert abs(r["target_loss"] - np.mean(a)) < 1e-9 and abs(r["background_loss"] - np.mean(b)) < 1e-9
            assert abs(r["score"] - (np.mean(a) - np.mean(b))) < 1e-9 and r["worst_token"] == int(np.argmax(np.array(a) - b))
        else:
            assert r["score"] is None
    scores = {r["doc_id"]: r["score"] for r in LM.score(table, models).collect()}
    assert np.mean([scores[i] for i in range(1, 60, 2)]) < np.mean([scores[i] for i in range(0, 60, 2)])
    empty = LM.train(table.limit(0), ids)
    assert LM.score(table.limit(0), empty).count() == 0


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_every_word_and_pair_counts(spark, block_bytes):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(50)]
    docs += [(100, None), (101, " \n"), (None, "w1 w2 once"), (7, "w3 Twice"), (7, "w3 twice")]
    target = {i for i in range(0, 50, 3)} | {7}
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string")
    ids = spark.createDataFrame([(i,) for i in target] + [(7,), (None,), (999,)], "doc_id long")
    tokens = [(d, (t or "").lower().split()) for d, t in docs]
    models = []
    for chosen in (lambda d: d in target, lambda d: True):
        word, pair = Counter(), Counter()
        for d, ws in tokens:
            if chosen(d) and ws:
                word.update([None, *ws])
                pair.update(zip([None, *ws], ws))
        models.append((word, pair))
    n = [sum(c for w, c in word.items() if w) for word, _ in models]
    size, want = len(models[1][0]) - 1, []
    for d, ws in tokens:
        losses = []
        for (word, pair), s in zip(models, (1, n[0] / n[1])):
            single = {w: (word[w] * s + LM.WORD_PRIOR) / (n[0] + LM.WORD_PRIOR * size) for w in ws}
            losses.append([-np.log2((pair[v, w] * s + LM.PAIR_PRIOR * single[w]) / (word[v] * s + LM.PAIR_PRIOR)) for v, w in zip([None, *ws], ws)])
        apart = np.array(losses[0]) - losses[1]
        want.append((d, len(ws), *(round(float(np.mean(x)), 9) if ws else None for x in (*losses, apart)), *((int(np.argmin(apart)), int(np.argmax(apart))) if ws else (None, None))))
    got = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in LM.score_exactly(table, ids, block_bytes=block_bytes).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert LM.score_exactly(table.limit(0), ids).count() == 0
    labels = ids.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    whole = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in LM.cross_entropy_difference(table, labels).collect()]
    assert sorted(whole, key=repr) == sorted(want, key=repr)
