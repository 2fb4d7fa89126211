import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from orrery.llm import queries as Q
from orrery.llm.common import cut_lineage, table
from orrery.llm.simhash_dedup import fingerprint

from ..test_catalog import TABLES, rows_of


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = Q.queries()[name](spark, sf), con.sql(Q.oracle_sql()[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_registered():
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in contract.queries()


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage kept."""
    odd = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, "12 34 !!", "en", "s", 8)], table(spark, sf, "documents").schema)
    docs = table(spark, sf, "documents").unionByName(odd)
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(cut_lineage(stage(spark, kept[-1], sf), name))
    return kept


def test_each_stage_takes_effect(spark, sf, stages):
    docs, known, single, cut, clean, packed = ({r["doc_id"]: r for r in s.collect()} for s in stages)
    for s in stages[:-1]:
        assert s.columns == list(corpus_pipeline.COLUMNS)
    assert set(docs) - set(known) == {900_001, 900_002, 900_003}
    prints = {d: fingerprint(r["text"].encode()) for d, r in known.items()}
    near = lambda d: [e for e in known if e < d and (prints[d] ^ prints[e]).bit_count() <= 3]
    assert set(single) == {d for d in known if not near(d)}
    assert set(cut) <= set(single) and all(r["n_chars"] == len(r["text"]) and r["text"].strip() for r in cut.values())
    held = [{" ".join(w[a : a + 60]) for a in range(len(w) - 59)} for w in (r["text"].lower().split() for r in cut.values())]
    assert sum(map(len, held)) == len(set().union(*held)), "no passage of 60 words occurs in two documents"
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    words = lambda t: " " + " ".join(__import__("re").findall(r"\w+", t.lower())) + " "
    leaked = {d for d, r in cut.items() if any(words(i) in words(r["text"]) for i in items)}
    assert set(cut) - set(clean) >= leaked and len(set(cut) - set(clean) - leaked) <= 1
    assert set(packed) == set(clean)


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "packing"]


ODD = "doc_id long, text string, lang string, source string, n_chars long, _gone long, removed string, root long, fp long, _language string, target boolean, digest binary"


@pytest.mark.parametrize("rows", [[], [
    (1, "Some words of a text, long enough to count here.", "en", "s", 48), (1, "Some words of a text, long enough to count here.", "en", "s", 48),
    (2, None, None, None, None), (None, "A null id with words of its own, quite unlike others.", "en", None, 3), (3, "", "en", "s", 0), (4, "x", None, "s", 1),
    (5, "word " * 60_000, "en", "s", 300_000), (6, "\n\n\n", "en", "s", 3), (7, "\x00 \ufffd 😀 a", "en", "s", 5),
]])
def test_odd_rows_and_columns(spark, sf, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, "y", True, b"z") for r in rows], ODD)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf), name)
        kept.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    known, single, cut, clean, packed = kept
    if rows:
        assert known == sorted([1, 1, 4, 5, 7, None], key=str) and single == known
        assert set(cut) == set(clean) == set(packed) == {1, 4, 5, 7, None}
    else:
        assert kept == [[]] * 5
