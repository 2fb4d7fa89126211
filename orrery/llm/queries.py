"""The training-data queries of the driver contract, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .common import fresh_path, table
from .decontamination import find_leaks
from .html_extraction import extract
from .language_id import identify
from .lm_scoring import cross_entropy_difference
from .media import features, to_media
from .packing import pack_documents
from .sharding import fill_table, place
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeats


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The shards of the placement query.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(to_media(table(spark, sf_dir, "documents")))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), ["doc_id"], SHARDS)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    n = F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed")
    return found.select("doc_id", "text", n, F.coalesce(F.array_join(spans, " "), F.lit("")).alias("removed"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.read(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_lm_scoring, op2_media_jpeg, op3_simhash_golay, op4_sharding, op5_decontamination, op6_substring_dedup,
        op7_warc, op8_packing, op9_html_extraction, op10_language_id,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Placement, with the filled table as a literal; substring removal in full."""
    filled = ",".join(SHARDS[k] for k in fill_table(SHARDS))
    return {"op4_sharding": _PLACEMENT.format(filled=filled), "op6_substring_dedup": _SUBSTRING, "op7_warc": _WARC}


_PLACEMENT = """
WITH lookup AS (SELECT string_split('{filled}', ',') AS shards),
hashed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT % 65537 AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1] AS shard FROM hashed, lookup
"""
_SUBSTRING = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]|[^ \t\n\r\f\v\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]+|[ \t\n\r\f\v]+') AS parts
  FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS k FROM split),
placed AS (
  SELECT *, CAST(coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
    coalesce(lag(part) OVER (PARTITION BY doc_id ORDER BY k), '') AS gap
  FROM parts),
words AS (
  SELECT doc_id, lower(part) AS word, pos, pos + length(part) AS stop, gap[1] IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) AND contains(gap, chr(10)) AS breaks,
    ('0x' || substr(md5(lower(part)), 1, 8))::BIGINT // 2 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i
  FROM placed WHERE part[1] NOT IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
texts AS (
  SELECT doc_id, list(word ORDER BY i) AS ws, list(h ORDER BY i) AS hs, list(pos ORDER BY i) AS starts, list(stop ORDER BY i) AS stops,
    coalesce(list(i ORDER BY i) FILTER (WHERE breaks AND i > 0), []) AS breaks, count(*) AS n
  FROM words GROUP BY doc_id HAVING count(*) >= 16),
gaps AS (SELECT *, list_transform(range(1, n), lambda i: (hs[i] * 48271 + hs[i + 1] * 39373) % 2147483647) AS g FROM texts),
least AS (SELECT *, list_transform(range(1, len(g) - 10), lambda a: a - 1 + list_position(g[a:a + 11], list_min(g[a:a + 11]))) AS inner_cuts FROM gaps),
cut AS (SELECT *, list_sort(list_distinct(inner_cuts || breaks || [0, n])) AS cuts FROM least),
spans AS (
  SELECT doc_id, ws, list_transform(cuts, lambda c: {'a': c, 'b': list_min(list_filter(cuts, lambda e: e >= c + 16))})
    || list_transform(breaks || [n], lambda e: {'a': list_max(list_filter(cuts, lambda c: c <= e - 16)), 'b': e}) AS spans
  FROM cut),
units AS (SELECT doc_id, ws, unnest(list_distinct(spans)) AS span FROM spans),
keyed AS (
  SELECT doc_id, span.a AS a, span.b AS b, md5(array_to_string(ws[span.a + 1:span.b], ' ')) AS digest
  FROM units WHERE span.a IS NOT NULL AND span.b IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, a) AS rk FROM keyed),
gone AS (SELECT doc_id, a, b, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM ranked WHERE rk > 1),
grouped AS (SELECT *, sum(CASE WHEN upto IS NULL OR a > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b) AS run FROM gone),
runs AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM grouped GROUP BY doc_id, run HAVING max(b) - min(a) >= 30),
removed AS (
  SELECT doc_id, a, starts[a + 1] AS pos, stops[b] AS stop,
    CASE WHEN a > 0 AND (b = n OR list_contains(breaks, b) AND NOT list_contains(breaks, a)) THEN stops[a] ELSE starts[a + 1] END AS cut_from,
    CASE WHEN a > 0 AND (b = n OR list_contains(breaks, b) AND NOT list_contains(breaks, a)) THEN stops[b] WHEN b = n THEN 1000000000 ELSE starts[b + 1] END AS cut_to
  FROM runs JOIN texts USING (doc_id)),
pieces AS (SELECT r.*, text, coalesce(lag(cut_to) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM removed r JOIN documents USING (doc_id)),
joined AS (
  SELECT doc_id, string_agg(substr(text, since + 1, cut_from - since), '' ORDER BY a) || substr(any_value(text), max(cut_to) + 1) AS text,
    count(*) AS n_removed, string_agg(pos || '-' || stop, ' ' ORDER BY a) AS removed
  FROM pieces GROUP BY doc_id)
SELECT d.doc_id, coalesce(j.text, d.text) AS text, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN joined j USING (doc_id)
"""
_WARC = """
WITH payloads AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""
