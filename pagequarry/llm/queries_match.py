"""Queries of the matching operators: op1, op4, op8, op9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated, contamination
from . import bm25, jaccard_join, lsm_dedup, suffix_dedup
from .shared import doc_key


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_key(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), d AS (SELECT doc_id, coalesce(ws, []) AS ws, len(coalesce(ws, [])) AS n FROM w),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), bl AS (SELECT item_id, ws, least(13, len(ws)) AS l FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[s:s + l - 1], ' ') AS win FROM (SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS s FROM bl)),
lens AS (SELECT DISTINCT l FROM bl),
dw AS (SELECT doc_id, l, s, array_to_string(ws[s:s + l - 1], ' ') AS win FROM (SELECT doc_id, ws, l, unnest(range(1, n - l + 2)) AS s FROM d, lens WHERE n >= l)),
h AS (SELECT dw.doc_id, dw.l, dw.s, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT doc_id, s, l FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= d.n AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_key(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return lsm_dedup.without_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS s FROM d)),
f AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
p AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT p.*, max(f.s) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM p LEFT JOIN f ON p.r = f.r AND p.i = f.s),
k AS (SELECT r, count(*) FILTER (last IS NOT NULL AND i < last + 35) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR i >= last + 35) AS kept FROM g GROUP BY r)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_key(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return suffix_dedup.without_copies(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, s, md5_number(substring(x, 2 * s - 1, 200)) AS h FROM (SELECT r, x, unnest(range(1, len(x) // 2 - 98)) AS s FROM d)),
f AS (SELECT w.r, w.s FROM w JOIN (SELECT h, min(r * 4294967296 + s) AS m FROM w GROUP BY h HAVING count(*) > 1) AS g ON w.h = g.h WHERE w.r * 4294967296 + w.s > g.m),
i AS (SELECT r, s, s > coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), -1000) + 100 AS fresh FROM f),
j AS (SELECT r, s, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY s) AS k FROM i),
sp AS (SELECT r, k, min(s) AS a, max(s) + 100 AS b FROM j GROUP BY r, k),
kept AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS before FROM sp),
t AS (SELECT kept.r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(x, 2 * before - 1, 2 * (a - before)), '' ORDER BY a) AS head FROM kept JOIN d ON kept.r = d.r GROUP BY kept.r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(x, 2 * coalesce(last, 1) - 1))) AS kept_sha256
FROM d LEFT JOIN t ON d.r = t.r
"""


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_key(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.top_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# BM25 with k1 1.2 and b 0.75 of all words that two documents have; scores of words are multiples of 2**-24, as the operator's.
OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), g AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS DOUBLE) / count(*) AS mean FROM w),
p AS (SELECT r, word, count(*) AS c FROM (SELECT r, unnest(ws) AS word FROM w) GROUP BY r, word),
f AS (SELECT word, count(*) AS df FROM p GROUP BY word HAVING count(*) >= 2),
s AS (
  SELECT p.r, p.word, w.doc_id, round_even(ln(1e0 + (docs - df + 0.5e0) / (df + 0.5e0)) * c * 2.2e0 / (c + 1.2e0 * (0.25e0 + 0.75e0 * len(ws) / mean)) * 16777216e0, 0) / 16777216e0 AS x
  FROM p JOIN f ON p.word = f.word JOIN w ON w.r = p.r, g
),
m AS (
  SELECT q.r, q.doc_id AS query_id, s.r AS d, s.doc_id, sum(s.x) AS score
  FROM w AS q JOIN p ON p.r = q.r JOIN s ON s.word = p.word WHERE q.doc_id % 20 = 0 GROUP BY q.r, q.doc_id, s.r, s.doc_id
),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST, d) AS INTEGER) AS rank, doc_id, score FROM m)
SELECT * FROM k WHERE rank <= 10
"""


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT r, array_to_string(ws[s:s + least(5, len(ws)) - 1], ' ') AS x FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM d WHERE len(ws) > 0)
), n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
o AS (SELECT p.r AS a, q.r AS b, count(*) AS shared FROM g AS p JOIN g AS q ON p.x = q.x AND p.r <> q.r GROUP BY p.r, q.r),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT reach.a, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n ON d.r = n.r JOIN c ON d.r = c.a
"""

QUERIES = {"op5_top_k_search": op5_top_k_search, "op1_jaccard_join": op1_jaccard_join, "op8_suffix_dedup": op8_suffix_dedup, "op4_substring_dedup": op4_substring_dedup, "op9_decontamination": op9_decontamination}
SQL = {"op5_top_k_search": OP5_SQL, "op1_jaccard_join": OP1_SQL, "op8_suffix_dedup": OP8_SQL, "op4_substring_dedup": OP4_SQL, "op9_decontamination": OP9_SQL}
