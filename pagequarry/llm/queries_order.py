"""Queries of the ordering operators: op7 and op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixture as M
from . import shard as S
from .numbering import ROWS_PER_BUCKET, spread_sql

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.mixture(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position", "repeat_position")



def op7_sql() -> str:
    """The checksum byte by byte from the CRC-32 polynomial, the numbering and the permutation with its walk."""
    p = 2147483647

    def scramble(x: str, r: int) -> str:
        m, o = S.ROUND_KEYS[r]
        return f"((({x} * {m} + {o}) % {p}) * (({x} * {m} + {o}) % {p}) % {p} * 69621 + {o}) % {p}"

    steps = []
    for k in range(S.ROUNDS):
        left, right = ("l + " + scramble("r", k), "r") if k % 2 == 0 else ("l", "r + " + scramble("l", k))
        steps.append(f"s{k + 1} AS (SELECT id, n, a, b, CAST(({left}) % a AS BIGINT) AS l, CAST(({right}) % b AS BIGINT) AS r FROM s{k})")
    spread = spread_sql("doc_id", "crc", 7)
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY k) AS tb FROM (SELECT k, list_reduce([k] || range(0, 8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(0, 256)) AS k))
), base AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST(concat('0x', x) AS BIGINT)) AS bs FROM documents
), d AS (
  SELECT doc_id, len(bs) + 1 AS size, xor(list_reduce([CAST(4294967295 AS BIGINT)] || bs, lambda c, x: xor(tb[xor(c % 256, x) + 1], c // 256)), 4294967295) AS crc FROM base, tab
), k AS (
  SELECT *, ({spread}) % greatest(1, CAST(ceil((SELECT count(*) FROM (SELECT DISTINCT doc_id, size, crc FROM d)) / {ROWS_PER_BUCKET}.0) AS BIGINT)) AS bucket FROM d
), x AS (
  SELECT row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, crc) - 1 AS id, doc_id, size, crc FROM k
), g AS (
  SELECT n, a, CAST(ceil(n / CAST(a AS DOUBLE)) AS BIGINT) AS b FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM (SELECT count(*) AS n FROM d))
), place AS (
  WITH s0 AS (SELECT y AS id, n, a, b, y // b AS l, y % b AS r FROM g, (SELECT unnest(range(0, (SELECT a * b FROM g))) AS y)),
  {', '.join(steps)}
  SELECT id, n, l * b + r AS z FROM s{S.ROUNDS}
), walk AS (
  SELECT id AS start, z, n FROM place WHERE id < n
  UNION ALL
  SELECT w.start, q.z, w.n FROM walk w JOIN place q ON q.id = w.z WHERE w.z >= w.n
)
SELECT x.doc_id, CAST(x.size AS BIGINT) AS size, x.crc AS text_crc32, 'rows' AS law, CAST(z % {S.SHARDS} AS INTEGER) AS shard, z // {S.SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM x JOIN walk ON x.id = walk.start WHERE z < n
"""


def op10_sql() -> str:
    spread = spread_sql("doc_id", "size", 3)
    return f"""
WITH s AS (SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS tier FROM s GROUP BY source),
wt AS (SELECT *, CASE tier WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM src),
lv AS (SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
tg AS (SELECT source, source_size, tier, least(CAST(cap AS DOUBLE), (SELECT max(level) FROM lv) * weight) AS target FROM lv),
sp AS (SELECT *, {spread} AS spread FROM s),
ln AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY spread % greatest(1, CAST(ceil((SELECT count(*) FROM (SELECT DISTINCT doc_id, source, size FROM s)) / {ROWS_PER_BUCKET}.0) AS BIGINT)), spread, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sp),
j AS (SELECT ln.doc_id, ln.size, tg.source_size, tg.tier, tg.target, ln.before,
  greatest(0, least(ln.size, CAST(floor(target) AS BIGINT) - before)) AS f1, greatest(0, least(ln.size, CAST(floor(target) AS BIGINT) - source_size - before)) AS f2,
  CAST(before AS DOUBLE) / target AS at1, CAST(source_size + before AS DOUBLE) / target AS at2
  FROM ln JOIN tg ON ln.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, source_size, target, CAST(f1 + f2 AS BIGINT) AS taken,
  CASE WHEN f1 > 0 THEN {M.position_sql('at1', 'tier')} END AS position, CASE WHEN f2 > 0 THEN {M.position_sql('at2', 'tier')} END AS repeat_position
FROM j
"""


QUERIES = {"op7_sharding": op7_sharding, "op10_mixing": op10_mixing}
SQL = {"op7_sharding": op7_sql(), "op10_mixing": op10_sql()}
