"""Deterministic numbering of rows without a single-task sort, on DataFrame functions only.

Rows are dealt into buckets by arithmetic on their key, or by a global sort; bucket totals give
each bucket's offset, and a window inside the bucket the rest. As many buckets as rows need, so
no source or key gathers in one task. Equal rows are counted before and told apart after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

ROWS_PER_BUCKET = 16384
_PRIME = 2147483647


def spread_sql(key: str, size: str, seed: int) -> str:
    """A number below 2**31 - 1 from two integers, as SQL that Spark and DuckDB both read."""
    a = f"((coalesce({key}, -1) % {_PRIME}) + {_PRIME}) % {_PRIME}"
    b = f"(({a}) * {48271 + 2 * seed} + coalesce({size}, 0) % {_PRIME} + {seed}) % {_PRIME}"
    return f"((({b}) * 69621) % {_PRIME} * 1103515245 + 12345) % {_PRIME}"


def buckets(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BUCKET))


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df sorted and written, with the sort's partition as _part: a bucket for running_before."""
    return stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "in-order")


def each_copy(df: DataFrame, n: str, copy: str, most: int) -> DataFrame:
    """Each row n times, numbered 0 to n - 1 in `copy`. Rows of many copies are cut into chunks and dealt out; `most` is the largest n."""
    rows = df.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {ROWS_PER_BUCKET})")))
    if most > ROWS_PER_BUCKET:
        rows = rows.repartition(F.xxhash64(*df.columns, "_chunk"))
    first = F.col("_chunk") * ROWS_PER_BUCKET
    return rows.withColumn(copy, F.explode(F.sequence(first, F.least(F.col(n) - 1, first + (ROWS_PER_BUCKET - 1))))).drop("_chunk")


def running_before(df: DataFrame, group: list[str], bucket: str, order: list[str | Column], amount: str, out: str) -> DataFrame:
    """df with the sum of `amount` over all rows of its group that come before it, by (bucket, order)."""
    totals = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy(bucket) if group else Window.orderBy(bucket)
    offsets = totals.select(*group, bucket, (F.sum("_total").over(earlier) - F.col("_total")).alias("_offset"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, bucket]]
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return inner.alias("a").join(offsets.alias("b"), on=_all(same)).select("a.*", (F.col("b._offset") + F.col("a._within")).cast("long").alias(out)).drop("_within")


def _all(conditions: list[Column]) -> Column:
    first, *rest = conditions
    for c in rest:
        first = first & c
    return first
