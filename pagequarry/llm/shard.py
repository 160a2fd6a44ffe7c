"""Sharding by a Feistel permutation of global row numbers, on DataFrame functions only.

Rows get global numbers (by bucket, doc_id, size, checksum); a Feistel network over the grid
a x b >= n permutes them, walking on while it lands outside of n. The permuted number gives
the shard (its remainder) and the slot (its quotient), so shard sizes differ by one row at
most, and both can be computed from the number alone, without the table.

Defined cases: a null text counts as an empty one; a null doc_id sorts first; equal rows are
counted before they are shuffled and take neighbouring numbers; ties of doc_id, size and checksum
count as equal rows; texts of any length count whole; an empty table gives no rows; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import buckets, each_copy, running_before, spread_sql
from .shared import stored

SHARDS, ROUNDS = 16, 6
_PRIME = 2147483647
#: Multiplier and offset of each round; any values below the prime keep the network a permutation.
ROUND_KEYS = [(48271 + 7919 * r, 1103515245 // (r + 1) + 12345 * r) for r in range(ROUNDS)]
#: Walks beyond this many steps fail loudly; up to 4096 rows no walk can be as long.
MOST_WALKS = 64


def grid(n: int) -> tuple[int, int]:
    """The sides of the smallest near-square grid that holds n rows."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _scramble(x: Column, r: Column) -> Column:
    keys = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(o).cast("long").alias("o")) for m, o in ROUND_KEYS))
    key = F.get(keys, r)
    y = (x * key["m"] + key["o"]) % F.lit(_PRIME)
    return ((y * y) % F.lit(_PRIME) * F.lit(69621) + key["o"]) % F.lit(_PRIME)


def _once(x: Column, n: int) -> Column:
    a, b = grid(n)

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        left = F.when(even, (s["l"] + _scramble(s["r"], r)) % F.lit(a)).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise((s["r"] + _scramble(s["l"], r)) % F.lit(b))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    start = F.struct(((x - x % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(x: Column, n: int) -> Column:
    """The place of row number x (0 to n - 1) in the shuffled order of n rows."""
    a, b = grid(n)
    steps = min(MOST_WALKS, a * b - n)
    once = _once(x, n)
    if not steps:
        return once
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once, lambda y, _: F.when(y < F.lit(n), y).otherwise(_once(y, n)))
    return F.when(walk < F.lit(n), walk).otherwise(F.raise_error("the permutation walked too long"))


def shards(docs: DataFrame, n_shards: int = SHARDS, row: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, number, shard and slot of each row of docs.

    `row` names a column that is unique, which is returned too and tells equal rows apart.
    """
    key = ["doc_id", "size", "text_crc32", *([row] if row else [])]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *([F.col(row)] if row else []))
    kept = stored(rows.groupBy(*key).agg(F.count("*").alias("n")), "shard-keys")
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    n, m = int(total[0]), buckets(int(total[1]))
    dealt = kept.withColumn("bucket", F.expr(f"{spread_sql('doc_id', 'text_crc32', 7)} % {m}"))
    numbered = running_before(dealt, [], "bucket", key, "n", "before")
    each = each_copy(numbered, "n", "copy", int(total[2])).withColumn("number", F.col("before") + F.col("copy"))
    each = each.withColumn("place", permuted(F.col("number"), n))
    return each.select(*key, "number", (F.col("place") % n_shards).cast("int").alias("shard"), F.expr(f"place div {n_shards}").alias("slot"))
