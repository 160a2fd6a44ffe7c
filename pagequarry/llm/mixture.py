"""Mixing sources to target weights on a time-varying curriculum, on DataFrame functions only.

Targets: the sources share `budget` times all sizes by weight; a target stops at `repeat`
times its source's size, and the excess is shared again by weight. The level where nothing is
left over is found from running sums over the sources, ordered by how soon they fill.

Positions: a source's weight follows a piecewise linear schedule over training time. Its
integral is the share of the target that is used up by then; the inverse at a document's
place in its source's word count is the time at which the document is trained on. Documents
of a source are lined up in a fixed pseudo-random order; the line is walked until the target
is reached, at most `repeat` (two) times. The result is range-sorted by position.

Defined cases: a null text has no words; a null source is a source and sorts last; a source
without words has target 0; a document that isn't taken has no position; null ids are ids like
others; rows of equal doc_id, source and size are documents of their own with neighbouring
places; texts of any length count whole; an empty table gives no rows; columns other than
doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import buckets, each_copy, in_order, running_before, spread_sql
from .shared import stored

WEIGHTS = (5, 2, 1)
BUDGET, REPEAT = 1.5, 2
#: Weight multipliers at training times 0, 1/2 and 1, for each of WEIGHTS in turn; each integrates to 1.
TIMES = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
WORD = r"[^\x20\x09-\x0D]+"


def time_sql(share: str, schedule: tuple[float, ...], times: tuple[float, ...] = TIMES) -> str:
    """Training time at which `share` of a source's target is used up: the inverse of the schedule's integral."""
    parts, used = [], 0.0
    for (t0, t1), (g0, g1) in zip(zip(times, times[1:], strict=False), zip(schedule, schedule[1:], strict=False), strict=True):
        slope, area = (g1 - g0) / (t1 - t0), (g0 + g1) / 2 * (t1 - t0)
        rest = f"({share} - {used!r}e0)"
        parts.append((used + area, f"{t0!r}e0 + 2e0 * {rest} / ({g0!r}e0 + sqrt({g0 * g0!r}e0 + {2 * slope!r}e0 * {rest}))"))
        used += area
    *early, (_, last) = parts
    return "CASE " + " ".join(f"WHEN {share} <= {end!r}e0 THEN {x}" for end, x in early) + f" ELSE {last} END"


def position_sql(share: str, tier: str) -> str:
    """As time_sql, with the schedule of the source's tier."""
    return "CASE " + " ".join(f"WHEN {tier} = {k} THEN {time_sql(share, s)}" for k, s in enumerate(SCHEDULES)) + " END"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, tier and target of each source; sizes has source and amount.

    Ranks and sums go over a sorted, written table of the sources, so that there may be many.
    """
    sources = sizes.groupBy("source").agg(F.sum("amount").alias("source_size")).withColumn("one", F.lit(1))
    by_name, by_fill = F.col("source").asc_nulls_last(), F.col("cap") / F.col("weight")
    ranked = running_before(in_order(sources, by_name), [], "_part", [by_name], "one", "rank").drop("_part", "one")
    tier = (F.col("rank") % len(WEIGHTS)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("tier") + 1)
    filled = in_order(ranked.withColumn("tier", tier).withColumn("weight", weight).withColumn("cap", F.col("source_size") * REPEAT), by_fill, by_name)
    total = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    summed = running_before(running_before(filled, [], "_part", [by_fill, by_name], "cap", "full"), [], "_part", [by_fill, by_name], "weight", "used")
    levels = (F.lit(BUDGET) * F.lit(total[0] or 0) - F.col("full")) / (F.lit(total[1] or 0) - F.col("used"))
    level = summed.agg(F.max(levels)).first()[0]
    return filled.select("source", "source_size", "tier", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mixture(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position and repeat_position, sorted by position.

    taken counts words, those of the second pass included; position is the training time of the
    first pass, repeat_position that of the second, null where the document isn't taken. `row`
    names a column that is unique, which is returned too; rows of equal doc_id, source and size
    then line up by the checksum of their text.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *([F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("tie"), F.col(row)] if row else []))
    base = base.withColumn("n", F.lit(1).cast("long")) if row else base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    sizes = stored(base.withColumn("amount", F.col("size") * F.col("n")), "mix-sizes")
    counted = sizes.agg(F.count("*"), F.max("n")).first()
    m, most = buckets(counted[0]), int(counted[1] or 0)
    key, order = ("size + tie", ["tie", row]) if row else ("size", [])
    dealt = sizes.withColumn("_spread", F.expr(spread_sql("doc_id", key, 3))).withColumn("_bucket", F.col("_spread") % m)
    lined = each_copy(running_before(dealt, ["source"], "_bucket", ["_spread", "doc_id", "size", *order], "amount", "start"), "n", "copy", most)
    lined = lined.withColumn("before", F.col("start") + F.col("copy") * F.col("size"))
    kept = ["doc_id", "source", "size", "before", *([row] if row else [])]
    joined = lined.alias("a").join(targets(sizes).alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select(*(f"a.{c}" for c in kept), "t.source_size", "t.tier", "t.target")
    goal = F.floor("target")
    first = F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("before")))
    second = F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("source_size") - F.col("before")))
    out = joined.withColumn("_first", first).withColumn("_second", second)
    out = out.withColumn("_at", F.try_divide("before", "target")).withColumn("_again", F.try_divide(F.col("source_size") + F.col("before"), F.col("target")))
    return out.select(
        *([row] if row else []),
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_first") + F.col("_second")).cast("long").alias("taken"),
        F.when(F.col("_first") > 0, F.expr(position_sql("_at", "tier"))).alias("position"),
        F.when(F.col("_second") > 0, F.expr(position_sql("_again", "tier"))).alias("repeat_position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")
