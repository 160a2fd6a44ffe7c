"""Line deduplication on levelled sorted runs of line hashes, on DataFrame functions only.

A line's key is hashed to 128 bits. A run is a table of keys, each once, with the number of
documents that have it, in buckets by key and sorted inside; it is never changed. A new batch,
bucketed alike, is merge-anti-joined with each run without a shuffle: keys that no run has are
first seen in this batch. Then the batch becomes a run of level 0 itself; as soon as a level
has `fanout` runs they are merged into one of the next level, so there are few runs to join.

A whole table is cut into batches by doc_id, the largest first, so that the batch that sees a
key first has the largest doc_id that holds it. Keys of enough documents, their keepers and the
positions of their lines are joined by key; a key that a third of all documents has is one row
on the side of the keys, and adaptive execution splits the other side.

Defined cases: a null or empty text is one empty line; a null doc_id is smaller than any other;
rows are documents, also those of one doc_id, which all keep a line if their doc_id is the
largest that holds it; a line that a document has twice counts once; texts of any length are
read whole; an empty table gives no rows; columns other than doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, doc_key, stored

LEAST_POINTS, LEAST_DOCUMENTS = 40, 5
FANOUT, LEAST_BATCHES = 3, 4
#: Lines in a batch and in a bucket, of a whole table.
BATCH_LINES, BUCKET_LINES = 1 << 30, 1 << 20
MOST_BUCKETS = 1 << 15
_BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _lowered(line: Column) -> Column:
    """A-Z lowered: by lower() where all is ASCII, else letter by letter."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def line_keys(docs: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """doc_id, tie (of the text), position, key and whether it is the document's first line of this key, for every line of enough code points."""
    stripped = F.transform(F.transform(_lines(), lambda x: F.btrim(x, F.lit(_BLANK))), _lowered)
    placed = F.transform(stripped, lambda x, i: F.struct(x.alias("line"), i.alias("pos")))
    long = F.filter(placed, lambda e: F.char_length(e["line"]) >= least_points)
    hashed = F.transform(long, lambda e: F.struct(F.xxhash64(e["line"]).alias("h1"), F.xxhash64(F.lit(1), e["line"]).alias("h2"), e["pos"].alias("pos")))
    each = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.sort_array(hashed).alias("keys"))

    def told(e: Column, i: Column) -> Column:
        before = F.get(F.col("keys"), i - 1)
        return F.struct(*(e[c].alias(c) for c in (*KEY, "pos")), (~(before["h1"].eqNullSafe(e["h1"]) & before["h2"].eqNullSafe(e["h2"]))).alias("first"))

    return each.select("doc_id", "tie", F.inline(F.transform("keys", told)))


class LineIndex:
    """Levelled sorted runs of line keys in the shared folder. A batch has h1, h2, docs and largest, each key once."""

    def __init__(self, buckets: int, fanout: int = FANOUT):
        self.buckets, self.fanout = buckets, fanout
        self.runs: list[tuple[int, DataFrame]] = []

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds a batch; returns the keys that no earlier batch had, with the batch's largest doc_id that holds them."""
        first = batch
        for _, run in self.runs:
            first = first.join(run.select(*KEY), KEY, "left_anti")
        first = stored(first.select(*KEY, "largest"), "first-lines")
        self.runs.append((0, bucketed(batch.select(*KEY, "docs"), "line-run", KEY, self.buckets)))
        self.compact()
        return first

    def compact(self) -> None:
        """Merges the runs of each level that has enough of them."""
        level = 0
        while len(same := [run for at, run in self.runs if at == level]) >= self.fanout:
            self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, bucketed(reduce(_merged, same), "line-run", KEY, self.buckets))]
            level += 1

    def counted(self) -> DataFrame:
        """Every key with the number of documents that have it."""
        return reduce(_merged, [run for _, run in self.runs])


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one, by a merge join of their buckets. (Spark 4.1 takes a columnar union of bucketed scans for bucketed, but doesn't run it so.)"""
    docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
    return a.join(b.withColumnRenamed("docs", "more"), KEY, "full_outer").select(*KEY, docs.alias("docs"))


def keepers(keys: DataFrame, least_documents: int = LEAST_DOCUMENTS, batch_lines: int = BATCH_LINES, bucket_lines: int = BUCKET_LINES) -> DataFrame | None:
    """Keys of enough documents, each with the largest doc_id that holds it; None if there are no lines."""
    lines = keys.count()
    if not lines:
        return None
    batches, buckets = max(LEAST_BATCHES, -(-lines // batch_lines)), min(MOST_BUCKETS, max(4, -(-lines // bucket_lines)))
    bounds = keys.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0]
    bounds = sorted(set(bounds or ()))
    later = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: F.col("doc_id") <= b)) if bounds else F.lit(0)
    number = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(later)
    counted = keys.where("first").groupBy(number.alias("batch"), *KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest"))
    runs = bucketed(counted, "line-batches", KEY, buckets)
    index, first = LineIndex(buckets), None
    for k in range(len(bounds) + 1):
        seen = index.append(runs.where(F.col("batch") == k).drop("batch"))
        first = seen if first is None else first.unionByName(seen)
    return first.join(index.counted().where(F.col("docs") >= least_documents), KEY)


def without_repeated_lines(docs: DataFrame, least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS, **sizes: int) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is kept, of each row."""
    docs = doc_key(docs)
    keys = stored(line_keys(docs, least_points), "line-keys")
    kept = keepers(keys, least_documents, **sizes)
    rows = docs.withColumn("tie", F.xxhash64("text"))
    n = F.size(_lines()).cast("long")
    if kept is None:
        return docs.select("doc_id", n.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept"))
    gone = keys.join(stored(kept, "line-keepers"), KEY).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    gone = gone.groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("gone"))
    both = rows.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.tie") == F.col("g.tie")), "left").select("d.doc_id", "d.text", "g.gone")
    left = F.array_except(F.sequence(F.lit(0), F.size(_lines()) - 1), F.col("gone"))
    split = both.select("doc_id", n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), "gone", "text", F.when(F.col("gone").isNotNull(), _lines()).alias("lines"), F.when(F.col("gone").isNotNull(), left).alias("left"))
    text = F.array_join(F.transform("left", lambda i: F.get(F.col("lines"), i)), "\n")
    return split.select("doc_id", "n_lines", "n_dropped", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(text).alias("kept"))
