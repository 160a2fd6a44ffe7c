"""Corpus pipeline: quality classifier, Jaccard join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and returns
a DataFrame; run() writes each result as Parquet in the shared folder and reads it again for
the next. All stages but the last return the columns of documents, the last adds shard and slot.

Stages decide by row, not by doc_id: rows get a number of their own, written with them, so null
and repeated ids, ties and repeated rows are told apart. Every stage takes any column as null,
texts of any length, extra columns (which it drops) and an empty table (which stays empty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import decontaminate, jaccard_join, mixture, quality, shard
from pagequarry.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own (rid), written, so that every reader sees the same numbers."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("rid")), name)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, doesn't reject.

    Null, empty and word-free texts score 0 and go; texts too short to tell stay; repeated rows
    score alike, so all stay or all go.
    """
    docs = docs.select(*COLUMNS)
    return quality.scored(docs, quality.fitted(docs)).where("quality_score >= 0.5").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row: of the smallest doc_id (null last), of these the first by content.

    Rows without words are no duplicates of anything and all stay. Rows that are equal in every
    column are duplicates as others are.
    """
    rows = _numbered(docs, "numbered")
    found = jaccard_join.jaccard_components(rows, row="rid")
    tie = rows.select("rid", F.xxhash64(*COLUMNS[1:]).alias("tie"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "rid")).alias("first")
    kept = found.join(tie, "rid").groupBy("component").agg(first).select("first.rid")
    return rows.join(kept, "rid", "left_semi").select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit less than a twentieth.

    Rows are judged one by one, so null ids and repeated rows need no rule; null, empty and
    word-free texts have no hit and stay.
    """
    found = decontaminate.contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows at their training positions: twice where the curriculum takes a second pass, not at all where it takes no word.

    A null source is a source; rows without words are never taken; equal positions go by doc_id
    (null first); repeated rows have positions of their own.
    """
    rows = _numbered(docs, "unmixed")
    taken = mixture.mixture(rows, row="rid").where("taken > 0")
    times = taken.select("rid", F.explode(F.array_compact(F.array("position", "repeat_position"))).alias("_at"))
    return rows.join(times, "rid").orderBy("_at", "doc_id").select(*COLUMNS)


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix with size, text_crc32, number, shard and slot.

    Null texts count as empty, null ids sort first; repeated rows get numbers of their own.
    """
    rows = _numbered(docs, "undealt")
    return rows.join(shard.shards(rows, row="rid").drop("doc_id"), "rid").drop("rid")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix),
    ("sharding", deal),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs


#: The quality classifier is learned, so SQL can't express the first stage; the stages are tested one by one.
ORACLE_SQL = None
