"""Run folders as a relation: what each one's manifest says, found by one listing and parsed in the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.runs import DETECTED, EDITOR
from . import graph, registry
from .detector import LAST_KEY_COUNTS
from .dialect import Spark


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """run_id (the folder), kind (editor or detected), body and modified of the manifests of all run folders below a root."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{DETECTED},{EDITOR}}}").option("recursiveFileLookup", True).load(root)
    parts = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    depth = len(root.rstrip("/").split("/"))
    return found.select(parts.alias("parts"), F.col("content").cast("string").alias("body"), F.col("modificationTime").alias("modified")).select(F.element_at("parts", -2).alias("run_id"), F.when(F.element_at("parts", -1) == EDITOR, "editor").otherwise("detected").alias("kind"), "body", "modified", F.element_at(F.slice("parts", 1, F.size("parts") - 2), -1).alias("above")).where(F.col("above") == root.rstrip("/").split("/")[depth - 1])


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """run_id, kind, source_pdf and page_count of each folder that has a manifest; the editor's comes before the detector's, blanks where it can't be read."""
    spark.conf.set(LAST_KEY_COUNTS, "true")
    files = run_files(spark, root).select("run_id", "kind", "body")
    return graph.run(spark, "SELECT * FROM run_catalogue", registry.relations(Spark()), {"run_files": files})
