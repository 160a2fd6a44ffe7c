"""The registered stream: the edit log of the tables, replayed in batches of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import graph
from ..plans.dialect import DuckDB, Spark
from ..plans.registry import relations
from ..plans.store import delete, new_path, stored
from . import edits

EDITS_A_PARTITION, FILES, FILES_AT_ONCE = 12_500, 6, 2
_BEFORE = ", ".join(f"h.before_{c}" for c in ("x0", "y0", "x1", "y1"))
_AFTER = ", ".join(f"e.{c}" for c in ("x0", "y0", "x1", "y1"))
BATCH = f"SELECT e.edit_seq, e.doc_id, e.object_id, e.region, e.code, {_BEFORE}, {_AFTER} FROM edit_checks e LEFT JOIN edit_history h ON h.edit_seq = e.edit_seq"


def it4_stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits written as files and read as a stream, a few files at a time, with the detected objects that they name as initial state.

    State is looked up by object alone, and the log is whole before the stream starts, so other objects would only be carried along.
    """
    known = relations(Spark())
    over = lambda sql: graph.run(spark, sql, known, graph.tables(spark, sf_dir, sql, known), sf_dir, graph.stamps(spark, sf_dir, sql, known))
    log, out, checkpoint = (new_path(spark, f"edit-stream-{n}") for n in ("log", "out", "checkpoint"))
    rows = over("SELECT doc_id, edit_seq, object_id, region, x0, y0, x1, y1 FROM edits")
    rows.repartitionByRange(FILES, "edit_seq").write.parquet(log)
    logged = spark.read.parquet(log)
    n = logged.count()
    try:
        objects = over("SELECT * FROM stream_objects").join(logged.select(*edits.KEY).distinct().hint("merge"), edits.KEY, "left_semi").select(*(c.split()[0] for c in edits.OBJECTS.split(", ")))
        found = edits.replayed(spark, log, objects, out, checkpoint, FILES_AT_ONCE, max(4, -(-n // EDITS_A_PARTITION)))
        return stored(found.select("edit_seq", "doc_id", "object_id", "region", "code", *(f"before_{c}" for c in ("x0", "y0", "x1", "y1")), "x0", "y0", "x1", "y1"), "edits-replayed")
    finally:
        for path in (log, out, checkpoint):
            delete(spark, path)


QUERIES = {"it4_stream_replay": it4_stream_replay}


def oracle_sql() -> dict[str, str]:
    return {"it4_stream_replay": graph.duckdb_sql(BATCH, relations(DuckDB()))}
