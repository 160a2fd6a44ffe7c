"""The edit log as a stream: every edit's code, what it replaced and its box, with the objects as initial state.

State is kept by object: one value with what it is, its regions' boxes and their last edits, and
its edits by region and number. Edits may come in any batches and any order. One that is newer than all of its
region costs a look at the last one; a late one is put in its place, and the edit after it is
sent again with what it now replaces. Each row has a version; the last one of an edit counts,
so the stream ends as the batch relations `edit_checks` and `edit_history` do. A number that
comes twice for an object and region is taken once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.contracts import EDITS

REGIONS = ("caption_region", "body_region", "context_region")
SLACK = 0.5
_BOX = ("x0", "y0", "x1", "y1")
_CORNERS = ", ".join(f"{c} double" for c in _BOX)
OBJECTS = f"doc_id long, object_id string, kind string, width double, height double, region string, {_CORNERS}"
OUT = f"edit_seq long, doc_id long, object_id string, region string, code string, {', '.join(f'before_{c} double' for c in _BOX)}, {_CORNERS}, version long"
_ROW = Row(*(c.split()[0] for c in OUT.split(", ")))
KEY = ["doc_id", "object_id"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits from JSON lines as they arrive."""
    return spark.readStream.schema(EDITS).json(folder)


class Replay(StatefulProcessor):
    """Judges and replays the edits of one object after another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: JSON: kind, size, version; of each region its first box, its last applied edit and the newest number it has seen.
        self.object = handle.getValueState("object", "body string")
        self.edits = handle.getMapState("edits", "region string, edit_seq long", f"code string, {_CORNERS}")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        r = initialState
        self.object.update((json.dumps({"kind": r.kind, "size": [r.width, r.height], "boxes": json.loads(r.boxes), "last": {}, "newest": {}, "version": 0}),))

    @staticmethod
    def _code(known: dict, region: str, box: tuple) -> str:
        """The first code that fails, in order."""
        if known["kind"] is None:
            return "EDIT_OBJECT_NOT_FOUND"
        width, height = known["size"]
        if region not in (("bbox",) if known["kind"] == "common" else REGIONS):
            return "EDIT_REGION_NOT_FOUND"
        x0, y0, x1, y1 = box
        if any(c is None for c in box) or not (x0 < x1 and y0 < y1):
            return "EDIT_BAD_BBOX"
        if width is not None and (x0 < -SLACK or y0 < -SLACK or x1 > width + SLACK or y1 > height + SLACK):
            return "EDIT_OUT_OF_PAGE_BOUNDS"
        return "ok"

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = json.loads(self.object.get()[0]) if self.object.exists() else {"kind": None, "size": [None, None], "boxes": {}, "last": {}, "newest": {}, "version": 0}
        out = []
        for r in sorted(rows, key=lambda r: r.edit_seq):
            seq, region = r.edit_seq, r.region
            late = known["newest"].get(region, seq - 1) >= seq
            if late and self.edits.containsKey((region, seq)):
                continue
            given = tuple(r[c] for c in _BOX)
            code = self._code(known, region, given)
            box = tuple(None if c is None else round(c, 2) for c in given)
            self.edits.updateValue((region, seq), (code, *box))
            known["newest"][region] = max(seq, known["newest"].get(region, seq))
            if code != "ok":
                out.append((seq, *key, region, code, *(None,) * 4, *box, known["version"]))
                continue
            last, after = known["last"].get(region), None
            if last is None or last[0] < seq:
                before = last[1:] if last else None
                known["last"][region] = [seq, *box]
            else:
                before, after = self._neighbours(region, seq)
            before = before or known["boxes"].get(region)
            out.append((seq, *key, region, code, *(before or (None,) * 4), *box, known["version"]))
            if after:
                out.append((after[0], *key, region, "ok", *box, *after[1:], known["version"]))
            known["version"] += 1
        self.object.update((json.dumps(known),))
        for values in out:
            yield _ROW(*values)

    def _neighbours(self, region: str, seq: int) -> tuple[tuple | None, tuple | None]:
        """The box that a late edit replaces, and the edit (number and box) that follows it."""
        before = after = None
        for (of, at), (code, *box) in self.edits.iterator():
            if of != region or code != "ok" or at == seq:
                continue
            if at < seq and (before is None or before[0] < at):
                before = (at, *box)
            if at > seq and (after is None or after[0] > at):
                after = (at, *box)
        return before[1:] if before else None, after

    def close(self) -> None:
        pass


def replay(edits: DataFrame, objects: DataFrame) -> DataFrame:
    """A row for each edit, and again for an edit that a late one goes before. objects has a row for each region of each object (OBJECTS).

    The session must keep state in RocksDB (see PROVIDER, ROCKS).
    """
    box = F.struct("region", F.array(*_BOX).alias("box"))
    boxes = F.to_json(F.map_from_entries(F.collect_list(F.when(F.col("x0").isNotNull(), box)))).alias("boxes")
    known = objects.groupBy(*KEY).agg(F.first("kind").alias("kind"), F.first("width").alias("width"), F.first("height").alias("height"), boxes).groupBy(*KEY)
    wanted = edits.selectExpr("doc_id", "object_id", "edit_seq", "region", *(f"CAST({c} AS DOUBLE) AS {c}" for c in _BOX))
    return wanted.groupBy(*KEY).transformWithState(Replay(), OUT, "Append", "None", initialState=known)


def settled(rows: DataFrame) -> DataFrame:
    """The last version of each edit."""
    last = Window.partitionBy(*KEY, "region", "edit_seq").orderBy(F.desc("version"))
    return rows.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth", "version")


def replayed(spark: SparkSession, folder: str, objects: DataFrame, out: str, checkpoint: str, files_at_once: int = 1000, partitions: int | None = None) -> DataFrame:
    """Runs the stream over the Parquet files that a folder has by now and goes on where the checkpoint is; returns all settled rows so far.

    partitions: of the state, fixed when the checkpoint begins (the session's shuffle partitions if not given).
    """
    settings = {PROVIDER: ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        schema = ", ".join(f"{c} {t}" for c, t in (("doc_id", "long"), ("edit_seq", "long"), ("object_id", "string"), ("region", "string"), *((c, "double") for c in _BOX)))
        edits = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
        done = replay(edits, objects).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    return settled(spark.read.schema(OUT).parquet(out))
