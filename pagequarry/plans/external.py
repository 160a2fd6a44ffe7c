"""A detector that is a program: one process for each case, in the tasks, under a time limit, its output checked by the contract."""

from __future__ import annotations

import json
import os
import signal
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.contracts import DETECTED_VERSION, ORIGIN, UNIT
from . import detector
from .store import stored

STDERR_SHOWN = 200
RESULT = "case_id string, status string, exit_code int, message string, body string"


def _once(command: list[str], case_id: str, pdf: str, content: bytes, seconds: float) -> tuple:
    with tempfile.TemporaryDirectory() as top:
        document, out = Path(top) / Path(pdf).name, Path(top) / "case.json"
        document.write_bytes(content)
        run = subprocess.Popen([a.format(pdf=document, out=out) for a in command], stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, start_new_session=True)
        try:
            _, err = run.communicate(timeout=seconds)
        except subprocess.TimeoutExpired:
            os.killpg(run.pid, signal.SIGKILL)  # it and what it has started
            run.communicate()
            return case_id, "timeout", None, f"more than {seconds:g} s", None
        said = err.decode(errors="replace").strip()[:STDERR_SHOWN]
        if run.returncode:
            return case_id, "failed", run.returncode, said, None
        if not out.is_file():
            return case_id, "no_output", 0, said, None
        try:
            pages = json.loads(out.read_text(encoding="utf-8"))["pages"]
        except (ValueError, KeyError, TypeError, UnicodeDecodeError) as e:
            return case_id, "unreadable", 0, f"{type(e).__name__}: {e}"[:STDERR_SHOWN], None
    body = {"schema_version": DETECTED_VERSION, "coordinate_unit": UNIT, "coordinate_origin": ORIGIN, "producer": {"name": command[0].rpartition("/")[2], "version": "external", "mode": "detector"}, "cases": [{"case_id": case_id, "pdf": pdf, "pages": pages}]}
    return case_id, "ok", 0, said, json.dumps(body)


def run_detector(spark: SparkSession, cases: DataFrame, command: list[str], seconds: float = 120) -> DataFrame:
    """case_id, status, exit_code, message and body of each case (case_id, pdf, content).

    The command's parts may hold {pdf} and {out}: the document, and where it writes {"pages": [...]}.
    status is ok, failed (exit code and the head of its error output), timeout (it is killed with
    all it started), no_output, unreadable, or invalid (message has the first violation of the
    contract). Rows that aren't ok have no body. A task that is run again runs its cases again.
    """
    columns = {"case_id": pa.string(), "status": pa.string(), "exit_code": pa.int32(), "message": pa.string(), "body": pa.string()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for case_id, pdf, content in zip(*(batch[c].to_pylist() for c in ("case_id", "pdf", "content")), strict=True):
                row = _once(command, case_id, pdf, content or b"", seconds)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, columns.values(), strict=True)], names=list(columns))

    done = stored(cases.select(F.col("case_id").cast("string"), F.col("pdf").cast("string"), "content").mapInArrow(of, RESULT), "detected-by-command")
    texts = done.where("status = 'ok'").select(F.xxhash64("case_id").alias("doc"), "body")
    bad = detector.violations(spark, texts, "detector").groupBy("doc").agg(F.min("violation").alias("violation"))
    both = done.join(bad, (F.xxhash64("case_id") == bad["doc"]) & (F.col("status") == "ok"), "left")
    wrong = F.col("violation").isNotNull()
    return both.select("case_id", F.when(wrong, "invalid").otherwise(F.col("status")).alias("status"), "exit_code", F.when(wrong, F.col("violation")).otherwise(F.col("message")).alias("message"), F.when(~wrong, F.col("body")).alias("body"))


def detected_cases(results: DataFrame) -> DataFrame:
    """case_id and pages (a variant) of the cases that are ok, as golden.Comparison takes them."""
    return results.where("status = 'ok'").select("case_id", F.expr("variant_get(parse_json(body), '$.cases[0].pages', 'variant')").alias("pages"))
