"""A run's folder, its saved manifest, reviews and reports: documents that the driver reads and writes itself."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.lifecycle import NEXT_TASKS
from ..operators.validate import EXIT_CODES, OK, UNKNOWN_ERROR
from ..plans import detector
from .contracts import ORIGIN, UNIT, InvalidInput
from .mappings import inside, read_mapping

EDITOR, DETECTED = "editor_save_manifest.json", "detected_manifest.json"
# Versions, the review table's columns and what a row's decision must say.
EDITOR_VERSION, GALLERY_VERSION, FROZEN_VERSION = "editor-save-manifest-v0", "rtm-gallery-v0", "rtm-frozen-v0"
REVIEW_COLUMNS = ("case_id", "thumbnail", "axis tags", "realism 1-5", "keep/drop", "critique")
KEEP = "keep"


class RunError(InvalidInput):
    """A run that can't be opened, edited or written; code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code


def read_scenario(path: str | Path) -> dict:
    """A scenario file's mapping, or an error with the contract's code."""
    return _mapping(path, "SCENARIO_FILE_NOT_FOUND", "SCENARIO_FILE_UNREADABLE", "SCENARIO_INVALID_VALUE")


def read_setup(path: str | Path) -> dict:
    """A setup file's mapping, or an error with the contract's code."""
    return _mapping(path, "SETUP_FILE_NOT_FOUND", "SETUP_FILE_UNREADABLE", "SETUP_FILE_UNREADABLE")


def _mapping(path: str | Path, absent: str, unreadable: str, no_mapping: str) -> dict:
    if not Path(path).is_file():
        raise RunError(absent, str(path))
    try:
        return read_mapping(path)
    except (InvalidInput, OSError, UnicodeDecodeError) as e:
        raise RunError(no_mapping if "mapping" in str(e) else unreadable, str(e)) from e


def exit_code(code: str | None) -> int:
    """The process's exit code for an error's code, or for none."""
    return OK if code is None else EXIT_CODES.get(code, UNKNOWN_ERROR)


def _faults(spark: SparkSession, body: dict) -> list[str]:
    texts = spark.createDataFrame([(0, json.dumps(body))], "doc long, body string")
    return [r["violation"] for r in detector.violations(spark, texts, "editor").limit(3).collect()]


def _read(path: Path) -> dict:
    try:
        return read_mapping(path)
    except InvalidInput as e:
        raise RunError("RUN_MANIFEST_UNREADABLE", str(e)) from e


def build_initial(detected: dict, source: str) -> dict:
    """An editor manifest from a detector manifest: all cases' pages in order, and an empty log."""
    cases = detected.get("cases") or []
    pages = [{"page": p.get("page"), **{k: list(p.get(k) or []) for k in ("figures", "tables", "common_regions")}} for c in cases for p in c.get("pages") or []]
    return {"schema_version": EDITOR_VERSION, "source_pdf": cases[0].get("pdf", "") if cases else "", "source_detector_manifest": source, "coordinate_unit": UNIT, "coordinate_origin": ORIGIN, "pages": pages, "edits": []}


def load_run(spark: SparkSession, folder: str | Path, manifest: str | Path | None = None) -> tuple[dict, Path]:
    """The run's editor manifest and where to save it; one is made of the detector's manifest if none was saved yet."""
    folder = Path(folder)
    if not folder.is_dir():
        raise RunError("RUN_DIR_NOT_FOUND", str(folder))
    if manifest is not None:
        try:
            path = inside(folder, Path(manifest).resolve())
        except InvalidInput as e:
            raise RunError("MANIFEST_OUTSIDE_RUN_DIR", str(manifest)) from e
        if not path.is_file():
            raise RunError("RUN_MANIFEST_NOT_FOUND", str(path))
    else:
        path = folder / EDITOR
    if path.is_file():
        body = _read(path)
        if faults := _faults(spark, body):
            raise RunError("RUN_MANIFEST_INVALID", "; ".join(faults))
        return body, path
    if not (folder / DETECTED).is_file():
        raise RunError("RUN_MANIFEST_NOT_FOUND", f"neither {EDITOR} nor {DETECTED} in {folder}")
    return build_initial(_read(folder / DETECTED), str(folder / DETECTED)), path


def save(spark: SparkSession, folder: str | Path, body: dict, path: str = EDITOR) -> dict:
    """Writes a valid manifest into its run folder, or under another name there; returns what was written."""
    try:
        target = inside(folder, path)
    except InvalidInput as e:
        raise RunError("SAVE_PATH_NOT_ALLOWED", path) from e
    if faults := _faults(spark, body):
        raise RunError("SAVE_MANIFEST_INVALID", "; ".join(faults))
    try:
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(body, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    except OSError as e:
        raise RunError("SAVE_WRITE_FAILED", str(e)) from e
    return {"saved": str(target), "dirty": False, "edit_count": len(body.get("edits") or [])}


def table(columns, rows) -> list[str]:
    """Lines of a pipe table."""
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(str, r)) + " |" for r in rows)]


def _details(o: dict) -> str:
    if o["status"] != "matched":
        return o["status"]
    bad = [f"{r['region']} Δ{r['delta']} tol({r['tolerance']['x']}, {r['tolerance']['y']})" for r in o["regions"] if not r["passed"]]
    return "; ".join(bad + [f"{f['field']}: exp {f['expected']} got {f['actual']}" for f in o["fields"] if not f["passed"]])


def write_report(comparison, folder: str | Path, case_id: str | None = None) -> dict:
    """compare_report.md and .json of a golden.Comparison: totals, failures and every case with its objects, regions and fields; returns the totals.

    Cases come one after the other and are written at once, so the driver holds one case at a time.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    t = comparison.summary().first().asDict()
    config = {"tolerance_profile": comparison.profile, "allow_extra": comparison.allow_extra, "case_id_filter": case_id, "region_kind_filter": comparison.kind}
    head = ["# Comparison of detections with truth", "", f"- tolerance profile: `{comparison.profile}`, allow_extra: {comparison.allow_extra}", f"- cases: {t['cases_passed']}/{t['cases_total']} passed ({t['cases_failed']} failed)", f"- objects: expected {t['objects_expected']}, matched {t['objects_matched']}, missing {t['objects_missing']}, extra {t['objects_extra']}", f"- regions: {t['regions_checked'] - t['regions_failed']}/{t['regions_checked']} within tolerance ({t['regions_failed']} failed)", ""]
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    with (folder / "compare_report.json").open("w", encoding="utf-8") as out, (folder / "compare_report.md").open("w", encoding="utf-8") as page:
        page.write("\n".join(head) + "\n")
        out.write(f'{{"summary": {dump(t)},\n"config": {dump(config)},\n"cases": [')
        failures, first = folder / ".failures", True
        with failures.open("w", encoding="utf-8") as failed:
            for r in comparison.reports().orderBy("case_id").toLocalIterator():
                case = r.asDict(recursive=True)
                for o in case["objects"]:
                    o["regions"] = [{k: v for k, v in x.items() if k != "reason" or v} for x in o["regions"]]
                out.write(("\n" if first else ",\n") + dump(case))
                first = False
                for o in case["objects"]:
                    if not o["passed"]:
                        if not failed.tell():
                            page.write("\n".join(["## Failures", "", *table(("case_id", "kind", "index", "status", "detail"), [])]) + "\n")
                        failed.write((",\n" if failed.tell() else "\n") + dump({"case_id": case["case_id"], **o}))
                        page.write(f"| `{case['case_id']}` | {o['kind']} | {o['index'] or ''} | {o['status']} | {_details(o)} |\n")
        if not failures.stat().st_size:
            page.write("All comparisons passed within tolerance.\n")
        out.write('],\n"failures": [')
        with failures.open(encoding="utf-8") as failed:
            shutil.copyfileobj(failed, out)
        out.write("]}\n")
        failures.unlink()
    return t


def summarize(spark: SparkSession, review: dict) -> dict:
    """Counts of a review's decisions and the tasks they call for; the list of missed objects counts as that issue."""
    texts = spark.createDataFrame([(0, json.dumps(review))], "doc long, body string")
    if faults := [r["violation"] for r in detector.violations(spark, texts, "review").collect()]:
        raise RunError("INVALID_INPUT", "; ".join(faults))
    objects, missed = review.get("objects") or [], review.get("missed_objects") or []
    decisions = [o["decision"] for o in objects]
    issues = {k: decisions.count(k) for k in NEXT_TASKS}
    issues["missed_object"] += len(missed)
    tasks = list(dict.fromkeys(task for k, task in NEXT_TASKS.items() if issues[k]))
    return {"ok": True, "pdf": review.get("pdf"), "reviewer": review.get("reviewer", "manual"), "reviewed_objects": len(objects), "accepted": decisions.count("accept"), "missed_objects": len(missed), "issues": issues, "recommended_next_tasks": tasks}
