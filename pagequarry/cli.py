"""Command lines: python -m pagequarry.cli COMMAND ...; one JSON object on standard output and the contract's exit code."""

from __future__ import annotations

import argparse
import json
import sys

from .plans import catalogue, detector, gallery, golden, scenarios
from .session import local_session
from .sources import contracts, runs, specs
from .sources.contracts import InvalidInput
from .sources.mappings import read_mapping

CONTRACTS = tuple(detector.CHECKS)


def _validate(a) -> tuple[dict, int]:
    reader = {"scenario": runs.read_scenario, "setup": runs.read_setup}.get(a.contract, read_mapping)
    spark = local_session()
    texts = spark.createDataFrame([(0, json.dumps(reader(a.file)))], "doc long, body string")
    found = [r.asDict() for r in detector.violations(spark, texts, a.contract).drop("doc").collect()]
    if a.contract in ("setup", "scenario"):
        bad = found[0]["code"] != "ok"
        return {"ok": not bad} | ({"error_code": found[0]["code"], "field": found[0]["field"]} if bad else {}), runs.UNKNOWN_ERROR * bad
    return {"ok": not found, "violations": sorted(r["violation"] for r in found)}, int(bool(found))


def _compare(a) -> tuple[dict, int]:
    spark = local_session()
    truth, found = contracts.read_truth(spark, a.truth, a.case_id), contracts.read_detected(spark, a.detected)
    if a.case_id and not a.all_detections:
        found = found.where(found.case_id == a.case_id)
    comparison = golden.Comparison(spark, truth, found, a.profile, a.allow_extra, a.kind)
    totals = runs.write_report(comparison, a.out, a.case_id) if a.out else comparison.summary().first().asDict()
    return {"ok": not totals["cases_failed"], "summary": totals}, runs.exit_code("COMPARE_FAILED" if totals["cases_failed"] else None)


def _promote(a) -> tuple[dict, int]:
    spark = local_session()
    decisions = None if a.keep else contracts.read_decisions(spark, f"{a.gallery}/index.md")
    kept = gallery.promote(spark, a.gallery, a.out, decisions, a.keep, a.force, a.allow_empty)
    return {"ok": True, "selected": sorted(r["case_id"] for r in kept.toLocalIterator())}, 0


def _scenarios(a) -> tuple[dict, int]:
    spark = local_session()
    texts = scenarios.read_scenarios(spark, a.scenarios)
    found = {r["doc"]: r for r in scenarios.errors(spark, texts).toLocalIterator()}
    files = [(r["file"], found[r["doc"]]) for r in texts.select("doc", "file").toLocalIterator()]
    bad = [{"file": f, "error_code": r["code"], "field": r["field"]} for f, r in sorted(files) if r["code"] != "ok"]
    if a.command == "generate" and not bad:
        gallery.generate(spark, texts, a.out, replace=a.force)
    cases = scenarios.compiled(spark, texts, "case_specs").select("case_id", "size_", "orientation", "page_count").orderBy("case_id")
    code = bad[0]["error_code"] if bad else None
    return {"ok": not bad, "scenarios": [{"case_id": r[0], "page_size": r[1], "orientation": r[2], "page_count": r[3]} for r in cases.toLocalIterator()]} | ({"errors": bad, "error_code": code} if bad else {}), runs.exit_code(code)


def _self_check(a) -> tuple[dict, int]:
    found = [r.asDict() for r in gallery.Gallery(local_session(), a.gallery).errors().orderBy("gate", "case_id", "page", "detail").toLocalIterator()]
    return {"ok": not found, "errors": found}, runs.exit_code("SELF_CHECK_FAILED" if found else None)


def _list_runs(a) -> tuple[dict, int]:
    return {"runs": [r.asDict() for r in catalogue.list_runs(local_session(), a.folder).orderBy("run_id").toLocalIterator()]}, 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagequarry")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments) -> None:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for names, options in arguments:
            c.add_argument(*names.split(), **options)

    flag = {"action": "store_true"}
    command("validate", _validate, ("contract", {"choices": CONTRACTS}), ("file", {}))
    command("compare", _compare, ("truth", {}), ("detected", {}), ("--out", {}), ("--case-id", {}), ("--all-detections", flag), ("--kind", {}), ("--profile", {"choices": tuple(golden.PROFILES), "default": "strict"}), ("--allow-extra", flag))
    command("promote", _promote, ("gallery", {}), ("out", {}), ("--keep", {"nargs": "+"}), ("--force", flag), ("--allow-empty", flag))
    command("summarize-review", lambda a: (runs.summarize(local_session(), read_mapping(a.file)), 0), ("file", {}))
    command("list-templates", lambda a: (specs.list_templates(), 0))
    command("list-scenarios", _scenarios, ("scenarios", {}))
    command("generate", _scenarios, ("scenarios", {}), ("out", {}), ("--force", flag))
    command("self-check", _self_check, ("gallery", {}))
    command("list-runs", _list_runs, ("folder", {}))
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        out, code = a.run(a)
    except InvalidInput as e:
        error = getattr(e, "code", "INVALID_INPUT")
        out, code = {"ok": False, "error_code": error, "message": str(e)}, runs.exit_code(error)
    print(json.dumps(out, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
