import json

from test_contracts import CHANGES, PAGES, change, manifest, write
from test_validate import REVIEW, SCENARIO, SETUP

from pagequarry import cli


def run(capsys, *arguments):
    code = cli.main([str(a) for a in arguments])
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_commands(spark, tmp_path, capsys):
    """Success, failure and bad input of each command, with its exit code."""
    write(tmp_path / "truth/MANIFEST.json", {"cases": [{"case_id": "a"}]})
    write(tmp_path / "truth/a/a.truth.json", {"case_id": "a", "coordinate_unit": "pdf_pt", "coordinate_origin": "top-left", "pages": PAGES})
    write(tmp_path / "same.json", manifest(PAGES))
    write(tmp_path / "other.json", manifest(change(CHANGES["figure lost"][0])))
    assert run(capsys, "compare", tmp_path / "truth", tmp_path / "same.json")[0] == 0
    code, out = run(capsys, "compare", tmp_path / "truth", tmp_path / "other.json", "--out", tmp_path / "report")
    assert code == 1 and out["summary"]["objects_missing"] == 1 and (tmp_path / "report/compare_report.json").is_file()
    assert run(capsys, "compare", tmp_path / "truth", tmp_path / "other.json", "--kind", "table")[0] == 0
    write(tmp_path / "v9.json", manifest(PAGES, schema_version="v9"))
    assert run(capsys, "compare", tmp_path / "truth", tmp_path / "v9.json") [0] == 2
    for name, body in (("scenario", SCENARIO), ("setup", SETUP), ("review", REVIEW)):
        write(tmp_path / f"{name}.json", body)
        assert run(capsys, "validate", name, tmp_path / f"{name}.json") [0] == 0
    write(tmp_path / "bad.json", SCENARIO | {"case_id": ""})
    assert run(capsys, "validate", "scenario", tmp_path / "bad.json") == (2, {"ok": False, "error_code": "SCENARIO_INVALID_VALUE", "field": "case_id"})
    (tmp_path / "list.json").write_text("[1]")
    for path, error in (("none.json", "SCENARIO_FILE_NOT_FOUND"), ("list.json", "SCENARIO_INVALID_VALUE")):
        code, out = run(capsys, "validate", "scenario", tmp_path / path)
        assert (code, out["error_code"]) == (2, error)
    write(tmp_path / "wrong.json", REVIEW | {"pdf": ""})
    assert run(capsys, "validate", "review", tmp_path / "wrong.json") == (1, {"ok": False, "violations": ["pdf must be a non-empty string"]})
    code, out = run(capsys, "summarize-review", tmp_path / "review.json")
    assert code == 0 and (out["accepted"], out["issues"]["wrong_title"], out["issues"]["missed_object"]) == (1, 1, 2) and len(out["recommended_next_tasks"]) == 2
    assert run(capsys, "list-templates")[1]["page_size"] == ["letter", "a4"]
    runs = {"both": {"editor_save_manifest.json": {"pages": [1, 2], "source_pdf": "e.pdf"}, "detected_manifest.json": manifest(PAGES)}, "detected": {"detected_manifest.json": {"cases": [{"pdf": "d.pdf", "pages": [1, 2, 3]}]}}, "editor": {"editor_save_manifest.json": {"pages": None, "source_pdf": "n.pdf"}}, "blank": {"detected_manifest.json": [1]}, "none": {"other.json": {}}, "a b+": {"editor_save_manifest.json": {"cases": []}}}
    for name, files in runs.items():
        for file, body in files.items():
            write(tmp_path / "runs" / name / file, body)
    (tmp_path / "runs/broken").mkdir()
    (tmp_path / "runs/broken/editor_save_manifest.json").write_text('{"pages":')
    write(tmp_path / "runs/broken/detected_manifest.json", {"cases": [{"pdf": "d.pdf", "pages": [1]}]})
    write(tmp_path / "runs/both/old/detected_manifest.json", manifest(PAGES))
    found = {r["run_id"]: (r["kind"], r["source_pdf"], r["page_count"]) for r in run(capsys, "list-runs", tmp_path / "runs")[1]["runs"]}
    assert found == {"both": ("editor", "e.pdf", 2), "detected": ("detected", "d.pdf", 3), "editor": ("editor", "n.pdf", 0), "blank": ("detected", "", 0), "a b+": ("editor", "", 0), "broken": ("editor", "", 0)}


def test_gallery_commands(spark, tmp_path, capsys):
    write(tmp_path / "scenarios/s.json", SCENARIO)
    assert run(capsys, "list-scenarios", tmp_path / "scenarios") == (0, {"ok": True, "scenarios": [{"case_id": "s", "page_size": "letter", "orientation": "portrait", "page_count": 2}]})
    assert run(capsys, "generate", tmp_path / "scenarios", tmp_path / "g")[0] == 0 and (tmp_path / "g/s/s.truth.json").is_file()
    code, out = run(capsys, "self-check", tmp_path / "g")
    assert code == 1 and {"gate": "missing_pdf", "case_id": "s", "page": None, "detail": ""} in out["errors"]
    assert run(capsys, "promote", tmp_path / "g", tmp_path / "f", "--keep", "s") == (0, {"ok": True, "selected": ["s"]})
    assert run(capsys, "promote", tmp_path / "g", tmp_path / "f")[1]["error_code"] == "PROMOTION_FAILED"
    write(tmp_path / "scenarios/t.json", SCENARIO | {"case_id": " "})
    code, out = run(capsys, "generate", tmp_path / "scenarios", tmp_path / "h")
    assert (code, out["error_code"], out["errors"][0]["field"]) == (2, "SCENARIO_INVALID_VALUE", "case_id") and not (tmp_path / "h").exists()
