import json

import pytest

from pagequarry.plans import detector
from pagequarry.sources import runs

BOX = [10, 20, 300, 400]
FIGURE = {"kind": "figure", "index": "1", "title": "t", "title_position": "below", "title_body_gap_lines": 1, "caption_region": BOX, "body_region": BOX, "context_region": BOX}
TABLE = {"kind": "table", "index": "2", "title": "u", "table_group_id": "g", "part_index": 1, "is_continuation": False, "continuation_marker": None, "caption_region": BOX, "body_region": BOX}
PAGE = {"page": 1, "common_regions": [{"kind": "footer", "bbox": BOX}, {"kind": "header", "bbox": BOX}], "figures": [FIGURE, FIGURE], "tables": [TABLE, TABLE]}
HEAD = {"coordinate_unit": "pdf_pt", "coordinate_origin": "top-left"}
DETECTOR = {"schema_version": "detector-output-v0", **HEAD, "producer": {"name": "n", "version": "1", "mode": "m"}, "cases": [{"case_id": "a", "pdf": "a.pdf", "pages": []}, {"case_id": "b", "pdf": "b.pdf", "pages": [PAGE, {**PAGE, "page": 7}]}]}
EDIT = {"object_id": "figure:1:page1", "operation": "update_bbox", "region": "body_region", "before": None, "after": BOX}
EDITOR = {"schema_version": "editor-save-manifest-v0", **HEAD, "source_pdf": "a.pdf", "source_detector_manifest": "d.json", "pages": [PAGE, PAGE], "edits": [EDIT, EDIT]}
ITEM = {"object_id": "figure:1:page1", "kind": "figure", "page": 1, "caption_region": BOX, "body_region": BOX, "crops": {}, "downstream_task_hint": "table"}
PACKAGE = {"schema_version": "downstream-package-v0", **HEAD, "source_pdf": "a.pdf", "source_editor_manifest": "runs/detected_manifest.json.bak", "objects": [ITEM, ITEM]}
REVIEW = {"schema_version": "real-pdf-review-v0", "pdf": "a.pdf", "objects": [{"object_id": "table:A.1:page3", "decision": "wrong_title"}, {"object_id": "figure:1:page1", "decision": "accept", "expected_change": {"body_region": BOX}}], "missed_objects": [{"kind": "table", "page": 2}, {"kind": "figure", "page": 4, "approximate_region": None}]}
SETUP = {"schema_version": "setup-yaml-v0", "project": {"name": "p"}, "input": {"pdf_path": "/a.pdf", "page_range": "3"}, "output": {"artifact_dir": "o"}, "advanced_fine_tuning": {"detector_profile": "default"}}
PART = {"index": "1", "caption_region": BOX, "body_region": BOX}
SCENARIO = {"case_id": "s", "page": {"page_count": 2, "columns": 2}, "header": {"enabled": True, "text_template": "plain", "bbox": BOX, "support_pages": [1, 2]}, "footer": {"enabled": False, "text_template": "nothing"}, "figures": [PART, {**PART, "page": 2}], "tables": [{**PART, "table_group_id": "g"}, {**PART, "table_group_id": "g"}], "negative_texts": [{"text": "n", "bbox": BOX}]}

F2, T2 = ["cases", 1, "pages", 1, "figures", 1], ["cases", 1, "pages", 1, "tables", 1]
LOST = object()
# contract, document, path of the fault, value (or LOST), what is found
FAULTS = [
    ("detector", DETECTOR, ["schema_version"], "v1", "schema_version must be detector-output-v0"),
    ("detector", DETECTOR, ["producer", "mode"], "", "producer.mode is required"),
    ("detector", DETECTOR, ["producer", "version"], 0, "producer.version is required"),
    ("detector", DETECTOR, ["producer"], None, "producer object is required"),
    ("detector", DETECTOR, ["cases"], {}, "cases must be a list"),
    ("detector", DETECTOR, ["cases", 1], 4, "cases[1] must be an object"),
    ("detector", DETECTOR, ["cases", 1, "pdf"], 4, "cases[1].pdf must be a non-empty string"),
    ("detector", DETECTOR, ["cases", 1, "pages"], None, "cases[1].pages must be a list"),
    ("detector", DETECTOR, ["cases", 1, "pages", 1, "page"], 7.0, "cases[1].page[?].page must be an integer"),
    ("detector", DETECTOR, ["cases", 1, "pages", 1, "tables"], 5, "cases[1].page[7].tables must be a list"),
    ("detector", DETECTOR, ["cases", 1, "pages", 1, "common_regions", 1, "kind"], "edge", "cases[1].page[7].common_regions[1].kind must be a common kind"),
    ("detector", DETECTOR, [*F2, "title"], LOST, "cases[1].page[7].figures[1].title is required"),
    ("detector", DETECTOR, [*F2, "title"], None, None),
    ("detector", DETECTOR, [*F2, "title_position"], "left", "cases[1].page[7].figures[1].title_position must be above or below"),
    ("detector", DETECTOR, [*F2, "context_region"], LOST, "cases[1].page[7].figures[1].context_region must be 4 numbers"),
    ("detector", DETECTOR, [*F2, "caption_region", 1], True, "cases[1].page[7].figures[1].caption_region must be 4 numbers"),
    ("detector", DETECTOR, [*T2, "context_region"], [1], "cases[1].page[7].tables[1].context_region must be 4 numbers when present"),
    ("detector", DETECTOR, [*T2, "context_region"], None, None),
    ("detector", DETECTOR, [*T2, "part_index"], LOST, "cases[1].page[7].tables[1].part_index is required"),
    ("editor", EDITOR, ["pages", 1, "page"], "1", "pages[1].page must be an integer"),
    ("editor", EDITOR, ["edits", 1, "operation"], "move", "edits[1].operation must be an operation"),
    ("editor", EDITOR, ["edits", 1, "after"], [1, 2, 3], "edits[1].after must be 4 numbers"),
    ("editor", EDITOR, ["edits", 1, "before"], "x", "edits[1].before must be 4 numbers when present"),
    ("editor", EDITOR, ["edits"], LOST, "edits must be a list"),
    ("package", PACKAGE, ["source_editor_manifest"], "runs/detected_manifest.json", "source_editor_manifest must be an editor manifest"),
    ("package", PACKAGE, ["objects", 1, "crops"], [], "objects[1].crops must be an object"),
    ("package", PACKAGE, ["objects", 1, "downstream_task_hint"], "", "objects[1].downstream_task_hint is required"),
    ("package", PACKAGE, ["objects", 1, "page"], LOST, "objects[1].page must be an integer"),
    ("review", REVIEW, ["objects", 1, "decision"], "fine", "objects[1].decision must be a decision"),
    ("review", REVIEW, ["objects", 0, "object_id"], "tables:1:page1", "objects[0].object_id must be <figure|table>:<index>:page<N>"),
    ("review", REVIEW, ["objects", 1, "expected_change", "body_region"], [1], "objects[1].expected_change.body_region must be 4 numbers"),
    ("review", REVIEW, ["objects", 1, "expected_change", "edge"], BOX, "objects[1].expected_change.edge is no region"),
    ("review", REVIEW, ["missed_objects", 1, "page"], 4.5, "missed_objects[1].page must be an integer"),
    ("setup", SETUP, ["project", "name"], LOST, ("SETUP_MISSING_FIELD", "project.name")),
    ("setup", SETUP, ["output", "artifact_dir"], " ", ("SETUP_INVALID_VALUE", "output.artifact_dir")),
    ("setup", SETUP, ["input", "pdf_path"], "CHANGE_ME", ("SETUP_PLACEHOLDER_UNRESOLVED", "input.pdf_path")),
    ("setup", SETUP, ["input", "page_range"], "7-2", ("SETUP_BAD_PAGE_RANGE", "input.page_range")),
    ("setup", SETUP, ["advanced_fine_tuning", "detector_profile"], "x", ("SETUP_UNKNOWN_DETECTOR", "advanced_fine_tuning.detector_profile")),
    ("scenario", SCENARIO, ["page", "size"], "a9", ("SCENARIO_UNSUPPORTED_PAGE_SIZE", "page.size")),
    ("scenario", SCENARIO, ["page", "page_count"], 0, ("SCENARIO_INVALID_VALUE", "page.page_count")),
    ("scenario", SCENARIO, ["header", "text_template"], "bar_two_line", ("SCENARIO_UNKNOWN_TEMPLATE", "header.text_template")),
    ("scenario", SCENARIO, ["header", "support_pages", 1], 1.5, ("SCENARIO_INVALID_VALUE", "header.support_pages")),
    ("scenario", SCENARIO, ["figures", 1, "page"], 3, ("SCENARIO_INVALID_VALUE", "figures[1].page")),
    ("scenario", SCENARIO, ["figures", 1, "body_region", 0], 300, ("SCENARIO_BAD_BBOX", "figures[1].body_region")),
    ("scenario", SCENARIO, ["tables", 1, "body_region", 3], 793, ("SCENARIO_OUT_OF_PAGE_BOUNDS", "tables[1].body_region")),
    ("scenario", SCENARIO, ["tables", 1, "table_group_id"], "", ("SCENARIO_INVALID_VALUE", "tables[1].table_group_id")),
    ("scenario", SCENARIO, ["negative_texts", 0, "bbox"], None, ("SCENARIO_BAD_BBOX", "negative_texts[0].bbox")),
]


def faulty(document, path, value):
    out = at = json.loads(json.dumps(document))  # nothing shared
    for step in path[:-1]:
        at = at[step]
    if value is LOST:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


@pytest.mark.parametrize("contract", ["detector", "editor", "package", "setup", "review", "scenario"])
def test_faults_in_later_items_are_found(spark, contract):
    """A valid document has none; each fault gives its message, or its code and field, and nothing else."""
    cases = [(d, p, v, want) for c, d, p, v, want in FAULTS if c == contract]
    texts = [(0, json.dumps(cases[0][0]))] + [(k, json.dumps(faulty(d, p, v))) for k, (d, p, v, _) in enumerate(cases, 1)]
    found = {}
    for r in detector.violations(spark, spark.createDataFrame(texts, "doc long, body string"), contract).collect():
        found.setdefault(r.doc, []).append(r.violation if "violation" in r else (r.code, r.field))
    clean = [("ok", "")] if contract in ("setup", "scenario") else None
    assert found.get(0) == clean
    for k, (_, path, _, want) in enumerate(cases, 1):
        assert found.get(k) == (clean if want is None else [want]), path


def test_first_error_counts(spark):
    both = faulty(faulty(SCENARIO, ["figures", 1, "page"], 9), ["header", "bbox"], [1, 2])
    (r,) = detector.violations(spark, spark.createDataFrame([(1, json.dumps(both))], "doc long, body string"), "scenario").collect()
    assert (r.code, r.field) == ("SCENARIO_BAD_BBOX", "header.bbox")
    assert [runs.exit_code(c) for c in (None, "COMPARE_FAILED", "SCENARIO_BAD_BBOX", "OVERLAY_FAILED", "anything")] == [0, 1, 2, 3, 2]


def test_texts_that_are_no_json(spark):
    """One text doesn't fail the others; the last of a repeated key counts."""
    twice = '{"schema_version":"v9",' + json.dumps(DETECTOR)[1:]
    texts = spark.createDataFrame([(1, '{"a":'), (2, ""), (3, None), (4, twice), (5, json.dumps(DETECTOR))], "doc long, body string")
    for contract in ("detector", "editor", "package", "review"):
        found = {r.doc: r.violation for r in detector.violations(spark, texts.where("doc < 4"), contract).collect()}
        assert found == dict.fromkeys((1, 2, 3), "text is not valid JSON"), contract
    for contract, code in (("setup", "SETUP_FILE_UNREADABLE"), ("scenario", "SCENARIO_FILE_UNREADABLE")):
        assert {(r.doc, r.code, r.field) for r in detector.violations(spark, texts.where("doc < 4"), contract).collect()} == {(k, code, "") for k in (1, 2, 3)}
    assert {r.doc for r in detector.violations(spark, texts, "detector").collect()} == {1, 2, 3}
