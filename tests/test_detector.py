import json

import pytest

from pagequarry.plans import detector, graph, registry
from pagequarry.plans.dialect import Spark
from pagequarry.sources import contracts as C
from pagequarry.sources import runs


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    def extract(content):  # pages as JSON, as a stand-in for a page extractor
        for p in json.loads(content):
            yield p["page"], 612.0, 792.0, p["lines"], p["drawings"]

    top = tmp_path_factory.mktemp("docs")
    one = [{"page": 1, "lines": [["Fig. 2.1: Ring", 60, 320, 200, 332], ["  ", 1, 1, 2, 2], ["Chapter 1", 60, 40, 200, 52]], "drawings": [[70, 200, 400, 300], [10, 10, 10, 90]]}, {"page": 2, "lines": [["Table 3.1: Tones", 60, 100, 200, 112], ["row", 60, 118, 300, 128]], "drawings": []}]
    (top / "a.json").write_text(json.dumps(one))
    (top / "b.json").write_text(json.dumps([{"page": 1, "lines": [], "drawings": []}]))
    return detector.read_documents(spark, str(top), extract)


def test_documents_are_extracted(documents):
    pages, lines, drawings = documents
    assert pages.count() == 3 and sorted((r.page, r.line_seq, r.text) for r in lines.collect()) == [(1, 1, "Fig. 2.1: Ring"), (1, 2, "Chapter 1"), (2, 1, "Table 3.1: Tones"), (2, 2, "row")]
    assert [(r.x0, r.y1) for r in drawings.collect()] == [(70.0, 300.0)]


def test_nested_manifests_are_valid(spark, documents, tmp_path):
    pages, lines, drawings = documents
    cases = detector.nested(pages, detector.detect(spark, pages, lines, drawings), detector.detect(spark, pages, lines, drawings, "commons"))
    texts = detector.detector_texts(cases)
    bodies = [json.loads(r.body) for r in texts.collect()]
    found = detector.violations(spark, texts, "detector")
    assert found.collect() == []
    C.write_manifest(texts, found, str(tmp_path / "out"))
    (full,) = [b["cases"][0]["pages"] for b in bodies if len(b["cases"][0]["pages"]) == 2]
    assert [p["page"] for p in full] == [1, 2] and [len(p["common_regions"]) for p in full] == [1, 0]
    assert full[0]["figures"][0]["index"] == "2.1" and full[0]["figures"][0]["body_region"] == [68.0, 198.0, 402.0, 302.0] and full[0]["tables"] == []
    assert full[1]["tables"][0]["table_group_id"] == "tbl_003_001" and full[1]["tables"][0]["continuation_marker"] is None
    assert detector.violations(spark, detector.editor_texts(cases, "d.json"), "editor").collect() == []


def test_run_is_opened_edited_and_saved(spark, documents, tmp_path):
    pages, lines, drawings = documents
    cases = detector.nested(pages, detector.detect(spark, pages, lines, drawings), detector.detect(spark, pages, lines, drawings, "commons"))
    (body,) = [json.loads(r.body) for r in detector.detector_texts(cases).collect() if "2.1" in r.body]
    run = tmp_path / "run"
    with pytest.raises(runs.RunError, match="RUN_DIR_NOT_FOUND"):
        runs.load_run(spark, run)
    run.mkdir()
    with pytest.raises(runs.RunError, match="RUN_MANIFEST_NOT_FOUND"):
        runs.load_run(spark, run)
    (run / runs.DETECTED).write_text(json.dumps(body))
    manifest, path = runs.load_run(spark, run)
    assert manifest["edits"] == [] and len(manifest["pages"]) == 2 and path.name == runs.EDITOR
    manifest["edits"].append({"object_id": "figure:2.1:page1", "operation": "update_bbox", "region": "body_region", "before": None, "after": [1, 2, 3, 4]})
    assert runs.save(spark, run, manifest)["edit_count"] == 1
    assert runs.load_run(spark, run)[0]["edits"] == manifest["edits"]
    with pytest.raises(runs.RunError, match="SAVE_PATH_NOT_ALLOWED"):
        runs.save(spark, run, manifest, "../out.json")
    with pytest.raises(runs.RunError, match="SAVE_MANIFEST_INVALID"):
        runs.save(spark, run, manifest | {"pages": None})
    with pytest.raises(runs.RunError, match="MANIFEST_OUTSIDE_RUN_DIR"):
        runs.load_run(spark, run, tmp_path / "other.json")
    (run / runs.EDITOR).write_text(json.dumps(manifest | {"source_pdf": ""}))
    with pytest.raises(runs.RunError, match="RUN_MANIFEST_INVALID"):
        runs.load_run(spark, run)


def test_edits_replace_the_objects_box_first(spark):
    """IT4: before is the object's own box, then what the edit before it left; EDT3 logs edits of unknown objects too."""
    box = "x0 double, y0 double, x1 double, y1 double"
    objects = spark.createDataFrame([(1, 1, "figure", "1", "t", "figure:1:page1", 5)], "doc_id long, page int, kind string, idx string, title string, object_id string, place int")
    boxes = spark.createDataFrame([(1, 1, "figure", "figure:1:page1", 5, "body_region", 10.0, 20.0, 30.0, 40.0)], f"doc_id long, page int, kind string, object_id string, place int, region string, {box}")
    edits = spark.createDataFrame([(k, 1, 1, o, "body_region", *b) for k, o, b in ((1, "figure:1:page1", (11.0, 21.0, 31.0, 41.0)), (2, "figure:1:page1", (50.0, 21.0, 31.0, 41.0)), (3, "figure:9:page1", (1.0, 2.0, 3.0, 4.0)), (4, "figure:1:page1", (12.0, 22.0, 32.0, 42.0)))], f"edit_seq long, doc_id long, page int, object_id string, region string, {box}")
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0)], detector.PAGE)
    sources = {"editor_objects": objects, "overlay_boxes": boxes, "edits": edits, "layout_pages": pages}
    rows = lambda sql: [tuple(r) for r in graph.run(spark, sql, registry.relations(Spark()), sources).collect()]
    assert rows("SELECT edit_seq, before_x0, before_y1, x0 FROM edit_history ORDER BY edit_seq") == [(1, 10.0, 40.0, 11.0), (4, 11.0, 41.0, 12.0)]
    assert rows("SELECT edit_seq, before_x0, x0 FROM unchecked_history ORDER BY edit_seq") == [(1, 10.0, 11.0), (2, 11.0, 50.0), (3, None, 1.0), (4, 50.0, 12.0)]
    assert rows("SELECT edit_seq, code FROM edit_checks ORDER BY edit_seq") == [(1, "ok"), (2, "EDIT_BAD_BBOX"), (3, "EDIT_OBJECT_NOT_FOUND"), (4, "ok")]
    assert rows("SELECT x0, y1, edited FROM edited_boxes") == [(12.0, 42.0, True)]
