import copy
import json

import pytest

from pagequarry.plans import golden
from pagequarry.sources import contracts as C
from pagequarry.sources import runs

PAGES = [
    {
        "page": 2,
        "common_regions": [{"kind": "footer", "bbox": [48, 740, 564, 775], "text": "foot"}, {"kind": "watermark", "bbox": [180, 360, 440, 430], "text": "DRAFT"}],
        "figures": [
            {"kind": "figure", "index": "5-2", "title": "Ring", "caption_region": [72, 250, 330, 273], "body_region": [72, 120, 330, 246], "context_region": [64, 112, 338, 281]},
            {"kind": "figure", "index": "B.4", "title": "Well", "caption_region": [72, 470, 330, 493], "body_region": [72, 330, 330, 466], "context_region": [64, 322, 338, 501]},
        ],
        "tables": [],
    },
    {
        "page": 5,
        "common_regions": [],
        "figures": [],
        "tables": [{"kind": "table", "index": "7", "title": "Tones", "table_group_id": "tbl_007", "part_index": 2, "is_continuation": True, "continuation_marker": "(cont)", "continued_from": "tbl_007", "caption_region": [80, 140, 500, 163], "body_region": [80, 170, 500, 420], "context_region": [72, 132, 508, 428]}],
    },
]


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(body, indent=1))


def manifest(pages, **more):
    return {"schema_version": "detector-output-v0", "coordinate_unit": "pdf_pt", "coordinate_origin": "top-left", "producer": {"name": "d"}, "cases": [{"case_id": "a", "pdf": "x", "pages": []}, {"case_id": "a", "pdf": "x", "pages": pages}]} | more


@pytest.fixture(scope="module")
def truth(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("truth")
    write(root / "MANIFEST.json", {"cases": [{"case_id": "a"}]})
    write(root / "z/z.truth.json", {"case_id": "z", "coordinate_unit": "px", "pages": []})
    write(root / "a/a.truth.json", {"case_id": "a", "coordinate_unit": "pdf_pt", "coordinate_origin": "top-left", "pages": PAGES})
    return C.read_truth(spark, str(root))


def change(edit):
    pages = copy.deepcopy(PAGES)
    edit(*pages)
    return pages


CHANGES = {
    "as it was": (lambda p, q: None, {}),
    "body wider within bounds": (lambda p, q: p["figures"][1]["body_region"].__setitem__(2, 342), {}),
    "body wider beyond": (lambda p, q: p["figures"][1]["body_region"].__setitem__(2, 342.25), {"figure|2|B.4": ("matched", False)}),
    "watermark lower within bounds": (lambda p, q: p["common_regions"][1].update(bbox=[180, 374, 440, 444]), {}),
    "footer lower": (lambda p, q: p["common_regions"][0]["bbox"].__setitem__(3, 781), {"common|2|footer|0": ("matched", False)}),
    "figure lost": (lambda p, q: p["figures"].pop(0), {"figure|2|5-2": ("missing", False)}),
    "context lost": (lambda p, q: q["tables"][0].pop("context_region"), {"table|tbl_007|2": ("matched", False)}),
    "another footer": (lambda p, q: p["common_regions"].append({"kind": "footer", "bbox": [48, 700, 300, 735]}), {"common|2|footer|1": ("extra", False)}),
    "part renumbered": (lambda p, q: q["tables"][0].update(part_index=3), {"table|tbl_007|2": ("missing", False), "table|tbl_007|3": ("extra", False)}),
    "not continued": (lambda p, q: q["tables"][0].update(is_continuation=False, continued_from=None), {"table|tbl_007|2": ("matched", False)}),
}


def test_perturbations(spark, truth, tmp_path):
    """All changes at once, each as a case of its own."""
    from pyspark.sql import functions as F

    names = list(CHANGES)
    write(tmp_path / "d.json", manifest([]) | {"cases": [{"case_id": n, "pdf": "x", "pages": change(CHANGES[n][0])} for n in names]})
    every = truth.crossJoin(spark.createDataFrame([(n,) for n in names], "name string")).select(F.col("name").alias("case_id"), "pages")
    comparison = golden.Comparison(spark, every, C.read_detected(spark, str(tmp_path / "d.json")))
    out = comparison.compared()
    found = {n: {} for n in names}
    for r in out.collect():
        if not r.passed:
            found[r.case_id][r.object_key] = (r.status, r.passed)
    assert found == {n: want for n, (_, want) in CHANGES.items()}
    (s,) = comparison.summary().collect()
    assert (s.cases_total, s.cases_passed, s.objects_missing, s.objects_extra) == (10, 3, 2, 2)


def test_last_duplicate_and_gates(spark, tmp_path):
    write(tmp_path / "d.json", manifest(PAGES))
    (r,) = C.read_detected(spark, str(tmp_path / "d.json")).collect()
    assert len(r.pages.toPython()) == 2
    for name, more in (("v", {"schema_version": "v9"}), ("o", {"coordinate_origin": "bottom-left"}), ("u", {"coordinate_unit": None})):
        write(tmp_path / f"{name}.json", manifest(PAGES, **more))
        with pytest.raises(C.InvalidInput):
            C.read_detected(spark, str(tmp_path / f"{name}.json"))
    write(tmp_path / "MANIFEST.json", {"cases": []})
    with pytest.raises(C.InvalidInput):
        C.read_truth(spark, str(tmp_path))


def test_report_says_what_failed(spark, truth, tmp_path):
    write(tmp_path / "d.json", manifest([]) | {"cases": [{"case_id": "a", "pdf": "x", "pages": change(CHANGES["body wider beyond"][0])}]})
    detected = C.read_detected(spark, str(tmp_path / "d.json"))
    comparison = golden.Comparison(spark, truth, detected)
    runs.write_report(comparison, tmp_path / "out")
    text = (tmp_path / "out/compare_report.md").read_text()
    assert "- cases: 0/1 passed (1 failed)" in text and "| `a` | figure | B.4 | matched | body_region Δ[0.0, 0.0, 12.25, 0.0] tol(12.0, 8.0) |" in text
    assert golden.Comparison(spark, truth, detected, profile="loose").summary().first().cases_failed == 0
    boxes = {(r.colour, r.label) for r in comparison.relation("failure_boxes").collect()}
    assert {label for _, label in boxes} == {"truth body", "det body Δ[0.0, 0.0, 12.25, 0.0]"}


def figure(index="1", **more):
    return {"kind": "figure", "index": index, "caption_region": [1, 2, 3, 4]} | more


def table(**more):
    return {"kind": "table", "index": "7", "caption_region": [1, 2, 3, 4]} | more


def case(*, figures=(), tables=(), commons=(), page=1):
    return [{"page": page, "common_regions": list(commons), "figures": list(figures), "tables": list(tables)}]


#: Truth, detections, what the case's objects come to: (key, status, passed, failing regions, failing fields).
PRESENCE = {
    "no object": (case(), case(), []),
    "no pages": ([], None, []),
    "field absent in truth": (case(tables=[table(part_index=1)]), case(tables=[table(part_index=1, is_continuation=False)]), [("table|1|7|1", "matched", True, [], [])]),
    "field null in truth": (case(tables=[table(continued_from=None)]), case(tables=[table()]), [("table|1|7|", "matched", False, [], [("continued_from", "None", "'<<missing>>'")])]),
    "null is null": (case(tables=[table(continued_from=None)]), case(tables=[table(continued_from=None)]), [("table|1|7|", "matched", True, [], [])]),
    "true is one": (case(tables=[table(is_continuation=True)]), case(tables=[table(is_continuation=1)]), [("table|1|7|", "matched", True, [], [])]),
    "text is no number": (case(tables=[table(continuation_marker="1")]), case(tables=[table(continuation_marker=1)]), [("table|1|7|", "matched", False, [], [("continuation_marker", "'1'", "1")])]),
    "quotes": (case(tables=[table(continuation_marker="it's")]), case(tables=[table(continuation_marker=True)]), [("table|1|7|", "matched", False, [], [("continuation_marker", '"it\'s"', "True")])]),
    "null box in truth": (case(commons=[{"kind": "footer", "bbox": None}]), case(commons=[{"kind": "footer", "bbox": [1, 2, 3, 4]}]), [("common|1|footer|0", "matched", False, [("bbox", "missing region in truth")], [])]),
    "no box in detections": (case(commons=[{"kind": "footer", "bbox": [1, 2, 3, 4]}]), case(commons=[{"kind": "footer"}]), [("common|1|footer|0", "matched", False, [("bbox", "missing region in detected")], [])]),
    "region absent in truth": (case(figures=[figure()]), case(figures=[figure(body_region=[1, 2, 3, 4])]), [("figure|1|1", "matched", True, [], [])]),
    "region null in detections": (case(figures=[figure(body_region=[1, 2, 3, 4])]), case(figures=[figure(body_region=None)]), [("figure|1|1", "matched", False, [("body_region", "missing region in detected")], [])]),
    "rounded onto the bound": (case(figures=[figure(caption_region=[0, 2, 3, 4])]), case(figures=[figure(caption_region=[8.005, 2, 3, 4])]), [("figure|1|1", "matched", False, [("caption_region", None)], [])]),
    "rounded within the bound": (case(figures=[figure(caption_region=[0, 2, 3, 4])]), case(figures=[figure(caption_region=[8.0049, 2, 3, 4])]), [("figure|1|1", "matched", True, [], [])]),
    "last of a key": (case(figures=[figure(caption_region=[90, 90, 95, 95]), figure()]), case(figures=[figure()]), [("figure|1|1", "matched", True, [], [])]),
    "only detected": (None, case(figures=[figure()]), [("figure|1|1", "extra", False, [], [])]),
    "only in truth": (case(figures=[figure()]), None, [("figure|1|1", "missing", False, [], [])]),
}


@pytest.fixture(scope="module")
def presence(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("presence")
    write(root / "MANIFEST.json", {"cases": [{"case_id": n} for n, (t, _, _) in PRESENCE.items() if t is not None]})
    for n, (t, _, _) in PRESENCE.items():
        if t is not None:
            write(root / n / f"{n}.truth.json", {"coordinate_unit": "pdf_pt", "coordinate_origin": "top-left", "pages": t})
    write(root / "d.json", manifest([]) | {"cases": [{"case_id": n, "pdf": "x", "pages": d} for n, (_, d, _) in PRESENCE.items() if d is not None]})
    return golden.Comparison(spark, C.read_truth(spark, str(root)), C.read_detected(spark, str(root / "d.json")))


def test_absent_and_null(presence):
    found = {r.case_id: r.asDict(True) for r in presence.reports().collect()}
    for name, (_, _, want) in PRESENCE.items():
        got = [("|".join(o["key"]), o["status"], o["passed"], [(r["region"], r["reason"]) for r in o["regions"] if not r["passed"]], [(f["field"], f["expected"], f["actual"]) for f in o["fields"] if not f["passed"]]) for o in found[name]["objects"]]
        assert got == want, name
        assert found[name]["passed"] == all(w[2] for w in want)
    s = presence.summary().first()
    assert s.cases_total == len(PRESENCE) and s.cases_failed == sum(not all(w[2] for w in want) for _, _, want in PRESENCE.values())


def test_whole_report(presence, tmp_path):
    runs.write_report(presence, tmp_path)
    body = json.loads((tmp_path / "compare_report.json").read_text())
    assert body["summary"]["cases_total"] == len(body["cases"]) == len(PRESENCE)
    assert body["config"] == {"tolerance_profile": "strict", "allow_extra": False, "case_id_filter": None, "region_kind_filter": None}
    by = {c["case_id"]: c for c in body["cases"]}
    region = {"region": "caption_region", "expected": [0, 2, 3, 4], "actual": [8.005, 2, 3, 4], "delta": [round(8.005, 2), 0, 0, 0], "tolerance": {"x": 8, "y": 5}, "passed": False}
    assert by["rounded onto the bound"] == {"case_id": "rounded onto the bound", "passed": False, "objects": [{"key": ["figure", "1", "1"], "kind": "figure", "page": 1, "index": "1", "status": "matched", "passed": False, "regions": [region], "fields": []}]}
    assert by["no object"] == {"case_id": "no object", "passed": True, "objects": []}
    assert {f["case_id"] for f in body["failures"]} == {n for n, (_, _, want) in PRESENCE.items() if not all(w[2] for w in want)}
    assert "| `field null in truth` | table | 7 | matched | continued_from: exp None got '<<missing>>' |" in (tmp_path / "compare_report.md").read_text()


def test_kind_filter_and_unknown_kind(spark, tmp_path):
    from pagequarry.sources.contracts import InvalidInput

    for n, k in (("a", "footer"), ("b", "sidebar")):
        write(tmp_path / n / f"{n}.truth.json", {"coordinate_unit": "pdf_pt", "coordinate_origin": "top-left", "pages": case(figures=[figure()], commons=[{"kind": k, "bbox": [1, 2, 3, 4]}])})
    write(tmp_path / "MANIFEST.json", {"cases": [{"case_id": "a"}, {"case_id": "b"}]})
    one, both = C.read_truth(spark, str(tmp_path), "a"), C.read_truth(spark, str(tmp_path))
    s = golden.Comparison(spark, one, one, kind="footer").summary().first()
    assert (s.cases_total, s.objects_matched, s.regions_checked) == (1, 1, 1)
    with pytest.raises(InvalidInput):
        golden.Comparison(spark, both, both)


def test_decisions(spark, tmp_path):
    rows = ["| case_id | thumbnail | axis tags | realism 1-5 | keep/drop | critique |", "|---|---|---|---|---|---|", "| `a` | x | y | 4 | Keep | good |", "| b | x | y | 3 | drop |  |", "| `c` | x | y | 2 | keep | |", "| c | x | y | 2 | | |", "| short | keep |"]
    (tmp_path / "index.md").write_text("# Cases\n\n" + "\n".join(rows) + "\n")
    assert {tuple(r) for r in C.read_decisions(spark, str(tmp_path / "index.md")).collect()} == {("a", "keep"), ("b", "drop"), ("c", "")}


def test_manifest_is_gated(spark, tmp_path):
    texts = spark.createDataFrame([(1, json.dumps({"x": 1}))], "doc long, body string")
    with pytest.raises(C.InvalidInput):
        C.write_manifest(texts, texts, str(tmp_path / "no"))
    C.write_manifest(texts, texts.limit(0), str(tmp_path / "yes"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "yes")).collect()] == [{"x": 1}]
