import json

import pytest

from pagequarry.plans import golden, scenarios
from pagequarry.sources import contracts

CASE = {
    "case_id": "one",
    "page": {"page_count": 3, "page_offset": 10},
    "header": {"enabled": True, "text_template": "chapter_page", "bbox": [60, 30, 400, 54], "support_pages": [1, 3], "rule_line": True, "mirrored_even_odd": 1},
    "footer": {"enabled": False, "text_template": "nonsense"},
    "watermark": {"enabled": True, "text_template": "licensed", "bbox": [150, 350, 450, 420], "rotation_deg": 45.126, "variable_text": True, "opacity": 0.3},
    "figures": [{"index": "A.1", "title": "Two\nlines", "caption_region": [72, 180.125, 540, 198], "body_region": [72, 100, 540, 156.119]}],
    "tables": [
        {"index": "2", "table_group_id": "g", "caption_region": [72, 300, 300, 318], "body_region": [72, 330, 300, 400], "page": 2},
        {"index": "2", "table_group_id": "g", "caption_region": [5, 3, 300, 21], "body_region": [5, 22, 610, 100], "page": 3, "part_index": 2, "is_continuation": True, "continuation_marker": "(cont)", "continued_from": "g"},
    ],
    "negative_texts": [{"text": "see Table 9 above", "bbox": [72, 300, 500, 315], "page": 1}],
    "coverage_hints": ["neg.kind:see_table_above"],
    "axes": {"core": "x"},
}
FILES = {"one.json": CASE, "two.yaml": {"case_id": "two"}, "three.json": {"case_id": "three", "page": {"size": "a9"}}, "four.json": ["no mapping"], "six.json": {"case_id": "six", "page": {"columns": 2, "size": "a4", "orientation": "landscape"}, "figures": [{"index": "1", "caption_region": [60, 300, 380, 318], "body_region": [60, 200, 380, 290]}]}}


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("scenarios")
    for name, body in FILES.items():
        (root / name).write_text(json.dumps(body))
    (root / "five.json").write_text('{"case_id":')
    return scenarios.read_scenarios(spark, str(root)).cache()


@pytest.fixture(scope="module")
def truth(spark, texts):
    return {r.case_id: json.loads(r.body) for r in scenarios.truths(spark, texts).collect()}


def test_errors(spark, texts):
    names = {r.doc: r.file.rpartition("/")[2] for r in texts.collect()}
    found = {names[r.doc]: (r.code, r.field) for r in scenarios.errors(spark, texts).collect()}
    yaml = scenarios.parse_mapping.__globals__["yaml"]
    assert found == {"one.json": ("ok", ""), "two.yaml": ("ok", "") if yaml else ("SCENARIO_FILE_UNREADABLE", ""), "three.json": ("SCENARIO_UNSUPPORTED_PAGE_SIZE", "page.size"), "four.json": ("SCENARIO_INVALID_VALUE", ""), "five.json": ("SCENARIO_FILE_UNREADABLE", ""), "six.json": ("ok", "")}


def test_tags(spark, texts):
    found = {r.tag for r in scenarios.compiled(spark, texts, "tags").join(scenarios.compiled(spark, texts, "case_specs").where("case_id = 'one'"), "k").collect()}
    assert found >= {"page.size:letter", "page.pages:3", "page.offset:nonzero", "hf.mode:header_only", "hf.partial:partial_support", "hf.support:partial_support", "hf.rule:header_rule", "hf.mirrored:mirrored", "wm.presence:variable", "wm.opacity:strong", "wm.rotation:diagonal", "wm.jitter:none", "fig.index:alpha", "fig.title:multiline", "fig.body:waveform", "fig.caption:below", "fig.alias:Figure", "fig.width:column"}
    assert found >= {"tbl.span:continuation", "tbl.parts:2", "tbl.suffix:(cont)", "tbl.title:same_title", "tbl.width:wide", "tbl.width:normal", "title_gap:figure_below_g2", "title_gap:table_above_g1", "title_gap:table_above_g0", "neg.kind:see_table_above", "interstitial_text.lines:none"}
    assert not any(t.startswith(("seq:", "sequence.")) for t in found)


def test_truth(truth):
    one = truth["one"]
    assert (one["axes"], one["realistic"], one["coordinate_unit"], len(one["pages"])) == ({"core": "x"}, True, "pdf_pt", 3)
    first, second, third = one["pages"]
    assert first["width"] == 612 and [r["kind"] for r in first["common_regions"]] == ["header", "watermark"] and [r["kind"] for r in second["common_regions"]] == ["watermark"]
    assert first["common_regions"] == [{"kind": "header", "bbox": [60, 30, 400, 54], "text": "Chapter 2 · Page 11"}, {"kind": "watermark", "bbox": [150, 350, 450, 420], "text": "Licensed to user1@example.test", "variable_text": True, "rotation_deg": 45.13}]
    assert first["figures"] == [{"kind": "figure", "index": "A.1", "title": "Two\nlines", "caption_region": [72, round(180.125, 2), 540, 198], "body_region": [72, 100, 540, round(156.119, 2)], "context_region": [64, 92, 548, 206], "body_kind": "waveform", "title_position": "below", "title_body_gap_lines": 2}]
    a, b = second["tables"][0], third["tables"][0]
    assert a["continuation_marker"] is None and "continued_from" not in a and (a["part_index"], a["is_continuation"], a["title"]) == (1, False, "")
    assert (b["continued_from"], b["continuation_marker"], b["part_index"]) == ("g", "(cont)", 2)
    assert b["context_region"] == [0, 0, 612, 108]


def free(top, bottom, taken, least=34):
    """Free bands by marking tenths of points."""
    marks = [False] * int((bottom - top) * 10)
    for a, b in taken:
        for i in range(max(0, round((a - top) * 10)), min(len(marks), round((b - top) * 10))):
            marks[i] = True
    out, begin = [], None
    for i, m in enumerate([*marks, True]):
        if not m and begin is None:
            begin = i
        if m and begin is not None:
            if i - begin >= least * 10:
                out.append((top + begin / 10, top + i / 10))
            begin = None
    return out


def test_body_text_fills_what_is_free(truth):
    page = truth["one"]["pages"][0]
    got = [tuple(n["bbox"]) for n in page["non_target_text_regions"]]
    assert got == [(54, a, 558, b) for a, b in free(86, 706, [(92, 206), (300, 315)])]
    page = truth["six"]["pages"][0]
    width = (842 - 108 - 22) / 2
    got = sorted(tuple(n["bbox"]) for n in page["non_target_text_regions"])
    left = [(54, a, round(54 + width, 2), b) for a, b in free(86, 595 - 86, [(192, 326)])]
    assert got == sorted([*left, (round(54 + width + 22, 2), 86, 842 - 54, 595 - 86)])


def test_truth_compares_with_itself(spark, truth, tmp_path):
    for name, body in truth.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.truth.json").write_text(json.dumps(body))
    (tmp_path / "MANIFEST.json").write_text(json.dumps({"cases": [{"case_id": n} for n in truth]}))
    side = contracts.read_truth(spark, str(tmp_path))
    s = golden.Comparison(spark, side, side).summary().first()
    assert (s.cases_total, s.cases_failed, s.objects_matched) == (len(truth), 0, 5 + 4)
