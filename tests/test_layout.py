import pytest

from pagequarry.plans import graph, registry
from pagequarry.plans.dialect import DuckDB, Spark

duckdb = pytest.importorskip("duckdb")

PAGE, LINE, DRAW = "doc_id long, page int, width double, height double", "doc_id long, page int, line_seq int, text string, x0 double, y0 double, x1 double, y1 double", "doc_id long, page int, draw_seq int, x0 double, y0 double, x1 double, y1 double"


def detect(spark, sql, lines, drawings=(), pages=None):
    pages = pages or sorted({(r[0], r[1], 612.0, 792.0) for r in lines})
    sources = {"layout_pages": spark.createDataFrame(pages, PAGE), "lines": spark.createDataFrame(lines, LINE), "drawings": spark.createDataFrame(list(drawings), DRAW)}
    return [r.asDict() for r in graph.run(spark, sql, registry.relations(Spark()), sources).collect()]


def lines_of(*rows, page=1):
    return [(1, page, k, t, float(a), float(b), float(c), float(e)) for k, (t, a, b, c, e) in enumerate(rows, 1)]


CAPTIONS = [
    ("Figure 3.4. Clock tree", "figure", "3.4", "Clock tree"),
    ("Table 1-7: Pin budget", "table", "1-7", "Pin budget"),
    ("Figure 3-3 Mixing stage of three taps", "figure", "3-3", "Mixing stage of three taps"),
    ("Fig. 5: Floor plan", "figure", "5", "Floor plan"),
    ("FIGURE A.1. Outer ring", "figure", "A.1", "Outer ring"),
    ("Figure 3-3 shows the route", None, None, None),
    ("Table 2.1 Describes it", None, None, None),
    ("Figure of speech", None, None, None),
    ("In Figure 3-5: see", None, None, None),
    ("Figure 3.4. shows all", "figure", "3.4", "shows all"),
    ("Table 4 ", None, None, None),
]


def test_captions(spark):
    lines = lines_of(*((t, 60, 100 + k, 200, 112 + k) for k, (t, *_) in enumerate(CAPTIONS)))
    found = {r["line_seq"]: (r["kind"], r["idx"], r["title"]) for r in detect(spark, registry._detect(Spark())["p1_match_caption"], lines)}
    assert [found[k] for k in range(1, len(CAPTIONS) + 1)] == [tuple(x) for _, *x in CAPTIONS]


def test_continued_and_independent_tables(spark):
    parts = [(1, p, 1, t, 60.0, 100.0, 200.0, 112.0) for p, t in ((1, "Table 2.1: Map"), (2, "Table 2.1: Map (continued)"), (3, "Table 2.1: Map cont."), (4, "Table 10.9: One"), (5, "Table 10.9: Two"), (6, "Table A.1: x"))]
    found = sorted((r["page"], r["group_id"], r["part_index"], r["continuation_marker"]) for r in detect(spark, "SELECT * FROM table_groups", parts))
    assert found == [(1, "tbl_002_001", 1, None), (2, "tbl_002_001", 2, "(continued)"), (3, "tbl_002_001", 3, "cont."), (4, "tbl_010_009", 1, None), (5, "tbl_010_010", 1, None), (6, "tbl_A_001", 1, None)]


def test_framed_figure_with_labels_and_note(spark):
    lines = lines_of(("Note: prose above the figure that is wide", 60, 100, 500, 112), ("SIG", 40, 220, 60, 232), ("FAR", 5, 225, 20, 237), ("Figure 1.1. Timing", 60, 320, 200, 332), ("goes on here", 60, 334, 180, 344))
    drawings = [(1, 1, 1, 70.0, 200.0, 400.0, 300.0), (1, 1, 2, 80.0, 210.0, 120.0, 240.0), (1, 1, 3, 54.0, 116.0, 500.0, 117.0)]
    (r,) = detect(spark, "SELECT * FROM objects", lines, drawings)
    assert (r["body_x0"], r["body_y0"], r["body_x1"], r["body_y1"]) == (38, 198, 402, 302)
    assert (r["cap_y0"], r["cap_y1"], r["title_position"], r["gap_lines"]) == (319, 320 + 23 + 18, "below", 1)
    assert (r["ctx_x0"], r["ctx_y0"], r["ctx_x1"], r["ctx_y1"]) == (30, 190, 410, 369)


def test_table_of_rows_stops_at_a_wide_gap(spark):
    rows = [(f"row {k}", 60, y, 300, y + 10) for k, y in enumerate((120, 135, 150, 200))]
    (r,) = detect(spark, "SELECT * FROM row_cores", lines_of(("Table 1.1: Rows", 60, 100, 200, 112), *rows))
    assert (r["y0"], r["y1"]) == (120, 160)


def test_common_regions(spark):
    lines = lines_of(("Chapter 1", 60, 40, 200, 52), ("Overview", 60, 54, 150, 66), ("CONFIDENTIAL", 100, 300, 200, 320), ("left 1", 60, 750, 120, 762), ("right", 400, 750, 480, 762))
    lines += [(1, 2, k, t.replace("1", "2"), *b) for _, _, k, t, *b in lines]
    found = detect(spark, "SELECT * FROM commons", lines)
    first = {r["region_id"]: (r["kind"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in found if r["page"] == 1}
    assert first == {"hdr_001": ("header", 48, 40, 564, 81), "ftr_001": ("footer", 57, 750, 123, 785), "ftr_002": ("footer", 397, 750, 483, 785), "wm_001": ("watermark", 82, 282, 218, 338)}
    assert {r["region_id"] for r in found if r["page"] == 2} == set(first)


def test_pages_without_anything(spark):
    assert detect(spark, "SELECT * FROM objects", [], (), [(1, 1, 612.0, 792.0)]) == []
    (r,) = detect(spark, "SELECT * FROM objects", lines_of(("Figure 1. Alone", 60, 320, 200, 332)))
    assert (r["title_position"], r["gap_lines"]) == ("below", 0) and (r["body_y0"], r["cap_y0"]) == (319, 319)


NAMES = ("c1_find_anchors", "c2_common_regions", "c4_detect", "a3_compare_summary", "a10_coverage_summary", "j11_text_match", "j18_free_bands", "edt2_edit_bbox", "it4_replay", "edt4_saved_state", "c9_build_package", "a5_next_tasks", "v1_detector_output", "v4_setup", "v6_scenario", "src9_decision_table")


@pytest.mark.parametrize("name", NAMES)
def test_both_engines_agree(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_every_query_has_both_spellings():
    for d in (Spark(), DuckDB()):
        assert len(registry._statements(d)) > 100
    assert registry.queries().keys() == registry.oracle_sql().keys()
