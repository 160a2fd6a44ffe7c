"""Every query of the layout engine by name, with its oracle; names begin with the survey's ids."""

from __future__ import annotations

from ..functions import scalars as S
from ..operators import compare, corpus, detect, lifecycle, validate, scenarios
from ..sources import layout, specs
from . import graph
from .dialect import Spark


def relations(d) -> dict[str, str]:
    return {k: v for m in (layout, specs, detect, compare, corpus, lifecycle, validate) for k, v in m.relations(d).items()}


def _detect(d) -> dict[str, str]:
    return {
        "src2_extract_lines": "SELECT * FROM lines",
        "src2_extract_drawings": "SELECT * FROM drawings WHERE x1 > x0 AND y1 > y0",
        "p1_match_caption": "SELECT doc_id, page, line_seq, kind, CASE WHEN kind IS NOT NULL THEN idx END AS idx, CASE WHEN kind IS NOT NULL THEN title END AS title FROM line_captions",
        "p2_reference_sentence": f"SELECT doc_id, page, line_seq, {S.is_prose(d, 'spaced')} AS prose FROM line_titles WHERE word <> ''",
        "p3_continuation_marker": f"SELECT doc_id, page, anchor_id, {S.marker(d, 'title')} AS marker FROM anchors",
        "p4_group_id": f"SELECT DISTINCT idx, {S.group_id(d, 'idx')} AS group_id FROM anchors",
        "p5_bump_last": f"SELECT DISTINCT idx, n, {S.bumped(d, S.group_id(d, 'idx'), 'n')} AS bumped FROM anchors CROSS JOIN (VALUES (1), (2), (998)) AS v(n)",
        "p8_geometry": f"SELECT a.doc_id, a.page, a.anchor_id, b.draw_seq, {S.area('a.')} AS a_area, {S.area('b.')} AS b_area, least(a.x0, b.x0) AS union_x0, least(a.y0, b.y0) AS union_y0, greatest(a.x1, b.x1) AS union_x1, greatest(a.y1, b.y1) AS union_y1, {S.shared_area('a.', 'b.')} AS shared, {S.y_meets('a.', 'b.', 2)} AS y_meets, {S.x_meets('a.', 'b.', 2)} AS x_meets FROM zone_drawings b JOIN anchors a ON a.doc_id = b.doc_id AND a.page = b.page AND a.anchor_id = b.anchor_id",
        "p10_iou_center": f"SELECT b.doc_id, b.page, b.anchor_id, b.draw_seq, {S.iou('a.', 'b.')} AS iou, {S.center_in('a.', 'b.')} AS core_in, {S.center_in('b.', 'a.')} AS drawing_in, least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 AS y_overlap, 0 <= b.x0 AND b.x0 < b.x1 AND b.x1 <= p.width AND 0 <= b.y0 AND b.y0 < b.y1 AND b.y1 <= p.height AS bbox_ok FROM zone_drawings b JOIN drawn_cores a ON a.doc_id = b.doc_id AND a.page = b.page AND a.anchor_id = b.anchor_id JOIN layout_pages p ON p.doc_id = b.doc_id AND p.page = b.page",
        "p11_common_key": f"SELECT doc_id, page, line_seq, {S.common_key(d, 'text')} AS k FROM lines",
        "p12_letters_key": f"SELECT doc_id, page, line_seq, {S.letters_key(d, 'text')} AS k FROM lines",
        "p13_is_watermark": f"SELECT doc_id, page, line_seq, {S.is_watermark(d, 'text')} AS is_watermark FROM lines",
        "p14_caption_band": "SELECT doc_id, page, anchor_id, title_lines, x0, y0, x1, y1 FROM captions",
        "p15_context_region": "SELECT doc_id, page, anchor_id, ctx_x0, ctx_y0, ctx_x1, ctx_y1 FROM objects",
        "p16_bands": "SELECT doc_id, page, kind, pos, x0, y0, x1, y1 FROM bands",
        "p17_body_zone": "SELECT doc_id, page, height, least(CAST(86 AS DOUBLE), height) AS lo, height - 86 AS hi FROM layout_pages",
        "p18_safe_index": f"SELECT DISTINCT idx, {S.safe_index(d, 'idx')} AS safe FROM anchors",
        "p19_object_id": f"SELECT doc_id, anchor_id, page, {S.object_id(d, 'kind', 'idx', 'page')} AS object_id FROM anchors",
        "p20_coordinates": f"SELECT doc_id, page, draw_seq, scale, {d.hundredths('x0 / scale')} AS pt_x, {d.hundredths('y0 / scale')} AS pt_y, {d.hundredths('x0 * scale')} AS screen_x, {d.hundredths('y0 * scale')} AS screen_y, {d.hundredths('x1 - x0')} AS dx, {d.hundredths('y1 - y0')} AS dy, {d.hundredths('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))')} AS distance, {d.hundredths('x1 * scale')} AS px_x1, {d.hundredths('y1 * scale')} AS px_y1 FROM (SELECT *, CAST(1 + draw_seq % 4 * 0.5 AS DOUBLE) AS scale FROM drawings) AS x",
        # three-decimal coordinates of both signs; DuckDB formats them instead, which rounds the exact value too
        "p20_exact_rounding": f"SELECT l_orderkey, l_linenumber, x, {d.hundredths('x') if d.name == 'spark' else "CAST(printf('%.2f', x) AS DOUBLE)"} AS rounded FROM (SELECT l_orderkey, l_linenumber, CAST((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey) % 2000003 - 1000001 AS DOUBLE) / 1000 AS x FROM lineitem) AS x",
        "p24_index_style": f"SELECT DISTINCT idx, {S.index_style(d, 'idx')} AS style FROM anchors",
        "p25_task_hint": f"SELECT doc_id, anchor_id, page, {S.hint(d, 'kind')} AS hint FROM anchors",
        "f1_margin_lines": "SELECT doc_id, page, kind, line_seq FROM margin_lines",
        "f2_zone_lines": "SELECT doc_id, page, anchor_id, line_seq FROM zone_lines",
        "f3_split_commons": "SELECT doc_id, page, kind, pos, CASE WHEN kind = 'watermark' THEN trim(text) END AS watermark_text, kind <> 'watermark' AS by_box FROM commons",
        "c1_find_anchors": "SELECT doc_id, page, anchor_id, kind, idx, title, y0 FROM anchors",
        "w7_anchor_order": "SELECT doc_id, page, anchor_id, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, anchor_id) AS BIGINT) AS nth FROM anchors",
        "w2_table_groups": "SELECT * FROM table_groups",
        "j9_table_parts": "SELECT doc_id, page, anchor_id, CAST(part AS BIGINT) AS part, parts, any_mark = 1 AS any_mark FROM table_parts",
        "c2_common_regions": "SELECT doc_id, page, kind, pos, text, region_id, x0, y0, x1, y1 FROM commons",
        "it2_merge_lines": "SELECT doc_id, page, kind, CAST(many AS BIGINT) AS many FROM margin_blocks",
        "w3_common_ids": "SELECT doc_id, kind, region_id, count(*) AS n FROM commons GROUP BY doc_id, kind, region_id",
        "j1_ownership": "SELECT doc_id, page, anchor_id, draw_seq FROM owned",
        "j2_nearest_side": "SELECT doc_id, page, anchor_id, gap_above, gap_below FROM nearest",
        "j3_zone_bounds": "SELECT doc_id, page, anchor_id, lo, hi FROM zones",
        "j4_two_columns": "SELECT doc_id, page, anchor_id, two_columns FROM zones",
        "j5_zone_drawings": "SELECT doc_id, page, anchor_id, draw_seq, gap FROM zone_drawings",
        "w8_orientation": "SELECT * FROM orientation",
        "w6_cluster_growth": "SELECT doc_id, page, anchor_id, draw_seq FROM clusters",
        "j6_drawing_core": "SELECT * FROM drawn_cores",
        "w4_table_rows": "SELECT * FROM row_cores",
        "it1_expand_labels": "SELECT doc_id, page, anchor_id, g.x0 AS x0, g.y0 AS y0, g.x1 AS x1, g.y1 AS y1 FROM grown g",
        "it3_title_lines": "SELECT doc_id, page, anchor_id, r.t.n AS n, r.t.top AS top FROM title_runs r",
        "a2_title_extent": "SELECT doc_id, page, max(r.t.n) AS most_lines, min(r.t.top) AS top FROM title_runs r GROUP BY doc_id, page",
        "c3_infer_body": "SELECT * FROM bodies",
        "c5_fallback": "SELECT doc_id, page, anchor_id, bx0, by0, bx1, by1, title_position, gap_lines FROM placed",
        "j7_neighbour_clamp": "SELECT * FROM limits",
        "c4_detect": "SELECT * FROM objects",
        "c12_truth_to_detected": "SELECT case_id, page, kind, idx, title, CASE WHEN kind = 'table' THEN group_id END AS table_group_id, CASE WHEN kind = 'table' THEN part_index END AS part_index, title_position, gap_lines, cap_x0, cap_y0, cap_x1, cap_y1, body_x0, body_y0, body_x1, body_y1, ctx_x0, ctx_y0, ctx_x1, ctx_y1 FROM spec_truth UNION ALL SELECT case_id, page, kind, '', text, NULL, NULL, NULL, NULL, x0, y0, x1, y1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM common_boxes",
    }


def _statements(d) -> dict[str, str]:
    return {**_detect(d), **compare.queries(d), **corpus.queries(d), **lifecycle.queries(d), **validate.queries(d)}


def compiled(d) -> dict[str, str]:
    """The relations with those of compiled scenarios instead of the specifications that derive from the tables."""
    return relations(d) | scenarios.relations(d)


def _all() -> dict[str, tuple]:
    found = {name: graph.query(lambda d, name=name: _statements(d)[name], relations) for name in _statements(Spark())}
    return found | {name: graph.query(lambda d, name=name: scenarios.queries(d)[name], compiled) for name in scenarios.queries(Spark())}


def queries() -> dict:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items()}
