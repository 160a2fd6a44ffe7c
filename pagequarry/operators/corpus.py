"""Corpus coverage, self-check gates, gaps and intervals, sequences and selection, over the case specifications."""

from __future__ import annotations

from ..functions import scalars as S
from ..sources.specs import CORE_NAMES, LINE, NEGATIVE_NAMES

# Required values of each axis.
AXES = {
    "page.size": ("letter", "a4"),
    "page.orientation": ("portrait", "landscape"),
    "page.columns": ("single", "two"),
    "page.pages": ("1", "3", "8"),
    "page.offset": ("zero", "nonzero"),
    "hf.mode": ("none", "header_only", "footer_only", "both"),
    "hf.variable": ("page_number", "subtitle"),
    "hf.mirrored": ("mirrored",),
    "hf.rule_line": ("rule_line",),
    "hf.partial": ("partial_support",),
    "hf.rule": ("none", "header_rule", "footer_rule", "both_rules"),
    "hf.page_number_position": ("none", "bottom_center", "bottom_right", "page_x_of_y"),
    "hf.subtitle_position": ("none", "centered", "top_right"),
    "hf.support": ("all_pages", "first_page_suppressed", "partial_support"),
    "hf.jitter": ("none", "xy_jitter", "rule_y_jitter", "evenodd_jitter"),
    "wm.jitter": ("none", "position_jitter", "rotation_opacity_jitter", "variable_text_jitter", "near_footer"),
    "seq": ("figure_figure", "figure_text1_figure", "figure_text2_figure", "figure_table", "table_figure", "table_table", "table_text1_figure", "table_text2_figure", "figure_text1_table", "figure_text2_table"),
    "interstitial_text.lines": ("none", "one_line", "two_line"),
    "title_gap": ("figure_above_g0", "figure_above_g1", "figure_above_g2", "figure_below_g0", "figure_below_g1", "figure_below_g2", "table_above_g0", "table_above_g1", "table_above_g2", "table_below_g0", "table_below_g1", "table_below_g2"),
    "sequence.with_common_regions": ("no_common", "two_line_header", "footer_bar_two_lines", "jittered_common"),
    "wm.presence": ("none", "fixed", "variable"),
    "wm.location": ("center", "corner"),
    "wm.opacity": ("light", "strong"),
    "wm.rotation": ("rot0", "diagonal"),
    "wm.image": ("image_like",),
    "fig.caption": ("above", "below"),
    "fig.alias": ("Figure", "Fig.", "FIGURE"),
    "fig.index": ("dotted", "integer", "dashed", "alpha"),
    "fig.title": ("one_line", "multiline"),
    "fig.body": ("waveform", "diagram", "raster", "mixed"),
    "fig.width": ("column", "page_wide"),
    "fig.count": ("multiple_per_page",),
    "tbl.span": ("single_page", "continuation"),
    "tbl.parts": ("2", "3", "4"),
    "tbl.suffix": ("(cont)", "(continued)", "continued", "Continued", "cont."),
    "tbl.title": ("same_title", "different_title"),
    "tbl.fragment": ("same_page_fragment",),
    "tbl.width": ("normal", "wide"),
    "tbl.caption": ("above",),
    "neg.kind": ("plain_text", "figure_of_merit", "see_table_above", "figure_ref_only", "table_ref_only", "weak_partial_header"),
}
# Of these one case is enough, of the others it takes two.
ONE_IS_ENOUGH = {
    "tbl.parts": ("4",),
    "tbl.suffix": ("(continued)", "continued", "Continued", "cont."),
    "tbl.fragment": ("same_page_fragment",),
    "neg.kind": ("plain_text", "figure_of_merit", "see_table_above", "figure_ref_only", "table_ref_only", "weak_partial_header"),
    "hf.rule": ("header_rule", "footer_rule", "both_rules"),
    "hf.page_number_position": ("bottom_right", "page_x_of_y"),
    "hf.subtitle_position": ("top_right",),
    "hf.support": ("first_page_suppressed",),
    "hf.jitter": ("xy_jitter", "rule_y_jitter", "evenodd_jitter"),
    "wm.jitter": ("position_jitter", "rotation_opacity_jitter", "variable_text_jitter", "near_footer"),
    "seq": ("figure_figure", "figure_text1_figure", "figure_text2_figure", "figure_table", "table_figure", "table_table", "table_text1_figure", "table_text2_figure", "figure_text1_table", "figure_text2_table"),
    "title_gap": ("figure_above_g0", "figure_above_g1", "figure_above_g2", "figure_below_g0", "figure_below_g2", "table_above_g0", "table_above_g2", "table_below_g0", "table_below_g1", "table_below_g2"),
    "sequence.with_common_regions": ("two_line_header", "footer_bar_two_lines", "jittered_common"),
}
SUFFIXES = S.CONTINUATION
STRONG_OPACITY, PAGE_WIDE, TEXT_PAD = 0.22, 0.85, 3
LEAST_CORE, LEAST_NEGATIVE, LEAST_CASES, MOST_CASES, LEAST_ALPHA = 8, 5, 30, 80, 2


def required() -> list[tuple[str, int]]:
    """Every required tag and how many cases it takes."""
    return [(f"{axis}:{v}", 1 if v in ONE_IS_ENOUGH.get(axis, ()) else 2) for axis, values in AXES.items() for v in values]


def _tags(d) -> str:
    """Case and tag, by one rule after the other."""
    t = d.text
    text = lambda x: f"CAST({x} AS {t})"
    when = lambda axis, *pairs, other=None: f"concat('{axis}:', CASE " + " ".join(f"WHEN {c} THEN {v if v[0] == '(' else repr(v)}" for v, c in pairs) + (f" ELSE '{other}'" if other else "") + " END)"
    of = lambda relation, tag, where="true": (relation, f"CASE WHEN {where} THEN {tag} END")
    wide = f"x1 - x0 >= CAST({PAGE_WIDE} AS DOUBLE) * width"
    turned = "jx <> 0 OR jitter_rot <> 0 OR jitter_opacity > 0"
    rules = [
        of("case_specs", "concat('page.size:', size_)"),
        of("case_specs", "concat('page.orientation:', orientation)"),
        of("case_specs", when("page.columns", ("two", "columns_ = 2"), other="single")),
        of("case_specs", f"concat('page.pages:', {text('page_count')})"),
        of("case_specs", when("page.offset", ("nonzero", "page_offset <> 0"), other="zero")),
        of("hf_cases", when("hf.mode", ("both", "header AND footer"), ("header_only", "header"), ("footer_only", "footer"), other="none")),
        of("hf_cases", "'hf.variable:page_number'", "own_page"),
        of("hf_cases", "'hf.variable:subtitle'", "own_subtitle"),
        of("hf_cases", "'hf.mirrored:mirrored'", "own_mirrored"),
        of("hf_cases", "'hf.rule_line:rule_line'", "own_rule"),
        of("hf_cases", "'hf.partial:partial_support'", "own_partial"),
        of("hf_cases", when("hf.rule", ("both_rules", "header_rule AND footer_rule"), ("header_rule", "header_rule"), ("footer_rule", "footer_rule"), other="none")),
        of("hf_cases", when("hf.support", ("first_page_suppressed", "suppressed"), ("partial_support", "partial"), other="all_pages"), "any_on"),
        of("hf_cases", "'hf.jitter:xy_jitter'", "xy"),
        of("hf_cases", "'hf.jitter:rule_y_jitter'", "rule_jitter"),
        of("hf_cases", "'hf.jitter:evenodd_jitter'", "evenodd"),
        of("hf_cases", "'hf.jitter:none'", "NOT xy AND NOT rule_jitter"),
        of("hf_cases", when("hf.page_number_position", ("page_x_of_y", "of_pages"), ("bottom_center", "any_page"), other="none"), "NOT hinted_number"),
        of("hf_cases", when("hf.subtitle_position", ("centered", "any_subtitle"), other="none"), "NOT hinted_subtitle"),
        of("wm_specs", when("wm.presence", ("none", "NOT enabled"), ("variable", "variable_text"), other="fixed")),
        of("wm_specs", "concat('wm.location:', location_)", "enabled"),
        of("wm_specs", when("wm.opacity", ("strong", f"opacity >= CAST({STRONG_OPACITY} AS DOUBLE)"), other="light"), "enabled"),
        of("wm_specs", when("wm.rotation", ("diagonal", "rotation <> 0"), other="rot0"), "enabled"),
        of("wm_specs", "'wm.image:image_like'", "enabled AND image_like"),
        of("wm_specs", "'wm.jitter:position_jitter'", "enabled AND jx <> 0"),
        of("wm_specs", "'wm.jitter:rotation_opacity_jitter'", "enabled AND (jitter_rot <> 0 OR jitter_opacity > 0)"),
        of("wm_specs", "'wm.jitter:variable_text_jitter'", f"enabled AND variable_text AND ({turned})"),
        of("wm_specs", "'wm.jitter:near_footer'", "enabled AND near_footer"),
        of("wm_specs", "'wm.jitter:none'", f"NOT (enabled AND ({turned} OR near_footer))"),
        of("target_specs", "concat('fig.caption:', position_)", "kind = 'figure'"),
        of("target_specs", "concat('fig.alias:', alias_)", "kind = 'figure'"),
        of("target_specs", f"concat('fig.index:', {S.index_style(d, 'idx')})", "kind = 'figure'"),
        of("target_specs", when("fig.title", ("multiline", "position(chr(10) IN title) > 0"), other="one_line"), "kind = 'figure'"),
        of("target_specs", "concat('fig.body:', body_kind)", "kind = 'figure'"),
        of("target_specs", when("fig.width", ("page_wide", wide), other="column"), "kind = 'figure'"),
        of("case_figures", "'fig.count:multiple_per_page'", "n >= 2"),
        of("target_specs", when("tbl.width", ("wide", wide), other="normal"), "kind = 'table'"),
        of("target_specs", "'tbl.caption:above'", "kind = 'table' AND cap_y0 < body_y0"),
        of("target_specs", "concat('tbl.suffix:', marker)", "kind = 'table' AND is_continuation AND marker IS NOT NULL"),
        of("case_parts", when("tbl.span", ("continuation", "n >= 2 OR continued"), other="single_page")),
        of("case_parts", f"concat('tbl.parts:', {text('least(greatest(n, parts), 4)')})", "n >= 2 OR continued"),
        of("case_titles", "'tbl.title:same_title'", "n >= 2 AND different < n"),
        of("case_titles", "'tbl.title:different_title'", "n >= 2 AND different >= 2"),
        of("case_sequences", "concat('seq:', signature)", "targets >= 2"),
        of("case_sequences", "'interstitial_text.lines:one_line'", "one_line"),
        of("case_sequences", "'interstitial_text.lines:two_line'", "two_line"),
        of("sequence_commons", "'interstitial_text.lines:none'", "NOT one_line AND NOT two_line"),
        of("target_gaps", f"concat('title_gap:', kind, '_', position_, '_g', {text('gap')})"),
        of("sequence_commons", "'sequence.with_common_regions:no_common'", "targets >= 2 AND NOT any_on"),
        of("sequence_commons", "'sequence.with_common_regions:two_line_header'", "targets >= 2 AND two_line_header"),
        of("sequence_commons", "'sequence.with_common_regions:footer_bar_two_lines'", "targets >= 2 AND two_line_footer_bar"),
        of("sequence_commons", "'sequence.with_common_regions:jittered_common'", "targets >= 2 AND (xy OR rule_jitter)"),
        of("case_hints", "hint"),
    ]
    by: dict[str, list[str]] = {}
    for relation, rule in rules:
        by.setdefault(relation, []).append(rule)
    parts = [f"SELECT k, tag FROM ({d.explode(relation, 'k', d.filter(d.array(*own), 'x', 'x IS NOT NULL'), 'tag')}) AS r" for relation, own in by.items()]
    return "SELECT DISTINCT k, tag FROM (" + " UNION ALL ".join(parts) + ") AS r"


def relations(d) -> dict[str, str]:
    t = d.text
    need = ", ".join(f"('{x}', {n})" for x, n in required())
    suffixes = ", ".join(f"('{x}')" for x in SUFFIXES)
    named = ", ".join(f"('{x}', '{a}')" for a, names in (("core", CORE_NAMES), ("negative", NEGATIVE_NAMES)) for x in names)
    on = lambda c: f"coalesce(bool_or(enabled AND ({c})), false)"
    own = lambda c: f"coalesce(bool_or(enabled AND slot <> 'extra' AND ({c})), false)"
    partial = "f.supported < c.page_count"
    signature = d.join(d.map(d.gather(d.struct(pos="pos", item="CASE WHEN kind = 'text' THEN concat('text', CAST(line_count AS " + t + ")) ELSE kind END")), "v", "v.item"), "'_'")
    gap_pt = "CASE WHEN {p} = 'below' THEN cap_y0 - body_y1 ELSE body_y0 - cap_y1 END"
    real_gap = d.half_even(f"greatest(0, {gap_pt.format(p='title_position')}) / {LINE}")
    boxes = [("caption_region", "cap"), ("body_region", "body"), ("context_region", "ctx")]
    spread = " UNION ALL ".join(f"SELECT k, case_id, page, width, height, j, kind, idx, '{r}' AS region, {n} AS region_no, {p}_x0 AS x0, {p}_y0 AS y0, {p}_x1 AS x1, {p}_y1 AS y1 FROM spec_truth" for n, (r, p) in enumerate(boxes))
    stressed = "NOT EXISTS (SELECT 1 FROM case_specs c WHERE c.k = {0}.k AND c.stress)"
    padded = ", ".join(f"{c} {s} {TEXT_PAD} AS {c}" for c, s in (("x0", "-"), ("y0", "-"), ("x1", "+"), ("y1", "+")))
    error = lambda gate, rest: f"SELECT '{gate}' AS gate, {rest}"
    none = "CAST(NULL AS INT) AS page"
    return {
        # What rules read of a case
        "hf_cases": f"""SELECT h.k, {own("slot = 'header'")} AS header, {own("slot = 'footer'")} AS footer, {on('true')} AS any_on, {own("template LIKE '%{page}%'")} AS own_page, {own("template LIKE '%{subtitle}%'")} AS own_subtitle, {own('mirrored')} AS own_mirrored, {own('rule_line')} AS own_rule, {own(partial)} AS own_partial,
          {on("rule_line AND kind = 'header'")} AS header_rule, {on("rule_line AND kind = 'footer'")} AS footer_rule, {on('first_suppressed')} AS suppressed, {on(partial)} AS partial, {on('jx <> 0 OR jy <> 0')} AS xy, {on('rjy <> 0')} AS rule_jitter, {on('mirrored AND (jx <> 0 OR jy <> 0)')} AS evenodd,
          {on("template LIKE '%{pages}%'")} AS of_pages, {on("template LIKE '%{page}%'")} AS any_page, {on("template LIKE '%{subtitle}%'")} AS any_subtitle, {on("slot = 'header' AND position(chr(10) IN template) > 0")} AS two_line_header, {on("slot = 'footer' AND position(chr(10) IN template) > 0 AND rule_line")} AS two_line_footer_bar, coalesce(max(n.number), false) AS hinted_number, coalesce(max(n.subtitle), false) AS hinted_subtitle
          FROM hf_specs h JOIN case_specs c ON h.k = c.k LEFT JOIN (SELECT k AS few_k, slot AS few_slot, supported FROM hf_few) AS f ON f.few_k = h.k AND f.few_slot = h.slot LEFT JOIN hinted n ON h.k = n.k GROUP BY h.k""",
        # how many pages a header or footer names, where it names any
        "hf_few": "SELECT s.k, s.slot, CAST(ceil(c.page_count / 2.0) AS BIGINT) AS supported FROM hf_specs s JOIN case_specs c ON s.k = c.k WHERE s.odd_only",
        "hinted": "SELECT k, bool_or(hint LIKE 'hf.page_number_position:%') AS number, bool_or(hint LIKE 'hf.subtitle_position:%') AS subtitle FROM case_hints GROUP BY k",
        "sequence_commons": "SELECT f.*, coalesce(s.targets, 0) AS targets, coalesce(s.one_line, false) AS one_line, coalesce(s.two_line, false) AS two_line FROM hf_cases f LEFT JOIN case_sequences s ON f.k = s.k",
        "case_figures": "SELECT k, page, count(*) AS n FROM target_specs WHERE kind = 'figure' GROUP BY k, page",
        "case_parts": "SELECT k, group_id, count(*) AS n, max(part_index) AS parts, bool_or(is_continuation) AS continued FROM target_specs WHERE kind = 'table' GROUP BY k, group_id",
        "case_titles": "SELECT k, count(*) AS n, count(DISTINCT title) AS different FROM target_specs WHERE kind = 'table' GROUP BY k",
        "case_sequences": f"SELECT s.k, {signature} AS signature, count(*) FILTER (WHERE kind <> 'text') + coalesce(max(p.n), 0) AS targets, bool_or(kind = 'text' AND line_count = 1) AS one_line, bool_or(kind = 'text' AND line_count = 2) AS two_line FROM layout_sequence s LEFT JOIN (SELECT k, count(*) AS n FROM part_specs GROUP BY k) AS p ON s.k = p.k GROUP BY s.k",
        "target_gaps": f"SELECT k, kind, position_, {d.half_even(f'greatest(0, {gap_pt.format(p="position_")}) / {LINE}')} AS gap FROM target_specs",
        "tags": _tags(d),
        "tag_counts": "SELECT tag, count(*) AS n FROM tags GROUP BY tag",
        "requirements": f"SELECT * FROM (VALUES {need}) AS v(tag, need)",
        "coverage": "SELECT r.tag, r.need, coalesce(c.n, 0) AS n, CASE WHEN coalesce(c.n, 0) = 0 THEN 'missing' WHEN c.n < r.need THEN 'below_min' ELSE 'ok' END AS status FROM requirements r LEFT JOIN tag_counts c ON r.tag = c.tag",
        "suffix_list": f"SELECT * FROM (VALUES {suffixes}) AS v(suffix)",
        "named_cases": f"SELECT * FROM (VALUES {named}) AS v(name, axis)",
        # self-check: boxes of targets and of what repeats on pages
        "target_boxes": spread,
        "common_boxes": "SELECT k, case_id, page_no AS page, width, height, kind, text, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM hf_pages UNION ALL SELECT k, case_id, page_no, width, height, 'watermark', text, x0, y0, x1, y1 FROM wm_pages",
        # Other text on a target, targets on one another; cases of stress are exempt
        "contaminations": f"SELECT b.k, b.case_id, b.page, b.pos, b.role, g.kind, g.idx, g.region FROM plain_specs b JOIN target_boxes g ON b.k = g.k AND b.page = g.page WHERE {S.iou('b.', 'g.')} > 0 AND {stressed.format('b')}",
        "target_overlaps": f"SELECT a.k, a.case_id, a.page, a.idx AS a_idx, a.region AS a_region, b.idx AS b_idx, b.region AS b_region FROM target_boxes a JOIN target_boxes b ON a.k = b.k AND a.page = b.page AND (a.j < b.j OR a.j = b.j AND a.region_no < b.region_no) WHERE a.region_no < 2 AND b.region_no < 2 AND {S.iou('a.', 'b.')} > 0 AND {stressed.format('a')}",
        # Recorded sequence against real tops; of equal targets the last page counts
        "target_tops": "SELECT k, kind, idx, top FROM (SELECT *, least(cap_y0, body_y0) AS top, row_number() OVER (PARTITION BY k, kind, idx ORDER BY page DESC, j DESC) AS nth FROM spec_truth) AS x WHERE nth = 1",
        "sequence_tops": "SELECT s.k, s.case_id, s.pos, s.kind, s.idx, t.top, lag(t.top) OVER (PARTITION BY s.k ORDER BY s.pos) AS before FROM layout_sequence s JOIN target_tops t ON s.k = t.k AND s.kind = t.kind AND s.idx = t.idx",
        "title_checks": f"SELECT *, title_position = 'above' AND NOT cap_y0 <= body_y0 OR title_position = 'below' AND NOT cap_y0 >= body_y0 AS bad_position, gap_lines <> {real_gap} AS bad_gap FROM spec_truth",
        "interstitial_checks": f"SELECT k, case_id, page, pos, abs(y1 - y0 - line_count * {LINE}) > 2 AS bad FROM plain_specs WHERE role = 'interstitial_text' AND line_count > 0",
        # Every failed gate as a row
        "self_check_errors": " UNION ALL ".join(
            (
                error("bbox", f"case_id, page, concat(kind, '.', region) AS detail FROM target_boxes WHERE NOT (0 <= x0 AND x0 < x1 AND x1 <= width AND 0 <= y0 AND y0 < y1 AND y1 <= height)"),
                error("bbox", "case_id, page, kind AS detail FROM common_boxes WHERE NOT (0 <= x0 AND x0 < x1 AND x1 <= width AND 0 <= y0 AND y0 < y1 AND y1 <= height)"),
                error("header_in_upper_half", "case_id, page, kind AS detail FROM common_boxes WHERE kind = 'header' AND y0 >= height / 2"),
                error("core_count", f"'' AS case_id, {none}, '' AS detail FROM (SELECT count(*) AS n FROM case_specs WHERE axis = 'core') AS x WHERE n < {LEAST_CORE}"),
                error("negative_count", f"'' AS case_id, {none}, '' AS detail FROM (SELECT count(*) AS n FROM case_specs WHERE axis = 'negative') AS x WHERE n < {LEAST_NEGATIVE}"),
                error("named_case", f"'' AS case_id, {none}, name AS detail FROM named_cases n WHERE NOT EXISTS (SELECT 1 FROM case_specs c WHERE c.case_id = n.name)"),
                error("case_count", f"'' AS case_id, {none}, '' AS detail FROM (SELECT count(*) AS n FROM case_specs) AS x WHERE NOT n BETWEEN {LEAST_CASES} AND {MOST_CASES}"),
                error("coverage", f"'' AS case_id, {none}, tag AS detail FROM coverage WHERE n < need"),
                error("diagonal_watermark", f"'' AS case_id, {none}, '' AS detail FROM (SELECT count(*) AS n FROM wm_pages WHERE rotation <> 0) AS x WHERE n = 0"),
                error("alpha_index", f"'' AS case_id, {none}, '' AS detail FROM (SELECT count(DISTINCT k) AS n FROM spec_truth WHERE {d.matches('idx', '[A-Za-z]')}) AS x WHERE n < {LEAST_ALPHA}"),
                error("suffix", f"'' AS case_id, {none}, suffix AS detail FROM suffix_list s WHERE NOT EXISTS (SELECT 1 FROM spec_truth p WHERE p.is_continuation AND p.marker = s.suffix)"),
                error("contamination", "case_id, page, concat(kind, ' ', idx, ' ', region) AS detail FROM contaminations"),
                error("title_position", "case_id, page, idx AS detail FROM title_checks WHERE bad_position"),
                error("title_gap", "case_id, page, idx AS detail FROM title_checks WHERE bad_gap"),
                error("target_overlap", "case_id, page, concat(a_idx, ' ', a_region, ' ', b_idx, ' ', b_region) AS detail FROM target_overlaps"),
                error("interstitial_lines", f"case_id, page, CAST(pos AS {t}) AS detail FROM interstitial_checks WHERE bad"),
                error("sequence_order", f"case_id, {none}, '' AS detail FROM (SELECT k, case_id, bool_or(coalesce(top < before, false)) AS bad FROM sequence_tops GROUP BY k, case_id) AS x WHERE bad"),
                error("text_overlap", f"CAST(doc_id AS {t}) AS case_id, page, concat(kind, ' ', key_text) AS detail FROM text_overlap WHERE status IN ('none', 'mismatch')"),
            )
        ),
        # Occupied intervals, and the free bands between
        "occupied": "SELECT doc_id, page, line_seq, y0, y1 FROM lines",
        "interval_edges": "SELECT *, CASE WHEN y0 > max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, y1, line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM occupied",
        "interval_runs": "SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY y0, y1, line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM interval_edges",
        "intervals": "SELECT doc_id, page, run, min(y0) AS y0, max(y1) AS y1 FROM interval_runs GROUP BY doc_id, page, run",
        # Bands of the body zone that nothing occupies, those at its ends included
        "free_bands": """SELECT i.doc_id, i.page, greatest(CAST(86 AS DOUBLE), coalesce(lag(i.y1) OVER w, 86)) AS y0, least(i.y0, p.height - 86) AS y1, coalesce(lag(i.y1) OVER w, 86) < p.height - 86 AND i.y0 <= p.height - 86 AS open_ FROM intervals i JOIN layout_pages p ON i.doc_id = p.doc_id AND i.page = p.page WINDOW w AS (PARTITION BY i.doc_id, i.page ORDER BY i.y0)
          UNION ALL SELECT p.doc_id, p.page, greatest(CAST(86 AS DOUBLE), coalesce(max(i.y1) FILTER (WHERE i.y0 <= p.height - 86), 86)), p.height - 86, true FROM layout_pages p LEFT JOIN intervals i ON i.doc_id = p.doc_id AND i.page = p.page GROUP BY p.doc_id, p.page, p.height""",
        # Text in the padded region of a caption or common region, in line order; rotated watermarks are skipped
        "text_regions": f"""SELECT doc_id, page, kind, CAST(anchor_id AS {t}) AS id, idx AS key_text, {padded.replace('x0 -', 'cap_x0 -').replace('y0 -', 'cap_y0 -').replace('x1 +', 'cap_x1 +').replace('y1 +', 'cap_y1 +')}, false AS rotated FROM objects
          UNION ALL SELECT doc_id, page, kind, concat(region_id, '@', CAST(pos AS {t})), text, {padded}, kind = 'watermark' AND text LIKE 'Licensed%' FROM commons""",
        "text_found": f"""SELECT g.doc_id, g.page, g.kind, g.id, g.key_text, g.rotated, {d.join(d.map(d.filter(d.gather(d.struct(line_seq='l.line_seq', text='l.text')), 'u', 'u.line_seq IS NOT NULL'), 'v', 'v.text'), "''")} AS joined, count(l.line_seq) AS n FROM text_regions g
          LEFT JOIN lines l ON g.doc_id = l.doc_id AND g.page = l.page AND ({S.iou('g.', 'l.')} > 0 OR {S.center_in('l.', 'g.')} OR {S.center_in('g.', 'l.')}) AND least(g.y1, l.y1) - greatest(g.y0, l.y0) > 0 GROUP BY g.doc_id, g.page, g.kind, g.id, g.key_text, g.rotated""",
        "text_overlap": f"SELECT doc_id, page, kind, id, key_text, CASE WHEN rotated THEN 'skipped' WHEN n = 0 THEN 'none' WHEN {S.letters_key(d, 'key_text')} <> '' AND position({S.letters_key(d, 'key_text')} IN {S.letters_key(d, 'joined')}) > 0 THEN 'ok' ELSE 'mismatch' END AS status FROM text_found",
        # SRC9: rows of a review table
        "decision_rows": f"SELECT c_custkey AS place, concat('| `case_', CAST(c_custkey AS {t}), '` | ![](p.png) | axis=x | 4 | ', CASE WHEN c_custkey % 3 = 0 THEN 'drop' WHEN c_custkey % 5 = 0 THEN '' ELSE ' Keep ' END, ' | note |') AS row_text FROM customer UNION ALL SELECT -1, '| case_id | thumbnail | axis tags | realism 1-5 | keep/drop | critique |' UNION ALL SELECT -2, '|---|---|---|---|---|---|' UNION ALL SELECT -3, '| short | row |'",
        "decision_cells": f"SELECT place, {d.split(d.replace('trim(row_text)', '^[|]|[|]$', ''), '[|]')} AS cells FROM decision_rows WHERE trim(row_text) LIKE '|%'",
        "decisions": f"SELECT place, {d.replace(f'trim({_cell(d, 1)})', '^`|`$', '')} AS case_id, trim({_cell(d, 5)}) AS decision FROM decision_cells WHERE {_size(d, 'cells')} >= 5 AND lower(trim({_cell(d, 1)})) <> 'case_id' AND NOT {d.matches(f'trim({_cell(d, 1)})', '^[-:]*$')}",
        "keep_list": "SELECT * FROM (VALUES ('case_1'), ('case_17'), ('case_33'), ('case_0'), ('nobody')) AS v(case_id)",
    }


def _cell(d, n: int) -> str:
    return f"get(cells, {n - 1})" if d.name == "spark" else f"cells[{n}]"


def _size(d, items: str) -> str:
    return f"size({items})" if d.name == "spark" else f"len({items})"


def queries(d) -> dict[str, str]:
    t = d.text
    gates = lambda gate, bad, checked: f"SELECT '{gate}' AS gate, CAST(({bad}) AS BIGINT) AS failures, CAST(({checked}) AS BIGINT) AS checked"
    return {
        "a11_derive_tags": "SELECT c.case_id, g.tag FROM tags g JOIN case_specs c ON g.k = c.k",
        "a9_count_tags": "SELECT * FROM tag_counts",
        "a10_coverage_summary": "SELECT * FROM coverage",
        "a12_corpus_gates": f"""SELECT (SELECT count(*) FROM case_specs) AS total_cases, (SELECT count(*) FROM case_specs WHERE axis = 'core') AS core_cases, (SELECT count(*) FROM case_specs WHERE axis = 'negative') AS negative_cases, (SELECT count(*) FROM named_cases n WHERE NOT EXISTS (SELECT 1 FROM case_specs c WHERE c.case_id = n.name)) AS names_missing,
          (SELECT count(*) FROM wm_pages WHERE rotation <> 0) AS diagonal_watermarks, (SELECT count(DISTINCT k) FROM spec_truth WHERE {d.matches('idx', '[A-Za-z]')}) AS alpha_cases, (SELECT count(*) FROM suffix_list s WHERE NOT EXISTS (SELECT 1 FROM spec_truth p WHERE p.is_continuation AND p.marker = s.suffix)) AS suffixes_missing, (SELECT count(*) FROM coverage WHERE n < need) AS tags_short""",
        "a13_consistency_counters": " UNION ALL ".join(
            (
                gates("generic_text_target_overlaps", "SELECT count(*) FROM contaminations", "SELECT count(*) FROM plain_specs"),
                gates("target_target_unintended_overlaps", "SELECT count(*) FROM target_overlaps", "SELECT count(*) FROM spec_truth"),
                gates("sequence_order_failures", "SELECT count(*) FROM (SELECT k FROM sequence_tops WHERE top < before GROUP BY k) AS x", "SELECT count(DISTINCT k) FROM layout_sequence"),
                gates("interstitial_line_count_failures", "SELECT count(*) FROM interstitial_checks WHERE bad", "SELECT count(*) FROM interstitial_checks"),
                gates("title_position_failures", "SELECT count(*) FROM title_checks WHERE bad_position", "SELECT count(*) FROM title_checks"),
                gates("title_gap_failures", "SELECT count(*) FROM title_checks WHERE bad_gap", "SELECT count(*) FROM title_checks"),
            )
        ),
        "a14_text_overlap_report": "SELECT count(*) FILTER (WHERE status <> 'skipped') AS checked, count(*) FILTER (WHERE status = 'ok') AS passed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'none') AS without_text, count(*) FILTER (WHERE status = 'mismatch') AS other_text FROM text_overlap",
        "a14_text_overlap_failures": "SELECT doc_id, page, kind, id, key_text, status FROM text_overlap WHERE status IN ('none', 'mismatch')",
        "a15_distinct_sets": f"SELECT doc_id, {d.strings('text')} AS watermark_texts FROM commons WHERE kind = 'watermark' GROUP BY doc_id",
        "a16_multi_figure": "SELECT k, bool_or(n >= 2) AS multi FROM case_figures GROUP BY k",
        "a17_stage_conjunction": "SELECT case_id, bool_and(ok) AS all_ok FROM (SELECT c.case_id, NOT EXISTS (SELECT 1 FROM title_checks x WHERE x.k = c.k AND (x.bad_position OR x.bad_gap)) AS ok FROM case_specs c UNION ALL SELECT c.case_id, NOT EXISTS (SELECT 1 FROM sequence_tops s WHERE s.k = c.k AND s.top < s.before) FROM case_specs c UNION ALL SELECT c.case_id, NOT EXISTS (SELECT 1 FROM contaminations n WHERE n.k = c.k) FROM case_specs c) AS s GROUP BY case_id",
        "a1_union_extent": "SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM drawings GROUP BY doc_id, page",
        "c10_self_check": "SELECT gate, case_id, page, detail FROM self_check_errors",
        "j11_text_match": "SELECT * FROM text_overlap",
        "j12_contamination": "SELECT * FROM contaminations",
        "j13_target_overlap": "SELECT * FROM target_overlaps",
        "j14_sequence_tops": "SELECT k, case_id, bool_and(coalesce(top >= before, true)) AS sorted FROM sequence_tops GROUP BY k, case_id",
        "w9_sequence_order": "SELECT k, pos, kind, idx, top, coalesce(top >= before, true) AS in_order FROM sequence_tops",
        "j17_between": f"""SELECT k, pos, before, after FROM (SELECT k, pos, kind, {d.known('last_value', 'label')} OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, {d.known('first_value', 'label')} OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
          FROM (SELECT *, CASE WHEN kind <> 'text' THEN concat(kind, ':', idx) END AS label FROM layout_sequence) AS x) AS y WHERE kind = 'text'""",
        "w5_merge_intervals": "SELECT doc_id, page, y0, y1 FROM intervals",
        "j18_free_bands": "SELECT doc_id, page, y0, y1 FROM free_bands WHERE open_ AND y1 - y0 >= 24",
        "it5_running_cursor": "SELECT k, j, kind, CAST(y AS BIGINT) AS y, item_h FROM item_specs",
        "src9_decision_table": "SELECT place, case_id, decision FROM decisions",
        "f5_select_cases": "SELECT place, case_id FROM decisions WHERE lower(decision) = 'keep'",
        "f5_keep_override": "SELECT k.case_id, c.case_id IS NOT NULL AS known FROM keep_list k LEFT JOIN decisions c ON k.case_id = c.case_id",
        "p9_truth_context": "SELECT case_id, page, kind, idx, title_position, gap_lines, ctx_x0, ctx_y0, ctx_x1, ctx_y1 FROM spec_truth",
        "p21_render_template": "SELECT case_id, slot, page_no, text FROM hf_pages UNION ALL SELECT case_id, 'watermark', page_no, text FROM wm_pages",
        "p22_page_jitter": "SELECT case_id, slot, page_no, x0, y0, x1, y1 FROM hf_pages",
        "p23_page_dimensions": "SELECT case_id, size_, orientation, width, height FROM case_specs",
        "x2_header_footer_pages": "SELECT case_id, slot, kind, page_no, text, variable_text, rule_y FROM hf_pages",
        "x3_watermark_pages": "SELECT case_id, page_no, text, rotation, opacity, style, x0, y0, x1, y1 FROM wm_pages",
        "x5_continuation_parts": "SELECT case_id, idx, part FROM part_specs",
        "x6_list_scenarios": "SELECT case_id, axis, size_, orientation, columns_, page_count, page_offset FROM case_specs",
        "x7_case_boxes": "SELECT gate, case_id, page, detail FROM self_check_errors WHERE gate IN ('bbox', 'header_in_upper_half')",
        "x8_spans": "SELECT doc_id, page, line_seq, trim(text) AS text, x0, y0, x1, y1 FROM lines WHERE trim(text) <> ''",
        "x1_clip_lines": f"SELECT c.doc_id, c.page, c.pos, count(*) AS n, greatest(0, min(l.x0) - 3) AS x0, min(l.y0) AS y0, least(max(p.width), max(l.x1) + 3) AS x1, min(l.y0) + 35 + 6 * (count(*) - 1) AS y1 FROM commons c JOIN layout_pages p ON p.doc_id = c.doc_id AND p.page = c.page JOIN lines l ON c.doc_id = l.doc_id AND c.page = l.page AND {S.y_meets('l.', 'c.', 2)} AND {S.x_meets('l.', 'c.', 2)} WHERE c.kind = 'footer' GROUP BY c.doc_id, c.page, c.pos",
        "x1_watermark_bands": f"SELECT doc_id, page, pos, greatest(0, x0 - 18) AS x0, greatest(0, y0 - 18) AS y0, least(width, x1 + 18) AS x1, least(height, y1 + 18) AS y1 FROM (SELECT c.doc_id, c.page, c.pos, l.x0, l.y0, l.x1, l.y1, p.width, p.height, row_number() OVER (PARTITION BY c.doc_id, c.page, c.pos ORDER BY l.line_seq) AS nth FROM commons c JOIN layout_pages p ON p.doc_id = c.doc_id AND p.page = c.page JOIN lines l ON c.doc_id = l.doc_id AND c.page = l.page AND {S.y_meets('l.', 'c.', 2)} AND {S.x_meets('l.', 'c.', 2)} AND {S.is_watermark(d, 'l.text')} WHERE c.kind = 'watermark') AS x WHERE nth = 1",
    } | ({} if t else {})
