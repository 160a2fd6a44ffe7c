"""Scenario files compiled into case specifications: defaults filled in, lists exploded, boxes placed, body text flowed around them.

A scenario is valid if the contract's checks (validate) find nothing; only valid ones become
cases. The compiled relations take the place of those that `sources.specs` derives from the
driver's tables, so tags, coverage, truth and gates run on given scenarios unchanged.
"""

from __future__ import annotations

from ..functions import scalars as S
from ..sources.specs import CONTEXT_MARGIN, FOOTER_TEMPLATES, HEADER_TEMPLATES, LINE, WATERMARK_TEMPLATES, quoted
from .validate import TEMPLATES, Value, _field

# Fixed values of the contracts.
SIDE_MARGIN, COLUMN_GAP, BODY_MARGIN, LEAST_BAND = 54, 22, 86, 34
OPACITY = 0.15
_TEXTS = {"header": HEADER_TEMPLATES, "footer": FOOTER_TEMPLATES, "watermark": WATERMARK_TEMPLATES}
_CORNERS = ("x0", "y0", "x1", "y1")


def _files(d) -> str:
    """Scenario texts derived from events: every optional part present, absent, null or off somewhere, coordinates with decimals, some faults."""
    t = d.text
    text = lambda x: f"CAST({x} AS {t})"
    pick = lambda number, *values: f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {v if v.startswith('concat') else repr(v)}" for i, v in enumerate(values)) + " END"
    k = "event_id"
    size, turned, columns = pick(k, '"size":"a4",', '"size":"letter",', ""), pick(f"({k} + 1)", '"orientation":"portrait",', "", '"orientation":"landscape",', "", ""), pick(k, "", '"columns":2,', '"columns":1,')
    page = f"CASE WHEN {k} % 11 = 0 THEN '' WHEN {k} % 11 = 1 THEN ',\"page\":null' ELSE concat(',\"page\":{{', {size}, {turned}, {columns}, '\"page_offset\":', {text(f'{k} % 2 * 10')}, ',\"page_count\":', {text(f'{k} % 4 + 1')}, '}}') END"
    header = pick(k, "", ',"header":{"enabled":true,"text_template":"chapter_page","bbox":[60,30,400.125,54],"rule_line":true}', ',"header":{"enabled":1,"text_template":"two_line","bbox":[60.005,20,400,60.5],"mirrored_even_odd":1,"variable_text":true,"support_pages":[1,3]}', ',"header":{"enabled":false,"text_template":"none"}', ',"header":{"enabled":true,"text_template":"subtitle_page","bbox":[60,30,300,54],"support_pages":null}')
    footer = pick(f"({k} + 2)", "", ',"footer":{"enabled":true,"text_template":"page_x_of_y","bbox":[60,540,300,560],"support_pages":[]}', ',"footer":null', ',"footer":{}', ',"footer":{"enabled":"yes","text_template":"bar_two_line","bbox":[60,540.335,300,570],"rule_line":true}', ',"footer":{"enabled":true,"text_template":"nowhere","bbox":[1,2,3,4]}')
    mark = pick(f"({k} + 3)", "", ',"watermark":{"enabled":true,"text_template":"draft","bbox":[150,250,450,320]}', ',"watermark":{"enabled":true,"text_template":"licensed","bbox":[150,250,450,320],"variable_text":1,"rotation_deg":45}', ',"watermark":{"enabled":true,"text_template":"confidential","bbox":[150.5,250,450,320],"opacity":0.3,"location":"corner"}', ',"watermark":{"enabled":true,"text_template":"draft","bbox":[150,250,450,320],"image_like":true,"opacity":0.22}', ',"watermark":{"enabled":0}', ',"watermark":null')

    def figure(n: int) -> str:
        y, gap = 90 + 150 * (n - 1), f"12 * (({k} + {n}) % 3)"
        body_below, cap_below = f"'[72,{y},', {text(f'300 + ({k} + {n}) % 3 * 120')}, ',{y + 80}]'", f"'[72.005,', {text(f'{y + 80} + {gap}')}, '.335,540,', {text(f'{y + 98} + {gap}')}, '.335]'"
        cap_above, body_above = f"'[72,{y},540,{y + 18}]'", f"'[72,', {text(f'{y + 18} + {gap}')}, ',300,', {text(f'{y + 78} + {gap}')}, ']'"
        index = pick(f"({k} + {n})", f"{n}", f"1.{n}", f"2-{n}", f"A.{n}")
        title = pick(f"({k} + {n})", ',"title":"One line"', "", "concat(',\"title\":\"Two', chr(92), 'nlines\"')")
        return f"concat('{{\"index\":\"', {index}, '\"', {title}, {pick(f'({k} + {n})', '', ',"alias":"Fig."', ',"alias":"FIGURE"', ',"alias":"Figure"')}, {pick(f'({k} * {n})', '', ',"body_template":"mixed"', ',"body_template":"raster"')}, CASE WHEN ({k} + {n}) % 2 = 0 THEN concat({pick(k, '', ',"caption_position":"below"')}, ',\"body_region\":', {body_below}, ',\"caption_region\":', {cap_below}) ELSE concat(',\"caption_position\":\"above\",\"caption_region\":', {cap_above}, ',\"body_region\":', {body_above}) END, '}}')"

    def table(n: int) -> str:
        y = 540 + 100 * (n - 1)
        gap = f"12 * (({k} + {n}) % 2)"
        parts = pick(f"({k} + {n})", "", f',"part_index":{n},"is_continuation":{"true" if n > 1 else "false"},"continuation_marker":{"null" if n == 1 else chr(34) + "(cont)" + chr(34)}', f',"rows":12,"cols":3,"page":1,"continued_from":"tbl_009"')
        return f"concat('{{\"index\":\"9.{n}\",\"table_group_id\":\"tbl_009\"', {parts}, ',\"title\":\"T', {text(f'{k} % 2 * {n}')}, '\",\"caption_region\":[72,{y},540,{y + 18}],\"body_region\":[72,', {text(f'{y + 18} + {gap}')}, ',', {text(f'300 + {k} % 2 * 250')}, ',', {text(f'{y + 78} + {gap}')}, ']}}')"

    def listed(name: str, item, counts: str, most: int) -> str:
        return f"CASE {counts} WHEN 0 THEN '' " + " ".join(f"WHEN {n} THEN concat(',\"{name}\":[', {', chr(44), '.join(item(i) for i in range(1, n + 1))}, ']')" for n in range(1, most + 1)) + " END"

    figures, tables = listed("figures", figure, f"{k} % 4", 3), listed("tables", table, f"({k} + 1) % 3", 2)
    negative = pick(k, "", ',"negative_texts":[{"text":"see Table 1 above","bbox":[72,400.125,300,415],"page":1}]', "", ',"negative_texts":null')
    hints = pick(f"({k} + 1)", "", "", ',"coverage_hints":["neg.kind:plain_text"]', "", ',"coverage_hints":["hf.page_number_position:bottom_right","hf.subtitle_position:top_right"]')
    axes = pick(k, ',"axes":{"core":"x"}', "", ',"axes":{"negative":"y","z":1}')
    return f"SELECT event_id AS doc, concat('{{\"case_id\":\"case_', {text(k)}, '\"', {axes}, {page}, {header}, {footer}, {mark}, {figures}, {tables}, {negative}, {hints}, '}}') AS body FROM events"


def relations(d) -> dict[str, str]:
    t = d.text
    h = _field(d)
    v = lambda path="": Value(d, path)
    number = lambda column, path, other: f"coalesce({d.number_at(column, path)}, {other})"
    on = lambda path: f"NOT {h(path).falsy}"
    name_of = lambda kind: "CASE " + d.text_at(kind, "text_template") + " " + " ".join(f"WHEN '{n}' THEN {quoted(x)}" for n, x in zip(TEMPLATES[kind], _TEXTS[kind], strict=True)) + " END"
    box = lambda column, path: ", ".join(f"{d.number_at(column, f'{path}[{i}]')} AS {c}" for i, c in enumerate(_CORNERS))
    pair = ", ".join(f"{d.number_at('v', f'{name}_region[{i}]')} AS {p}_{c}" for name, p in (("caption", "cap"), ("body", "body")) for i, c in enumerate(_CORNERS))
    band = lambda kind: f"SELECT h.doc AS k, '{kind}' AS slot, '{kind}' AS kind, {on(kind)} AND {on(f'{kind}.enabled')} AS enabled, {name_of(kind)} AS template, {on(f'{kind}.variable_text')} AS variable_text, {on(f'{kind}.mirrored_even_odd')} AS mirrored, {on(f'{kind}.rule_line')} AS rule_line, {h(f'{kind}.support_pages').has('array')} AS listed, {box(kind, 'bbox')} FROM sx_heads h"
    item = lambda kind, j, alias, body, position, rest: f"SELECT doc AS k, w AS width, h AS height, '{kind}' AS kind, {j} AS j, CAST({number('v', 'page', 1)} AS INT) AS page, {d.text_at('v', 'index')} AS idx, coalesce({d.text_at('v', 'title')}, '') AS title, {alias} AS alias_, {body} AS body_kind, {position} AS position_, {rest}, {pair} FROM sx_{kind}s"
    below = "position_ = 'below'"
    gap = d.half_even(f"greatest(0, CASE WHEN {below} THEN cap_y0 - body_y1 ELSE body_y0 - cap_y1 END) / {LINE}")
    m = CONTEXT_MARGIN
    context = (("x0", f"greatest(0, least(cap_x0, body_x0) - {m})"), ("y0", f"greatest(0, least(cap_y0, body_y0) - {m})"), ("x1", f"least(width, greatest(cap_x1, body_x1) + {m})"), ("y1", f"least(height, greatest(cap_y1, body_y1) + {m})"))
    rounded = ", ".join(f"{d.hundredths(f'{p}_{c}')} AS {p}_{c}" for p in ("cap", "body", "ctx") for c in _CORNERS)
    none = f"CAST(NULL AS {t})"
    valid = lambda relation: f"SELECT r.* FROM {relation} r JOIN sx_valid a ON r.doc = a.doc"
    column_width = f"(width - {2 * SIDE_MARGIN} - (columns_ - 1) * {COLUMN_GAP}) / CAST(columns_ AS DOUBLE)"
    return {
        "scenario_texts": _files(d),
        "sx_valid": "SELECT doc FROM v6 WHERE code = 'ok'",
        "sx_heads": valid("sc_heads"),
        "sx_roots": valid("sc_roots"),
        "sx_figures": valid("sc_figures"),
        "sx_tables": valid("sc_tables"),
        "sx_negatives": valid("sc_negative_texts"),
        # A case of each valid scenario, with what it leaves out filled in
        "case_specs": f"""SELECT h.doc AS k, {d.text_at('h.case_id', '')} AS case_id, CASE WHEN {Value(d, 'axes.core', 'r.v').lacks('absent')} THEN 'core' WHEN {Value(d, 'axes.negative', 'r.v').lacks('absent')} THEN 'negative' ELSE 'custom' END AS axis, coalesce({d.text_at('h.page', 'size')}, 'letter') AS size_, coalesce({d.text_at('h.page', 'orientation')}, 'portrait') AS orientation,
          CAST({number('h.page', 'columns', 1)} AS INT) AS columns_, CAST(h.pages AS INT) AS page_count, CAST({number('h.page', 'page_offset', 0)} AS INT) AS page_offset, false AS stress, CAST(h.w AS DOUBLE) AS width, CAST(h.h AS DOUBLE) AS height FROM sx_heads h JOIN sx_roots r ON h.doc = r.doc""",
        "sx_roots_axes": f"""SELECT doc AS k, coalesce({d.object_text('v', 'axes')}, '{{"scenario":"custom"}}') AS axes, {v('realistic').has('absent')} OR NOT {v('realistic').falsy} AS realistic, coalesce({d.text_at('v', 'notes')}, concat('Custom scenario ', {d.text_at('v', 'case_id')}, '.')) AS notes FROM sx_roots""",
        "case_hints": f"SELECT doc AS k, {d.text_at('v', '')} AS hint FROM ({d.items('sx_roots', 'r.doc', 'coverage_hints')}) AS x",
        "hf_support": f"SELECT s.doc AS k, s.kind AS slot, CAST({d.number_at('s.v', '')} AS INT) AS page_no FROM sc_supports s JOIN sx_valid a ON s.doc = a.doc",
        "hf_bands": " UNION ALL ".join(band(kind) for kind in ("header", "footer")),
        "hf_specs": "SELECT k, slot, kind, enabled, coalesce(template, '') AS template, enabled AND variable_text AS variable_text, enabled AND mirrored AS mirrored, enabled AND rule_line AS rule_line, false AS first_suppressed, false AS odd_only, 0 AS jx, 0 AS jy, 0 AS rjy, x0, y0, x1, y1 FROM hf_bands",
        "hf_few": "SELECT b.k, b.slot, coalesce(n.n, 0) AS supported FROM hf_bands b LEFT JOIN (SELECT k, slot, count(*) AS n FROM hf_support GROUP BY k, slot) AS n ON n.k = b.k AND n.slot = b.slot WHERE b.listed",
        "hf_shown": """SELECT s.*, c.case_id, c.page_count, c.page_offset, c.width, c.height, p.page_no FROM hf_specs s JOIN case_specs c ON s.k = c.k JOIN case_pages_of p ON p.k = s.k LEFT JOIN hf_few f ON f.k = s.k AND f.slot = s.slot
          LEFT JOIN (SELECT DISTINCT k, slot, page_no FROM hf_support) AS u ON u.k = s.k AND u.slot = s.slot AND u.page_no = p.page_no WHERE s.enabled AND (f.supported IS NULL OR u.k IS NOT NULL)""",
        "wm_specs": f"""SELECT doc AS k, {on('watermark')} AND {on('watermark.enabled')} AS enabled, coalesce({name_of('watermark')}, '') AS template, {on('watermark.variable_text')} AS variable_text, {number('watermark', 'rotation_deg', 0)} AS rotation, {number('watermark', 'opacity', f'CAST({OPACITY} AS DOUBLE)')} AS opacity, coalesce({d.text_at('watermark', 'location')}, 'center') AS location_, {on('watermark.image_like')} AS image_like,
          0 AS jx, 0 AS jitter_rot, CAST(0 AS DOUBLE) AS jitter_opacity, false AS near_footer, {box('watermark', 'bbox')} FROM sx_heads""",
        "sx_targets": item("figure", "i + 1", f"coalesce({d.text_at('v', 'alias')}, 'Figure')", f"coalesce({d.text_at('v', 'body_template')}, 'waveform')", f"coalesce({d.text_at('v', 'caption_position')}, 'below')", f"{none} AS group_id, 1 AS part_index, false AS is_continuation, {none} AS marker, {none} AS continued_from, 0 AS rows_, 0 AS cols_")
        + " UNION ALL "
        + item("table", "i + 100001", "'Table'", "'grid'", "'above'", f"{d.text_at('v', 'table_group_id')} AS group_id, CAST({number('v', 'part_index', 1)} AS INT) AS part_index, NOT {v('is_continuation').falsy} AS is_continuation, {d.text_at('v', 'continuation_marker')} AS marker, {d.text_at('v', 'continued_from')} AS continued_from, CAST({number('v', 'rows', 8)} AS INT) AS rows_, CAST({number('v', 'cols', 4)} AS INT) AS cols_"),
        "target_specs": "SELECT g.k, c.case_id, c.width, c.height, g.kind, g.j, g.page, g.idx, g.title, g.alias_, g.body_kind, g.position_, g.group_id, g.part_index, g.is_continuation, g.marker, g.continued_from, g.body_x0 AS x0, g.body_x1 AS x1, g.cap_y0, g.cap_y1, g.body_y0, g.body_y1 FROM sx_targets g JOIN case_specs c ON g.k = c.k",
        # Truth as written, boxes at two decimals; gaps and contexts come from the boxes as given
        "sx_contexts": f"SELECT g.*, c.case_id, {', '.join(f'{e} AS ctx_{c}' for c, e in context)} FROM (SELECT g.*, {gap} AS gap_lines FROM sx_targets g) AS g JOIN case_specs c ON g.k = c.k".replace("width,", "g.width,").replace("height,", "g.height,"),
        "spec_truth": f"SELECT k, case_id, width, height, kind, j, page, idx, title, group_id, part_index, is_continuation, marker, continued_from, body_kind, position_ AS title_position, gap_lines, {rounded} FROM sx_contexts",
        # Body text fills the free bands of each column
        "sx_columns": f"SELECT c.k, c.case_id, p.page_no AS page, n.col, {SIDE_MARGIN} + n.col * ({column_width} + {COLUMN_GAP}) AS x0, {SIDE_MARGIN} + n.col * ({column_width} + {COLUMN_GAP}) + {column_width} AS x1, height - {BODY_MARGIN} AS bottom FROM case_specs c JOIN case_pages_of p ON c.k = p.k CROSS JOIN (VALUES (0), (1)) AS n(col) WHERE n.col < c.columns_",
        "sx_taken": f"SELECT k, page, ctx_x0 AS x0, ctx_y0 AS y0, ctx_x1 AS x1, ctx_y1 AS y1 FROM sx_contexts UNION ALL SELECT doc AS k, CAST({number('v', 'page', 1)} AS INT) AS page, {box('v', 'bbox')} FROM sx_negatives",
        "sx_columns_taken": f"SELECT c.k, c.page, c.col, r.y0, r.y1, greatest(CAST({BODY_MARGIN} AS DOUBLE), coalesce(max(r.y1) OVER (PARTITION BY c.k, c.page, c.col ORDER BY r.y0, r.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {BODY_MARGIN})) AS reached FROM sx_columns c JOIN sx_taken r ON c.k = r.k AND c.page = r.page AND r.x1 > c.x0 AND r.x0 < c.x1 WHERE r.y0 <= c.bottom",
        "sx_free": f"""SELECT k, page, col, reached AS y0, y0 AS y1 FROM sx_columns_taken WHERE y0 - reached >= {LEAST_BAND}
          UNION ALL SELECT k, page, col, y0, bottom AS y1 FROM (SELECT c.k, c.page, c.col, c.bottom, greatest(CAST({BODY_MARGIN} AS DOUBLE), coalesce(max(r.y1), {BODY_MARGIN})) AS y0 FROM sx_columns c LEFT JOIN sx_columns_taken r ON c.k = r.k AND c.page = r.page AND c.col = r.col GROUP BY c.k, c.page, c.col, c.bottom) AS x WHERE bottom - y0 >= {LEAST_BAND}""",
        "plain_specs": f"SELECT k, case_id, page, CAST(row_number() OVER (PARTITION BY k, page ORDER BY col, x0, y0) AS INT) AS pos, 'body_filler' AS role, 0 AS line_count, {', '.join(f'{d.hundredths(c)} AS {c}' for c in _CORNERS)} FROM (SELECT f.k, c.case_id, f.page, f.col, c.x0, f.y0, c.x1, f.y1 FROM sx_free f JOIN sx_columns c ON f.k = c.k AND f.page = c.page AND f.col = c.col) AS x",
        # a scenario file has no sequence, no generated parts and no rendered text
        "layout_sequence": f"SELECT k, case_id, 1 AS page, 1 AS pos, 'text' AS kind, {none} AS idx, 1 AS line_count FROM case_specs WHERE false",
        "part_specs": "SELECT k, case_id, width, height, 1 AS part, '' AS idx FROM case_specs WHERE false",
        "text_overlap": "SELECT k AS doc_id, 1 AS page, '' AS kind, '' AS id, '' AS key_text, 'ok' AS status FROM case_specs WHERE false",
    }


def queries(d) -> dict[str, str]:
    return {
        "v6_compiled_cases": "SELECT k, case_id, axis, size_, orientation, columns_, page_count, page_offset, width, height FROM case_specs",
        "v6_compiled_targets": "SELECT k, case_id, kind, j, page, idx, title, alias_, body_kind, position_, group_id, part_index, is_continuation, marker, continued_from FROM target_specs",
        "v6_compiled_tables": "SELECT k, j, rows_, cols_ FROM sx_targets WHERE kind = 'table'",
        "x2_compiled_bands": "SELECT case_id, slot, page_no, text, variable_text, rule_y, x0, y0, x1, y1 FROM hf_pages",
        "x3_compiled_watermarks": "SELECT case_id, page_no, text, rotation, opacity, style, x0, y0, x1, y1 FROM wm_pages",
        "p9_compiled_truth": f"SELECT case_id, page, kind, idx, title_position, gap_lines, {', '.join(f'{p}_{c}' for p in ('cap', 'body', 'ctx') for c in _CORNERS)} FROM spec_truth",
        "x1_compiled_body_text": "SELECT case_id, page, pos, x0, y0, x1, y1 FROM plain_specs",
        "a11_compiled_tags": "SELECT c.case_id, g.tag FROM tags g JOIN case_specs c ON g.k = c.k",
        "a10_compiled_coverage": "SELECT * FROM coverage",
        "c10_compiled_self_check": "SELECT gate, case_id, page, detail FROM self_check_errors",
    }
