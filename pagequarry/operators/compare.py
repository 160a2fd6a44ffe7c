"""Golden comparison: identity keys, tolerances, full outer diff, case and corpus summaries, reports and overlays."""

from __future__ import annotations

# Tolerance in points by region or kind (x, y); the loose profile doubles them.
TOLERANCES = {"header": (8, 5), "footer": (8, 5), "watermark": (14, 14), "caption_region": (8, 5), "body_region": (12, 8), "context_region": (14, 10)}
TABLE_FIELDS = ("table_group_id", "part_index", "is_continuation", "continuation_marker", "continued_from")
# Colours (red, green, blue) and line widths of overlays.
COLOURS = {"truth": "0.0,0.6,0.0", "detected": "0.0,0.0,0.9", "failed": "0.85,0.0,0.0", "extra": "0.95,0.55,0.0"}
NORMAL_WIDTH, FIELD_WIDTH, FAIL_WIDTH = 2, 3, 5


def label(idx: str, group: str, part: str, text) -> str:
    """What a box of an object is labelled with."""
    return f"CASE kind WHEN 'figure' THEN concat('[FIG ', {idx}, ']') WHEN 'table' THEN concat('[TBL ', coalesce({group}, ''), ' p', coalesce({text(part)}, ''), ']') WHEN 'header' THEN '[H]' WHEN 'footer' THEN '[F]' WHEN 'watermark' THEN '[WM]' ELSE concat('[', kind, ']') END"


def relations(d) -> dict[str, str]:
    t = d.text
    text = lambda x: f"CAST({x} AS {t})"
    rows = ", ".join(f"('{k}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for k, (x, y) in TOLERANCES.items())
    key = f"CASE WHEN kind = 'figure' THEN concat('figure|', {text('page')}, '|', idx) WHEN table_group_id IS NULL THEN concat('table|', {text('page')}, '|', idx, '|', coalesce({text('part_index')}, '')) ELSE concat('table|', table_group_id, '|', {text('part_index')}) END"
    regions = [("caption_region", "cap"), ("body_region", "body"), ("context_region", "ctx")]
    last = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, object_key ORDER BY page DESC, pos DESC) AS rn FROM {0}) AS k WHERE rn = 1"
    spread = lambda source: " UNION ALL ".join(f"SELECT case_id, object_key, kind, page, '{r}' AS region, {p}_x0 AS x0, {p}_y0 AS y0, {p}_x1 AS x1, {p}_y1 AS y1 FROM {source} WHERE kind IN ('figure', 'table') AND {p}_x0 IS NOT NULL" for r, p in regions) + f" UNION ALL SELECT case_id, object_key, kind, page, 'bbox' AS region, cap_x0 AS x0, cap_y0 AS y0, cap_x1 AS x1, cap_y1 AS y1 FROM {source} WHERE kind NOT IN ('figure', 'table')"
    shift = lambda c, e: f"{c} + {e} AS {c}"
    moved = ", ".join(shift(f"{p}_{c}", "CASE WHEN (case_id + pos) % 7 = 0 THEN 3 ELSE 0 END" if c[0] == "x" else "CASE WHEN (case_id + pos) % 13 = 0 THEN 9 ELSE 0 END") for p in ("cap", "body") for c in ("x0", "y0", "x1", "y1"))
    # tables may come without a context
    context = ", ".join(f"CASE WHEN kind = 'table' AND (case_id + pos) % 11 = 0 THEN NULL ELSE ctx_{c} END AS ctx_{c}" for c in ("x0", "y0", "x1", "y1"))
    # a value's key compares as the contract's values do (numbers by value, true as 1), shown is how a report writes it
    quote, number = "chr(39)", lambda x: f"concat('n:', {text(f'CAST({x} AS DOUBLE)')})"
    values = {"part_index": (number("part_index"), text("part_index")), "is_continuation": (f"CASE WHEN is_continuation THEN {number(1)} ELSE {number(0)} END", "CASE WHEN is_continuation THEN 'True' ELSE 'False' END")}
    field = lambda f: values.get(f, (f"concat('s:', {f})", f"concat({quote}, {f}, {quote})"))
    with_fields = lambda source, absent: " UNION ALL ".join(f"SELECT case_id, object_key, '{f}' AS field, CASE WHEN {f} IS NULL THEN 'null' ELSE {field(f)[0]} END AS val, CASE WHEN {f} IS NULL THEN 'None' ELSE {field(f)[1]} END AS shown FROM {source} WHERE kind = 'table'" + (f" AND NOT ({absent[f]})" if f in absent else "") for f in TABLE_FIELDS)
    delta = ", ".join(f"{d.hundredths(f'f.{c} - t.{c}')} AS d{c}" for c in ("x0", "y0", "x1", "y1"))
    shown = f"concat('[', {text('dx0')}, ', ', {text('dy0')}, ', ', {text('dx1')}, ', ', {text('dy1')}, ']')"
    short = "replace({0}, '_region', '')"
    box = "x0, y0, x1, y1"
    return {
        "tolerances": f"SELECT * FROM (VALUES {rows}) AS v(region, tol_x, tol_y)",
        # Objects by identity; the last of a key counts
        "ordinals": "SELECT *, row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY pos, region_id) - 1 AS ordinal FROM commons",
        "keyed": f"""SELECT doc_id AS case_id, {key} AS object_key, kind, page, idx, anchor_id AS pos, table_group_id, part_index, is_continuation, continuation_marker, continued_from, cap_x0, cap_y0, cap_x1, cap_y1, body_x0, body_y0, body_x1, body_y1, ctx_x0, ctx_y0, ctx_x1, ctx_y1 FROM objects
          UNION ALL SELECT doc_id, concat('common|', {text('page')}, '|', kind, '|', {text('ordinal')}), kind, page, '', pos, NULL, NULL, NULL, NULL, NULL, {box}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ordinals""",
        "truth": last.format("keyed"),
        # the detected side: truth with shifts, losses, extras, wrong markers and missing contexts here and there
        "detected": f"""SELECT case_id, CASE WHEN (case_id + pos) % 19 = 0 AND kind = 'figure' THEN concat(object_key, 'x') ELSE object_key END AS object_key, kind, page, idx, pos, table_group_id, part_index, is_continuation, CASE WHEN (case_id + pos) % 23 = 0 THEN 'cont.' ELSE continuation_marker END AS continuation_marker, continued_from, {moved}, {context} FROM truth WHERE (case_id + pos) % 17 <> 0""",
        # Status by key
        "diff": """SELECT coalesce(t.case_id, f.case_id) AS case_id, coalesce(t.object_key, f.object_key) AS object_key, coalesce(t.kind, f.kind) AS kind, coalesce(t.page, f.page) AS page, coalesce(t.idx, f.idx) AS idx, CASE WHEN f.case_id IS NULL THEN 'missing' WHEN t.case_id IS NULL THEN 'extra' ELSE 'matched' END AS status
          FROM truth t FULL OUTER JOIN detected f ON t.case_id = f.case_id AND t.object_key = f.object_key""",
        "truth_regions": spread("truth"),
        "found_regions": spread("detected"),
        # SRC3: a field that is absent has no row, one that is null has; here and there either side lacks one
        "truth_fields": with_fields("truth", {"is_continuation": "(case_id + pos) % 5 = 0"}),
        "found_fields": with_fields("detected", {"continued_from": "(case_id + pos) % 7 = 0", "is_continuation": "(case_id + pos) % 3 = 0"}),
        # every case of either side, also those without any object
        "truth_cases": "SELECT DISTINCT doc_id AS case_id FROM layout_pages",
        "found_cases": "SELECT DISTINCT case_id FROM detected UNION SELECT -1 - case_id FROM truth_cases WHERE case_id % 31 = 0",
        "all_cases": "SELECT case_id FROM truth_cases UNION SELECT case_id FROM found_cases",
        # Boxes within tolerance; deltas are rounded before the test
        "region_deltas": f"""SELECT t.case_id, t.object_key, t.kind, t.page, t.region, {', '.join(f't.{c} AS t_{c}' for c in ('x0', 'y0', 'x1', 'y1'))}, {', '.join(f'f.{c} AS f_{c}' for c in ('x0', 'y0', 'x1', 'y1'))}, {delta}, tol_x, tol_y, CASE WHEN f.x0 IS NULL THEN 'missing region in detected' WHEN t.x0 IS NULL THEN 'missing region in truth' END AS reason
          FROM truth_regions t JOIN diff x ON x.case_id = t.case_id AND x.object_key = t.object_key AND x.status = 'matched' JOIN tolerances o ON o.region = CASE WHEN t.region = 'bbox' THEN t.kind ELSE t.region END
          LEFT JOIN found_regions f ON f.case_id = t.case_id AND f.object_key = t.object_key AND f.region = t.region""",
        "region_checks": "SELECT *, coalesce(abs(dx0) <= tol_x AND abs(dx1) <= tol_x AND abs(dy0) <= tol_y AND abs(dy1) <= tol_y, false) AS passed FROM region_deltas",
        # only fields that truth has are compared
        "field_checks": f"""SELECT t.case_id, t.object_key, t.field, t.shown AS expected, coalesce(f.shown, concat({quote}, '<<missing>>', {quote})) AS actual, coalesce(f.val = t.val, false) AS passed
          FROM truth_fields t JOIN diff x ON x.case_id = t.case_id AND x.object_key = t.object_key AND x.status = 'matched' LEFT JOIN found_fields f ON f.case_id = t.case_id AND f.object_key = t.object_key AND f.field = t.field""",
        # A4: an object passes with all of its regions and fields
        "compared": """SELECT x.case_id, x.object_key, x.kind, x.page, x.idx, x.status, x.status = 'matched' AND coalesce(r.passed, true) AND coalesce(f.passed, true) AS passed, coalesce(r.checked, 0) AS regions_checked, coalesce(r.failed, 0) AS regions_failed FROM diff x
          LEFT JOIN (SELECT case_id, object_key, bool_and(passed) AS passed, count(*) AS checked, count(*) FILTER (WHERE NOT passed) AS failed FROM region_checks GROUP BY case_id, object_key) AS r ON x.case_id = r.case_id AND x.object_key = r.object_key
          LEFT JOIN (SELECT case_id, object_key, bool_and(passed) AS passed FROM field_checks GROUP BY case_id, object_key) AS f ON x.case_id = f.case_id AND x.object_key = f.object_key""",
        "case_results": """SELECT c.case_id, coalesce(bool_and(x.passed), true) AS passed, count(*) FILTER (WHERE x.status <> 'extra') AS expected, count(*) FILTER (WHERE x.status = 'matched') AS matched, count(*) FILTER (WHERE x.status = 'missing') AS missing, count(*) FILTER (WHERE x.status = 'extra') AS extra,
          CAST(coalesce(sum(x.regions_checked), 0) AS BIGINT) AS regions_checked, CAST(coalesce(sum(x.regions_failed), 0) AS BIGINT) AS regions_failed FROM all_cases c LEFT JOIN compared x ON x.case_id = c.case_id GROUP BY c.case_id""",
        # SNK3: what a failure's row says
        "failure_notes": f"""SELECT case_id, object_key, 0 AS part, region AS name, concat(region, ' Δ', CASE WHEN reason IS NULL THEN {shown} ELSE 'None' END, ' tol(', {text('tol_x')}, ', ', {text('tol_y')}, ')') AS note FROM region_checks WHERE NOT passed
          UNION ALL SELECT case_id, object_key, 1, field, concat(field, ': exp ', expected, ' got ', actual) FROM field_checks WHERE NOT passed""",
        "failure_details": f"SELECT case_id, object_key, {d.join(d.map(d.gather(d.struct(part='part', name='name', note='note')), 'v', 'v.note'), repr('; '))} AS detail FROM failure_notes GROUP BY case_id, object_key",
        # pages to draw; failing ones, or all
        "page_failures": "SELECT case_id, page, count(*) FILTER (WHERE NOT passed) AS failures, count(*) AS objects FROM compared GROUP BY case_id, page",
        # Boxes that show why an object failed
        "failure_boxes": f"""SELECT r.case_id, r.page, r.object_key, r.region, {box}, '{COLOURS['failed']}' AS colour, {FAIL_WIDTH} AS width, concat('missing ', {short.format('r.region')}) AS label FROM truth_regions r JOIN compared c ON r.case_id = c.case_id AND r.object_key = c.object_key WHERE c.status = 'missing'
          UNION ALL SELECT r.case_id, r.page, r.object_key, r.region, {box}, '{COLOURS['extra']}', {FAIL_WIDTH}, concat('extra ', {short.format('r.region')}) FROM found_regions r JOIN compared c ON r.case_id = c.case_id AND r.object_key = c.object_key WHERE c.status = 'extra'
          UNION ALL SELECT case_id, page, object_key, region, t_x0, t_y0, t_x1, t_y1, '{COLOURS['truth']}', {NORMAL_WIDTH}, concat('truth ', {short.format('region')}) FROM region_checks WHERE NOT passed
          UNION ALL SELECT case_id, page, object_key, region, f_x0, f_y0, f_x1, f_y1, '{COLOURS['failed']}', {FAIL_WIDTH}, concat('det ', {short.format('region')}, ' Δ', {shown}) FROM region_checks WHERE NOT passed AND reason IS NULL
          UNION ALL SELECT case_id, page, object_key, region, t_x0, t_y0, t_x1, t_y1, '{COLOURS['failed']}', {FAIL_WIDTH}, concat('missing ', {short.format('region')}) FROM region_checks WHERE NOT passed AND reason IS NOT NULL
          UNION ALL SELECT f.case_id, r.page, f.object_key, 'caption_region', {box}, '{COLOURS['failed']}', {FIELD_WIDTH}, concat(f.field, ': exp ', f.expected, ' got ', f.actual) FROM field_checks f JOIN truth_regions r ON r.case_id = f.case_id AND r.object_key = f.object_key AND r.region = 'caption_region' WHERE NOT f.passed""",
        # Boxes of both sides with their labels
        "overlay_labels": f"""SELECT r.case_id, r.page, r.object_key, r.region, {', '.join(f'r.{c} AS {c}' for c in ('x0', 'y0', 'x1', 'y1'))}, '{COLOURS['truth']}' AS colour, {NORMAL_WIDTH} AS width, false AS dashed, concat({label('o.idx', 'o.table_group_id', 'o.part_index', text).replace('CASE kind', 'CASE r.kind').replace("'[', kind", "'[', r.kind")}, CASE WHEN r.region = 'bbox' THEN '' ELSE concat(' ', {short.format('r.region')}) END) AS label FROM truth_regions r JOIN truth o ON r.case_id = o.case_id AND r.object_key = o.object_key
          UNION ALL SELECT r.case_id, r.page, r.object_key, r.region, {', '.join(f'r.{c}' for c in ('x0', 'y0', 'x1', 'y1'))}, '{COLOURS['detected']}', {NORMAL_WIDTH}, true, concat({label('o.idx', 'o.table_group_id', 'o.part_index', text).replace('CASE kind', 'CASE r.kind').replace("'[', kind", "'[', r.kind")}, CASE WHEN r.region = 'bbox' THEN '' ELSE concat(' ', {short.format('r.region')}) END) FROM found_regions r JOIN detected o ON r.case_id = o.case_id AND r.object_key = o.object_key""",
    }


def queries(d) -> dict[str, str]:
    t = d.text
    return {
        "w1_common_ordinals": "SELECT doc_id, page, kind, pos, CAST(ordinal AS BIGINT) AS ordinal FROM ordinals",
        "c7_extract_objects": "SELECT case_id, object_key, kind, page, idx, table_group_id, part_index, is_continuation, continuation_marker, continued_from FROM truth",
        "c7_object_regions": "SELECT case_id, object_key, region, x0, y0, x1, y1 FROM truth_regions",
        "j8_identity_diff": "SELECT * FROM diff",
        "c6_compare_bbox": "SELECT case_id, object_key, kind, region, dx0, dy0, dx1, dy1, tol_x, tol_y, passed, reason FROM region_checks",
        "c6_compare_fields": "SELECT case_id, object_key, field, expected, actual, passed FROM field_checks",
        "a4_object_case_pass": "SELECT case_id, object_key, status, passed FROM compared",
        "a3_compare_summary": """SELECT count(*) AS cases_total, count(*) FILTER (WHERE passed) AS cases_passed, count(*) FILTER (WHERE NOT passed) AS cases_failed, CAST(sum(expected) AS BIGINT) AS objects_expected, CAST(sum(matched) AS BIGINT) AS objects_matched, CAST(sum(missing) AS BIGINT) AS objects_missing,
          CAST(sum(extra) AS BIGINT) AS objects_extra, CAST(sum(regions_checked) AS BIGINT) AS regions_checked, CAST(sum(regions_failed) AS BIGINT) AS regions_failed FROM case_results""",
        "f4_region_kind_filter": "SELECT case_id, object_key, status FROM diff WHERE kind = 'table'",
        "f6_failing_pages": "SELECT case_id, page, failures FROM page_failures WHERE failures > 0",
        "f6_overlay_pages": "SELECT case_id, page, objects, failures FROM page_failures WHERE case_id % 2 = 1 AND page IN (1, 3)",
        "p7_overlay_labels": "SELECT * FROM overlay_labels",
        "j15_overlay_boxes": "SELECT * FROM failure_boxes",
        "a4_case_results": "SELECT * FROM case_results",
        "src3_field_presence": "SELECT c.case_id, c.object_key, count(t.field) AS in_truth, count(f.field) AS in_detected FROM diff c LEFT JOIN truth_fields t ON t.case_id = c.case_id AND t.object_key = c.object_key LEFT JOIN found_fields f ON f.case_id = t.case_id AND f.object_key = t.object_key AND f.field = t.field WHERE c.kind = 'table' GROUP BY c.case_id, c.object_key",
        "snk3_report_rows": f"SELECT c.case_id, c.object_key, concat('| `', CAST(c.case_id AS {t}), '` | ', c.kind, ' | ', c.idx, ' | ', c.status, ' | ', CASE WHEN c.status = 'matched' THEN coalesce(f.detail, '') ELSE c.status END, ' |') AS row_text FROM compared c LEFT JOIN failure_details f ON c.case_id = f.case_id AND c.object_key = f.object_key WHERE NOT c.passed",
        "snk3_report_summary": f"SELECT concat('- cases: ', CAST(count(*) FILTER (WHERE passed) AS {t}), '/', CAST(count(*) AS {t}), ' passed (', CAST(count(*) FILTER (WHERE NOT passed) AS {t}), ' failed)') AS cases_line, concat('- objects: expected ', CAST(CAST(sum(expected) AS BIGINT) AS {t}), ', matched ', CAST(CAST(sum(matched) AS BIGINT) AS {t}), ', missing ', CAST(CAST(sum(missing) AS BIGINT) AS {t}), ', extra ', CAST(CAST(sum(extra) AS BIGINT) AS {t})) AS objects_line, concat('- regions: ', CAST(CAST(sum(regions_checked) - sum(regions_failed) AS BIGINT) AS {t}), '/', CAST(CAST(sum(regions_checked) AS BIGINT) AS {t}), ' within tolerance (', CAST(CAST(sum(regions_failed) AS BIGINT) AS {t}), ' failed)') AS regions_line FROM case_results",
        "x12_overlay_index": f"SELECT p.case_id, p.page, concat('| `', CAST(p.case_id AS {t}), '` | ', CAST(p.page AS {t}), ' | ', CAST(p.objects AS {t}), ' | ', CAST(p.failures AS {t}), ' |') AS row_text FROM page_failures p WHERE p.failures > 0",
        "t9_extra_cases_of_filter": "SELECT DISTINCT f.case_id FROM detected f WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.case_id = f.case_id AND t.case_id % 2 = 0)",
    }
