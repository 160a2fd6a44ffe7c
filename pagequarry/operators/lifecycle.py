"""Edits, packages and reviews: log validation and replay, flat objects, overlays, crops, summaries."""

from __future__ import annotations

from ..functions import scalars as S

# Review decisions other than accept, each with the task that it calls for.
NEXT_TASKS = {
    "bad_body_region": "Improve body_region inference for flagged figures/tables (e.g. waveform lower-bound).",
    "bad_caption_region": "Improve caption_region band inference.",
    "bad_context_region": "Improve context_region inference.",
    "wrong_title": "Improve title text extraction.",
    "wrong_index": "Improve index parsing.",
    "false_positive": "Strengthen anchor false-positive guards.",
    "common_region_issue": "Revisit common-region / watermark detection.",
    "missed_object": "Improve anchor recall for missed figures/tables.",
}
# Colours (red, green, blue) and line widths of review overlays.
COLOURS = {"figure": "0.0,0.0,0.9", "table": "0.0,0.6,0.0", "margin": "0.45,0.45,0.45", "watermark": "0.95,0.55,0.0"}
BODY_WIDTH, OTHER_WIDTH = 2.4, 1.2
EDITOR_VERSION, DETECTOR_VERSION = "editor-save-manifest-v0", "detector-output-v0"
_CORNERS = ("x0", "y0", "x1", "y1")


def relations(d) -> dict[str, str]:
    t = d.text
    text = lambda x: f"CAST({x} AS {t})"
    oid = S.object_id(d, "kind", "idx", "page")
    issues = ", ".join(f"({k}, '{name}', '{task}')" for k, (name, task) in enumerate(NEXT_TASKS.items()))
    regions = [("caption_region", "cap"), ("body_region", "body"), ("context_region", "ctx")]
    decision = "CASE (doc_id + anchor_id) % 12 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(NEXT_TASKS)) + " ELSE 'accept' END"
    box = ", ".join(_CORNERS)
    of = lambda p, names=_CORNERS: ", ".join(f"{p}{c}" for c in names)
    before = ", ".join(f"coalesce(lag(e.{c}) OVER w, o.{c}) AS before_{c}" for c in _CORNERS)
    crop = lambda r: f"CASE WHEN {r}_x0 IS NOT NULL AND least({r}_x1, width) - greatest({r}_x0, 0) > 1 AND least({r}_y1, height) - greatest({r}_y0, 0) > 1 THEN concat('crops/', kind, '_', {S.safe_index(d, 'idx')}, '_{dict(cap='caption', body='body', ctx='context')[r]}.png') END"
    wide = lambda r: ", ".join(f"max(CASE WHEN region = '{dict(regions_by)[r]}' THEN {c} END) AS {r}_{c}" for c in _CORNERS)
    regions_by = [(p, r) for r, p in regions]
    paged = f"{d.at('v', 'pages')} IS NOT NULL"
    return {
        # The editor's flat objects; equal ids are told apart by place
        "editor_objects": f"SELECT doc_id, page, kind, idx, title, {oid} AS object_id, anchor_id AS place FROM objects UNION ALL SELECT doc_id, page, 'common', kind, text, concat('common:', region_id, ':page', {text('page')}), pos FROM commons",
        "overlay_boxes": " UNION ALL ".join(f"SELECT doc_id, page, kind, {oid} AS object_id, anchor_id AS place, '{r}' AS region, {', '.join(f'{p}_{c} AS {c}' for c in _CORNERS)} FROM objects" for r, p in regions) + f" UNION ALL SELECT doc_id, page, kind, concat('common:', region_id, ':page', {text('page')}), pos, 'bbox', {box} FROM commons",
        # Boxes as they are drawn
        "draw_boxes": f"""SELECT doc_id, page, anchor_id AS place, 'body_region' AS region, {of('body_')}, CASE kind WHEN 'figure' THEN '{COLOURS['figure']}' ELSE '{COLOURS['table']}' END AS colour, CAST({BODY_WIDTH} AS DOUBLE) AS width, false AS dashed, concat(CASE kind WHEN 'figure' THEN '[FIG ' ELSE '[TBL ' END, idx, '] body') AS label FROM objects
          UNION ALL SELECT doc_id, page, anchor_id, 'caption_region', {of('cap_')}, CASE kind WHEN 'figure' THEN '{COLOURS['figure']}' ELSE '{COLOURS['table']}' END, CAST({OTHER_WIDTH} AS DOUBLE), true, concat(CASE kind WHEN 'figure' THEN '[FIG ' ELSE '[TBL ' END, idx, '] caption') FROM objects
          UNION ALL SELECT doc_id, page, anchor_id, 'context_region', {of('ctx_')}, CASE kind WHEN 'figure' THEN '{COLOURS['figure']}' ELSE '{COLOURS['table']}' END, CAST({OTHER_WIDTH} AS DOUBLE), true, NULL FROM objects
          UNION ALL SELECT doc_id, page, pos, 'bbox', {box}, CASE kind WHEN 'watermark' THEN '{COLOURS['watermark']}' ELSE '{COLOURS['margin']}' END, CAST({OTHER_WIDTH} AS DOUBLE), false, concat('[', upper(substring(kind, 1, 2)), ']') FROM commons""",
        # the edit log: two dozen edits of a page, then of the next document, over all documents
        "edit_targets": "SELECT event_id AS edit_seq, CAST(floor(event_id / 24) AS BIGINT) % (SELECT max(doc_id) FROM layout_pages) + 1 AS doc_id, CAST(CAST(floor(event_id / 24) AS BIGINT) % 3 + 1 AS INT) AS page, (event_id % 3 + 1) * 10 + 1 AS place, CASE event_id % 6 WHEN 0 THEN 'caption_region' WHEN 1 THEN 'body_region' WHEN 2 THEN 'context_region' WHEN 3 THEN 'bbox' WHEN 4 THEN 'title' ELSE 'caption_region' END AS region, CAST(floor(value) AS BIGINT) % 40 AS v, event_id FROM events",
        "edits": """SELECT e.edit_seq, e.doc_id, e.page, coalesce(o.object_id, 'figure:9.9:page1') AS object_id, e.region, CAST(60 + v * 0.25 - CASE WHEN event_id % 29 = 0 THEN 100 ELSE 0 END AS DOUBLE) AS x0, CAST(100 + v AS DOUBLE) AS y0, CAST(300 + v * 0.5 - CASE WHEN event_id % 31 = 0 THEN 300 ELSE 0 END AS DOUBLE) AS x1, CAST(150 + v + CASE WHEN event_id % 37 = 0 THEN 700 ELSE 0 END AS DOUBLE) AS y1
          FROM edit_targets e LEFT JOIN editor_objects o ON e.doc_id = o.doc_id AND e.page = o.page AND e.place = o.place""",
        # Edits and lookups take the first object of an id, listings the last
        "live_objects": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, object_id ORDER BY page, place) AS nth, row_number() OVER (PARTITION BY doc_id, object_id ORDER BY page DESC, place DESC) AS nth_last FROM editor_objects) AS o",
        "live_boxes": f"SELECT b.doc_id, b.object_id, b.region, {of('b.')} FROM overlay_boxes b JOIN live_objects o ON b.doc_id = o.doc_id AND b.object_id = o.object_id AND b.page = o.page AND b.place = o.place WHERE o.nth = 1",
        # EDT2: the first code that fails, in order; boxes at two decimals
        "edit_checks": f"""SELECT e.edit_seq, e.doc_id, e.object_id, e.region, CASE WHEN o.object_id IS NULL THEN 'EDIT_OBJECT_NOT_FOUND' WHEN o.kind = 'common' AND e.region <> 'bbox' OR o.kind <> 'common' AND e.region NOT IN ('caption_region', 'body_region', 'context_region') THEN 'EDIT_REGION_NOT_FOUND'
          WHEN NOT (e.x0 < e.x1 AND e.y0 < e.y1) THEN 'EDIT_BAD_BBOX' WHEN e.x0 < -0.5 OR e.y0 < -0.5 OR e.x1 > p.width + 0.5 OR e.y1 > p.height + 0.5 THEN 'EDIT_OUT_OF_PAGE_BOUNDS' ELSE 'ok' END AS code, {', '.join(f'{d.hundredths(f"e.{c}")} AS {c}' for c in _CORNERS)}
          FROM edits e LEFT JOIN live_objects o ON o.doc_id = e.doc_id AND o.object_id = e.object_id AND o.nth = 1 LEFT JOIN layout_pages p ON p.doc_id = o.doc_id AND p.page = o.page""",
        # what a stream of edits starts from: each region of the objects that edits can find
        "stream_objects": f"SELECT o.doc_id, o.object_id, o.kind, p.width, p.height, b.region, {of('b.')} FROM live_objects o LEFT JOIN layout_pages p ON p.doc_id = o.doc_id AND p.page = o.page LEFT JOIN live_boxes b ON b.doc_id = o.doc_id AND b.object_id = o.object_id WHERE o.nth = 1",
        "applied": "SELECT * FROM edit_checks WHERE code = 'ok'",
        # IT4: what each edit replaced (at first the object's own box), and what is valid after all
        "edit_history": f"""SELECT e.edit_seq, e.doc_id, e.object_id, e.region, {before}, {of('e.')}, row_number() OVER (PARTITION BY e.doc_id, e.object_id, e.region ORDER BY e.edit_seq DESC) AS from_end FROM applied e LEFT JOIN live_boxes o ON o.doc_id = e.doc_id AND o.object_id = e.object_id AND o.region = e.region WINDOW w AS (PARTITION BY e.doc_id, e.object_id, e.region ORDER BY e.edit_seq)""",
        # EDT3: the same without checks; only figures and tables have a box to replace, the rest is logged without one
        "unchecked_history": f"""SELECT e.edit_seq, e.doc_id, e.object_id, e.region, {', '.join(f"CASE WHEN l.object_id IS NOT NULL THEN coalesce(lag(e.{c}) OVER w, o.{c}) END AS before_{c}" for c in _CORNERS)}, {of('e.')} FROM edits e LEFT JOIN live_objects l ON l.doc_id = e.doc_id AND l.object_id = e.object_id AND l.nth = 1 AND l.kind <> 'common'
          LEFT JOIN live_boxes o ON o.doc_id = e.doc_id AND o.object_id = e.object_id AND o.region = e.region WINDOW w AS (PARTITION BY e.doc_id, e.object_id, e.region ORDER BY e.edit_seq)""",
        "edited_boxes": f"SELECT o.doc_id, o.page, o.kind, o.object_id, o.place, o.region, {', '.join(f'coalesce(e.{c}, o.{c}) AS {c}' for c in _CORNERS)}, e.edit_seq IS NOT NULL AS edited FROM overlay_boxes o LEFT JOIN live_objects l ON l.nth = 1 AND l.doc_id = o.doc_id AND l.object_id = o.object_id AND l.page = o.page AND l.place = o.place LEFT JOIN edit_history e ON l.object_id IS NOT NULL AND e.from_end = 1 AND e.doc_id = o.doc_id AND e.object_id = o.object_id AND e.region = o.region",
        # EDT1: a document's pages with an empty log
        "editor_pages": "SELECT p.doc_id, p.page, count(o.object_id) FILTER (WHERE o.kind = 'figure') AS figures, count(o.object_id) FILTER (WHERE o.kind = 'table') AS tables, count(o.object_id) FILTER (WHERE o.kind = 'common') AS common_regions FROM layout_pages p LEFT JOIN editor_objects o ON o.doc_id = p.doc_id AND o.page = p.page GROUP BY p.doc_id, p.page",
        # Package rows of edited boxes; only saved manifests of the editor count, crops leave out the page
        "package_sources": f"SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '{DETECTOR_VERSION}' ELSE '{EDITOR_VERSION}' END AS schema_version, CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('doc', {text('doc_id')}, '.pdf') END AS source_pdf FROM (SELECT DISTINCT doc_id FROM layout_pages) AS x",
        "package_boxes": f"SELECT b.doc_id, b.page, b.object_id, b.place, b.kind, {', '.join(wide(p) for _, p in regions)}, count(*) FILTER (WHERE b.edited) AS edits FROM edited_boxes b WHERE b.region <> 'bbox' GROUP BY b.doc_id, b.page, b.object_id, b.place, b.kind",
        "package_objects": f"""SELECT x.doc_id, x.object_id, x.place, x.kind, x.page, x.idx, x.title, {', '.join(of(f'{p}_') for _, p in regions)}, {crop('cap')} AS caption_crop, {crop('body')} AS body_crop, {crop('ctx')} AS context_crop, {S.hint(d, 'kind')} AS task_hint
          FROM (SELECT b.*, o.idx, o.title, p.width, p.height FROM package_boxes b JOIN package_sources s ON s.doc_id = b.doc_id JOIN editor_objects o ON o.doc_id = b.doc_id AND o.page = b.page AND o.place = b.place AND o.kind <> 'common' JOIN layout_pages p ON p.doc_id = b.doc_id AND p.page = b.page WHERE s.schema_version = '{EDITOR_VERSION}' AND s.source_pdf <> '') AS x""",
        # SRC8, SRC10: run folders; an editor's manifest comes before a detector's, one that can't be read leaves blanks
        "run_files": "SELECT concat('run', lpad(CAST(doc AS " + t + "), 9, '0')) AS run_id, 'detected' AS kind, body FROM detector_texts WHERE doc % 3 <> 0 UNION ALL SELECT concat('run', lpad(CAST(doc AS " + t + "), 9, '0')) AS run_id, 'editor' AS kind, body FROM editor_texts WHERE doc % 3 <> 1",
        "run_chosen": f"SELECT run_id, kind, {d.parse('body')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY kind DESC) AS nth FROM run_files) AS x WHERE nth = 1",
        "run_catalogue": f"""SELECT run_id, kind, CASE WHEN {paged} THEN coalesce({d.text_at('v', 'source_pdf')}, '') ELSE coalesce({d.text_at('v', 'cases[0].pdf')}, '') END AS source_pdf, CAST(CASE WHEN {paged} THEN {d.length_at('v', 'pages')} ELSE {d.length_at('v', 'cases[0].pages')} END AS BIGINT) AS page_count FROM run_chosen""",
        # reviews
        "reviews": f"SELECT doc_id, {oid} AS object_id, anchor_id AS place, page, kind, {decision} AS decision FROM objects",
        "missed": "SELECT doc_id, count(*) AS n FROM line_captions WHERE kind IS NULL AND word <> '' GROUP BY doc_id",
        "issue_list": f"SELECT * FROM (VALUES {issues}) AS v(place, issue, task)",
        "issue_counts": """SELECT r.doc_id, i.place, i.issue, i.task, coalesce(c.n, 0) + CASE WHEN i.issue = 'missed_object' THEN coalesce(m.n, 0) ELSE 0 END AS n FROM (SELECT DISTINCT doc_id FROM reviews) AS r CROSS JOIN issue_list i
          LEFT JOIN (SELECT doc_id, decision, count(*) AS n FROM reviews GROUP BY doc_id, decision) AS c ON c.doc_id = r.doc_id AND c.decision = i.issue LEFT JOIN missed m ON m.doc_id = r.doc_id""",
    }


def queries(d) -> dict[str, str]:
    t = d.text
    text = lambda x: f"CAST({x} AS {t})"
    tasks = d.join(d.map(d.gather(d.struct(place="place", task="task")), "v", "v.task"), "' | '")
    commas = ", ', ', "
    shown = lambda p: f"concat('[', {commas.join(text(f'{p}_{c}') for c in _CORNERS)}, ']')"
    links = d.join(d.filter(d.array(*(f"CASE WHEN {r}_crop IS NOT NULL THEN concat('[{r}](', {r}_crop, ')') END" for r in ("caption", "body", "context"))), "x", "x IS NOT NULL"), "', '")
    return {
        "c8_page_objects": "SELECT doc_id, page, kind, idx, title, object_id, place FROM editor_objects",
        "c8_overlays": "SELECT doc_id, page, kind, object_id, region, x0, y0, x1, y1 FROM overlay_boxes",
        "c8_all_objects_last": "SELECT doc_id, object_id, page, kind, place FROM live_objects WHERE nth_last = 1",
        "j16_find_object": "SELECT e.edit_seq, e.object_id, o.page, o.kind, o.place FROM edits e LEFT JOIN live_objects o ON o.doc_id = e.doc_id AND o.object_id = e.object_id AND o.nth = 1",
        "edt1_build_initial": "SELECT doc_id, page, figures, tables, common_regions, CAST(0 AS BIGINT) AS edits FROM editor_pages",
        "edt2_edit_bbox": "SELECT edit_seq, doc_id, object_id, region, code FROM edit_checks",
        "edt3_apply_bbox_edit": "SELECT * FROM unchecked_history",
        "it4_replay": "SELECT edit_seq, doc_id, object_id, region, before_x0, before_y0, before_x1, before_y1, x0, y0, x1, y1 FROM edit_history",
        "edt4_saved_state": "SELECT doc_id, page, object_id, place, region, x0, y0, x1, y1, edited FROM edited_boxes",
        "edt4_edit_state": "SELECT p.doc_id, count(a.edit_seq) AS edit_count, count(a.edit_seq) > 0 AS dirty FROM (SELECT DISTINCT doc_id FROM layout_pages) AS p LEFT JOIN applied a ON a.doc_id = p.doc_id GROUP BY p.doc_id",
        "a8_edited_summary": """SELECT p.doc_id, p.pages, p.figures, p.tables, coalesce(a.n, 0) AS edit_count, coalesce(c.n, 0) AS crops FROM (SELECT doc_id, count(*) AS pages, CAST(sum(figures) AS BIGINT) AS figures, CAST(sum(tables) AS BIGINT) AS tables FROM editor_pages GROUP BY doc_id) AS p
          LEFT JOIN (SELECT doc_id, count(*) AS n FROM applied GROUP BY doc_id) AS a ON a.doc_id = p.doc_id LEFT JOIN (SELECT doc_id, count(body_crop) AS n FROM package_objects GROUP BY doc_id) AS c ON c.doc_id = p.doc_id""",
        "c9_build_package": "SELECT * FROM package_objects",
        "c9_provenance_gate": f"SELECT doc_id, CASE WHEN schema_version <> '{EDITOR_VERSION}' THEN 'not an editor manifest' ELSE 'source_pdf not resolvable' END AS error FROM package_sources WHERE schema_version <> '{EDITOR_VERSION}' OR source_pdf = ''",
        "a7_package_summary": "SELECT doc_id, count(*) AS objects, count(*) FILTER (WHERE kind = 'figure') AS figures, count(*) FILTER (WHERE kind = 'table') AS tables, count(caption_crop) + count(body_crop) + count(context_crop) AS crops FROM package_objects GROUP BY doc_id",
        "c9_crop_collisions": "SELECT doc_id, caption_crop, count(*) AS n FROM package_objects WHERE caption_crop IS NOT NULL GROUP BY doc_id, caption_crop HAVING count(*) > 1",
        "c11_review_template": "SELECT doc_id, object_id, place, 'accept' AS decision, '' AS notes FROM reviews",
        "c11_review_package": "SELECT doc_id, object_id, place, kind, page, idx, title, table_group_id, crop FROM (SELECT o.doc_id, " + S.object_id(d, "o.kind", "o.idx", "o.page") + f" AS object_id, o.anchor_id AS place, o.kind, o.page, o.idx, o.title, o.table_group_id, CASE WHEN least(o.body_x1, p.width) - greatest(o.body_x0, 0) > 1 AND least(o.body_y1, p.height) - greatest(o.body_y0, 0) > 1 THEN concat('crops/', o.kind, '_', {S.safe_index(d, 'o.idx')}, '_body.png') END AS crop FROM objects o JOIN layout_pages p ON p.doc_id = o.doc_id AND p.page = o.page) AS x",
        "src10_run_catalogue": "SELECT * FROM run_catalogue",
        "a5_review_summary": "SELECT doc_id, issue, n FROM issue_counts",
        "a5_accepted": "SELECT doc_id, count(*) AS reviewed_objects, count(*) FILTER (WHERE decision = 'accept') AS accepted FROM reviews GROUP BY doc_id",
        "a5_next_tasks": f"SELECT doc_id, {tasks} AS tasks FROM issue_counts WHERE n > 0 GROUP BY doc_id",
        "a6_review_package_summary": "SELECT p.doc_id, p.pages, p.figures, p.tables, p.commons, coalesce(c.watermarks, 0) AS watermarks, p.figures + p.tables = 0 AS empty_warning FROM (SELECT doc_id, count(*) AS pages, CAST(sum(figures) AS BIGINT) AS figures, CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(common_regions) AS BIGINT) AS commons FROM editor_pages GROUP BY doc_id) AS p LEFT JOIN (SELECT doc_id, count(*) AS watermarks FROM commons WHERE kind = 'watermark' GROUP BY doc_id) AS c ON p.doc_id = c.doc_id",
        "j10_unknown_reviewed": "SELECT r.doc_id, r.object_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(object_id, 'page', 'page9') ELSE object_id END AS object_id FROM reviews) AS r WHERE NOT EXISTS (SELECT 1 FROM editor_objects o WHERE o.doc_id = r.doc_id AND o.object_id = r.object_id)",
        "p19_parse_object_id": f"SELECT doc_id, object_id, {d.group('object_id', S.OBJECT_ID, 1)} AS kind, {d.group('object_id', S.OBJECT_ID, 2)} AS idx, {d.group('object_id', S.OBJECT_ID, 3)} AS page FROM editor_objects",
        "p6_overlay_labels": "SELECT * FROM draw_boxes",
        "snk7_index_markdown": f"SELECT doc_id, place, concat('| `', object_id, '` | ', kind, ' | ', {text('page')}, ' | ', replace(title, '|', '\\|'), ' | ', task_hint, ' | ', CASE WHEN {links} = '' THEN '—' ELSE {links} END, ' |') AS row_text FROM package_objects".replace("'\\|'", "concat(chr(92), '|')"),
        "snk7_review_index": f"SELECT doc_id, anchor_id, concat('| `', {S.object_id(d, 'kind', 'idx', 'page')}, '` | ', {text('page')}, ' | ', kind, ' | ', idx, ' | ', replace(title, '|', concat(chr(92), '|')), ' | ', {shown('cap')}, ' | ', {shown('body')}, ' | ', {shown('ctx')}, ' |') AS row_text FROM objects",
        "snk7_edited_index": f"SELECT doc_id, page, concat('| ', {text('page')}, ' | [overlay](pages/page_', lpad({text('page')}, 3, '0'), '_overlay.png) | ', {text('figures')}, ' | ', {text('tables')}, ' |') AS row_text FROM editor_pages",
    }
