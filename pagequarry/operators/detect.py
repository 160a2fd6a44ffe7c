"""Caption anchors, common regions, body inference, contexts and table identity as relations.

Everything is local to a page but common ids and table groups, which are local to a document.
Theta conditions always come with the page as an equality, so no plan has a nested loop join.
"""

from __future__ import annotations

from ..functions import scalars as S

BOX = "x0, y0, x1, y1"


def _c(p: str) -> str:
    return ", ".join(f"{p}{c}" for c in ("x0", "y0", "x1", "y1"))


def relations(d) -> dict[str, str]:
    t = d.text
    line = d.struct(y0="y0", x0="x0", line_seq="line_seq", x1="x1", y1="y1", text="text")
    line_kind = f"STRUCT<y0: DOUBLE, x0: DOUBLE, line_seq: INT, x1: DOUBLE, y1: DOUBLE, text: {t}>" if d.name == "spark" else f"STRUCT(y0 DOUBLE, x0 DOUBLE, line_seq INT, x1 DOUBLE, y1 DOUBLE, text {t})"
    blocks = f"ARRAY<{line_kind}>" if d.name == "spark" else f"{line_kind}[]"
    # first block whose last line the next line follows, else a new block
    tail = d.last("b")
    fits = f"(x.y0 - {tail}.y1 < 4 AND {tail}.x0 < x.x1 AND {tail}.x1 > x.x0)"
    at = d.find(d.map("acc", "b", fits), "true")
    placed = d.map_at("acc", "b", "i", f"CASE WHEN <i> = {at} THEN {d.append('b', 'x')} ELSE b END")
    merge = d.fold("ls", d.empty(blocks), "acc", "x", f"CASE WHEN {at} > 0 THEN {placed} ELSE {d.append('acc', d.array('x'))} END")
    box_kind = {"x0": "DOUBLE", "y0": "DOUBLE", "x1": "DOUBLE", "y1": "DOUBLE"}
    # a label within 16 points that widens the body joins it; as many passes as labels
    grows = "greatest(a.x0 - x.x1, x.x0 - a.x1, 0) <= 16 AND (x.x0 < a.x0 - 0.5 OR x.x1 > a.x1 + 0.5)"
    joined = d.struct(**{c: f"{f}(a.{c}, x.{c})" for c, f in (("x0", "least"), ("y0", "least"), ("x1", "greatest"), ("y1", "greatest"))})
    core = d.struct(**{c: f"CAST({c} AS DOUBLE)" for c in box_kind})
    one_pass = d.fold("labels", "g", "a", "x", f"CASE WHEN {grows} THEN {joined} ELSE a END")
    passes = "sequence(1, greatest(1, size(labels)))" if d.name == "spark" else "range(0, greatest(1, len(labels)))"
    grown = d.fold(passes, core, "g", "k", one_pass)
    # the title goes on with lines that follow closely below the last one
    follows = "x.y0 > cur.y0 + 0.5 AND x.y0 - cur.y1 < 5 AND x.x0 < cur.x1 AND x.x1 > cur.x0 AND x.plain"
    state = d.struct(n="CAST(1 AS INT)", top="CAST(y0 AS DOUBLE)", x0="CAST(x0 AS DOUBLE)", y0="CAST(y0 AS DOUBLE)", x1="CAST(x1 AS DOUBLE)", y1="CAST(y1 AS DOUBLE)")
    moved = d.struct(n="CAST(cur.n + 1 AS INT)", top="least(cur.top, x.y0)", x0="x.x0", y0="x.y0", x1="x.x1", y1="x.y1")
    title_lines = d.fold("ls", state, "cur", "x", f"CASE WHEN {follows} THEN {moved} ELSE cur END")
    gap = "CASE WHEN {s}side = 'above' THEN {s}y0 - r.y1 ELSE r.y0 - {s}y1 END"
    owner_gap = "CASE WHEN {s}side = 'above' THEN {s}y0 - o.r1 ELSE o.r0 - {s}y1 END"
    page = "a.doc_id = b.doc_id AND a.page = b.page"
    return {
        # Anchors, in reading order
        "line_heads": f"SELECT *, {d.group('text', S.CAPTION_HEAD, 1)} AS word, {d.group('text', S.CAPTION_HEAD, 2)} AS idx, {d.group('text', S.CAPTION_HEAD, 3)} AS rest FROM lines",
        "line_titles": f"SELECT *, trim({d.group('rest', S.AFTER_MARK, 1)}) AS marked, trim({d.group('rest', S.AFTER_SPACE, 1)}) AS spaced FROM line_heads",
        "line_captions": f"SELECT *, CASE WHEN word <> '' AND (marked <> '' OR spaced <> '' AND NOT {S.is_prose(d, 'spaced')}) THEN CASE WHEN lower(word) LIKE 'table%' THEN 'table' ELSE 'figure' END END AS kind, CASE WHEN marked <> '' THEN marked ELSE spaced END AS title FROM line_titles",
        "anchors": f"SELECT doc_id, page, line_seq AS anchor_id, kind, idx, title, {BOX} FROM line_captions WHERE kind IS NOT NULL",
        # Groups of tables of one index
        "table_parts": f"""SELECT doc_id, page, anchor_id, idx, {S.marker(d, 'title')} AS mark, row_number() OVER (PARTITION BY doc_id, idx ORDER BY page, y0, anchor_id) AS part,
          count(*) OVER (PARTITION BY doc_id, idx) AS parts, max(CASE WHEN {S.marker(d, 'title')} IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, idx) AS any_mark FROM anchors WHERE kind = 'table'""",
        "table_groups": f"""SELECT doc_id, page, anchor_id, idx, CASE WHEN parts > 1 AND any_mark = 1 OR part = 1 THEN {S.group_id(d, 'idx')} ELSE {S.bumped(d, S.group_id(d, 'idx'), '(part - 1)')} END AS group_id,
          CAST(CASE WHEN parts > 1 AND any_mark = 1 THEN part ELSE 1 END AS INT) AS part_index, parts > 1 AND any_mark = 1 AND part > 1 AS is_continuation, CASE WHEN parts > 1 AND any_mark = 1 AND part > 1 THEN mark END AS continuation_marker FROM table_parts""",
        # lines of the page's margins
        "margin_lines": f"""SELECT l.doc_id, l.page, k.kind, l.line_seq, l.text, l.{BOX.replace(', ', ', l.')}, p.width FROM lines l JOIN layout_pages p ON l.doc_id = p.doc_id AND l.page = p.page CROSS JOIN (VALUES ('header'), ('footer')) AS k(kind)
          WHERE NOT {S.is_watermark(d, 'l.text')} AND CASE WHEN k.kind = 'header' THEN l.y0 < 80 ELSE l.y1 > p.height - 80 END""",
        # IT2: lines merged into blocks
        "margin_stacks": f"SELECT doc_id, page, kind, width, {d.gather(line)} AS ls FROM margin_lines GROUP BY doc_id, page, kind, width",
        "margin_merged": f"SELECT doc_id, page, kind, width, {merge} AS blocks FROM margin_stacks",
        "margin_blocks": f"SELECT *, {'size' if d.name == 'spark' else 'len'}(blocks) AS many FROM margin_merged",
        "margin_block": d.explode("margin_blocks", "doc_id, page, kind, width, many", "blocks", "block"),
        # Bands; corners are found before they are rounded
        "band_corners": f"""SELECT doc_id, page, kind, width, many, block, greatest(0, {_fold_min(d, 'x0')} - 3) AS x0, {_fold_min(d, 'y0')} AS y0, least(width, {_fold_max(d, 'x1')} + 3) AS x1 FROM margin_block""",
        "bands": f"""SELECT doc_id, page, kind, {d.first('block')}.line_seq AS pos, {d.join(d.map('block', 'v', 'v.text'), 'chr(10)')} AS text, concat(kind, '|', {d.join(d.map('block', 'v', S.common_key(d, 'v.text')), "'|'")}) AS id_key,
          CASE WHEN many = 1 THEN CAST(48 AS DOUBLE) ELSE {d.hundredths('x0')} END AS x0, {d.hundredths('y0')} AS y0, CASE WHEN many = 1 THEN width - 48 ELSE {d.hundredths('x1')} END AS x1,
          {d.hundredths('y0')} + 35 + 6 * ({'size' if d.name == 'spark' else 'len'}(block) - 1) AS y1 FROM band_corners""",
        "watermarks": f"""SELECT l.doc_id, l.page, 'watermark' AS kind, l.line_seq AS pos, l.text, concat('wm|', {S.common_key(d, 'l.text')}) AS id_key, greatest(0, l.x0 - 18) AS x0, greatest(0, l.y0 - 18) AS y0, least(p.width, l.x1 + 18) AS x1, least(p.height, l.y1 + 18) AS y1
          FROM lines l JOIN layout_pages p ON l.doc_id = p.doc_id AND l.page = p.page WHERE {S.is_watermark(d, 'l.text')}""",
        # Ids by first appearance
        "common_all": f"SELECT doc_id, page, kind, pos, text, id_key, {BOX} FROM bands UNION ALL SELECT doc_id, page, kind, pos, text, id_key, {BOX} FROM watermarks",
        # ids by first place: keys are few, so they are ranked before their many places are looked at
        "common_keys": "SELECT doc_id, kind, id_key, min(page * 100000 + pos) AS first_pos FROM common_all GROUP BY doc_id, kind, id_key",
        "common_ids": f"SELECT doc_id, kind, id_key, concat(CASE kind WHEN 'header' THEN 'hdr_' WHEN 'footer' THEN 'ftr_' ELSE 'wm_' END, lpad(CAST(dense_rank() OVER (PARTITION BY doc_id, kind ORDER BY first_pos) AS {t}), 3, '0')) AS region_id FROM common_keys",
        "commons": f"SELECT c.doc_id, c.page, c.kind, c.pos, c.text, i.region_id, {_c('c.')} FROM common_all c JOIN common_ids i ON i.doc_id = c.doc_id AND i.kind = c.kind AND i.id_key = c.id_key",
        # Nearest drawing above and below
        "nearest": f"""SELECT a.doc_id, a.page, a.anchor_id, a.kind, a.y0, min(CASE WHEN r.y1 <= a.y0 + 2 THEN a.y0 - r.y1 END) AS gap_above, min(CASE WHEN r.y0 >= a.y1 - 2 THEN r.y0 - a.y1 END) AS gap_below
          FROM anchors a LEFT JOIN drawings r ON a.doc_id = r.doc_id AND a.page = r.page GROUP BY a.doc_id, a.page, a.anchor_id, a.kind, a.y0""",
        "nearest_text": f"""SELECT a.doc_id, a.page, a.anchor_id, min(CASE WHEN r.y1 <= a.y0 + 2 THEN a.y0 - r.y1 END) AS gap_above, min(CASE WHEN r.y0 >= a.y1 - 2 THEN r.y0 - a.y1 END) AS gap_below
          FROM anchors a LEFT JOIN lines r ON a.doc_id = r.doc_id AND a.page = r.page AND {S.shared_area('r.', 'a.')} <= 0.3 * {S.area('r.')} GROUP BY a.doc_id, a.page, a.anchor_id""",
        "sides": f"""SELECT n.doc_id, n.page, n.kind, n.y0, n.anchor_id, {_side('n.')} AS drawn, {_side('x.')} AS written FROM nearest n JOIN nearest_text x ON n.doc_id = x.doc_id AND n.page = x.page AND n.anchor_id = x.anchor_id""",
        # The side of a kind, from the first caption that tells
        "ranked_sides": """SELECT *, row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY CASE WHEN drawn IS NULL THEN 1 ELSE 0 END, y0, anchor_id) AS by_drawing, row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY CASE WHEN written IS NULL THEN 1 ELSE 0 END, y0, anchor_id) AS by_text FROM sides""",
        "orientation": "SELECT doc_id, page, kind, coalesce(max(CASE WHEN by_drawing = 1 THEN drawn END), max(CASE WHEN by_text = 1 THEN written END), 'below') AS side FROM ranked_sides GROUP BY doc_id, page, kind",
        "sided": "SELECT a.*, o.side FROM anchors a JOIN orientation o ON a.doc_id = o.doc_id AND a.page = o.page AND a.kind = o.kind",
        # Drawings owned by the nearest caption on its side
        "side_gaps": f"SELECT b.doc_id, b.page, b.anchor_id, r.draw_seq, r.x0 AS r_x0, r.y0 AS r_y0, r.x1 AS r_x1, r.y1 AS r_y1, {gap.format(s='b.')} AS gap FROM sided b JOIN drawings r ON b.doc_id = r.doc_id AND b.page = r.page",
        "near_gaps": "SELECT * FROM side_gaps WHERE gap >= -2",
        "owned": "SELECT doc_id, page, anchor_id, draw_seq, r_x0 AS x0, r_y0 AS y0, r_x1 AS x1, r_y1 AS y1 FROM (SELECT *, min(gap) OVER (PARTITION BY doc_id, page, draw_seq) AS least_gap FROM near_gaps) AS a WHERE NOT least_gap < gap - 0.5",
        # Zone between other captions and header or footer bands; J4: two columns
        "fences": f"SELECT doc_id, page, anchor_id AS fence, {BOX} FROM anchors UNION ALL SELECT doc_id, page, -1 AS fence, {BOX} FROM commons WHERE kind <> 'watermark'",
        "zones": f"""SELECT a.doc_id, a.page, a.anchor_id, CASE WHEN a.side = 'above' THEN greatest(30, coalesce(max(CASE WHEN f.y1 <= a.y0 + 2 AND {S.x_meets('f.', 'a.', 2)} THEN f.y1 END), 30)) ELSE a.y1 END AS lo,
          CASE WHEN a.side = 'above' THEN a.y0 ELSE least(p.height - 30, coalesce(min(CASE WHEN f.y0 >= a.y1 - 2 AND {S.x_meets('f.', 'a.', 2)} THEN f.y0 END), p.height - 30)) END AS hi,
          coalesce(bool_or(f.fence >= 0 AND abs((f.y0 + f.y1) / 2 - (a.y0 + a.y1) / 2) < 25 AND (f.x1 <= a.x0 OR f.x0 >= a.x1)), false) AS two_columns
          FROM sided a JOIN layout_pages p ON a.doc_id = p.doc_id AND a.page = p.page LEFT JOIN fences f ON f.doc_id = a.doc_id AND f.page = a.page AND f.fence <> a.anchor_id GROUP BY a.doc_id, a.page, a.anchor_id, a.side, a.x0, a.y0, a.x1, a.y1, p.height""",
        # Drawings of the zone
        "zone_drawings": f"""SELECT w.doc_id, w.page, w.anchor_id, a.kind, w.draw_seq, {_c('w.')}, CASE WHEN a.side = 'above' THEN a.y0 - w.y1 ELSE w.y0 - a.y1 END AS gap FROM owned w JOIN sided a ON w.doc_id = a.doc_id AND w.page = a.page AND w.anchor_id = a.anchor_id
          JOIN zones z ON z.doc_id = a.doc_id AND z.page = a.page AND z.anchor_id = a.anchor_id WHERE w.y1 >= z.lo - 2 AND w.y0 <= z.hi + 2 AND CASE WHEN a.side = 'above' THEN w.y1 <= a.y0 + 2 ELSE w.y0 >= a.y1 - 2 END AND (NOT z.two_columns OR {S.x_meets('w.', 'a.', 2)})""",
        # Islands of drawings in y; the island of the seed
        "island_edges": "SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY doc_id, page, anchor_id ORDER BY y0, draw_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 35 THEN 1 ELSE 0 END AS fresh FROM zone_drawings WHERE kind = 'figure'",
        "islands": "SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, anchor_id ORDER BY y0, draw_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island, row_number() OVER (PARTITION BY doc_id, page, anchor_id ORDER BY abs(gap), draw_seq) AS seed FROM island_edges",
        "clusters": "SELECT * FROM (SELECT *, max(CASE WHEN seed = 1 THEN island END) OVER (PARTITION BY doc_id, page, anchor_id) AS chosen FROM islands) AS i WHERE island = chosen",
        "core_members": f"SELECT doc_id, page, anchor_id, draw_seq, {BOX} FROM clusters UNION ALL SELECT doc_id, page, anchor_id, draw_seq, {BOX} FROM zone_drawings WHERE kind = 'table' AND y1 - y0 >= 45 AND x1 - x0 >= 100",
        # The frame that holds most, else the union
        "frames": f"""SELECT f.doc_id, f.page, f.anchor_id, f.draw_seq, {_c('f.')}, sum({S.area('m.')}) AS held FROM core_members f JOIN core_members m ON f.doc_id = m.doc_id AND f.page = m.page AND f.anchor_id = m.anchor_id AND {S.shared_area('m.', 'f.')} >= 0.6 * {S.area('m.')}
          WHERE {S.area('f.')} >= 8000 GROUP BY f.doc_id, f.page, f.anchor_id, f.draw_seq, {_c('f.')}""",
        "best_frames": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, anchor_id ORDER BY held DESC, draw_seq) AS rn FROM frames) AS f WHERE rn = 1 AND held > 0",
        "core_union": f"SELECT doc_id, page, anchor_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, coalesce(nullif(sum({S.area('')}), 0), 1) AS total FROM core_members GROUP BY doc_id, page, anchor_id",
        "drawn_cores": f"""SELECT u.doc_id, u.page, u.anchor_id, {', '.join(f'CASE WHEN f.held >= 0.62 * u.total THEN f.{c} ELSE u.{c} END AS {c}' for c in box_kind)} FROM core_union u
          LEFT JOIN best_frames f ON u.doc_id = f.doc_id AND u.page = f.page AND u.anchor_id = f.anchor_id""",
        # lines that belong to no body
        "watermark_texts": "SELECT DISTINCT doc_id, page, trim(text) AS text FROM commons WHERE kind = 'watermark'",
        "zone_lines": f"""SELECT a.doc_id, a.page, a.anchor_id, a.kind, a.side, l.line_seq, {_c('l.')} FROM sided a JOIN zones z ON a.doc_id = z.doc_id AND a.page = z.page AND a.anchor_id = z.anchor_id JOIN lines l ON l.doc_id = a.doc_id AND l.page = a.page AND l.y0 >= z.lo - 2 AND l.y1 <= z.hi + 2
          WHERE {S.shared_area('l.', 'a.')} <= 0.3 * {S.area('l.')} AND NOT EXISTS (SELECT 1 FROM watermark_texts w WHERE w.doc_id = l.doc_id AND w.page = l.page AND w.text = trim(l.text))
          AND NOT EXISTS (SELECT 1 FROM commons c WHERE c.doc_id = l.doc_id AND c.page = l.page AND c.kind <> 'watermark' AND {S.shared_area('l.', 'c.')} > 0.3 * {S.area('l.')})""",
        # Rows of a table without a grid, up to the first wide gap
        "row_gaps": """SELECT *, CASE WHEN side = 'above' THEN (min(y0) OVER w) - y1 ELSE y0 - (max(y1) OVER w) END AS gap, CASE WHEN side = 'above' THEN -y0 ELSE y0 END AS o FROM zone_lines WHERE kind = 'table'
          WINDOW w AS (PARTITION BY doc_id, page, anchor_id ORDER BY CASE WHEN side = 'above' THEN -y0 ELSE y0 END, line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "row_runs": "SELECT *, sum(CASE WHEN gap > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, anchor_id ORDER BY o, line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM row_gaps",
        "row_cores": "SELECT doc_id, page, anchor_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM row_runs WHERE run = 0 GROUP BY doc_id, page, anchor_id",
        "cores": f"""SELECT a.doc_id, a.page, a.anchor_id, a.side, {', '.join(f'coalesce(c.{x}, r.{x}) AS {x}' for x in box_kind)} FROM sided a LEFT JOIN drawn_cores c ON a.doc_id = c.doc_id AND a.page = c.page AND a.anchor_id = c.anchor_id
          LEFT JOIN row_cores r ON a.kind = 'table' AND a.doc_id = r.doc_id AND a.page = r.page AND a.anchor_id = r.anchor_id WHERE c.anchor_id IS NOT NULL OR r.anchor_id IS NOT NULL""",
        # IT1: labels beside the core, in line order
        "core_labels": f"""SELECT c.doc_id, c.page, c.anchor_id, {d.gather(d.struct(line_seq='l.line_seq', x0='l.x0', y0='l.y0', x1='l.x1', y1='l.y1'))} AS labels FROM cores c JOIN zone_lines l ON c.doc_id = l.doc_id AND c.page = l.page AND c.anchor_id = l.anchor_id
          WHERE l.x1 - l.x0 <= 180 AND {S.y_meets('l.', 'c.', 2)} GROUP BY c.doc_id, c.page, c.anchor_id""",
        "grown": f"SELECT c.doc_id, c.page, c.anchor_id, CASE WHEN labels IS NULL THEN {core} ELSE {grown} END AS g FROM cores c LEFT JOIN core_labels l ON c.doc_id = l.doc_id AND c.page = l.page AND c.anchor_id = l.anchor_id",
        "bodies": """SELECT g.doc_id, g.page, g.anchor_id, greatest(0, g.g.x0 - 2) AS x0, greatest(z.lo, g.g.y0 - 2) AS y0, least(p.width, g.g.x1 + 2) AS x1, least(z.hi, g.g.y1 + 2) AS y1 FROM grown g JOIN zones z ON g.doc_id = z.doc_id AND g.page = z.page AND g.anchor_id = z.anchor_id
          JOIN layout_pages p ON p.doc_id = g.doc_id AND p.page = g.page""",
        # IT3: lines of a title
        "page_stacks": f"SELECT doc_id, page, {d.gather(d.struct(y0='y0', line_seq='line_seq', x0='x0', x1='x1', y1='y1', plain="kind IS NULL"))} AS ls FROM line_captions GROUP BY doc_id, page",
        "title_runs": f"SELECT a.doc_id, a.page, a.anchor_id, {title_lines} AS t FROM anchors a JOIN page_stacks s ON a.doc_id = s.doc_id AND a.page = s.page",
        # Caption bands, and bodies where none was found
        "captions": """SELECT a.doc_id, a.page, a.anchor_id, a.kind, a.idx, a.title, a.side, t.t.n AS title_lines, p.width, p.height, b.anchor_id IS NOT NULL AS found, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1,
          greatest(0, CASE WHEN b.anchor_id IS NULL THEN 54 WHEN a.kind = 'table' THEN b.x0 ELSE greatest(54, b.x0) END) AS x0, greatest(0, t.t.top - 1) AS y0,
          least(p.width, CASE WHEN b.anchor_id IS NULL THEN p.width - 54 WHEN a.kind = 'table' THEN b.x1 ELSE least(p.width - 54, b.x1) END) AS x1, t.t.top + 23 + 18 * (t.t.n - 1) AS y1
          FROM sided a JOIN title_runs t ON a.doc_id = t.doc_id AND a.page = t.page AND a.anchor_id = t.anchor_id JOIN layout_pages p ON p.doc_id = a.doc_id AND p.page = a.page LEFT JOIN bodies b ON a.doc_id = b.doc_id AND a.page = b.page AND a.anchor_id = b.anchor_id""",
        "placed": f"""SELECT doc_id, page, anchor_id, kind, idx, title, title_lines, width, height, {BOX}, CASE WHEN found THEN bx0 ELSE x0 END AS bx0, CASE WHEN found THEN by0 ELSE y0 END AS by0, CASE WHEN found THEN bx1 ELSE x1 END AS bx1, CASE WHEN found THEN by1 ELSE y1 END AS by1,
          CASE WHEN NOT found OR side = 'above' THEN 'below' ELSE 'above' END AS title_position, CASE WHEN NOT found THEN 0 WHEN side = 'above' THEN {d.half_even('greatest(0, y0 - by1) / 12')} ELSE {d.half_even('greatest(0, by0 - y1) / 12')} END AS gap_lines FROM captions""",
        # Limits from bodies of the same column
        "limits": """SELECT a.doc_id, a.page, a.anchor_id, greatest(86, coalesce(max(CASE WHEN b.by1 <= a.by0 THEN b.by1 END), 86)) AS y_lo, least(a.height - 86, coalesce(min(CASE WHEN b.by1 > a.by0 AND b.by0 >= a.by1 THEN b.by0 END), a.height - 86)) AS y_hi
          FROM placed a LEFT JOIN placed b ON a.doc_id = b.doc_id AND a.page = b.page AND a.anchor_id <> b.anchor_id AND b.bx1 > a.bx0 AND b.bx0 < a.bx1 GROUP BY a.doc_id, a.page, a.anchor_id, a.height""",
        # C4: objects with caption, body and context
        "objects": """SELECT a.doc_id, a.page, a.anchor_id, a.kind, a.idx, a.title, a.title_position, a.gap_lines, g.group_id AS table_group_id, g.part_index, g.is_continuation, g.continuation_marker, CASE WHEN g.is_continuation THEN g.group_id END AS continued_from,
          a.x0 AS cap_x0, a.y0 AS cap_y0, a.x1 AS cap_x1, a.y1 AS cap_y1, a.bx0 AS body_x0, a.by0 AS body_y0, a.bx1 AS body_x1, a.by1 AS body_y1, greatest(0, least(a.x0, a.bx0) - 8) AS ctx_x0, greatest(least(l.y_lo, a.y0, a.by0), least(a.y0, a.by0) - 8) AS ctx_y0,
          least(a.width, greatest(a.x1, a.bx1) + 8) AS ctx_x1, least(greatest(l.y_hi, a.y1, a.by1), greatest(a.y1, a.by1) + 8) AS ctx_y1
          FROM placed a JOIN limits l ON a.doc_id = l.doc_id AND a.page = l.page AND a.anchor_id = l.anchor_id LEFT JOIN table_groups g ON a.kind = 'table' AND a.doc_id = g.doc_id AND a.page = g.page AND a.anchor_id = g.anchor_id""",
    }


def _fold_min(d, c: str) -> str:
    return (f"array_min(transform(block, v -> v.{c}))" if d.name == "spark" else f"list_min(list_transform(block, lambda v: v.{c}))")


def _fold_max(d, c: str) -> str:
    return (f"array_max(transform(block, v -> v.{c}))" if d.name == "spark" else f"list_max(list_transform(block, lambda v: v.{c}))")


def _side(p: str) -> str:
    a, b = f"{p}gap_above", f"{p}gap_below"
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL WHEN {a} IS NULL THEN 'below' WHEN {b} IS NULL THEN 'above' WHEN {a} <= {b} THEN 'above' ELSE 'below' END"
