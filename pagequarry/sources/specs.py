"""Case specifications derived from the driver's tables: pages, headers and footers, watermarks, figures, tables, sequences.

A customer is a case. Sizes, templates, jitter, boxes and faults follow from its key by integer
arithmetic, so every axis of the corpus and every gate has cases that meet it and cases that
don't. Boxes are whole numbers, opacities multiples of 1/16.
"""

from __future__ import annotations

from ..functions import scalars as S
from ..operators.validate import FIGURE_ALIASES, FIGURE_BODIES, PAGE_SIZES, TEMPLATES

# Fixed values of the contracts.
HEADER_TEMPLATES = ("Chapter {chapter} · Page {page}", "{subtitle} · {page}", "Technical Reference Manual", "{subtitle}", "Synthetic Reference Guide", "Synthetic Reference — Chapter {chapter}\nSubsection {chapter}.2 — Timing detail")
FOOTER_TEMPLATES = ("Confidential — {page}", "Rev A · {page}", "Internal Use Only", "{page}", "Page {page} of {pages}", "Synthetic distribution notice", "Synthetic distribution — internal use only\nDocument 7788 · Page {page}")
WATERMARK_TEMPLATES = ("DRAFT", "Licensed to {user}", "CONFIDENTIAL")
CORE_NAMES = ("core_fixed_header_footer", "core_variable_subtitle_header", "core_fixed_watermark", "core_figure_caption_bottom", "core_figure_caption_top", "core_multipage_table_cont", "core_same_title_tables", "core_wide_diagram_xrange")
NEGATIVE_NAMES = ("neg_plain_text_only", "neg_false_figure_of_merit", "neg_false_see_table_above", "neg_caption_reference_only", "neg_false_table_reference", "neg_weak_partial_header")
NEGATIVE_KINDS = ("plain_text", "figure_of_merit", "see_table_above", "figure_ref_only", "table_ref_only", "weak_partial_header")
LINE, CAPTION_HEIGHT, ITEM_GAP, CONTEXT_MARGIN = 12, 18, 12, 8


def list_templates() -> dict[str, list]:
    """What a scenario may name, by field."""
    return {"header": list(TEMPLATES["header"]), "footer": list(TEMPLATES["footer"]), "watermark": list(TEMPLATES["watermark"]), "table_caption": ["normal", "continued"], "figure_alias": list(FIGURE_ALIASES), "figure_body": list(FIGURE_BODIES), "caption_position": ["above", "below"], "watermark_location": ["center", "corner"], "page_size": list(PAGE_SIZES), "orientation": ["portrait", "landscape"], "columns": [1, 2]}


def quoted(text: str) -> str:
    """A text as SQL, with its line breaks."""
    parts = [f"'{x}'" for x in text.split("\n")]
    return parts[0] if len(parts) == 1 else f"concat({', chr(10), '.join(parts)})"


def choice(number: str, values) -> str:
    """The value at number modulo how many there are."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(values)) + " END"


def jitter(page: str, amplitude: str, step: int) -> str:
    """An offset of a page between -amplitude and amplitude."""
    return f"CASE WHEN {amplitude} > 0 THEN ({page} * {step}) % (2 * {amplitude} + 1) - {amplitude} ELSE 0 END"


def rendered(d, template: str, page: str, pages: str, offset: str, subtitle: str, user: str, chapter: str = "'2'") -> str:
    """A template with page, pages, chapter, subtitle and user filled in."""
    out = template
    for name, value in (("page", f"CAST({page} + {offset} AS {d.text})"), ("pages", f"CAST({pages} + {offset} AS {d.text})"), ("chapter", chapter), ("subtitle", subtitle), ("user", user)):
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


def relations(d) -> dict[str, str]:
    t = d.text
    text = lambda x: f"CAST({x} AS {t})"
    number = lambda x: f"CAST({x} AS DOUBLE)"
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(CORE_NAMES + NEGATIVE_NAMES, 1))
    core, negative = len(CORE_NAMES), len(CORE_NAMES + NEGATIVE_NAMES)
    kinds = " ".join(f"WHEN {core + k} THEN 'neg.kind:{n}'" for k, n in enumerate(NEGATIVE_KINDS, 1))
    sizes = ", ".join(f"('{n}', {number(w)}, {number(h)})" for n, (w, h) in PAGE_SIZES.items())
    hf = "SELECT k, '{slot}' AS slot, '{kind}' AS kind, {on} AS enabled, {template} AS template, k % 2 = 0 AS variable_text, k % 10 = {a} AS mirrored, k % 7 = {b} AS rule_line, k % 15 = {c} AS first_suppressed, k % 12 = {e} AS odd_only, CASE WHEN k % 9 = {f} THEN 3 ELSE 0 END AS jx, CASE WHEN k % 9 = {f} THEN 2 ELSE 0 END AS jy, CASE WHEN k % 14 = {b} THEN 2 ELSE 0 END AS rjy, 60 AS x0, {y0} AS y0, 400 AS x1, {y1} AS y1 FROM case_specs"
    slots = (("header", "header", "k % 4 <> 1", choice("k", HEADER_TEMPLATES), 0, 1, 2, 3, 4, "36", "60"), ("footer", "footer", "k % 3 <> 1", choice("k", FOOTER_TEMPLATES), 5, 2, 7, 8, 4, "CAST(height - 60 AS INT)", "CAST(height - 36 AS INT)"), ("extra", "footer", "k % 17 = 0", choice("k", FOOTER_TEMPLATES[:3]), 1, 3, 4, 5, 6, "CAST(height - 90 AS INT)", "CAST(height - 66 AS INT)"))
    page_no = f"SELECT s.*, c.case_id, c.page_count, c.page_offset, c.width, c.height, p.page_no FROM {{0}} s JOIN case_specs c ON s.k = c.k JOIN case_pages_of p ON p.k = s.k"
    dx, dy = jitter("page_no", "jx", 3), jitter("page_no", "jy", 2)
    flip = "mirrored AND page_no % 2 = 0"
    index = f"CASE (k + j) % 4 WHEN 0 THEN {text('j')} WHEN 1 THEN concat({text('k % 9 + 1')}, '.', {text('j')}) WHEN 2 THEN concat({text('k % 9 + 1')}, '-', {text('j')}) ELSE concat('A.', {text('j')}) END"
    title = f"CASE WHEN (k + j) % 11 = 0 THEN concat('Title ', {text('(k + j) % 3')}, chr(10), 'second line') ELSE concat('Title ', {text('(k + j) % 3')}) END"
    gap = f"CASE WHEN position_ = 'below' THEN cap_y0 - body_y1 ELSE body_y0 - cap_y1 END"
    lines = d.half_even(f"greatest(0, {gap}) / {LINE}")
    return {
        "page_sizes": f"SELECT * FROM (VALUES {sizes}) AS v(size_, w, h)",
        # Dimensions by size and orientation
        "case_specs": f"""SELECT c.*, CASE WHEN orientation = 'landscape' THEN s.h ELSE s.w END AS width, CASE WHEN orientation = 'landscape' THEN s.w ELSE s.h END AS height FROM (SELECT c_custkey AS k, CASE c_custkey {names} ELSE concat('case_', {text('c_custkey')}) END AS case_id,
          CASE WHEN c_custkey BETWEEN 1 AND {core} THEN 'core' WHEN c_custkey BETWEEN {core + 1} AND {negative} THEN 'negative' ELSE 'sequence' END AS axis, CASE WHEN c_custkey % 3 = 0 THEN 'a4' ELSE 'letter' END AS size_, CASE WHEN c_custkey % 5 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation,
          CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS columns_, CASE c_custkey % 7 WHEN 0 THEN 8 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 1 END AS page_count, CASE WHEN c_custkey % 6 = 0 THEN 10 ELSE 0 END AS page_offset, c_custkey % 29 = 0 AS stress FROM customer) AS c JOIN page_sizes s ON c.size_ = s.size_""",
        "case_pages_of": f"SELECT k, CAST(page_no AS INT) AS page_no FROM ({d.explode('case_specs', 'k', d.steps('page_count'), 'page_no')}) AS x",
        "hf_specs": " UNION ALL ".join(hf.format(slot=s, kind=kind, on=on, template=tp, a=a, b=b, c=c, e=e, f=f, y0=y0, y1=y1) for s, kind, on, tp, a, b, c, e, f, y0, y1 in slots),
        # What a header or footer shows on each page
        "hf_shown": f"SELECT * FROM ({page_no.format('hf_specs')}) AS x WHERE enabled AND NOT (first_suppressed AND page_no = 1) AND NOT (odd_only AND page_no % 2 = 0)",
        "hf_pages": f"""SELECT k, case_id, slot, kind, page_no, width, height, variable_text, {rendered(d, 'template', 'page_no', 'page_count', 'page_offset', f"concat('Section ', {text('page_no % 4 + 1')})", "'rtm@example.test'")} AS text,
          CASE WHEN {flip} THEN width - x1 ELSE x0 END + {dx} AS x0, y0 + {dy} AS y0, CASE WHEN {flip} THEN width - x0 ELSE x1 END + {dx} AS x1, y1 + {dy} AS y1, CASE WHEN rule_line THEN CASE WHEN kind = 'header' THEN y1 ELSE y0 END + {dy} + {jitter('page_no', 'rjy', 3)} END AS rule_y FROM hf_shown""",
        "wm_specs": f"""SELECT k, k % 3 = 0 AS enabled, {choice('k', WATERMARK_TEMPLATES)} AS template, k % 6 = 0 AS variable_text, CASE WHEN k % 4 = 0 THEN 45 ELSE 0 END AS rotation, {number('CASE WHEN k % 9 = 0 THEN 4 ELSE 2 END')} / 16 AS opacity, CASE WHEN k % 5 = 0 THEN 'corner' ELSE 'center' END AS location_, k % 21 = 0 AS image_like,
          CASE WHEN k % 12 = 0 THEN 4 ELSE 0 END AS jx, CASE WHEN k % 18 = 0 THEN 5 ELSE 0 END AS jitter_rot, {number('CASE WHEN k % 15 = 0 THEN 1 ELSE 0 END')} / 16 AS jitter_opacity, k % 33 = 0 AS near_footer, 150 AS x0, 350 AS y0, 450 AS x1, 420 AS y1 FROM case_specs""",
        # A watermark on each page
        "wm_pages": f"""SELECT k, case_id, page_no, width, height, {rendered(d, 'template', 'page_no', '1', 'page_offset', "'Overview'", f"CASE WHEN variable_text THEN concat('user', {text('page_no')}, '@example.test') ELSE 'fixed@example.test' END")} AS text, x0 + {jitter('page_no', 'jx', 3)} AS x0, y0 + {jitter('page_no', 'jx', 2)} AS y0, x1 + {jitter('page_no', 'jx', 3)} AS x1, y1 + {jitter('page_no', 'jx', 2)} AS y1,
          rotation + ((page_no * 2) % 3 - 1) * jitter_rot AS rotation, CASE WHEN jitter_opacity > 0 THEN greatest({number('0.04')}, least({number('0.6')}, opacity + (page_no % 3 - 1) * jitter_opacity)) ELSE opacity END AS opacity, CASE WHEN image_like THEN 'image' WHEN rotation + ((page_no * 2) % 3 - 1) * jitter_rot <> 0 THEN 'diagonal' ELSE 'flat' END AS style FROM ({page_no.format('wm_specs')}) AS x WHERE enabled""",
        # IT5: items of a sequence below one another
        "item_plans": f"""SELECT k, case_id, width, height, j, CASE (k * 7 + j * 3) % 5 WHEN 0 THEN 'figure' WHEN 1 THEN 'figure' WHEN 2 THEN 'table' WHEN 3 THEN 'table' ELSE 'text' END AS kind, (k + j) % 3 AS gap, 60 + 20 * ((k + j) % 3) AS body_h, CASE WHEN (k + j) % 2 = 0 THEN 'below' ELSE 'above' END AS position_, 1 + (k + j) % 2 AS line_count, CASE WHEN k % 5 = 0 THEN least(page_count, j) ELSE 1 END AS page FROM case_specs CROSS JOIN (VALUES (1), (2), (3), (4)) AS n(j) WHERE j <= k % 4 + 1 AND axis <> 'negative'""",
        "item_heights": f"SELECT *, CASE WHEN kind = 'text' THEN {LINE} * line_count ELSE {CAPTION_HEIGHT} + {LINE} * gap + body_h END AS item_h FROM item_plans",
        "item_specs": f"SELECT *, 100 + coalesce(sum(item_h + {ITEM_GAP}) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y, CASE WHEN k % 6 = 1 THEN 36 ELSE 72 END AS x0, CASE WHEN k % 6 = 1 THEN 576 ELSE 540 END AS x1, {index} AS idx FROM item_heights",
        # A part of a continued table on each page
        "part_specs": f"SELECT k, case_id, width, height, CAST(part AS INT) AS part, concat('9.', {text('k % 7 + 1')}) AS idx FROM ({d.explode('case_specs', 'k, case_id, width, height', d.steps('2 + k % 3'), 'part')}) AS x WHERE k % 8 = 3",
        "target_specs": f"""SELECT k, case_id, width, height, kind, j, page, idx, {title} AS title, {choice('(k + j)', FIGURE_ALIASES)} AS alias_, {choice('(k + j)', FIGURE_BODIES)} AS body_kind, position_, {S.group_id(d, 'idx')} AS group_id, 1 AS part_index, false AS is_continuation, CAST(NULL AS {t}) AS marker, x0, x1,
          CASE WHEN position_ = 'below' THEN y + body_h + {LINE} * gap ELSE y END AS cap_y0, CASE WHEN position_ = 'below' THEN y + body_h + {LINE} * gap ELSE y END + {CAPTION_HEIGHT} AS cap_y1, CASE WHEN position_ = 'below' THEN y ELSE y + {CAPTION_HEIGHT} + {LINE} * gap END AS body_y0, CASE WHEN position_ = 'below' THEN y ELSE y + {CAPTION_HEIGHT} + {LINE} * gap END + body_h AS body_y1 FROM item_specs WHERE kind <> 'text'
          UNION ALL SELECT k, case_id, width, height, 'table', 10 + part, part, idx, 'Continued table', 'Table', 'grid', 'above', {S.group_id(d, 'idx')}, part, part > 1, CASE WHEN part > 1 THEN {choice('k', S.CONTINUATION)} END, 72, 540, 720, 738, 738, 788 FROM part_specs""",
        # Truth of the targets; some cases record a wrong position or gap
        "spec_truth": f"""SELECT k, case_id, width, height, kind, j, page, idx, title, group_id, part_index, is_continuation, marker, CASE WHEN k % 37 = 0 AND position_ = 'below' THEN 'above' WHEN k % 37 = 0 THEN 'below' ELSE position_ END AS title_position, {lines} + CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END AS gap_lines,
          {', '.join(f'{number(e)} AS {n}' for n, e in (('cap_x0', 'x0'), ('cap_y0', 'cap_y0'), ('cap_x1', 'x1'), ('cap_y1', 'cap_y1'), ('body_x0', 'x0'), ('body_y0', 'body_y0'), ('body_x1', 'x1'), ('body_y1', 'body_y1 + CASE WHEN k % 47 = 0 THEN 40 ELSE 0 END'), ('ctx_x0', f'greatest(0, x0 - {CONTEXT_MARGIN})'), ('ctx_y0', f'greatest(0, least(cap_y0, body_y0) - {CONTEXT_MARGIN})'), ('ctx_x1', f'least(width, x1 + {CONTEXT_MARGIN})'), ('ctx_y1', f'least(height, greatest(cap_y1, body_y1) + {CONTEXT_MARGIN})')))} FROM target_specs""",
        # text between the targets, and other text; some bands are too high or lie on a target
        "plain_specs": f"""SELECT k, case_id, page, j AS pos, 'interstitial_text' AS role, line_count, {number('x0')} AS x0, {number('y')} AS y0, {number('x1')} AS x1, {number(f'y + item_h + CASE WHEN k % 43 = 0 THEN 5 ELSE 0 END')} AS y1 FROM item_specs WHERE kind = 'text'
          UNION ALL SELECT k, case_id, page, 100 + j, 'filler', 0, cap_x0 + 5, body_y0 + 5, cap_x0 + 100, body_y0 + 15 FROM spec_truth WHERE k % 23 = 0 AND j = 1
          UNION ALL SELECT k, case_id, 1, 200, 'negative', 0, {number('72')}, {number('200')}, {number('500')}, {number('215')} FROM case_specs WHERE axis = 'negative'""",
        # the sequence as the case records it; some record it backwards
        "layout_sequence": "SELECT k, case_id, page, CASE WHEN k % 41 = 0 THEN 10 - j ELSE j END AS pos, kind, idx, line_count FROM item_specs",
        "case_hints": f"""SELECT k, CASE k {kinds} END AS hint FROM case_specs WHERE axis = 'negative' UNION ALL SELECT k, 'tbl.fragment:same_page_fragment' FROM case_specs WHERE k % 16 = 5
          UNION ALL SELECT k, 'hf.page_number_position:bottom_right' FROM case_specs WHERE k % 13 = 4 UNION ALL SELECT k, 'hf.subtitle_position:top_right' FROM case_specs WHERE k % 19 = 6""",
    }
