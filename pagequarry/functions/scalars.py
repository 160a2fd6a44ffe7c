"""Scalar operators as SQL expressions: captions, identities, geometry, names, coordinates.

`d` is the dialect. The patterns and lists in this block are fixed values of the contracts.
"""

from __future__ import annotations

# Fixed values.
CAPTION_HEAD = r"^\s*(Figure|Fig\.|FIGURE|Table)\s+([A-Za-z]{0,2}\.?\d+(?:[.\-]\d+)*)(.*)$"
AFTER_MARK = r"^[.:]\s+(\S.*)$"
AFTER_SPACE = r"^\s+(\S.*)$"
FIRST_WORD = r"^[^A-Za-z]*([A-Za-z][\w'\-]*)"
PROSE_VERBS = ("shows", "illustrates", "lists", "describes", "depicts", "presents", "summarizes", "summarises", "is", "are", "was", "were", "see")
CONTINUATION = ("(continued)", "(cont)", "continued", "Continued", "cont.")
WATERMARK = r"^(CONFIDENTIAL|DRAFT)$|^Licensed to\b"
OBJECT_ID = r"^(figure|table):([^:]+):page(\d+)$"
TASK_HINTS = {"figure": "diagram_or_waveform", "table": "table"}


def is_prose(d, title: str) -> str:
    """Whether a title reads as a sentence: no word, a verb of reference, or a lower-case first word."""
    w = d.group(title, FIRST_WORD, 1)
    verbs = ", ".join(f"'{v}'" for v in PROSE_VERBS)
    return f"({w} = '' OR lower({w}) IN ({verbs}) OR ({w} = lower({w}) AND {w} <> upper({w})))"


def marker(d, title: str) -> str:
    """The first continuation marker that ends the title, or null."""
    return "CASE " + " ".join(f"WHEN trim({title}) LIKE '%{m}' THEN '{m}'" for m in CONTINUATION) + " END"


def group_id(d, index: str) -> str:
    part = f"CASE WHEN {d.matches('v', '^[0-9]+$')} THEN lpad(v, CAST(greatest(3, length(v)) AS INT), '0') ELSE upper(v) END"
    return f"concat('tbl_', {d.join(d.map(d.filter(d.split(index, '[.-]'), 'u', "u <> ''"), 'v', part), repr('_'))})"


def bumped(d, group: str, times: str) -> str:
    """Another id for the table of that index that comes `times` later."""
    head, tail = d.group(group, r"^(.*)_([^_]*)$", 1), d.group(group, r"^(.*)_([^_]*)$", 2)
    number = f"CAST(CAST({tail} AS BIGINT) + {times} AS {d.text})"
    next_one = f"CAST({times} + 1 AS {d.text})"
    pad = lambda x: f"lpad({x}, CAST(greatest(3, length({x})) AS INT), '0')"
    return f"CASE WHEN {d.matches(tail, '^[0-9]+$')} THEN concat({head}, '_', {pad(number)}) ELSE concat({group}, '_', {pad(next_one)}) END"


def common_key(d, t: str) -> str:
    return d.replace(d.replace(f"lower(trim({t}))", r"\s+", " "), r"\d+", "#")


def letters_key(d, t: str) -> str:
    return d.replace(f"lower({t})", "[^a-z0-9]", "")


def is_watermark(d, t: str) -> str:
    return d.matches(f"trim({t})", WATERMARK)


def safe_index(d, index: str) -> str:
    dashed = d.replace(index, r"[^\p{L}\p{N}]", "-")
    return f"coalesce(nullif({d.replace(dashed, '^-+|-+$', '')}, ''), 'x')"


def object_id(d, kind: str, index: str, page: str) -> str:
    return f"concat({kind}, ':', {index}, ':page', CAST({page} AS {d.text}))"


def index_style(d, index: str) -> str:
    return f"CASE WHEN {d.matches(index, '[A-Za-z]')} THEN 'alpha' WHEN {index} LIKE '%-%' THEN 'dashed' WHEN {index} LIKE '%.%' THEN 'dotted' ELSE 'integer' END"


def hint(d, kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TASK_HINTS.items()) + " ELSE 'unknown' END"


# geometry of boxes a, b given as prefixes such as "c."


def area(a: str) -> str:
    return f"(greatest({a}x1 - {a}x0, 0) * greatest({a}y1 - {a}y0, 0))"


def shared_area(a: str, b: str) -> str:
    return f"(greatest(least({a}x1, {b}x1) - greatest({a}x0, {b}x0), 0) * greatest(least({a}y1, {b}y1) - greatest({a}y0, {b}y0), 0))"


def y_meets(a: str, b: str, pad: float = 0) -> str:
    return f"NOT ({a}y1 <= {b}y0 - {pad} OR {a}y0 >= {b}y1 + {pad})"


def x_meets(a: str, b: str, pad: float = 0) -> str:
    return f"NOT ({a}x1 <= {b}x0 - {pad} OR {a}x0 >= {b}x1 + {pad})"


def iou(a: str, b: str) -> str:
    """Intersection over union; 0 where both are empty."""
    both = shared_area(a, b)
    return f"coalesce({both} / nullif({area(a)} + {area(b)} - {both}, 0), 0)"


def center_in(a: str, b: str, pad: float = 0) -> str:
    """Whether the middle of a lies in b."""
    x, y = f"(({a}x0 + {a}x1) / 2)", f"(({a}y0 + {a}y1) / 2)"
    return f"({x} BETWEEN {b}x0 - {pad} AND {b}x1 + {pad} AND {y} BETWEEN {b}y0 - {pad} AND {b}y1 + {pad})"
