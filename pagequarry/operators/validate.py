"""Contract validators over JSON text: one row for each violation, none where the text is valid.

A text is parsed once. Each list becomes a relation of its items, with the path to them; a rule
is a condition on the item, and an item's broken rules are one array, exploded at the end.
Parsed scenarios and detector outputs are written once, never shredded: Parquet's shredded values don't tell 2 from 2.0.
The texts derive from events: a valid document of several items with one fault somewhere.
"""

from __future__ import annotations

# Fixed values of the contracts.
COMMON_KINDS = ("header", "footer", "watermark")
FIGURE_FIELDS = ("index", "title", "title_position", "title_body_gap_lines")
TABLE_FIELDS = ("index", "title", "table_group_id", "part_index", "is_continuation", "continuation_marker")
PRODUCER_FIELDS = ("name", "version", "mode")
OPERATIONS = ("update_bbox", "update_field", "add_object", "remove_object")
REGIONS = ("caption_region", "body_region", "context_region", "bbox")
DECISIONS = ("accept", "false_positive", "missed_object", "bad_caption_region", "bad_body_region", "bad_context_region", "wrong_title", "wrong_index", "common_region_issue")
REQUIRED_SETUP = ("project.name", "input.pdf_path", "output.artifact_dir")
PLACEHOLDER_SETUP = ("project.name", "input.pdf_path")
PAGE_SIZES = {"letter": (612, 792), "a4": (595, 842)}
TEMPLATES = {"header": ("chapter_page", "subtitle_page", "plain", "subtitle_only", "doc_title", "two_line"), "footer": ("confidential_page", "doc_rev_page", "plain", "page_only", "page_x_of_y", "distribution_notice", "bar_two_line"), "watermark": ("draft", "licensed", "confidential")}
FIGURE_BODIES = ("waveform", "diagram", "raster", "mixed")
FIGURE_ALIASES = ("Figure", "Fig.", "FIGURE")
# Exit code of each error; any other error is 2, none is 0.
EXIT_CODES = {
    "SCENARIO_FILE_NOT_FOUND": 2,
    "SCENARIO_FILE_UNREADABLE": 2,
    "SCENARIO_INVALID_VALUE": 2,
    "SCENARIO_UNKNOWN_TEMPLATE": 2,
    "SCENARIO_BAD_BBOX": 2,
    "SCENARIO_OUT_OF_PAGE_BOUNDS": 2,
    "SCENARIO_UNSUPPORTED_PAGE_SIZE": 2,
    "OUTPUT_DIR_EXISTS": 2,
    "INVALID_INPUT": 2,
    "SELF_CHECK_FAILED": 1,
    "PROMOTION_FAILED": 1,
    "COMPARE_FAILED": 1,
    "PDF_GENERATION_FAILED": 3,
    "OVERLAY_FAILED": 3,
}
OK, UNKNOWN_ERROR = 0, 2
UNREADABLE = "text is not valid JSON"


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


class Value:
    """Conditions on the value at a path of the column v."""

    def __init__(self, d, path: str = "", column: str = "v"):
        self.d, self.path, self.column = d, path, column

    def _of(self, method, *rest):
        return method(self.column, self.path, *rest)

    def has(self, *kinds: str) -> str:
        return self.d.is_kind(self.column, self.path, kinds)

    def lacks(self, *kinds: str) -> str:
        return f"NOT {self.has(*kinds)}"

    def one_of(self, *values: str) -> str:
        return f"({self.has('string')} AND {self._of(self.d.text_at)} IN ({_names(values)}))"

    @property
    def filled(self) -> str:
        return f"({self.has('string')} AND {self._of(self.d.text_at)} <> '')"

    @property
    def spoken(self) -> str:
        return f"({self.has('string')} AND trim({self._of(self.d.text_at)}) <> '')"

    @property
    def whole(self) -> str:
        return self.has("int", "bool")  # true and false are whole numbers where the reference asks for an int

    @property
    def falsy(self) -> str:
        """Absent, null, empty, zero or false."""
        first = Value(self.d, f"{self.path}[0]", self.column)
        return f"({self.has('absent', 'null')} OR {self.has('string', 'bool', 'int', 'number')} AND ({self._of(self.d.text_at)} IN ('', 'false') OR coalesce({self._of(self.d.number_at)}, 1) = 0) OR {self.has('array')} AND {first.has('absent')} OR {self.has('object')} AND {self.d.text_at(self.column, self.path)} = '{{}}')"

    @property
    def bbox(self) -> str:
        """V7: an array of exactly four numbers; true and false are no numbers."""
        return self._of(self.d.four_numbers)

    def corner(self, k: int) -> str:
        return self.d.number_at(self.column, f"{self.path}[{k}]")


def _broken(d, relation: str, rules: list[tuple[str, str, str]], prefix: str = "path") -> str:
    """doc and violation (path and rule) of every rule (path, words, condition) that holds on a row."""
    found = d.filter(d.array(*(f"CASE WHEN {bad} THEN '{path} {words}' END" for path, words, bad in rules)), "x", "x IS NOT NULL")
    head = f"concat({prefix}, broken)" if prefix else "broken"
    return f"SELECT doc, {head} AS violation FROM ({d.explode(relation, f'doc, {prefix}' if prefix else 'doc', found, 'broken')}) AS b"


def _field(d):
    """Values of a document whose fields were taken out as columns, so that its text is searched once a field and not once a rule."""

    def of(path: str) -> Value:
        column, _, rest = path.partition(".")
        return Value(d, rest, column)

    return of


def _fields(d, relation: str, names, more: str = "") -> str:
    return f"SELECT doc{more}, {', '.join(f'{d.at("v", n)} AS {n}' for n in names)} FROM {relation}"


def _coordinates(d) -> list[tuple[str, str, str]]:
    f = _field(d)
    return [("coordinate_unit", "must be pdf_pt", f"NOT {f('coordinate_unit').one_of('pdf_pt')}"), ("coordinate_origin", "must be top-left", f"NOT {f('coordinate_origin').one_of('top-left')}")]


def _version(d, value: str) -> tuple[str, str, str]:
    return ("schema_version", f"must be {value}", f"NOT {_field(d)('schema_version').one_of(value)}")


def _boxes(d, names, prefix: str = ".") -> list[tuple[str, str, str]]:
    return [(f"{prefix}{n}", "must be 4 numbers", f"NOT {Value(d, n).bbox}") for n in names]


def _optional_box(d, name: str) -> tuple[str, str, str]:
    v = Value(d, name)
    return (f".{name}", "must be 4 numbers when present", f"{v.lacks('absent', 'null')} AND NOT {v.bbox}")


def _detector(d) -> dict[str, str]:
    v = lambda path="": Value(d, path)
    t = d.text
    h = _field(d)
    root = [_version(d, "detector-output-v0"), *_coordinates(d), ("producer", "object is required", h("producer").lacks("object"))]
    root += [(f"producer.{f}", "is required", f"{h('producer').has('object')} AND {h(f'producer.{f}').falsy}") for f in PRODUCER_FIELDS] + [("cases", "must be a list", "NOT cases_ok")]
    page_name = f"coalesce(CASE WHEN {Value(d, 'page').has('int')} THEN {d.text_at('v', 'page')} END, '?')"
    part = lambda name: f"SELECT doc, concat(path, '.{name}[', CAST(i AS {t}), ']') AS path, v FROM ({d.items('det_good_pages', 'r.doc, r.path', name)}) AS x"
    required = lambda names: [(f".{n}", "is required", v(n).has("absent")) for n in names]
    return {
        "det_roots": f"SELECT doc, {d.parse('body')} AS v FROM detector_texts",
        "det_objects": f"SELECT * FROM det_roots WHERE {v().has('object')}",
        "det_heads": _fields(d, "det_objects", ("schema_version", "coordinate_unit", "coordinate_origin", "producer"), f", {v('cases').has('array')} AS cases_ok"),
        "det_cases": f"SELECT doc, concat('cases[', CAST(i AS {t}), ']') AS path, v FROM ({d.items('det_objects', 'r.doc', 'cases')}) AS x",
        "det_good_cases": f"SELECT * FROM det_cases WHERE {v().has('object')}",
        "det_pages": f"SELECT doc, concat(path, '.page[', {page_name}, ']') AS path, v FROM ({d.items('det_good_cases', 'r.doc, r.path', 'pages')}) AS x",
        "det_good_pages": f"SELECT * FROM det_pages WHERE {v().has('object')} AND {v('page').whole}",
        "det_commons": part("common_regions"),
        "det_figures": part("figures"),
        "det_tables": part("tables"),
        "v1": " UNION ALL ".join(
            (
                f"SELECT doc, CASE WHEN v IS NULL THEN '{UNREADABLE}' ELSE 'manifest root must be an object' END AS violation FROM det_roots WHERE {v().lacks('object')}",
                _broken(d, "det_heads", root, ""),
                _broken(d, "det_cases", [("", "must be an object", v().lacks("object")), *((f".{n}", "must be a non-empty string", f"{v().has('object')} AND NOT {v(n).filled}") for n in ("case_id", "pdf")), (".pages", "must be a list", f"{v().has('object')} AND {v('pages').lacks('array')}")]),
                _broken(d, "det_pages", [(".page", "must be an integer", f"NOT ({v().has('object')} AND {v('page').whole})")]),
                _broken(d, "det_good_pages", [(f".{n}", "must be a list", v(n).lacks("absent", "array")) for n in ("common_regions", "figures", "tables")]),
                _broken(d, "det_commons", [(".kind", "must be a common kind", f"NOT {v('kind').one_of(*COMMON_KINDS)}"), *_boxes(d, ("bbox",))]),
                _broken(d, "det_figures", [(".kind", "must be figure", f"NOT {v('kind').one_of('figure')}"), *required(FIGURE_FIELDS), (".title_position", "must be above or below", f"NOT {v('title_position').one_of('above', 'below')}"), *_boxes(d, REGIONS[:3])]),
                _broken(d, "det_tables", [(".kind", "must be table", f"NOT {v('kind').one_of('table')}"), *required(TABLE_FIELDS), *_boxes(d, REGIONS[:2]), _optional_box(d, "context_region")]),
            )
        ),
    }


def _editor(d) -> dict[str, str]:
    v = lambda path="": Value(d, path)
    t = d.text
    h = _field(d)
    lists = [(n, "must be a list", f"NOT {n}_ok") for n in ("pages", "edits")]
    strings = [(n, "must be a non-empty string", f"NOT {h(n).filled}") for n in ("source_pdf", "source_detector_manifest")]
    page_ok = f"{v().has('object')} AND {v('page').whole}"
    box_edit = f"{v().has('object')} AND {v('operation').one_of('update_bbox')}"
    return {
        "ed_roots": f"SELECT doc, {d.parse('body')} AS v FROM editor_texts",
        "ed_objects": f"SELECT * FROM ed_roots WHERE {v().has('object')}",
        "ed_heads": _fields(d, "ed_objects", ("schema_version", "coordinate_unit", "coordinate_origin", "source_pdf", "source_detector_manifest"), "".join(f", {v(n).has('array')} AS {n}_ok" for n in ("pages", "edits"))),
        "ed_pages": f"SELECT doc, concat('pages[', CAST(i AS {t}), ']') AS path, v FROM ({d.items('ed_objects', 'r.doc', 'pages')}) AS x",
        "ed_edits": f"SELECT doc, concat('edits[', CAST(i AS {t}), ']') AS path, v FROM ({d.items('ed_objects', 'r.doc', 'edits')}) AS x",
        "v2": " UNION ALL ".join(
            (
                f"SELECT doc, CASE WHEN v IS NULL THEN '{UNREADABLE}' ELSE 'manifest root must be an object' END AS violation FROM ed_roots WHERE {v().lacks('object')}",
                _broken(d, "ed_heads", [_version(d, "editor-save-manifest-v0"), *_coordinates(d), *strings, *lists], ""),
                _broken(d, "ed_pages", [(".page", "must be an integer", f"NOT ({page_ok})"), *((f".{n}", "must be a list", f"{page_ok} AND {v(n).lacks('absent', 'array')}") for n in ("figures", "tables", "common_regions"))]),
                _broken(
                    d,
                    "ed_edits",
                    [
                        ("", "must be an object", v().lacks("object")),
                        (".object_id", "must be a non-empty string", f"{v().has('object')} AND NOT {v('object_id').filled}"),
                        (".operation", "must be an operation", f"{v().has('object')} AND NOT {v('operation').one_of(*OPERATIONS)}"),
                        (".region", "must be a region", f"{box_edit} AND NOT {v('region').one_of(*REGIONS)}"),
                        (".after", "must be 4 numbers", f"{box_edit} AND NOT {v('after').bbox}"),
                        (".before", "must be 4 numbers when present", f"{box_edit} AND {v('before').lacks('absent', 'null')} AND NOT {v('before').bbox}"),
                    ],
                ),
            )
        ),
    }


def _package(d) -> dict[str, str]:
    v = lambda path="": Value(d, path)
    t = d.text
    h = _field(d)
    source = d.text_at("source_editor_manifest", "")
    root = [_version(d, "downstream-package-v0"), *_coordinates(d), *((n, "must be a non-empty string", f"NOT {h(n).filled}") for n in ("source_pdf", "source_editor_manifest"))]
    root += [("source_editor_manifest", "must be an editor manifest", f"{h('source_editor_manifest').filled} AND {d.matches(source, '(^|/)detected_manifest[.]json$')}"), ("objects", "must be a list", "NOT objects_ok")]
    there = lambda bad: f"{v().has('object')} AND {bad}"
    rules = [(".object_id", "must be a non-empty string", f"NOT {v('object_id').filled}"), (".kind", "must be figure or table", f"NOT {v('kind').one_of('figure', 'table')}"), (".page", "must be an integer", f"NOT {v('page').whole}"), *_boxes(d, REGIONS[:2]), _optional_box(d, "context_region"), (".crops", "must be an object", v("crops").lacks("object")), (".downstream_task_hint", "is required", v("downstream_task_hint").falsy)]
    return {
        "pk_roots": f"SELECT doc, {d.parse('body')} AS v FROM package_texts",
        "pk_objects": f"SELECT * FROM pk_roots WHERE {v().has('object')}",
        "pk_heads": _fields(d, "pk_objects", ("schema_version", "coordinate_unit", "coordinate_origin", "source_pdf", "source_editor_manifest"), f", {v('objects').has('array')} AS objects_ok"),
        "pk_items": f"SELECT doc, concat('objects[', CAST(i AS {t}), ']') AS path, v FROM ({d.items('pk_objects', 'r.doc', 'objects')}) AS x",
        "v3": " UNION ALL ".join((f"SELECT doc, CASE WHEN v IS NULL THEN '{UNREADABLE}' ELSE 'package root must be an object' END AS violation FROM pk_roots WHERE {v().lacks('object')}", _broken(d, "pk_heads", root, ""), _broken(d, "pk_items", [("", "must be an object", v().lacks("object")), *((p, w, there(bad)) for p, w, bad in rules)]))),
    }


def _review(d) -> dict[str, str]:
    v = lambda path="": Value(d, path)
    t = d.text
    there = lambda bad: f"{v().has('object')} AND {bad}"
    an_id = f"({v('object_id').has('string')} AND {d.matches(d.text_at('v', 'object_id'), '^(figure|table):([^:]+):page([0-9]+)$')})"
    objects = [(".object_id", "must be <figure|table>:<index>:page<N>", f"NOT {an_id}"), (".decision", "must be a decision", f"NOT {v('decision').one_of(*DECISIONS)}"), (".expected_change", "must be a mapping", v("expected_change").lacks("absent", "null", "object"))]
    missed = [(".kind", "must be figure or table", f"NOT {v('kind').one_of('figure', 'table')}"), (".page", "must be an integer", f"NOT {v('page').whole}"), _optional_box(d, "approximate_region")]
    item = lambda name: f"SELECT doc, concat('{name}[', CAST(i AS {t}), ']') AS path, v FROM ({d.items('rv_roots', 'r.doc', name)}) AS x"
    return {
        "rv_roots": f"SELECT doc, {d.parse('body')} AS v FROM review_texts",
        "rv_heads": _fields(d, "rv_roots", ("schema_version", "pdf"), "".join(f", {v(n).has('absent', 'array')} AS {n}_ok" for n in ("objects", "missed_objects")) + ", v IS NULL AS unread"),
        "rv_heads_read": "SELECT * FROM rv_heads WHERE NOT unread",
        "rv_objects": item("objects"),
        "rv_missed": item("missed_objects"),
        "rv_changes": f"SELECT doc, concat(path, '.expected_change.', field) AS path, field, v FROM ({d.entries('rv_objects', 'r.doc, r.path', 'expected_change')}) AS x",
        "v5": " UNION ALL ".join(
            (
                f"SELECT doc, '{UNREADABLE}' AS violation FROM rv_heads WHERE unread",
                _broken(d, "rv_heads_read", [_version(d, "real-pdf-review-v0"), ("pdf", "must be a non-empty string", f"NOT {_field(d)('pdf').filled}"), *((n, "must be a list", f"NOT {n}_ok") for n in ("objects", "missed_objects"))], ""),
                _broken(d, "rv_objects", [("", "must be a mapping", v().lacks("object")), *((p, w, there(bad)) for p, w, bad in objects)]),
                _broken(d, "rv_changes", [("", "is no region", f"field NOT IN ({_names(REGIONS[:3])})"), ("", "must be 4 numbers", f"field IN ({_names(REGIONS[:3])}) AND NOT {v().bbox}")]),
                _broken(d, "rv_missed", [("", "must be a mapping", v().lacks("object")), *((p, w, there(bad)) for p, w, bad in missed)]),
            )
        ),
    }


def _first(cases: list[tuple[str, str, str]]) -> tuple[str, str]:
    """CASE expressions of the first (code, field, condition) that holds: its code and its field."""
    code = "CASE " + " ".join(f"WHEN {bad} THEN '{c}'" for c, _, bad in cases) + " ELSE 'ok' END"
    field = "CASE " + " ".join(f"WHEN {bad} THEN '{f}'" for _, f, bad in cases) + " ELSE '' END"
    return code, field


def _setup(d) -> dict[str, str]:
    v = _field(d)
    pages = d.text_at("input", "page_range")
    pattern = r"^\s*[0-9]+\s*(-\s*[0-9]+\s*)?$"
    low, high = (f"CAST(nullif({d.group(pages, p, 1)}, '') AS BIGINT)" for p in (r"^\s*([0-9]+)", r"-\s*([0-9]+)\s*$"))
    fine = "advanced_fine_tuning"
    given = f"{v('input.page_range').lacks('absent', 'null')}"
    cases = [("SETUP_FILE_UNREADABLE", "", "unread"), ("SETUP_MISSING_FIELD", "schema_version", v("schema_version").has("absent")), ("SETUP_INVALID_VALUE", "schema_version", f"NOT {v('schema_version').one_of('setup-yaml-v0')}")]
    for path in REQUIRED_SETUP:
        cases += [("SETUP_MISSING_FIELD", path, v(path).has("absent")), ("SETUP_INVALID_VALUE", path, f"NOT {v(path).spoken}")]
    cases += [("SETUP_PLACEHOLDER_UNRESOLVED", path, f"trim({d.text_at(*path.split('.'))}) = 'CHANGE_ME'") for path in PLACEHOLDER_SETUP]
    cases += [("SETUP_BAD_PAGE_RANGE", "input.page_range", f"{given} AND NOT ({v('input.page_range').has('string')} AND {d.matches(pages, pattern)})"), ("SETUP_BAD_PAGE_RANGE", "input.page_range", f"{given} AND {high} < {low}")]
    for code, name, good in (("SETUP_UNKNOWN_DETECTOR", "detector_profile", "default"), ("SETUP_INVALID_VALUE", "coordinate_unit", "pdf_pt"), ("SETUP_INVALID_VALUE", "coordinate_origin", "top-left")):
        x = v(f"{fine}.{name}")
        cases.append((code, f"{fine}.{name}", f"{x.lacks('absent')} AND NOT {x.one_of(good)}"))
    code, field = _first(cases)
    names = ("schema_version", "project", "input", "output", fine)
    return {"su_roots": f"SELECT doc, {d.parse('body')} AS v FROM setup_texts", "su_heads": _fields(d, "su_roots", names, ", v IS NULL AS unread"), "v4": f"SELECT doc, {code} AS code, {field} AS field FROM su_heads"}


def _scenario(d) -> dict[str, str]:
    """Errors of each part with their place in the order of checks; the first of a document is its result."""
    t = d.text
    v = lambda path="": Value(d, path)
    h = _field(d)
    size = f"CASE WHEN {h('page.size').has('absent')} THEN 'letter' ELSE {d.text_at('page', 'size')} END"
    turned = f"coalesce({d.text_at('page', 'orientation')}, 'portrait') = 'landscape'"
    side = lambda k: f"CASE {size} " + " ".join(f"WHEN '{n}' THEN {wh[k]}" for n, wh in PAGE_SIZES.items()) + " END"
    width, height = f"CASE WHEN {turned} THEN {side(1)} ELSE {side(0)} END", f"CASE WHEN {turned} THEN {side(0)} ELSE {side(1)} END"
    value, template, bad_box, outside = "SCENARIO_INVALID_VALUE", "SCENARIO_UNKNOWN_TEMPLATE", "SCENARIO_BAD_BBOX", "SCENARIO_OUT_OF_PAGE_BOUNDS"

    def number(path: str, least: int, of=v) -> str:
        x = of(path)
        return f"{x.lacks('absent')} AND NOT ({x.has('int')} AND {d.number_at(x.column, x.path)} >= {least})"

    def choice(path: str, names, of=v) -> str:
        return f"{of(path).lacks('absent')} AND NOT {of(path).one_of(*names)}"

    def box(path: str, field: str, of=v) -> list[tuple[str, str, str]]:
        b = of(path)
        x0, y0, x1, y1 = (b.corner(k) for k in range(4))
        return [(bad_box, field, f"NOT {b.bbox}"), (bad_box, field, f"NOT ({x0} < {x1} AND {y0} < {y1})"), (outside, field, f"NOT (0 <= {x0} AND {x1} <= w AND 0 <= {y0} AND {y1} <= h)")]

    def found(relation: str, place: int, cases, prefix: str = "''", nth: str = "0") -> str:
        rows = d.array(*(f"CASE WHEN {bad} THEN {d.struct(k=str(k), code=f"'{code}'", field=f"'{field}'")} END" for k, (code, field, bad) in enumerate(cases)))
        return f"SELECT doc, {place} * 100000000 + {nth} * 1000 + e.k AS place, e.code AS code, concat({prefix}, e.field) AS field FROM ({d.explode(relation, 'doc, ' + ('i' if nth != '0' else '0 AS i'), d.filter(rows, 'x', 'x IS NOT NULL'), 'e')}) AS x"

    head = [("SCENARIO_FILE_UNREADABLE", "", "unread"), (value, "case_id", f"NOT {h('case_id').spoken}"), ("SCENARIO_UNSUPPORTED_PAGE_SIZE", "page.size", choice("page.size", PAGE_SIZES, h)), (value, "page.orientation", choice("page.orientation", ("portrait", "landscape"), h)), (value, "page.columns", f"{h('page.columns').lacks('absent')} AND NOT coalesce({d.number_at('page', 'columns')} IN (1, 2), false)"), (value, "page.page_count", number("page.page_count", 1, h)), (value, "page.page_offset", number("page.page_offset", 0, h))]
    parts = []
    for kind in ("header", "footer"):
        on = f"NOT {h(kind).falsy} AND NOT {h(f'{kind}.enabled').falsy}"
        rules = [(template, f"{kind}.text_template", f"NOT {h(f'{kind}.text_template').one_of(*TEMPLATES[kind])}"), *box(f"{kind}.bbox", f"{kind}.bbox", h), (value, f"{kind}.support_pages", h(f"{kind}.support_pages").lacks("absent", "null", "array"))]
        parts.append([(c, f, f"{on} AND {bad}") for c, f, bad in rules])
    on = f"NOT {h('watermark').falsy} AND NOT {h('watermark.enabled').falsy}"
    mark = [(template, "watermark.text_template", f"NOT {h('watermark.text_template').one_of(*TEMPLATES['watermark'])}"), *box("watermark.bbox", "watermark.bbox", h), (value, "watermark.location", choice("watermark.location", ("center", "corner"), h))]
    parts.append([(c, f, f"{on} AND {bad}") for c, f, bad in mark])
    beyond = lambda: f"coalesce({d.number_at('v', 'page')}, 1) > pages"
    figures = [(value, ".index", f"NOT {v('index').filled}"), (template, ".body_template", choice("body_template", FIGURE_BODIES)), (template, ".alias", choice("alias", FIGURE_ALIASES)), (value, ".caption_position", choice("caption_position", ("above", "below"))), (value, ".page", number("page", 1)), (value, ".page", beyond()), *box("caption_region", ".caption_region"), *box("body_region", ".body_region")]
    tables = [(value, ".index", f"NOT {v('index').filled}"), (value, ".table_group_id", f"NOT {v('table_group_id').filled}"), (value, ".page", number("page", 1)), (value, ".page", beyond()), *box("caption_region", ".caption_region"), *box("body_region", ".body_region"), *((value, f".{n}", number(n, 1)) for n in ("part_index", "rows", "cols"))]
    negatives = [(value, ".text", f"NOT {v('text').filled}"), *box("bbox", ".bbox"), (value, ".page", number("page", 1))]
    lists = {"figures": figures, "tables": tables, "negative_texts": negatives}
    supports = " UNION ALL ".join(f"SELECT doc, {k + 2} AS part, '{kind}' AS kind, i, v FROM ({d.items('sc_roots', 'r.doc', f'{kind}.support_pages')}) AS x" for k, kind in enumerate(("header", "footer")))
    every = [found("sc_heads", k + 1, c) for k, c in enumerate([head, *parts])]
    every.append(f"SELECT doc, part * 100000000 + 900 AS place, '{value}' AS code, concat(kind, '.support_pages') AS field FROM sc_supports WHERE NOT {v().whole}")
    every += [found(f"sc_{name}", 5 + k, rules, f"concat('{name}[', CAST(i AS {t}), ']')", "i") for k, (name, rules) in enumerate(lists.items())]
    return {
        "sc_parsed": f"SELECT doc, {d.parse('body')} AS v FROM scenario_texts",
        "sc_fields": _fields(d, "sc_parsed", ("case_id", "page", "header", "footer", "watermark"), ", v IS NULL AS unread"),
        "sc_heads": f"SELECT *, {width} AS w, {height} AS h, coalesce({d.number_at('page', 'page_count')}, 1) AS pages FROM sc_fields",
        "sc_roots": "SELECT p.doc, p.v, f.w, f.h, f.pages FROM sc_parsed p JOIN (SELECT doc, w, h, pages FROM sc_heads) AS f ON p.doc = f.doc",
        "sc_supports": supports,
        **{f"sc_{name}": f"SELECT doc, w, h, pages, i, v FROM ({d.items('sc_roots', 'r.doc, r.w, r.h, r.pages', name)}) AS x" for name in lists},
        "scenario_errors": " UNION ALL ".join(every),
        "scenario_first": "SELECT doc, code, field FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY place, field) AS nth FROM scenario_errors) AS x WHERE nth = 1",
        "v6": "SELECT r.doc, coalesce(f.code, 'ok') AS code, coalesce(f.field, '') AS field FROM scenario_texts r LEFT JOIN scenario_first f ON r.doc = f.doc",
        "exit_codes": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {n})" for c, n in EXIT_CODES.items()) + ") AS x(code, exit_code)",
    }


# texts


def _obj(*fields) -> str:
    """SQL of a JSON object's text; a value is JSON text, (JSON text, {k: other text, or None to leave it out}) or [SQL of its text]."""
    out = []
    for name, value in fields:
        if isinstance(value, list):
            out.append(f"concat('\"{name}\":', {value[0]}, ',')")
            continue
        base, faults = value if isinstance(value, tuple) else (value, {})
        good = f"'\"{name}\":{base},'"
        cases = " ".join(f"WHEN {k} THEN " + ("''" if x is None else f"'\"{name}\":{x},'") for k, x in faults.items())
        out.append(f"CASE k {cases} ELSE {good} END" if faults else good)
    return "concat('{', " + ", ".join(out) + ", '\"note\":0}')"


def _arr(*items: str) -> str:
    return "concat('[', " + ", ',', ".join(items) + ", ']')"


def _kinds_of_box(first: int) -> tuple[str, dict]:
    return ("[1,2,3,4]", {first: "[1,2,3]", first + 1: "[1,true,3,4]", first + 2: "null", first + 3: "[1,2.5,3,4.0]", first + 4: "[1,2,3,4,5]", first + 5: '"x"'})


def _texts() -> dict[str, str]:
    box = '[10,20,300,400]'
    common = (("coordinate_unit", ('"pdf_pt"', {3: '"px"', 4: None})), ("coordinate_origin", ('"top-left"', {5: "7"})))
    figure = lambda faulty: _obj(("kind", ('"figure"', {6: '"table"'} if faulty else {})), ("index", ('"1.1"', {7: None} if faulty else {})), ("title", '"t"'), ("title_position", ('"below"', {8: None, 9: '"left"'} if faulty else {})), ("title_body_gap_lines", "1"), ("caption_region", box), ("body_region", _kinds_of_box(10) if faulty else box), ("context_region", (box, {16: None} if faulty else {})))
    table = lambda faulty: _obj(("kind", '"table"'), ("index", '"2.1"'), ("title", '"u"'), ("table_group_id", ('"g"', {17: None} if faulty else {})), ("part_index", "1"), ("is_continuation", "false"), ("continuation_marker", "null"), ("caption_region", (box, {18: "[]"} if faulty else {})), ("body_region", box), ("context_region", (box, {19: None, 20: "null", 21: "[1]"} if faulty else {})))
    region = lambda faulty: _obj(("kind", ('"header"', {22: '"margin"'} if faulty else {})), ("bbox", (box, {23: "[0,0,false,1]"} if faulty else {})))
    page = lambda n, faulty: _obj(("page", (n, {24: '"3"', 25: "3.0", 26: "true", 27: None} if faulty else {})), ("common_regions", [_arr(region(False), region(faulty))]), ("figures", [f"CASE k WHEN 28 THEN '5' ELSE {_arr(figure(False), figure(faulty))} END" if faulty else _arr(figure(False))]), ("tables", [_arr(table(False), table(faulty))]))
    case = lambda faulty: _obj(("case_id", ('"c"', {29: '""'} if faulty else {})), ("pdf", ('"a.pdf"', {30: "9"} if faulty else {})), ("pages", [f"CASE k WHEN 31 THEN '{{}}' ELSE {_arr(page('1', False), page('2', faulty))} END" if faulty else _arr(page("1", False))]))
    detector = _obj(("schema_version", ('"detector-output-v0"', {1: '"v9"', 2: None})), *common, ("producer", ('{"name":"d","version":"1","mode":"m"}', {32: '{"name":"d","version":"","mode":0}', 33: "5"})), ("cases", [f"CASE k WHEN 34 THEN '{{}}' WHEN 35 THEN '[5]' ELSE {_arr(case(False), case(True))} END"]))
    edit = lambda faulty: _obj(("object_id", ('"figure:1:page1"', {6: '""'} if faulty else {})), ("operation", ('"update_bbox"', {7: '"move"', 8: '"add_object"'} if faulty else {})), ("region", ('"body_region"', {9: '"edge"', 8: '"edge"'} if faulty else {})), ("before", ("null", {16: "[1]", 17: box} if faulty else {})), ("after", _kinds_of_box(10) if faulty else box))
    ed_page = lambda faulty: _obj(("page", ("1", {18: "1.5"} if faulty else {})), ("figures", ("[]", {19: "{}", 20: None} if faulty else {})), ("tables", "[]"))
    editor = _obj(("schema_version", ('"editor-save-manifest-v0"', {1: '"v9"', 2: None})), *common, ("source_pdf", ('"a.pdf"', {21: '""', 22: None})), ("source_detector_manifest", ('"d.json"', {23: "1"})), ("pages", [f"CASE k WHEN 24 THEN '{{}}' ELSE {_arr(ed_page(False), ed_page(True))} END"]), ("edits", [f"CASE k WHEN 25 THEN 'null' WHEN 26 THEN '[[]]' ELSE {_arr(edit(False), edit(True))} END"]))
    item = lambda faulty: _obj(("object_id", ('"figure:1:page1"', {6: "null"} if faulty else {})), ("kind", ('"figure"', {7: '"common"'} if faulty else {})), ("page", ("3", {8: '"3"'} if faulty else {})), ("caption_region", box), ("body_region", _kinds_of_box(10) if faulty else box), ("context_region", (box, {16: "[1]", 17: "null"} if faulty else {})), ("crops", ('{"body":"b.png"}', {18: "[]"} if faulty else {})), ("downstream_task_hint", ('"table"', {19: '""', 20: None} if faulty else {})))
    package = _obj(("schema_version", ('"downstream-package-v0"', {1: '"v9"', 2: None})), *common, ("source_pdf", ('"a.pdf"', {21: None})), ("source_editor_manifest", ('"runs/editor.json"', {22: '"runs/detected_manifest.json"', 23: '"runs/old_detected_manifest.json"', 24: '""'})), ("objects", [f"CASE k WHEN 25 THEN '7' WHEN 26 THEN '[null]' ELSE {_arr(item(False), item(True))} END"]))
    reviewed = lambda faulty: _obj(("object_id", ('"figure:1:page1"', {6: '"fig:1"', 7: "5"} if faulty else {})), ("decision", ('"accept"', {8: '"maybe"', 9: '"wrong_title"'} if faulty else {})), ("expected_change", [f"CASE k WHEN 16 THEN 'null' WHEN 17 THEN '[]' WHEN 18 THEN '{{\"edge\":[1,2,3,4]}}' ELSE {_obj2('body_region', _kinds_of_box(10))} END"] if faulty else "null"))
    missed = lambda faulty: _obj(("kind", ('"table"', {19: '"list"'} if faulty else {})), ("page", ("2", {20: "2.0"} if faulty else {})), ("approximate_region", ("null", {21: "[1]"} if faulty else {})))
    review = _obj(("schema_version", ('"real-pdf-review-v0"', {1: '"v9"', 2: None})), ("pdf", ('"a.pdf"', {3: '""'})), ("objects", [f"CASE k WHEN 4 THEN '{{}}' WHEN 22 THEN '[3]' ELSE {_arr(reviewed(False), reviewed(True))} END"]), ("missed_objects", [f"CASE k WHEN 5 THEN 'null' ELSE {_arr(missed(False), missed(True))} END"]))
    setup = _obj(
        ("schema_version", ('"setup-yaml-v0"', {1: None, 2: '"v9"'})),
        ("project", ('{"name":"p"}', {3: "{}", 4: '{"name":"CHANGE_ME"}', 5: "7"})),
        ("input", ('{"pdf_path":"/a.pdf","page_range":"2-9"}', {6: '{"pdf_path":" "}', 7: '{"pdf_path":"CHANGE_ME"}', 8: '{"pdf_path":"/a.pdf","page_range":"3"}', 9: '{"pdf_path":"/a.pdf","page_range":"9-2"}', 10: '{"pdf_path":"/a.pdf","page_range":"x"}', 11: '{"pdf_path":"/a.pdf","page_range":null}', 12: '{"pdf_path":"/a.pdf","page_range":4}'})),
        ("output", ('{"artifact_dir":"o"}', {13: None, 14: '{"artifact_dir":5}'})),
        ("advanced_fine_tuning", ("{}", {15: '{"detector_profile":"other"}', 16: '{"detector_profile":null}', 17: '{"coordinate_unit":"px"}', 18: '{"coordinate_origin":"bottom-left"}', 19: "5"})),
    )
    band = lambda faults=None: ("[60,100,300,200]", faults or {})
    hf = lambda kind, name, at: _obj(("enabled", ("true", {at: "false"})), ("text_template", (f'"{name}"', {at: '"none"', at + 1: '"none"'})), ("bbox", band({at + 2: "[60,10,60,20]", at + 3: "[0,0,700,20]"})), ("support_pages", ("null", {at + 4: "[1,2]", at + 5: "[1,1.5]", at + 6: "3"})))
    sc_figure = lambda faulty: _obj(("index", ('"1"', {20: '""'} if faulty else {})), ("body_template", ('"mixed"', {21: '"sketch"'} if faulty else {})), ("alias", ('"Fig."', {22: '"Fig"'} if faulty else {})), ("caption_position", ('"above"', {23: '"left"'} if faulty else {})), ("page", ("1", {24: "7", 25: "0", 26: "true"} if faulty else {})), ("caption_region", band()), ("body_region", band({27: "[1,2,3]", 28: "[1,true,3,4]", 29: "[5,2,3,4]", 30: "[1,2,3,900]", 31: "[1,2,650,780]"}) if faulty else band()))
    sc_table = lambda faulty: _obj(("index", '"2"'), ("table_group_id", ('"g"', {32: None} if faulty else {})), ("page", ("2", {33: "9"} if faulty else {})), ("caption_region", band()), ("body_region", band({34: "[-1,2,3,4]"} if faulty else {})), ("rows", ("8", {35: "0"} if faulty else {})), ("cols", ("4", {36: '"4"'} if faulty else {})))
    scenario = _obj(
        ("case_id", ('"s"', {1: '" "'})),
        ("page", ('{"page_count":2}', {2: '{"size":"a9"}', 3: '{"page_count":0}', 4: '{"page_count":"2"}', 5: '{"orientation":"upright","page_count":2}', 6: '{"columns":3,"page_count":2}', 7: '{"page_offset":-1,"page_count":2}', 31: '{"orientation":"landscape","page_count":2}'})),
        ("header", [hf("header", "two_line", 8)]),
        ("footer", ("{}", {37: '{"enabled":true,"text_template":"two_line","bbox":[1,2,3,4]}'})),
        ("watermark", ('{"enabled":true,"text_template":"draft","bbox":[1,2,3,4]}', {15: '{"enabled":true,"text_template":"secret"}', 16: '{"enabled":true,"text_template":"draft","bbox":[1,2,3,4],"location":"edge"}', 17: '{"enabled":true,"text_template":"draft"}'})),
        ("figures", [_arr(sc_figure(False), sc_figure(True))]),
        ("tables", [_arr(sc_table(False), sc_table(True))]),
        ("negative_texts", ('[{"text":"n","bbox":[1,2,3,4]}]', {38: '[{"text":"n","bbox":[1,2,3,4]},{"bbox":[1,2,3,4]}]', 39: '[{"text":"n","bbox":[1,2,3,4],"page":0}]'})),
    )
    return {"detector_texts": detector, "editor_texts": editor, "package_texts": package, "review_texts": review, "setup_texts": setup, "scenario_texts": scenario}


def _obj2(name: str, value: tuple[str, dict]) -> str:
    """As _obj, without a field besides."""
    cases = " ".join(f"WHEN {k} THEN '{{\"{name}\":{x}}}'" for k, x in value[1].items())
    return f"CASE k {cases} ELSE '{{\"{name}\":{value[0]}}}' END"


def relations(d) -> dict[str, str]:
    odd = lambda name: " WHEN k = 40 THEN '[1]'" if name in ("detector_texts", "editor_texts", "package_texts") else ""
    # here and there a text breaks off or is none
    texts = {name: f"SELECT doc, CASE WHEN doc % 211 = 5 THEN '{{\"a\":' WHEN doc % 211 = 6 THEN ''{odd(name)} ELSE {body} END AS body FROM cases_of_json" for name, body in _texts().items()}
    return {"cases_of_json": "SELECT event_id AS doc, event_id % 41 AS k FROM events", **texts, **_detector(d), **_editor(d), **_package(d), **_setup(d), **_review(d), **_scenario(d)}


def queries(d) -> dict[str, str]:
    return {
        "v1_detector_output": "SELECT doc, violation FROM v1",
        "v2_editor_manifest": "SELECT doc, violation FROM v2",
        "v3_downstream_package": "SELECT doc, violation FROM v3",
        "v4_setup": "SELECT doc, code, field FROM v4",
        "v5_review": "SELECT doc, violation FROM v5",
        "v6_scenario": "SELECT doc, code, field FROM v6",
        "v7_bbox_shape": f"SELECT doc, path, {Value(d, 'after').bbox} AS ok FROM ed_edits WHERE {Value(d).has('object')}",
        "v8_exit_codes": f"SELECT v.doc, v.code, CASE WHEN v.code = 'ok' THEN {OK} ELSE coalesce(e.exit_code, {UNKNOWN_ERROR}) END AS exit_code FROM v6 v LEFT JOIN exit_codes e ON v.code = e.code",
        "f7_scenario_guards": "SELECT doc, place, code, field FROM scenario_errors",
    }
