"""Page layout derived from the driver's tables: pages, text lines and drawings of documents.

A customer is a document, an order a page, a line item a slot of 88 points on it. Text and
boxes follow from the keys by integer arithmetic; all coordinates are multiples of 0.25.
"""

from __future__ import annotations

_T = "(90 + (slot - 1) * 88)"
_CAP_X = "60 + (s % 8) * 0.25 + CASE WHEN s % 6 = 0 THEN 250 ELSE 0 END"
_FIGURE, _TABLE = "p % 9 IN (0, 2, 8)", "p % 9 IN (1, 3, 7)"
_INDEX = "concat(CAST(s % 9 + 1 AS {t}), CASE WHEN p % 9 IN (1, 2) THEN '-' ELSE '.' END, CAST(q % 12 + 1 AS {t}))"


def relations(d) -> dict[str, str]:
    t, box = d.text, lambda x0, y0, x1, y1: f"CAST({x0} AS DOUBLE) AS x0, CAST({y0} AS DOUBLE) AS y0, CAST({x1} AS DOUBLE) AS x1, CAST({y1} AS DOUBLE) AS y1"
    index = _INDEX.format(t=t)
    text = f"""CASE p % 9 WHEN 0 THEN concat('Figure ', {index}, '. Clock tree ', CAST(p % 17 AS {t})) WHEN 1 THEN concat('Table ', {index}, ': Pin budget ', CAST(p % 13 AS {t}))
      WHEN 2 THEN concat('Figure ', {index}, ' Mixing stage ', CAST(q AS {t})) WHEN 3 THEN concat('Table ', CAST(s % 4 + 1 AS {t}), '.', CAST(q % 3 + 1 AS {t}), ' Colour codes', CASE WHEN q % 2 = 0 THEN ' (continued)' ELSE '' END)
      WHEN 4 THEN concat('Figure ', {index}, CASE WHEN q % 2 = 0 THEN ' shows the route' ELSE ' Lists all routes' END) WHEN 5 THEN concat('In Figure ', {index}, ': see above') WHEN 6 THEN concat('Note that Table ', {index}, ' is above and the rule holds')
      WHEN 7 THEN concat('Table A.', CAST(q % 3 + 1 AS {t}), ': Margins', CASE WHEN q % 4 = 1 THEN ' cont.' WHEN q % 4 = 2 THEN ' (cont)' ELSE '' END) ELSE concat('Fig. ', CAST(q % 5 + 1 AS {t}), ': Floor plan') END"""
    cap_y = f"{_T} + CASE WHEN {_FIGURE} THEN 64 WHEN {_TABLE} THEN 2 ELSE 40 END"
    width = "CASE WHEN p % 9 IN (5, 6) THEN 400 ELSE 150 + (q % 20) * 0.5 END"
    return {
        "doc_pages": "SELECT o_orderkey, o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page FROM orders",
        "layout_pages": "SELECT doc_id, page, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height FROM doc_pages",
        "slots": "SELECT doc_id, page, CAST(l_linenumber AS INT) AS slot, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem JOIN doc_pages ON l_orderkey = o_orderkey GROUP BY doc_id, page, l_linenumber",
        "lines": f"""SELECT doc_id, page, slot * 10 + 1 AS line_seq, {text} AS text, {box(_CAP_X, cap_y, f'{_CAP_X} + {width}', f'{cap_y} + 12')} FROM slots
      UNION ALL SELECT doc_id, page, slot * 10 + 2, 'second title line', {box(_CAP_X, f'{cap_y} + 13', f'{_CAP_X} + 120', f'{cap_y} + 23')} FROM slots WHERE q % 7 = 0 AND ({_FIGURE} OR {_TABLE})
      UNION ALL SELECT doc_id, page, slot * 10 + 3, concat('sig', CAST(q AS {t})), {box('40 + (q % 8) * 0.25', f'{_T} + 22', '60 + (q % 8) * 0.25', f'{_T} + 32')} FROM slots WHERE {_FIGURE} AND q % 3 < 2
      UNION ALL SELECT doc_id, page, slot * 10 + 4, concat('ab', CAST(p % 7 AS {t})), {box('26', f'{_T} + 30', '38', f'{_T} + 44')} FROM slots WHERE {_FIGURE} AND q % 4 = 0
      UNION ALL SELECT doc_id, page, slot * 10 + 4 + r, concat('row ', CAST(r AS {t}), ' value ', CAST(q AS {t})), {box('64', f'{_T} + 6 + r * 14 + CASE WHEN r = 3 AND q % 2 = 0 THEN 24 ELSE 0 END', '300 + q % 9', f'{_T} + 16 + r * 14 + CASE WHEN r = 3 AND q % 2 = 0 THEN 24 ELSE 0 END')} FROM slots CROSS JOIN (VALUES (1), (2), (3)) AS n(r) WHERE {_TABLE} AND q % 3 = 0
      UNION ALL SELECT doc_id, page, 1, concat('Chapter ', CAST(doc_id % 10 AS {t}), '  Overview'), {box('60', '40', '250', '52')} FROM doc_pages
      UNION ALL SELECT doc_id, page, 2, concat('Section ', CAST(page AS {t})), {box('60', '54', '200', '66')} FROM doc_pages WHERE page % 4 = 0
      UNION ALL SELECT doc_id, page, 3, 'CONFIDENTIAL', {box('200', '380', '420', '410')} FROM doc_pages WHERE doc_id % 7 = 0
      UNION ALL SELECT doc_id, page, 4, concat('Licensed to customer ', CAST(doc_id % 3 AS {t})), {box('100', '706', '300', '718')} FROM doc_pages WHERE doc_id % 11 = 0
      UNION ALL SELECT doc_id, page, 900, concat('Confidential - ', CAST(page AS {t})), {box('60', '750', '200', '762')} FROM doc_pages
      UNION ALL SELECT doc_id, page, 901, concat('Rev ', CAST(doc_id % 5 AS {t})), {box('400', '750', '500', '762')} FROM doc_pages WHERE doc_id % 3 = 0""",
        "drawings": f"""SELECT doc_id, page, slot * 10 + 1 AS draw_seq, {box('70 + (s % 8) * 0.25', f'{_T} + 4 + (q % 4) * 0.25', '300 + (q % 40) * 0.5', f'{_T} + 58')} FROM slots WHERE {_FIGURE} AND p % 5 < 4
      UNION ALL SELECT doc_id, page, slot * 10 + 2, {box('90', f'{_T} + 20', '150 + q % 7', f'{_T} + 40')} FROM slots WHERE {_FIGURE}
      UNION ALL SELECT doc_id, page, slot * 10 + 3, {box('310', f'{_T} + 10', '340', f'{_T} + 50')} FROM slots WHERE {_FIGURE} AND q % 5 = 0
      UNION ALL SELECT doc_id, page, slot * 10 + 4, {box('64', f'{_T} + 18', '400', f'{_T} + 80')} FROM slots WHERE {_TABLE} AND q % 3 <> 0
      UNION ALL SELECT doc_id, page, slot * 10 + 5, {box('54', f'{_T} + 36', '500', f'{_T} + 37')} FROM slots WHERE p % 9 = 6""",
    }
