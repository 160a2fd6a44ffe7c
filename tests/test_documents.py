import json
import sys
import time

import pytest

from pagequarry.plans import detector, external, golden
from pagequarry.sources import documents as D


def toy(seen):
    """Reads JSON documents {page: [texts]}; notes each page that it extracts in a folder."""

    def extract(content, wanted):
        body = json.loads(content)
        for page, texts in body.items():
            if wanted(int(page)):
                with open(f"{seen}/{body.get('name', 'x')}-{page}-{time.time_ns()}", "w"):
                    pass
                yield int(page), 612, 792, [(t, 72, 100 + 20 * k, 300, 112 + 20 * k) for k, t in enumerate(texts)], [(1, 1, 5, 5), (3, 3, 3, 9)]

    return extract


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "seen").mkdir()
    for name, pages in (("a", 3), ("b", 9), ("c", 1)):
        (tmp_path / f"docs/{name}").mkdir(parents=True)
        (tmp_path / f"docs/{name}/{name}.pdf").write_text(json.dumps({str(p): [f"Figure {p}. Text of {name}", "  "] for p in range(1, pages + 1)}))
    (tmp_path / "docs/empty.pdf").write_text("")
    (tmp_path / "docs/other.txt").write_text("no document")
    return tmp_path


def pages_seen(folder):
    found = sorted(int(p.name.split("-")[1]) for p in (folder / "seen").iterdir())
    for p in (folder / "seen").iterdir():
        p.unlink()
    return found


def test_all_rows(spark, folder):
    df = D.documents(spark, f"{folder}/docs", toy(f"{folder}/seen"))
    rows = df.collect()
    kinds = lambda k: [r for r in rows if r.kind == k]
    assert (len(kinds("page")), len(kinds("line")), len(kinds("drawing"))) == (13, 13, 13)
    assert {r.text for r in kinds("line") if r.path.endswith("c.pdf")} == {"Figure 1. Text of c"}
    captions = detector.detect(spark, *D.layout(df), relation="line_captions").where("kind IS NOT NULL")
    assert captions.count() == 13 and {r.kind for r in captions.collect()} == {"figure"}


def test_only_asked_pages_are_extracted(spark, folder):
    df = D.documents(spark, f"{folder}/docs", toy(f"{folder}/seen"))
    for condition, want in (("page = 2", [2, 2]), ("page > 7", [8, 9]), ("page BETWEEN 2 AND 3", [2, 2, 3, 3]), ("page IN (1, 9) AND kind = 'line'", [1, 1, 1, 9]), (f"path = '{folder}/docs/a/a.pdf' AND page <= 2", [1, 2]), ("page = 5 AND page = 6", [])):
        rows = df.where(condition).collect()
        assert pages_seen(folder) == want, condition
        assert sorted(r.page for r in rows if r.kind == "line") == want
        assert "kind" not in condition or {r.kind for r in rows} == {"line"}


def test_setups_name_files_and_pages(spark, folder):
    setups = spark.createDataFrame([(f"{folder}/docs/b/b.pdf", "4 - 5"), (f"{folder}/docs/a/a.pdf", None), (f"{folder}/docs/gone.pdf", "1-2")], "pdf_path string, page_range string")
    df = D.documents(spark, f"{folder}/docs", toy(f"{folder}/seen"), ranges=D.setup_ranges(setups))
    assert sorted((r.path[-5], r.page) for r in df.where("kind = 'page'").collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)]
    assert pages_seen(folder) == [1, 2, 3, 4, 5]


def test_partitions_are_balanced(spark, folder):
    sizes = {f"f{k}": n for k, n in enumerate([900, 500, 400, 300, 300, 200, 100, 0])}
    groups = D.balanced(sizes, 1000)
    assert sorted(x for g in groups for x in g) == sorted(sizes) and len(groups) == 3
    totals = [sum(sizes[x] for x in g) for g in groups]
    assert max(totals) - min(totals) <= 200
    assert D.documents(spark, f"{folder}/docs", toy(f"{folder}/seen"), bytes_a_partition=200).rdd.getNumPartitions() > 1
    assert D.documents(spark, f"{folder}/seen", toy(f"{folder}/seen")).collect() == []


def test_files_that_fail(spark, folder):
    (folder / "docs/bad.pdf").write_text("{")
    with pytest.raises(Exception, match="JSONDecodeError"):
        D.documents(spark, f"{folder}/docs", toy(f"{folder}/seen")).count()
    rows = D.documents(spark, f"{folder}/docs", toy(f"{folder}/seen"), keep_errors=True).where("kind IN ('error', 'page')").collect()
    assert [(r.path[-7:], r.text[:15]) for r in rows if r.kind == "error"] == [("bad.pdf", "JSONDecodeError")] and len(rows) == 14


PROGRAM = """
import json, subprocess, sys, time
pdf, out = sys.argv[1:]
what = open(pdf).read()
print("a word of", what, file=sys.stderr)
if what == "fails": sys.exit(3)
if what == "hangs": subprocess.run([sys.executable, "-c", "import time; time.sleep(60)"])
if what == "silent": sys.exit(0)
body = {"pages": [{"page": 1, "common_regions": [], "figures": [], "tables": []}]}
if what == "wrong": body = {"pages": [{"page": "1"}]}
if what == "shape": body = [1]
open(out, "w").write(json.dumps(body) if what != "broken" else "{")
"""


def test_a_program_as_detector(spark, tmp_path):
    (tmp_path / "program.py").write_text(PROGRAM)
    kinds = ("good", "fails", "hangs", "silent", "wrong", "shape", "broken")
    cases = spark.createDataFrame([(k, f"{k}/{k}.pdf", k.encode()) for k in kinds], "case_id string, pdf string, content binary").repartition(3)
    began = time.time()
    found = external.run_detector(spark, cases, [sys.executable, str(tmp_path / "program.py"), "{pdf}", "{out}"], seconds=3)
    rows = {r.case_id: (r.status, r.exit_code, r.message, r.body is not None) for r in found.collect()}
    assert time.time() - began < 40
    assert rows["good"] == ("ok", 0, "a word of good", True)
    assert rows["fails"] == ("failed", 3, "a word of fails", False)
    assert rows["hangs"] == ("timeout", None, "more than 3 s", False)
    assert rows["silent"] == ("no_output", 0, "a word of silent", False)
    assert rows["wrong"] == ("invalid", 0, "cases[0].page[?].page must be an integer", False)
    assert rows["shape"][:2] == ("unreadable", 0) and rows["broken"][:2] == ("unreadable", 0)
    side = external.detected_cases(found)
    assert golden.Comparison(spark, side, side).summary().first().cases_total == 1
