import json

import pytest
from pyspark.sql import functions as F

from pagequarry.plans import gallery, scenarios
from pagequarry.sources import contracts, file_sink
from pagequarry.sources.contracts import InvalidInput
from pagequarry.sources.runs import RunError

PDF = lambda n: b"%PDF-1.4\n" + b"".join(b"%d 0 obj << /Type /Page /Parent 1 0 R >>\n" % k for k in range(n)) + b"<< /Type /Pages >>"
FIGURE = {"index": "A.1", "caption_region": [72, 180, 540, 198], "body_region": [72, 100, 540, 156]}


def documents(spark, pages):
    """A document and an image a page for each case (name and number of pages)."""
    rows = [(f"{c}/{c}.pdf", PDF(n)) for c, n in pages.items()] + [(f"{c}/{c}.p{k:02d}.png", gallery.PNG + b"...") for c, n in pages.items() for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "name string, content binary")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("galleries") / "made of three"
    cases = [{"case_id": "a b", "figures": [FIGURE], "axes": {"core": "x", "n": 2}}, {"case_id": "b+", "page": {"page_count": 2}, "axes": {"negative": "y"}}, {"case_id": "c", "figures": [FIGURE, FIGURE | {"index": "2", "body_region": [72, 120, 540, 160]}]}, {"case_id": "bad", "page": {"size": "x"}}]
    texts = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(cases)], "doc long, body string")
    gallery.generate(spark, texts, str(top), documents(spark, {"a b": 1, "b+": 2, "c": 1}))
    return top


def files(top):
    return sorted(str(p.relative_to(top)) for p in top.rglob("*") if p.is_file())


def errors(spark, top, gates=None):
    rows = gallery.Gallery(spark, str(top)).errors()
    return sorted((r.gate, r.case_id or "", r.page or 0, r.detail) for r in (rows.where(F.col("gate").isin(*gates)) if gates else rows).collect())


FILES = ("missing_pdf", "missing_truth", "missing_notes", "pdf_unreadable", "page_count", "image", "index_column", "index_case", "coverage_summary")


def test_a_gallery_is_made(spark, made):
    assert files(made) == sorted(["MANIFEST.json", "index.md", *(f"{c}/{c}{s}" for c, n in (("a b", 1), ("b+", 2), ("c", 1)) for s in (".pdf", ".truth.json", ".notes.md", *(f".p{k:02d}.png" for k in range(1, n + 1))))])
    body = json.loads((made / "MANIFEST.json").read_text())
    assert [c["case_id"] for c in body["cases"]] == ["a b", "b+", "c"] and body["cases"][1]["page_count"] == 2 and "fig.index:alpha" in body["cases"][0]["coverage_tags"]
    assert body["coverage_summary"]["counts"]["fig.index:alpha"] == 2 and body["coverage_summary"]["total_cases"] == 3
    assert "| `a b` | ![](a b/a b.p01.png) | core=x, n=2 |  |  |  |" in (made / "index.md").read_text()
    assert list(made.parent.iterdir()) == [made]


def test_its_gates(spark, made):
    found = errors(spark, made)
    assert [e for e in found if e[0] in FILES] == []
    assert [e for e in found if e[1] == "c"] == [("target_overlap", "c", 1, "A.1 body_region 2 body_region"), ("target_overlap", "c", 1, "A.1 caption_region 2 caption_region")]
    whole = {e[0] for e in found}
    assert {"core_count", "negative_count", "case_count", "named_case", "coverage", "suffix", "diagonal_watermark"} <= whole and "alpha_index" not in whole


def test_faults_are_told(spark, made, tmp_path):
    import shutil

    top = tmp_path / "faulty"
    shutil.copytree(made, top)
    (top / "a b/a b.p01.png").write_bytes(b"GIF89a")
    (top / "b+/b+.pdf").write_bytes(PDF(3))
    (top / "b+/b+.notes.md").write_text(" \n")
    (top / "c/c.pdf").unlink()
    index = (top / "index.md").read_text().replace("critique", "words").replace("b+", "bb")
    (top / "index.md").write_text(index)
    assert errors(spark, top, FILES) == sorted([("image", "a b", 1, "a b.p01.png"), ("image", "b+", 3, "b+.p03.png"), ("page_count", "b+", 0, "pdf=3 truth=2"), ("missing_notes", "b+", 0, ""), ("missing_pdf", "c", 0, ""), ("index_case", "b+", 0, ""), ("index_column", "", 0, "critique")])
    truth = json.loads((top / "a b/a b.truth.json").read_text())
    truth["pages"][0]["figures"][0] |= {"body_region": [72, 100, 700, 156], "title_position": "above", "title_body_gap_lines": 7}
    truth["pages"][0]["non_target_text_regions"].append({"kind": "non_target_text", "bbox": [80, 110, 90, 120], "role": "interstitial_text", "line_count": 2})
    truth["layout_sequence"] = [{"type": "figure", "id": "A.1"}]
    (top / "a b/a b.truth.json").write_text(json.dumps(truth))
    found = [e for e in errors(spark, top) if e[1] == "a b" and e[0] not in FILES]
    assert found == [("bbox", "a b", 1, "figure.body_region"), ("contamination", "a b", 1, "figure A.1 body_region"), ("contamination", "a b", 1, "figure A.1 context_region"), ("interstitial_lines", "a b", 1, "1"), ("title_gap", "a b", 1, "A.1"), ("title_position", "a b", 1, "A.1")]
    with pytest.raises(InvalidInput):
        gallery.Gallery(spark, str(tmp_path / "nowhere"))


def test_promotion(spark, made, tmp_path):
    index = (made / "index.md").read_text()
    marked = tmp_path / "index.md"
    marked.write_text(index.replace("n=2 |  |  |  |", "n=2 | 4 | Keep |  |").replace("![](b+/b+.p01.png) | negative=y |  |  |", "![](b+/b+.p01.png) | negative=y | 3 | drop |"))
    out = tmp_path / "frozen"
    assert [r.case_id for r in gallery.promote(spark, str(made), str(out), contracts.read_decisions(spark, str(marked))).collect()] == ["a b"]
    assert files(out) == sorted(["MANIFEST.json", "index.md", *(f"a b/a b{s}" for s in (".pdf", ".truth.json", ".notes.md", ".p01.png"))])
    body = json.loads((out / "MANIFEST.json").read_text())
    assert body["promotion"] == {"source_gallery": str(made), "selection_source": "index.md", "selected_count": 1, "dropped_count": 2} and body["cases"][0]["axes"] == {"core": "x", "n": 2}
    assert (out / "a b/a b.pdf").read_bytes() == PDF(1)
    with pytest.raises(RunError, match="OUTPUT_DIR_EXISTS"):
        gallery.promote(spark, str(made), str(out), keep=["c"])
    gallery.promote(spark, str(made), str(out), keep=["c", "b+"], replace=True)
    assert {f.partition("/")[0] for f in files(out)} == {"MANIFEST.json", "index.md", "b+", "c"}
    for bad in (["nobody"], []):
        with pytest.raises(RunError, match="PROMOTION_FAILED"):
            gallery.promote(spark, str(made), str(tmp_path / "x"), keep=bad)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["frozen", "index.md"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("d/"), F.col("id")).alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken")).cast("string")).otherwise("x").cast("binary").alias("content")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        file_sink.publish(spark, rows, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []
    twice = spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, content binary")
    outside = spark.createDataFrame([("../a", b"1")], "name string, content binary")
    for bad in (twice, outside):
        with pytest.raises(Exception):
            file_sink.publish(spark, bad, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []
    file_sink.publish(spark, spark.createDataFrame([("a/b", b"1"), ("c", None)], "name string, content binary"), str(tmp_path / "out"), {"more": lambda: iter(["x", "y"])})
    assert {p: (tmp_path / "out" / p).read_bytes() for p in files(tmp_path / "out")} == {"a/b": b"1", "c": b"", "more": b"xy"}
