"""Galleries: folders of cases with their truth, notes, documents and page images; checked, made of scenarios, promoted.

All files are found by one listing and handled in tasks: truth as variants, images by their
first bytes, documents by a page counter that may be given. The gates of the self-check are
those of `operators.corpus`, over truth that is read instead of specifications.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import contracts
from ..sources.contracts import ORIGIN, UNIT, InvalidInput, get
from ..sources.file_sink import publish
from ..sources.runs import FROZEN_VERSION, GALLERY_VERSION, KEEP, REVIEW_COLUMNS, RunError, table
from . import graph, registry, scenarios
from .dialect import Spark
from .store import stored

PNG = bytes([0x89]) + b"PNG\r\n\x1a\n"
REQUIRED_COLUMNS = REVIEW_COLUMNS[3:]
_CORNERS = ("x0", "y0", "x1", "y1")
_BOXES = (("caption_region", "cap"), ("body_region", "body"), ("context_region", "ctx"))
#: The text_overlap gate's columns, for galleries whose documents aren't read.
_NO_TEXT = "doc_id string, page int, kind string, id string, key_text string, status string"


def count_pages(content: bytes) -> int | None:
    """Pages of a PDF whose page objects aren't compressed; None if it is none, or none is found."""
    found = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", content))
    return found if content.startswith(b"%PDF-") and found else None


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """file, case_id (its folder) and the columns of Spark's binary files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    name = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return found.withColumns({"file": F.element_at(F.split(name, "/"), -1), "case_id": F.element_at(F.split(name, "/"), -2)})


class Gallery:
    """A gallery read from a folder. pages_of counts the pages of a document's bytes, None where it can't be opened."""

    def __init__(self, spark: SparkSession, root: str, pages_of: Callable[[bytes], int | None] = count_pages):
        self.spark, self.root, self.pages_of = spark, root.rstrip("/"), pages_of
        try:
            manifest = contracts._variants(spark, f"{self.root}/MANIFEST.json")
            self.manifest = manifest.first()["v"]
            self.index = "\n".join(r[0] for r in spark.read.text(f"{self.root}/index.md").toLocalIterator())
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise InvalidInput(f"MANIFEST.json or index.md is missing in {root}") from e
            raise
        listed = manifest.select(F.posexplode(get("v", "cases", "array<variant>")).alias("k", "c"))
        self.cases = stored(listed.select(F.col("k").cast("long").alias("k"), get("c", "case_id", "string").alias("case_id"), F.expr("to_json(c)").alias("entry"), F.expr("try_variant_get(c, '$.axes.core', 'variant') IS NOT NULL").alias("core"), F.expr("try_variant_get(c, '$.axes.negative', 'variant') IS NOT NULL").alias("negative"), get("c", "coverage_tags", "array<string>").alias("tags")), "gallery-cases")

    def truth(self) -> DataFrame:
        """k, case_id and v, the truth of each listed case that has one."""
        found = contracts._variants(self.spark, f"{self.root}/*/*.truth.json").withColumn("case_id", F.regexp_extract("file", r"^(.+)\.truth\.json$", 1))
        return self.cases.select("k", "case_id").join(found.select("case_id", "v"), "case_id")

    def _pages(self) -> DataFrame:
        found = _files(self.spark, self.root, "*.pdf").where(F.col("file") == F.concat("case_id", F.lit(".pdf"))).select("case_id", "content")
        pages_of = self.pages_of

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["case_id"], pa.array([pages_of(x.as_py()) for x in batch["content"]], pa.int32())], names=["case_id", "n"])

        return found.mapInArrow(count, "case_id string, n int")

    def file_errors(self) -> DataFrame:
        """Rows (gate, case_id, page, detail) for files that are absent, empty, no image or of another page count. Without document or truth nothing else of a case is looked at."""
        have = _files(self.spark, self.root, "*").select("case_id", "file", "length")
        of = lambda suffix: have.where(F.col("file") == F.concat("case_id", F.lit(suffix))).select("case_id", F.col("length").alias("bytes"))
        notes = self.spark.read.option("wholetext", True).text(f"{self.root}/*/*.notes.md").select(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file"), (F.trim(F.regexp_replace("value", r"\s+", " ")) != "").alias("said"))
        notes = notes.select(F.regexp_extract("file", r"^(.+)\.notes\.md$", 1).alias("case_id"), "said")
        truth = self.truth().select("case_id", F.size(get("v", "pages", "array<variant>")).alias("in_truth"))
        state = self.cases.select("case_id").join(of(".pdf").withColumnRenamed("bytes", "pdf"), "case_id", "left").join(truth, "case_id", "left").join(notes, "case_id", "left").join(self._pages(), "case_id", "left")
        state = stored(state, "gallery-files")
        row = lambda gate, page=None, detail="": (F.lit(gate).alias("gate"), "case_id", F.lit(page).cast("int").alias("page"), F.lit(detail).alias("detail"))
        whole = state.where("pdf IS NOT NULL AND in_truth IS NOT NULL")
        out = state.where("pdf IS NULL").select(*row("missing_pdf")).unionByName(state.where("pdf IS NOT NULL AND in_truth IS NULL").select(*row("missing_truth")))
        out = out.unionByName(whole.where(~F.coalesce("said", F.lit(False))).select(*row("missing_notes"))).unionByName(whole.where("n IS NULL").select(*row("pdf_unreadable")))
        counts = F.concat(F.lit("pdf="), F.col("n"), F.lit(" truth="), F.col("in_truth"))
        out = out.unionByName(whole.where("n <> in_truth").select(F.lit("page_count").alias("gate"), "case_id", F.lit(None).cast("int").alias("page"), counts.alias("detail")))
        images = _files(self.spark, self.root, "*.png").select("case_id", "file", (F.substring("content", 1, len(PNG)) == F.lit(PNG)).alias("good"))
        wanted = whole.where("n > 0").select("case_id", F.explode(F.sequence(F.lit(1), "n")).alias("page")).withColumn("file", F.concat("case_id", F.lit(".p"), F.lpad(F.col("page").cast("string"), F.greatest(F.lit(2), F.length(F.col("page").cast("string"))), F.lit("0")), F.lit(".png")))
        bad = wanted.join(images, ["case_id", "file"], "left").where(~F.coalesce("good", F.lit(False)))
        return out.unionByName(bad.select(F.lit("image").alias("gate"), "case_id", "page", F.col("file").alias("detail")))

    def relations(self) -> dict[str, DataFrame]:
        """Truth, in the shape of the relations that the gates read."""
        truth = stored(self.truth().select("k", "case_id", F.expr("to_json(v)").alias("body")), "gallery-truth").select("k", "case_id", F.expr("parse_json(body)").alias("v"))
        stress, text = F.coalesce(get("v", "intentional_overlap_stress", "boolean"), F.lit(False)), "string"
        cases = self.cases.join(truth.select("k", stress.alias("stress")), "k", "left").select("k", "case_id", F.expr("CASE WHEN core THEN 'core' WHEN negative THEN 'negative' ELSE 'other' END").alias("axis"), F.coalesce("stress", F.lit(False)).alias("stress"))
        page = truth.select("k", "case_id", F.posexplode(get("v", "pages", "array<variant>")).alias("at", "p")).select("k", "case_id", get("p", "page", "int").alias("page"), get("p", "width", "double").alias("width"), get("p", "height", "double").alias("height"), "p")
        corners = lambda name, prefix: [F.get(get("o", name, "array<double>"), F.lit(i)).alias(f"{prefix}{c}") for i, c in enumerate(_CORNERS)]
        items = lambda name: page.select("k", "case_id", "page", "width", "height", F.posexplode(get("p", name, "array<variant>")).alias("pos", "o"))
        head, boxes = ["k", "case_id", "page", "width", "height"], [c for name, p in _BOXES for c in corners(name, f"{p}_")]

        def target(kind: str, first: int) -> DataFrame:
            is_table = kind == "table"
            field = lambda name, as_: get("o", name, as_) if is_table else F.lit(None).cast(as_)
            return items(f"{kind}s").select(*head, F.lit(kind).alias("kind"), (F.col("pos") + first).alias("j"), get("o", "index", text).alias("idx"), get("o", "title", text).alias("title"), field("table_group_id", text).alias("group_id"), field("part_index", "int").alias("part_index"), F.coalesce(field("is_continuation", "boolean"), F.lit(False)).alias("is_continuation"), field("continuation_marker", text).alias("marker"), get("o", "title_position", text).alias("title_position"), get("o", "title_body_gap_lines", "int").alias("gap_lines"), *boxes)

        common = items("common_regions").select(*head, get("o", "kind", text).alias("kind"), get("o", "text", text).alias("text"), F.coalesce(get("o", "rotation_deg", "double"), F.lit(0.0)).alias("rotation"), *corners("bbox", ""))
        plain = items("non_target_text_regions").select("k", "case_id", "page", "pos", get("o", "role", text).alias("role"), F.coalesce(get("o", "line_count", "int"), F.lit(0)).alias("line_count"), *corners("bbox", ""))
        step = truth.select("k", "case_id", F.posexplode(get("v", "layout_sequence", "array<variant>")).alias("pos", "o"))
        sequence = step.select("k", "case_id", F.lit(1).alias("page"), "pos", F.when(get("o", "type", text).isin("figure", "table"), get("o", "type", text)).otherwise("text").alias("kind"), get("o", "id", text).alias("idx"), F.coalesce(get("o", "line_count", "int"), F.lit(1)).alias("line_count"))
        marks = common.where("kind = 'watermark'").select("k", "case_id", "page", "rotation")
        none = self.spark.createDataFrame([], _NO_TEXT)
        made = {"case_specs": cases, "spec_truth": target("figure", 1).unionByName(target("table", 100_001)), "common_boxes": common, "wm_pages": marks, "plain_specs": plain, "layout_sequence": sequence, "tags": self.cases.select("k", F.explode("tags").alias("tag")).distinct()}
        return {n: stored(df, f"gallery-{n}") for n, df in made.items()} | {"text_overlap": none}

    def errors(self, text_overlap: DataFrame | None = None) -> DataFrame:
        """Every failed gate as a row (gate, case_id, page, detail): files, boxes, counts, names, coverage, overlaps, titles, order, index and summary.

        text_overlap: doc_id, page, kind, key_text and status of regions whose text was looked for
        in the documents (see text_overlap in operators.corpus); without it that gate isn't checked.
        """
        sources = self.relations()
        if text_overlap is not None:
            sources["text_overlap"] = text_overlap
        gates = graph.run(self.spark, "SELECT gate, case_id, page, detail FROM self_check_errors", registry.relations(Spark()), sources)
        rows = [("index_column", None, None, c) for c in REQUIRED_COLUMNS if c not in self.index]
        body = self.manifest.toPython()
        summary = body.get("coverage_summary") if isinstance(body, dict) else None
        rows += [] if isinstance(summary, dict) and "counts" in summary else [("coverage_summary", None, None, "")]
        own = self.spark.createDataFrame(rows, "gate string, case_id string, page int, detail string")
        unlisted = self.cases.where(~F.contains(F.lit(self.index), F.col("case_id"))).select(F.lit("index_case").alias("gate"), "case_id", F.lit(None).cast("int").alias("page"), F.lit("").alias("detail"))
        return self.file_errors().unionByName(gates).unionByName(own).unionByName(unlisted)


def _manifest(head: dict, entries: DataFrame) -> Callable[[], Iterator[str]]:
    """The pieces of a manifest: its head and, one after the other, the cases' entries (JSON, by place)."""

    def pieces() -> Iterator[str]:
        yield json.dumps(head, ensure_ascii=False, indent=2).removesuffix("\n}") + ',\n  "cases": ['
        for n, r in enumerate(entries.orderBy("place").select("entry").toLocalIterator()):
            yield (",\n    " if n else "\n    ") + r["entry"]
        yield "\n  ]\n}\n"

    return pieces


def _index(title: str, columns: tuple[str, ...], rows: DataFrame) -> Callable[[], Iterator[str]]:
    """The pieces of an index page: a table with a row (cells, by place) for each case."""

    def pieces() -> Iterator[str]:
        yield "\n".join([f"# {title}", "", *table(columns, [])]) + "\n"
        for r in rows.orderBy("place").select("cells").toLocalIterator():
            yield "| " + " | ".join(r["cells"]) + " |\n"

    return pieces


def _axes(entry: str):
    """axis=value of a case's entry, by axis."""
    axes = F.expr(f"try_variant_get(parse_json({entry}), '$.axes', 'map<string,variant>')")
    text = F.transform(F.array_sort(F.map_entries(F.transform_values(axes, lambda k, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(text, ", "), F.lit(""))


def generate(spark: SparkSession, texts: DataFrame, out: str, documents: DataFrame | None = None, replace: bool = False) -> None:
    """A gallery of the valid scenarios: truth and notes of each case, manifest with coverage, index; `documents` (name, content) are more files, such as drawn pages."""
    made = stored(scenarios.truths(spark, texts), "gallery-made")
    if twice := made.groupBy("case_id").count().where("count > 1").limit(1).collect():
        raise InvalidInput(f"more than one scenario of a case: {twice[0]['case_id']}")
    file = lambda suffix: F.concat("case_id", F.lit("/"), "case_id", F.lit(suffix)).alias("name")
    files = made.select(file(".truth.json"), F.concat("body", F.lit("\n")).cast("binary").alias("content")).unionByName(made.select(file(".notes.md"), F.concat(F.trim("notes"), F.lit("\n")).cast("binary").alias("content")))
    if documents is not None:
        files = files.unionByName(documents.select("name", "content"))
    tags = scenarios.compiled(spark, texts, "tags").groupBy(F.col("k").alias("doc")).agg(F.to_json(F.array_sort(F.collect_set("tag"))).alias("tags"))
    pages = scenarios.compiled(spark, texts, "case_specs").select(F.col("k").alias("doc"), "page_count")
    entry = F.concat(F.lit('{"case_id": '), F.to_json(F.col("case_id").cast("variant")), F.lit(', "axes": '), "axes", F.lit(', "page_count": '), "page_count", F.lit(', "coverage_tags": '), "tags", F.lit("}"))
    entries = stored(made.join(tags, "doc").join(pages, "doc").select(F.col("case_id").alias("place"), "case_id", entry.alias("entry")), "gallery-entries")
    counts = {r["tag"]: r["n"] for r in scenarios.compiled(spark, texts, "tag_counts").orderBy("tag").toLocalIterator()}  # one for each tag that is known
    cover = scenarios.compiled(spark, texts, "coverage").collect()
    summary = {"total_cases": entries.count(), "counts": counts, "required": [{"tag": r["tag"], "count": r["n"], "min": r["need"]} for r in cover], "missing": sorted(r["tag"] for r in cover if r["status"] == "missing"), "below_min": sorted(r["tag"] for r in cover if r["status"] == "below_min")}
    head = {"schema_version": GALLERY_VERSION, "coordinate_unit": UNIT, "coordinate_origin": ORIGIN, "generation": {"seed": None}, "coverage_summary": summary}
    code = F.concat(F.lit("`"), "case_id", F.lit("`"))
    cells = F.array(code, F.concat(F.lit("![]("), "case_id", F.lit("/"), "case_id", F.lit(".p01.png)")), _axes("entry"), *(F.lit("") for _ in REQUIRED_COLUMNS))
    publish(spark, files, out, {"MANIFEST.json": _manifest(head, entries), "index.md": _index("Gallery", REVIEW_COLUMNS, entries.select("place", cells.alias("cells")))}, replace)


def promote(spark: SparkSession, gallery: str, out: str, decisions: DataFrame | None = None, keep: list[str] | None = None, replace: bool = False, allow_empty: bool = False) -> DataFrame:
    """Copies the kept cases' folders, by a list or by decisions (case_id, decision), with a manifest and an index; returns their ids.

    Files are read and written in the tasks, as a whole or not at all.
    """
    root = gallery.rstrip("/")
    doc = contracts._variants(spark, f"{root}/MANIFEST.json")
    cases = stored(doc.select(F.posexplode(get("v", "cases", "array<variant>")).alias("place", "c")).select("place", get("c", "case_id", "string").alias("case_id"), F.expr("to_json(c)").alias("entry"), get("c", "page_count", "string").alias("pages")), "gallery-cases")
    if keep is not None:
        wanted = spark.createDataFrame([(c,) for c in dict.fromkeys(keep)], "case_id string")
        if unknown := wanted.join(cases, "case_id", "left_anti").limit(3).collect():
            raise RunError("PROMOTION_FAILED", f"unknown cases: {[r[0] for r in unknown]}")
    else:
        wanted = decisions.where(F.lower(F.trim("decision")) == KEEP).select("case_id").distinct()
    chosen = stored(cases.join(wanted, "case_id", "left_semi"), "gallery-chosen")
    n, every = chosen.count(), cases.count()
    if not n and not allow_empty:
        raise RunError("PROMOTION_FAILED", "no case is marked keep")
    files = _files(spark, root, "*").withColumn("name", F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"/{root.rpartition('/')[2]}/", -1))
    files = files.withColumn("case_id", F.substring_index("name", "/", 1)).where(F.contains("name", F.lit("/"))).join(chosen.select("case_id"), "case_id", "left_semi")
    if missing := chosen.join(files.select("case_id").distinct(), "case_id", "left_anti").limit(3).collect():
        raise RunError("PROMOTION_FAILED", f"no folder for: {[r['case_id'] for r in missing]}")
    version = doc.select(F.coalesce(get("v", "schema_version", "string"), F.lit(GALLERY_VERSION))).first()[0]
    counts = {"source_gallery": gallery, "selection_source": "cli" if keep is not None else "index.md", "selected_count": n, "dropped_count": every - n}
    head = {"schema_version": FROZEN_VERSION, "source_gallery_schema_version": version, "coordinate_unit": UNIT, "coordinate_origin": ORIGIN, "promotion": counts}
    path = lambda suffix: F.concat("case_id", F.lit("/"), "case_id", F.lit(suffix))
    cells = F.array(F.concat(F.lit("`"), "case_id", F.lit("`")), _axes("entry"), F.coalesce("pages", F.lit("")), path(".pdf"), path(".truth.json"))
    more = {"MANIFEST.json": _manifest(head, chosen), "index.md": _index("Frozen cases", ("case_id", "axis tags", "pages", "pdf", "truth"), chosen.select("place", cells.alias("cells")))}
    try:
        publish(spark, files.select("name", "content"), out, more, replace)
    except InvalidInput as e:
        raise RunError("OUTPUT_DIR_EXISTS", out) if "exists" in str(e) else e from e
    return chosen.select("case_id")
