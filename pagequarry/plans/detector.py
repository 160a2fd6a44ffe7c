"""Detection on given pages, lines and drawings, its nested manifest, and contract checks of JSON texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.contracts import DETECTED_VERSION, ORIGIN, UNIT
from . import graph, registry
from .dialect import Spark

PAGE = "doc_id long, page int, width double, height double"
LINE = "doc_id long, page int, line_seq int, text string, x0 double, y0 double, x1 double, y1 double"
DRAWING = "doc_id long, page int, draw_seq int, x0 double, y0 double, x1 double, y1 double"
_EXTRACTED = "path string, kind string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double"
_KINDS = {"path": pa.string(), "kind": pa.string(), "page": pa.int32(), "seq": pa.int32(), "text": pa.string(), **{c: pa.float64() for c in ("x0", "y0", "x1", "y1")}}
#: Texts of a contract, and what finds their faults.
CHECKS = {"detector": ("detector_texts", "v1"), "editor": ("editor_texts", "v2"), "package": ("package_texts", "v3"), "setup": ("setup_texts", "v4"), "review": ("review_texts", "v5"), "scenario": ("scenario_texts", "v6")}

LAST_KEY_COUNTS = "spark.sql.variant.allowDuplicateKeys"

#: What an extractor yields for a document's bytes: (page, width, height, lines, drawings), lines being (text, x0, y0, x1, y1), drawings (x0, y0, x1, y1).
Extractor = Callable[[bytes], Iterable[tuple[int, float, float, list, list]]]


def read_documents(spark: SparkSession, path: str, extract: Extractor) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, lines and drawings of document files, by a given extractor that runs in the tasks, one file at a time.

    doc_id is a hash of the file's path. Lines are trimmed, empty ones and drawings without area dropped.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = []
                for page, width, height, lines, drawings in extract(content.as_py()):
                    found.append((name.as_py(), "page", page, 0, None, 0.0, 0.0, width, height))
                    texts = [(text.strip(), *box) for text, *box in lines if text.strip()]
                    found += [(name.as_py(), "line", page, k, *line) for k, line in enumerate(texts, 1)]
                    found += [(name.as_py(), "drawing", page, k, None, *box) for k, box in enumerate((b for b in drawings if b[2] > b[0] and b[3] > b[1]), 1)]
                columns = list(zip(*found, strict=True)) if found else [[] for _ in _KINDS]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS.values(), strict=True)], names=list(_KINDS))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    every = files.mapInArrow(rows, _EXTRACTED).withColumn("doc_id", F.xxhash64("path"))
    of = lambda kind: every.where(F.col("kind") == kind)
    box = ["x0", "y0", "x1", "y1"]
    return of("page").select("doc_id", "page", F.col("x1").alias("width"), F.col("y1").alias("height")), of("line").select("doc_id", "page", F.col("seq").alias("line_seq"), "text", *box), of("drawing").select("doc_id", "page", F.col("seq").alias("draw_seq"), *box)


def detect(spark: SparkSession, pages: DataFrame, lines: DataFrame, drawings: DataFrame, relation: str = "objects") -> DataFrame:
    """The objects of the pages, or another relation of the detector such as commons."""
    return graph.run(spark, f"SELECT * FROM {relation}", registry.relations(Spark()), {"layout_pages": pages, "lines": lines, "drawings": drawings})


def _box(prefix: str = "") -> F.Column:
    return F.array(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def nested(pages: DataFrame, objects: DataFrame, commons: DataFrame) -> DataFrame:
    """doc_id and pages: page, common_regions, figures and tables as the detector's contract nests them, in reading order."""
    title = [F.col("idx").alias("index"), "title"]
    regions = [_box("cap_").alias("caption_region"), _box("body_").alias("body_region"), _box("ctx_").alias("context_region")]
    figure = F.struct("kind", *title, *regions, "title_position", F.col("gap_lines").alias("title_body_gap_lines"))
    table = F.struct("kind", *title, "table_group_id", "part_index", "is_continuation", "continuation_marker", *regions, "continued_from")
    common = F.struct("kind", _box().alias("bbox"), "text", F.col("region_id").alias("common_region_id"))

    def gathered(df: DataFrame, order: list, item: F.Column, name: str) -> DataFrame:
        both = F.array_sort(F.collect_list(F.struct(*order, item.alias("item"))))
        return df.groupBy("doc_id", "page").agg(F.transform(both, lambda x: x["item"]).alias(name))

    kinds = (gathered(commons, ["kind", "pos"], common, "common_regions"), gathered(objects.where("kind = 'figure'"), ["cap_y0", "anchor_id"], figure, "figures"), gathered(objects.where("kind = 'table'"), ["cap_y0", "anchor_id"], table, "tables"))
    every = pages.select("doc_id", "page")
    for part in kinds:
        every = every.join(part, ["doc_id", "page"], "left")
    filled = [F.coalesce(c, F.array().cast(part.schema[c].dataType)).alias(c) for c, part in zip(("common_regions", "figures", "tables"), kinds, strict=True)]
    page = F.struct("page", *filled)
    return every.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))


def detector_texts(cases: DataFrame, name: str = "pagequarry", version: str = "dev", mode: str = "detector") -> DataFrame:
    """doc and body: one detector manifest a document, from doc_id and pages, and pdf if there is one."""
    pdf = F.col("pdf") if "pdf" in cases.columns else F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".pdf"))
    case = F.struct(F.col("doc_id").cast("string").alias("case_id"), pdf.alias("pdf"), "pages")
    producer = F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(mode).alias("mode"))
    body = F.struct(F.lit(DETECTED_VERSION).alias("schema_version"), F.lit(UNIT).alias("coordinate_unit"), F.lit(ORIGIN).alias("coordinate_origin"), producer.alias("producer"), F.array(case).alias("cases"))
    return cases.select(F.col("doc_id").alias("doc"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def editor_texts(cases: DataFrame, source_detector_manifest: str, version: str = "editor-save-manifest-v0") -> DataFrame:
    """doc and body: an editor manifest with an empty log, from doc_id and pages, and pdf if there is one."""
    pdf = F.col("pdf") if "pdf" in cases.columns else F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".pdf"))
    body = F.struct(F.lit(version).alias("schema_version"), pdf.alias("source_pdf"), F.lit(source_detector_manifest).alias("source_detector_manifest"), F.lit(UNIT).alias("coordinate_unit"), F.lit(ORIGIN).alias("coordinate_origin"), "pages", F.array().cast("array<string>").alias("edits"))
    return cases.select(F.col("doc_id").alias("doc"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def violations(spark: SparkSession, texts: DataFrame, contract: str) -> DataFrame:
    """Faults of texts (doc, body) by contract: doc and violation, or doc, code and field where only the first counts.

    A text that is no JSON has one violation of its own. Of a key that comes twice in an object
    the last counts, as the contracts' readers have it; the session is set to that.
    """
    spark.conf.set(LAST_KEY_COUNTS, "true")
    source, found = CHECKS[contract]
    return graph.run(spark, f"SELECT * FROM {found}", registry.relations(Spark()), {source: texts})
