"""Given scenario files: their errors, the cases they compile to, and the truth of each case as its contract nests it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.contracts import ORIGIN, UNIT, InvalidInput
from ..sources.mappings import parse_mapping
from . import graph, registry
from .dialect import Spark
from .store import stored

_NULL = "parse_json('null')"


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """doc (a hash of the path), file, body (JSON, null if it can't be read) and fault of scenario files, YAML or JSON, read in the tasks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, faults = [], []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    bodies.append(json.dumps(parse_mapping(content.as_py().decode(), "." + name.as_py().rpartition(".")[2].lower())))
                    faults.append(None)
                except (InvalidInput, UnicodeDecodeError) as e:
                    bodies.append(None)
                    faults.append("SCENARIO_INVALID_VALUE" if "mapping" in str(e) else "SCENARIO_FILE_UNREADABLE")
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(bodies, pa.string()), pa.array(faults, pa.string())], names=["file", "body", "fault"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, body string, fault string")
    return found.select(F.xxhash64("file").alias("doc"), "file", "body", "fault")


def compiled(spark: SparkSession, texts: DataFrame, relation: str) -> DataFrame:
    """A relation over the valid ones of scenario texts (doc, body): case_specs, target_specs, spec_truth, tags, coverage, self_check_errors and what they come from."""
    return graph.run(spark, f"SELECT * FROM {relation}", registry.compiled(Spark()), {"scenario_texts": texts.where("body IS NOT NULL").select("doc", "body")})


def errors(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """doc, code and field of each text's first error; code `ok` where there is none, and the fault of a file that can't be read."""
    found = compiled(spark, texts, "v6")
    unread = texts.where("body IS NULL").select("doc", (F.col("fault") if "fault" in texts.columns else F.lit("SCENARIO_FILE_UNREADABLE")).alias("code"), F.lit("").alias("field"))
    return found.unionByName(unread)


def _object(*pairs: tuple[str, Column | str], **optional: tuple[Column, Column]) -> Column:
    """A JSON object: fields in order, null as null; the optional ones (value, condition) are absent where the condition doesn't hold."""
    of = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("variant"), F.expr(_NULL))
    parts = [F.create_map(*(x for n, c in pairs for x in (F.lit(n), of(c))))]
    parts += [F.when(there, F.create_map(F.lit(n), of(c))).otherwise(F.expr("CAST(map() AS MAP<STRING, VARIANT>)")) for n, (c, there) in optional.items()]
    return F.map_concat(*parts)


def truths(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """doc, case_id, axes and body: the truth of every compiled case, without drawing it. Pages without anything are there, with empty lists."""
    at = {n: stored(compiled(spark, texts, n), f"compiled-{n}") for n in ("case_specs", "case_pages_of", "hf_pages", "wm_pages", "spec_truth", "plain_specs", "sx_roots_axes")}
    box = lambda p="": F.array(*(F.col(f"{p}{c}").cast("double") for c in ("x0", "y0", "x1", "y1")))
    # to a hundredth, as all boxes of the contract
    exact = lambda df, p="": df.withColumns({f"{p}{c}": F.expr(Spark().hundredths(f"CAST({p}{c} AS DOUBLE)")) for c in ("x0", "y0", "x1", "y1")})
    true, turned = F.lit(True), F.expr(Spark().hundredths("CAST(rotation AS DOUBLE)"))
    bands = exact(at["hf_pages"]).select("k", F.col("page_no").alias("page"), F.when(F.col("kind") == "header", 0).otherwise(1).alias("place"), _object(("kind", "kind"), ("bbox", box()), ("text", "text"), variable_text=(true, F.col("variable_text"))).alias("item"))
    specs = compiled(spark, texts, "wm_specs").select("k", "variable_text")
    marks = exact(at["wm_pages"]).join(specs, "k").select("k", F.col("page_no").alias("page"), F.lit(2).alias("place"), _object(("kind", F.lit("watermark")), ("bbox", box()), ("text", "text"), variable_text=(true, F.col("variable_text")), rotation_deg=(turned, true)).alias("item"))
    regions = [("caption_region", box("cap_")), ("body_region", box("body_"))]
    figure = _object(("kind", "kind"), ("index", "idx"), ("title", "title"), *regions, ("context_region", box("ctx_")), ("body_kind", "body_kind"), ("title_position", "title_position"), ("title_body_gap_lines", "gap_lines"))
    table = _object(("kind", "kind"), ("index", "idx"), ("title", "title"), ("table_group_id", "group_id"), ("part_index", "part_index"), ("is_continuation", "is_continuation"), ("continuation_marker", "marker"), *regions, ("title_position", "title_position"), ("title_body_gap_lines", "gap_lines"), ("context_region", box("ctx_")), continued_from=(F.col("continued_from"), F.col("continued_from").isNotNull()))
    target = lambda kind, item: at["spec_truth"].where(F.col("kind") == kind).select("k", "page", F.col("j").alias("place"), item.alias("item"))
    plain = at["plain_specs"].select("k", "page", F.col("pos").alias("place"), _object(("kind", F.lit("non_target_text")), ("bbox", box()), ("role", "role")).alias("item"))
    lists = {"common_regions": bands.unionByName(marks), "figures": target("figure", figure), "tables": target("table", table), "non_target_text_regions": plain}
    page = at["case_pages_of"].select("k", F.col("page_no").alias("page")).join(at["case_specs"].select("k", "width", "height"), "k")
    for name, rows in lists.items():
        text = F.transform(F.array_sort(F.collect_list(F.struct("place", F.to_json("item", {"ignoreNullFields": "false"}).alias("text")))), lambda x: x["text"])
        page = page.join(rows.groupBy("k", "page").agg(text.alias(name)), ["k", "page"], "left")
    listed = [F.concat(F.lit(f',"{n}":['), F.array_join(F.coalesce(n, F.array().cast("array<string>")), ","), F.lit("]")) for n in lists]
    size = F.to_json(F.struct("page", "width", "height"))
    pages = page.withColumn("text", F.concat(F.rtrim(size, F.lit("}")), *listed, F.lit("}"))).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), ",").alias("pages"))
    cases = at["case_specs"].select("k", "case_id").join(at["sx_roots_axes"], "k").join(pages, "k")
    head = F.concat(F.lit('{"case_id":'), F.to_json(F.col("case_id").cast("variant")), F.lit(',"axes":'), "axes", F.lit(',"realistic":'), F.col("realistic").cast("string"))
    fixed = F.lit(f',"intentional_overlap_stress":false,"layout_sequence":[],"coordinate_unit":"{UNIT}","coordinate_origin":"{ORIGIN}","pages":[')
    return cases.select(F.col("k").alias("doc"), "case_id", "axes", "notes", F.concat(head, fixed, "pages", F.lit("]}")).alias("body"))
