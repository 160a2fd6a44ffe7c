"""Readers and writers of the versioned JSON contracts.

Manifests are read as VARIANT, so that an absent field, a null one and one of another type than
expected stay apart; edits and reviews have explicit schemas, none is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the contracts.
UNIT, ORIGIN, DETECTED_VERSION = "pdf_pt", "top-left", "detector-output-v0"

_BOX = "ARRAY<DOUBLE>"
TABLE_FIELDS = ("table_group_id", "part_index", "is_continuation", "continuation_marker", "continued_from")
REGIONS = ("caption_region", "body_region", "context_region")
EDITS = "doc_id LONG, edit_seq LONG, object_id STRING, operation STRING, region STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
REVIEW = f"schema_version STRING, pdf STRING, reviewer STRING, objects ARRAY<STRUCT<object_id: STRING, decision: STRING, notes: STRING, expected_change: MAP<STRING, {_BOX}>>>, missed_objects ARRAY<STRUCT<kind: STRING, page: INT, approximate_region: {_BOX}>>"


class InvalidInput(ValueError):
    """A source that breaks its contract."""


def _refuse(df: DataFrame, bad, message: str) -> None:
    if rows := df.where(bad).limit(3).collect():
        raise InvalidInput(f"{message}: {[r[0] for r in rows]}")


def _whole(spark: SparkSession, schema: str, path) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _variants(spark: SparkSession, path) -> DataFrame:
    """v: each file's document; refused if it can't be parsed."""
    found = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path).select("v", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file"))
    _refuse(found.select("file", "v"), F.col("v").isNull(), "unreadable")
    return found


def get(value: str, name: str, kind: str = "variant"):
    """The field of an object, null where it is absent or no such kind; as a variant, a null that is there is no SQL null."""
    return F.expr(f"try_variant_get({value}, '$.{name}', '{kind}')")


def read_truth(spark: SparkSession, root: str, case_id: str | None = None) -> DataFrame:
    """case_id and pages of the cases that MANIFEST.json lists, read as <case>/<case>.truth.json.

    Without a case filter all files are found by pattern and joined with the list, so that no list of names is collected.
    """
    listed = _variants(spark, f"{root}/MANIFEST.json").select(F.explode(get("v", "cases", "array<variant>")).alias("c"))
    cases = listed.select(get("c", "case_id", "string").alias("case_id"))
    cases = cases.where(F.col("case_id") == case_id) if case_id else cases
    if cases.isEmpty():
        raise InvalidInput("no case to compare")
    found = _variants(spark, f"{root}/{case_id or '*'}/{case_id or '*'}.truth.json").withColumn("case_id", F.regexp_extract("file", r"^(.+)\.truth\.json$", 1))
    truth = found.join(cases, "case_id", "left_semi").select("case_id", *(get("v", k, "string").alias(k) for k in ("coordinate_unit", "coordinate_origin")), get("v", "pages").alias("pages"))
    _refuse(truth, ~(F.col("coordinate_unit").eqNullSafe(UNIT) & F.col("coordinate_origin").eqNullSafe(ORIGIN)), "coordinates of")
    _refuse(cases.join(truth, "case_id", "left_anti"), F.lit(True), "no truth for")
    return truth.select("case_id", "pages")


def read_detected(spark: SparkSession, path: str) -> DataFrame:
    """case_id and pages (a variant) of a detector manifest; of repeated case ids the last counts."""
    doc = _variants(spark, path).select("v", *(get("v", k, "string").alias(k) for k in ("schema_version", "coordinate_unit", "coordinate_origin")))
    _refuse(doc.select("schema_version"), ~F.col("schema_version").eqNullSafe(DETECTED_VERSION), "schema_version")
    _refuse(doc.select("coordinate_origin", "coordinate_unit"), ~(F.col("coordinate_unit").eqNullSafe(UNIT) & F.col("coordinate_origin").eqNullSafe(ORIGIN)), "coordinates")
    cases = doc.select(F.posexplode(get("v", "cases", "array<variant>")).alias("at", "c")).select("at", get("c", "case_id", "string").alias("case_id"), get("c", "pages").alias("pages"))
    last = Window.partitionBy("case_id").orderBy(F.desc("at"))
    return cases.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("case_id", "pages")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, REVIEW, path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """case_id and decision from a review table: its first and fifth cell; header, rule and shorter rows don't count, and of a case's rows the last does."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(F.trim("value").startswith("|")).select("at", cells.alias("c")).where(F.size("c") >= 5)
    rows = rows.select("at", F.regexp_replace(F.get("c", F.lit(0)), "^`|`$", "").alias("case_id"), F.lower(F.get("c", F.lit(4))).alias("decision"))
    rows = rows.where((F.lower("case_id") != "case_id") & ~F.col("case_id").rlike("^[-:]*$"))
    return rows.groupBy("case_id").agg(F.max_by("decision", "at").alias("decision"))


def _kind_of(value: str):
    return F.expr(f"schema_of_variant({value})")


def _value_key(value: str):
    """A text that is equal for values the contract calls equal: numbers by value, true as 1, null only as null."""
    kind, number = _kind_of(value), F.concat(F.lit("n:"), F.expr(f"CAST(try_variant_get({value}, '$', 'double') AS STRING)"))
    return F.when(kind == "VOID", "null").when(kind == "STRING", F.concat(F.lit("s:"), F.expr(f"try_variant_get({value}, '$', 'string')"))).when(kind == "BOOLEAN", F.when(F.expr(f"try_variant_get({value}, '$', 'boolean')"), "n:1.0").otherwise("n:0.0")).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), number).otherwise(F.concat(F.lit("j:"), F.expr(f"to_json({value})")))


def _shown(value: str):
    """As a report writes a value: None, True, 'text', numbers as they are."""
    kind, text = _kind_of(value), F.expr(f"try_variant_get({value}, '$', 'string')")
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    quoted = F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.when(kind == "VOID", "None").when(kind == "STRING", quoted).when(kind == "BOOLEAN", F.initcap(text)).otherwise(F.expr(f"to_json({value})"))


def objects(cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects by identity (the last of a key), their regions and their fields, from nested pages (a variant, or typed).

    A region of a figure or table that is absent or null has no row, a common region's box always
    has one, with null corners if it is null. A field has a row if it is there, also as null.
    """
    pages = F.col("pages") if cases.schema["pages"].dataType.typeName() == "variant" else F.to_variant_object("pages")
    page = cases.select("case_id", pages.alias("pages")).select("case_id", F.posexplode(F.expr("try_variant_get(pages, '$', 'array<variant>')")).alias("at", "p"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    items = [page.select("case_id", "at", get("p", "page", "int").alias("page"), F.lit(k).alias("rank"), F.posexplode(get("p", column, "array<variant>")).alias("pos", "o")) for k, column in enumerate(("common_regions", "figures", "tables"))]
    fields = [get("o", f, "int" if f == "part_index" else "boolean" if f == "is_continuation" else "string").alias(f) for f in TABLE_FIELDS]
    none = [F.lit(None).cast(t).alias(f) for f, t in zip(TABLE_FIELDS, ("string", "int", "boolean", "string", "string"), strict=True)]
    head = ["case_id", "at", "page", "rank", "pos"]
    idx = get("o", "index", "string").alias("idx")
    boxes = lambda *names: F.create_map(*(x for n in names for x in (F.lit(n), get("o", n, "array<double>")))).alias("boxes")
    commons = items[0].select(*head, get("o", "kind", "string").alias("kind"), F.lit("").alias("idx"), *none, boxes("bbox"), F.lit(None).cast("variant").alias("o"))
    figures = items[1].select(*head, F.lit("figure").alias("kind"), idx, *none, boxes(*REGIONS), F.lit(None).cast("variant").alias("o"))
    tables = items[2].select(*head, F.lit("table").alias("kind"), idx, *fields, boxes(*REGIONS), "o")
    every = commons.unionByName(figures).unionByName(tables)
    ordinal = F.when(F.col("rank") == 0, F.row_number().over(Window.partitionBy("case_id", "at", "rank", "kind").orderBy("pos")) - 1)
    key = F.when(F.col("rank") == 0, F.concat_ws("|", F.lit("common"), text("page"), text("kind"), ordinal.cast("string"))).when(F.col("rank") == 1, F.concat_ws("|", F.lit("figure"), text("page"), text("idx")))
    key = key.when(F.col("table_group_id").isNull(), F.concat_ws("|", F.lit("table"), text("page"), text("idx"), text("part_index"))).otherwise(F.concat_ws("|", F.lit("table"), text("table_group_id"), text("part_index")))
    last = Window.partitionBy("case_id", "object_key").orderBy(F.desc("at"), F.desc("rank"), F.desc("pos"))
    kept = every.withColumn("object_key", key).withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")
    regions = kept.select("case_id", "object_key", "kind", "page", F.explode("boxes").alias("region", "b")).where("b IS NOT NULL OR region = 'bbox'")
    regions = regions.select("case_id", "object_key", "kind", "page", "region", *(F.get("b", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))
    there = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), get("o", f).alias("value")) for f in TABLE_FIELDS))).alias("f")
    values = kept.where("kind = 'table'").select("case_id", "object_key", there).select("case_id", "object_key", "f.field", "f.value").where("value IS NOT NULL")
    values = values.select("case_id", "object_key", "field", _value_key("value").alias("val"), _shown("value").alias("shown"))
    return kept.drop("boxes", "o"), regions, values


def write_objects(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.json(path)


def write_manifest(texts: DataFrame, violations: DataFrame, path: str) -> None:
    """JSON texts (body), one manifest a line, only if none has a violation."""
    _refuse(violations, F.lit(True), "violations in")
    texts.select(F.col("body").alias("value")).write.text(path)
