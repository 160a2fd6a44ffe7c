"""Golden comparison of read manifests, on the same relations as the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import TOLERANCES
from ..sources.contracts import InvalidInput, objects
from . import graph, registry
from .dialect import Spark
from .store import stored

PROFILES = {"strict": 1, "loose": 2}
_SIDES = {"truth": ("truth", "truth_regions", "truth_fields", "truth_cases"), "detected": ("detected", "found_regions", "found_fields", "found_cases")}
_CORNERS = ("x0", "y0", "x1", "y1")


class Comparison:
    """Detections against truth, both as case_id and pages. Each side is read once and its parts are written for all that is asked.

    Every case of either side counts, also one without objects. Fields and regions that truth
    lacks are not compared; a null box of a common region fails.
    """

    def __init__(self, spark: SparkSession, truth: DataFrame, detected: DataFrame, profile: str = "strict", allow_extra: bool = False, kind: str | None = None):
        self.spark, self.profile, self.allow_extra, self.kind = spark, profile, allow_extra, kind
        scale = PROFILES[profile]
        self.sides = {"tolerances": spark.createDataFrame([(k, float(x * scale), float(y * scale)) for k, (x, y) in TOLERANCES.items()], "region string, tol_x double, tol_y double")}
        for names, cases in ((_SIDES["truth"], truth), (_SIDES["detected"], detected)):
            kept, boxes, fields = objects(cases)
            if kind:
                kept, boxes = (x.where(F.col("kind") == kind) for x in (kept, boxes))
                fields = fields.where(F.lit(kind == "table"))
            self.sides |= zip(names, (stored(kept, "compared-objects"), stored(boxes, "compared-regions"), stored(fields, "compared-fields"), cases.select("case_id").distinct()), strict=True)
        unknown = self.sides["truth_regions"].where(F.col("region") == "bbox").join(self.sides["detected"].select("case_id", "object_key"), ["case_id", "object_key"], "left_semi").where(F.col("kind").isNull() | ~F.col("kind").isin(*TOLERANCES))
        if bad := unknown.limit(1).collect():
            raise InvalidInput(f"no tolerance for a common region of kind {bad[0]['kind']!r}")

    def relation(self, name: str) -> DataFrame:
        """A relation of the comparison, such as region_checks, field_checks, failure_details or failure_boxes."""
        return graph.run(self.spark, f"SELECT * FROM {name}", registry.relations(Spark()), self.sides)

    def compared(self) -> DataFrame:
        """case_id, object_key, kind, page, idx, status, passed, regions_checked and regions_failed of every object of both sides."""
        return self.relation("compared").withColumn("passed", F.col("passed") | (F.lit(self.allow_extra) & (F.col("status") == "extra")))

    def cases(self) -> DataFrame:
        """case_id of both sides."""
        return self.sides["truth_cases"].union(self.sides["found_cases"]).distinct()

    def summary(self) -> DataFrame:
        """Counts of cases, objects and regions, in one row."""
        done = stored(self.compared(), "compared")
        cases = self.cases().join(done.groupBy("case_id").agg(F.bool_and("passed").alias("passed")), "case_id", "left").withColumn("passed", F.coalesce("passed", F.lit(True)))
        count = lambda c: F.count_if(c).alias
        of_status = [count(F.col("status") != "extra")("objects_expected"), *(count(F.col("status") == s)(f"objects_{s}") for s in ("matched", "missing", "extra"))]
        all_objects = done.agg(*of_status, *(F.coalesce(F.sum(f"regions_{c}"), F.lit(0)).alias(f"regions_{c}") for c in ("checked", "failed")))
        return cases.agg(F.count("*").alias("cases_total"), count(F.col("passed"))("cases_passed"), count(~F.col("passed"))("cases_failed")).crossJoin(all_objects)  # one row each

    def reports(self) -> DataFrame:
        """case_id, passed and objects of every case, objects nested with their regions and fields as the contract's report has them."""
        box = lambda p: F.when(F.col(f"{p}x0").isNotNull(), F.array(*(F.col(f"{p}{c}") for c in _CORNERS)))
        region = F.struct("region", box("t_").alias("expected"), box("f_").alias("actual"), F.when(F.col("reason").isNull(), F.array(*(F.col(f"d{c}") for c in _CORNERS))).alias("delta"), F.struct(F.col("tol_x").alias("x"), F.col("tol_y").alias("y")).alias("tolerance"), "passed", "reason")
        place = F.expr("CASE region WHEN 'body_region' THEN 1 WHEN 'context_region' THEN 2 ELSE 0 END")
        regions = self.relation("region_checks").groupBy("case_id", "object_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), region.alias("r")))), lambda x: x["r"]).alias("regions"))
        order = F.array_position(F.array(*(F.lit(f) for f in ("table_group_id", "part_index", "is_continuation", "continuation_marker", "continued_from"))), F.col("field"))
        field = F.struct("field", "expected", "actual", "passed")
        fields = self.relation("field_checks").groupBy("case_id", "object_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("place"), field.alias("f")))), lambda x: x["f"]).alias("fields"))
        spot = self.sides["truth"].select("case_id", "object_key", F.lit(0).alias("side"), "at", "rank", "pos").unionByName(self.sides["detected"].select("case_id", "object_key", F.lit(1).alias("side"), "at", "rank", "pos"))
        spot = spot.groupBy("case_id", "object_key").agg(F.min(F.struct("side", "at", "rank", "pos")).alias("spot"))
        every = self.compared().join(regions, ["case_id", "object_key"], "left").join(fields, ["case_id", "object_key"], "left").join(spot, ["case_id", "object_key"])
        empty = lambda c: F.coalesce(c, F.array().cast(every.schema[c].dataType)).alias(c)
        each = F.struct(F.split("object_key", r"\|").alias("key"), "kind", "page", F.col("idx").alias("index"), "status", "passed", empty("regions"), empty("fields"))
        nested = every.groupBy("case_id").agg(F.bool_and("passed").alias("passed"), F.transform(F.array_sort(F.collect_list(F.struct("spot", each.alias("o")))), lambda x: x["o"]).alias("objects"))
        out = self.cases().join(nested, "case_id", "left")
        return out.select("case_id", F.coalesce("passed", F.lit(True)).alias("passed"), F.coalesce("objects", F.array().cast(out.schema["objects"].dataType)).alias("objects"))
