import random

import pytest
from pyspark.sql import functions as F

from pagequarry.plans import detector, graph, registry
from pagequarry.plans.dialect import Spark
from pagequarry.streaming import edits as E

BOX = "x0 double, y0 double, x1 double, y1 double"
REGIONS = ("caption_region", "body_region", "context_region", "bbox", "title")


def log(seed=4, n=160):
    """Edits of a few objects: good, bad, out of the page, of unknown objects and regions, three decimals."""
    rng = random.Random(seed)
    names = ["figure:1:page1", "table:2:page1", "common:h:page2", "figure:9:page9"]
    rows = []
    for k in range(1, n + 1):
        x, y = rng.randrange(-2000, 500000) / 1000, rng.randrange(-2000, 600000) / 1000
        w, h = rng.choice([1, 1, 1, -1]) * rng.randrange(1, 200000) / 1000, rng.randrange(1, 200000) / 1000
        rows.append((k, rng.choice([1, 1, 2]), 1, rng.choice(names), rng.choice(REGIONS), x, y, x + w, y + h))
    return rows


@pytest.fixture(scope="module")
def sides(spark):
    objects = [(d, p, k, "i", "t", o, 5 + p) for d in (1, 2) for p, k, o in ((1, "figure", "figure:1:page1"), (1, "table", "table:2:page1"), (2, "common", "common:h:page2"))]
    boxes = [(d, p, k, o, 5 + p, r, 10.0, 20.0, 30.0, 40.0 + d) for d, p, k, _, _, o, _ in objects for r in (("bbox",) if k == "common" else ("caption_region", "body_region"))]
    edits = spark.createDataFrame(log(), f"edit_seq long, doc_id long, page int, object_id string, region string, {BOX}")
    sources = {"editor_objects": spark.createDataFrame(objects, "doc_id long, page int, kind string, idx string, title string, object_id string, place int"), "overlay_boxes": spark.createDataFrame(boxes, f"doc_id long, page int, kind string, object_id string, place int, region string, {BOX}"), "edits": edits, "layout_pages": spark.createDataFrame([(d, p, 612.0, 792.0) for d in (1, 2) for p in (1, 2)], detector.PAGE)}
    rows = lambda relation: graph.run(spark, f"SELECT * FROM {relation}", registry.relations(Spark()), sources)
    initial = rows("stream_objects")
    want = rows("edit_checks").join(rows("edit_history").select("edit_seq", *(f"before_{c}" for c in ("x0", "y0", "x1", "y1"))), "edit_seq", "left")
    columns = ["edit_seq", "doc_id", "object_id", "region", "code", *(f"before_{c}" for c in ("x0", "y0", "x1", "y1")), "x0", "y0", "x1", "y1"]
    return edits, initial, sorted(map(tuple, want.select(*columns).collect()), key=repr), columns


def played(spark, sides, tmp_path, batches):
    """Feeds batches one after the other, the stream being started again for each."""
    edits, initial, _, columns = sides
    for k, batch in enumerate(batches):
        edits.where(F.col("edit_seq").isin(batch)).drop("page").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        out = E.replayed(spark, str(tmp_path / "log"), initial, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return sorted(map(tuple, out.select(*columns).collect()), key=repr)


def test_in_order_with_restarts(spark, sides, tmp_path):
    every = list(range(1, 161))
    assert played(spark, sides, tmp_path, [every[:50], every[50:51], every[51:]]) == sides[2]


def test_late_and_repeated(spark, sides, tmp_path):
    every = list(range(1, 161))
    random.Random(1).shuffle(every)
    batches = [every[:40], every[40:90], every[30:60], every[90:]]
    assert played(spark, sides, tmp_path, batches) == sides[2]
    codes = {r[4] for r in sides[2]}
    assert codes == {"ok", "EDIT_OBJECT_NOT_FOUND", "EDIT_REGION_NOT_FOUND", "EDIT_BAD_BBOX", "EDIT_OUT_OF_PAGE_BOUNDS"}
