"""What keeps moved data and the driver's memory in proportion to the input."""

import pytest

from pagequarry.plans import graph, registry
from pagequarry.plans.dialect import Spark

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def over(spark, sql, known=registry.relations):
    known = known(Spark())
    return graph.run(spark, sql, known, graph.tables(spark, SMALL, sql, known), SMALL, graph.stamps(spark, SMALL, sql, known))


@pytest.mark.parametrize("sql", ["SELECT a.doc_id, l.text FROM anchors a JOIN line_captions l ON a.doc_id = l.doc_id AND a.page = l.page AND a.anchor_id = l.line_seq", "SELECT a.doc_id, g.group_id FROM anchors a JOIN table_groups g ON a.doc_id = g.doc_id AND a.page = g.page AND a.anchor_id = g.anchor_id"])
def test_joins_within_documents_move_nothing(spark, sql):
    """Written relations lie by document, so a join by document, page and more needs no shuffle and no broadcast, however small they are."""
    df = over(spark, sql)
    assert "Exchange" not in plan(df) and df.count() > 0


@pytest.mark.parametrize("sql", ["SELECT t.case_id, t.field FROM truth_fields t JOIN diff x ON x.case_id = t.case_id AND x.object_key = t.object_key", "SELECT f.case_id, f.val FROM truth_fields t JOIN found_fields f ON f.case_id = t.case_id AND f.object_key = t.object_key AND f.field = t.field"])
def test_comparing_fields_moves_nothing(spark, sql):
    """Fields of either side lie by case as objects do, so a case's fields meet its objects and each other where they are."""
    df = over(spark, sql)
    assert "Exchange" not in plan(df) and df.count() > 0


def test_diff_is_written_where_its_sides_are(spark, monkeypatch):
    """Both sides lie by case, and so does the outer join's row of either."""
    moved, bucketed = {}, graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda df, n, keys, files, shuffle=True: (moved.setdefault(n, shuffle), bucketed(df, n, keys, files, shuffle))[1])
    graph.forget()
    assert over(spark, "SELECT * FROM diff").count() > 0
    assert moved["diff"] is False


def test_what_several_read_is_made_once(spark):
    """Members of cores, boxes of headers and checks of fields are read where they lie, not made anew by each that reads them."""
    known = registry.relations(Spark())
    for n in ("zone_drawings", "core_members", "common_all", "region_checks", "field_checks"):
        df = over(spark, f"SELECT * FROM {n}")
        assert plan(df).count("FileScan") == 1 and "Exchange" not in plan(df) and n in known


def test_written_texts_are_not_broadcast(spark):
    """A file of texts is a thousandth of the texts, so its size is no reason to send them through the driver."""
    df = registry.queries()["v6_scenario"](spark, SMALL)
    assert "Broadcast" not in plan(df)


def test_scenarios_are_parsed_once(spark):
    """Whatever reads a scenario's fields, items or faults reads what was written of its one parse."""
    for name in ("v6_scenario", "f7_scenario_guards", "v8_exit_codes"):
        assert "body#" not in plan(registry.queries()[name](spark, SMALL))


def test_detector_texts_are_parsed_once(spark):
    """Every branch of the checks reads what was written of the one parse, where its text lies."""
    assert "parsejson" not in plan(registry.queries()["v1_detector_output"](spark, SMALL)).lower()


def test_kinds_are_told_without_building_what_is_below(spark):
    """Each look at a value tells all of its kinds, as one look for each of them does."""
    texts = ["null", "1", "1.5", "1e300", '"x"', "true", "[]", "{}", '[{"a":1}]', '{"a":[1]}', '{"b":1}', '{"a":null}', '{"a":"2"}', '{"a":{"c":[1]}}', "{"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc long, body string").selectExpr("doc", "try_parse_json(body) AS v")
    kinds = ("null", "number", "int", "string", "bool", "array", "object", "absent")
    for path in ("", "a"):
        got = rows.selectExpr("doc", f"coalesce({Spark().kind('v', path)}, 'absent') AS kind", *(f"{Spark().is_kind('v', path, (k,))} AS {k}_" for k in kinds), f"{Spark().is_kind('v', path, kinds[1:5])} AS scalar").collect()
        assert [[k for k in kinds if r[f"{k}_"]] for r in got] == [[r.kind] for r in got]
        assert [r.scalar for r in got] == [r.kind in kinds[1:5] for r in got]
    assert "array<variant>" not in Spark().is_kind("v", "a", kinds) + Spark().four_numbers("v", "a")


def test_boxes_are_four_numbers(spark):
    good = ["[1,2,3,4]", "[1,2.5,3,4]", "[1e300,2,3,4]", "[1.5,2.5,3.5,-4e2]", "[99999999999999999999999,2,3,4]"]
    bad = ["[1,2,3]", "[1,2,3,4,5]", "[1,2,3,null]", "[1,2,3,null,4]", "[null,null,null,null]", "[1,2,3,true]", '[1,2,3,"4"]', "[1,2,3,[4]]", "[]", "{}", "4", "null", '{"a":4}']
    rows = spark.createDataFrame([(t,) for t in good + bad], "body string").selectExpr("body", "try_parse_json(body) AS v", "try_parse_json(concat('{\"a\":', body, '}')) AS w", "try_parse_json('{}') AS none")
    got = rows.selectExpr("body", f"{Spark().four_numbers('v', '')} AS x", f"{Spark().four_numbers('w', 'a')} AS y", f"{Spark().four_numbers('none', 'a')} AS z").collect()
    assert [tuple(r)[1:] for r in got] == [(r.body in good, r.body in good, False) for r in got]


def test_written_scenarios_keep_2_and_2_0_apart(spark):
    """Shredded values would make them one; the setting of the session stays as it was."""
    shredded = spark.conf.get(graph.SHREDDED)
    texts = spark.createDataFrame([(k, f'{{"case_id":"c","page":{{"page_count":{n}}}}}') for k, n in enumerate(["2", "2.0", "3", "2e0"])], "doc long, body string")
    got = graph.run(spark, "SELECT doc, code FROM v6", registry.relations(Spark()), {"scenario_texts": texts})
    assert sorted(map(tuple, got.collect())) == [(0, "ok"), (1, "SCENARIO_INVALID_VALUE"), (2, "ok"), (3, "SCENARIO_INVALID_VALUE")]
    assert spark.conf.get(graph.SHREDDED) == shredded


def test_lists_of_values_are_broadcast(spark):
    """A few fixed values go to the rows, not the rows to them."""
    df = over(spark, "SELECT a.doc_id, i.task FROM anchors a JOIN issue_list i ON i.place = a.anchor_id % 8")
    assert "BroadcastHashJoin" in plan(df)


def test_replay_starts_from_the_objects_that_edits_name(spark, monkeypatch):
    """State that no edit looks up isn't set up, and the result stays that of the batch relations."""
    from pagequarry.streaming import edits, queries

    seen, replayed = [], edits.replayed
    monkeypatch.setattr(edits, "replayed", lambda s, log, objects, *rest: (seen.append((objects.select(*edits.KEY).distinct().count(), s.read.parquet(log).select(*edits.KEY).distinct().count())), replayed(s, log, objects, *rest))[1])
    got = queries.it4_stream_replay(spark, SMALL)
    want = over(spark, queries.BATCH)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert 0 < seen[0][0] <= seen[0][1] < over(spark, "SELECT DISTINCT doc_id, object_id FROM stream_objects").count()
