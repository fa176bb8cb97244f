from pyspark.sql import functions as F

from weftline.functions import extraction as E
from weftline.operators import knowledge as K


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_extraction(spark):
    got = value(spark, "字段名称: ALT_ONE 位段为 3-10 范围: -5 m 到 20 m", lambda c: E.qa_fields(F.lit(""), c))
    assert tuple(got) == ("ALT_ONE", 3, 8, -5.0, 20.0, "m")
    assert value(spark, "formula: value * 2; more", E.formula_only) == "value * 2"
    assert value(spark, "1=A and 2=B", E.formula_only) == "1=A, 2=B"
    assert value(spark, "if x:\n    result = 1", E.formula_only) == "if x:\n    result = 1"
    assert value(spark, "Conversion", E.task_type) == "protocol_conversion" and value(spark, "?", E.conversion_mode) is None
    assert value(spark, "KM", E.unit_family) == "length" and value(spark, "bar", E.unit_family) == "bar"
    assert value(spark, "a, B，a", E.source_list) == ["A", "B"]
    assert value(spark, "x 1 -> A; 1=A, 5-9 = Z", E.normalised_mapping) == "1=A, 5-9=Z"
    assert value(spark, "9 lives 高", E.identifiers) == "f_9_lives_u9ad8" and value(spark, "U+9AD8", E.decoded_names) == "高"
    assert value(spark, 'so: ```json\n[1] {"a": {"b": "}"}} tail', E.json_extracted) == '{"a": {"b": "}"}}'
    assert [tuple(r) for r in value(spark, "- x: value * 2\nno rule here\ny：1=A", E.parsed_rules)] == [("X", "value * 2"), ("Y", "1=A")]
    assert [tuple(r) for r in value(spark, '{"rules": [{"target_field": "t", "formula": "1"}]}', E.parsed_rules)] == [("T", "1")]
    assert value(spark, "k", lambda c: E.message(F.array(F.struct(c.alias("name"), F.lit(1).alias("value")), F.struct(F.lit("K").alias("name"), F.lit(2).alias("value"))))) == {"K": 2}


def test_graph_and_resolution(spark):
    rules = spark.createDataFrame([(1, "p", "J1", "ALT_1", ["A"], "A"), (2, "p", "J1", "ALT_2", ["A", "B"], "A+B"), (3, "p", "J1", "X", [], "0")], "rule_id long, protocol string, message string, target_field string, source_fields array<string>, formula string")
    concepts, nodes, edges = K.bootstrapped(rules)
    assert {r["name"] for r in concepts.collect()} == {"ALT", "X"} and nodes.count() == 5 and edges.count() == 3
    again = K.written_back((concepts, nodes, edges), rules)
    assert [d.count() for d in again] == [2, 5, 3] and K.writable(rules).count() == 2
    fields = spark.createDataFrame([("Alt-1", "g/alt"), ("speed", "h/alt"), ("Speed ", "z")], "field_name string, path string")
    names = spark.createDataFrame([("alt_1",), ("SPEED",), ("none",)], "ref string")
    got = {r["ref"]: (r["field_name"], r["ambiguous"]) for r in K.resolved(names, fields, "ref", ["field_name", "path"]).collect()}
    assert got == {"alt_1": ("Alt-1", False), "SPEED": (None, True), "none": (None, False)}
    messages = spark.createDataFrame([("J1.2",), ("J2.0",), ("Q",)], "message string")
    templates = spark.createDataFrame([("J1.2", ["a"]), ("J2", ["b"]), ("default", ["c"])], "template string, fields array<string>")
    assert {r["message"]: r["template"] for r in K.schema_of(messages, templates).collect()} == {"J1.2": "J1.2", "J2.0": "J2", "Q": "default"}
    assert [r["reference"] for r in K.unknown_references(rules, spark.createDataFrame([("a",)], "field_name string")).collect()] == ["B"]


def test_scores_of_messages_broadcast_no_side(spark):
    """Messages grow with the data, so their joins are shuffled, also where the planner takes a side for small."""
    from weftline.operators import evaluation as V

    rows = spark.range(50).selectExpr("id AS message_id", "'F' AS field_name", "string(id) AS value")
    weights = rows.select("message_id", "field_name").selectExpr("*", "2.0D AS weight").filter("message_id < 5")
    scores = V.field_scores(rows.filter("message_id % 2 = 0"), rows, weights)
    for found in (V.message_scores(scores, rows), V.trace_summary(scores, rows)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 50
