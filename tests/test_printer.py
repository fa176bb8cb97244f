"""Printed formulas read again, printed SQL in another engine, and the payload of rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.functions import formula as E
from weftline.functions import printer as P
from weftline.operators import payload

FORMULAS = ["a + b * 2", "a if a > 3 and b < 5 else b", "1 if a == 2 else 2 if b == 3 else 0", "(a - b) / (b - 4)", "not a > b or a == 7", "a % 3 + b // 2", "max(a, b) - min(a, 3)", "-a * 2 if 1 < a <= 6 else abs(b)", "a ** 2"]


@pytest.mark.parametrize("formula", FORMULAS)
def test_printed_text_means_the_same(spark, formula):
    rows = [(a, b) for a in range(10) for b in range(-3, 8)]
    table = spark.createDataFrame(rows, "a long, b long")
    own = {"a": F.col("a"), "b": F.col("b")}
    columns = {"own": E.expression(formula.replace(" if ", " if "), own) if " if " not in formula else None, "sql": F.expr(P.sql_text(formula))}
    text = P.c_text(formula)
    if "//" not in formula and "**" not in formula:
        columns["c"] = E.c_expression(text, own)
    got = table.select("a", "b", *[c.cast("double").alias(n) for n, c in columns.items() if c is not None]).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT a::BIGINT AS a, b::BIGINT AS b FROM range(10) x(a), range(-3, 8) y(b)")
    other = {(a, b): v for a, b, v in con.execute(f"SELECT a, b, CAST({P.sql_text(formula)} AS DOUBLE) FROM t").fetchall()}

    def python(a, b):
        try:
            return float(eval(formula))  # the test's own formulas
        except ZeroDivisionError:
            return None

    for r in got:
        expected = python(r.a, r.b)
        assert other[r.a, r.b] == expected and r.sql == expected
        if "c" in columns:
            assert r.c == expected
        if columns["own"] is not None:
            assert r.own == expected


def test_c_like_text():
    assert P.c_text("result = a.x") == "a.x"
    assert P.c_text("1 if a.x > 3 and b.y else None") == "(((a.x > 3) && b.y) ? 1 : 0)"
    assert P.c_text("a and not (b == True)") == "(a && !((b == 1)))"
    assert P.c_text("0 < x <= 5 or y ** 2 > 1") == "(((0 < x) && (x <= 5)) || (pow(y, 2) > 1))"
    assert P.c_text("a.x * 2") == "a.x * 2" and P.c_text(None) == "" and P.c_text("x if") == "x if"
    assert P.c_text("[1 for x in y if x]") == "[1 for x in y if x]"
    assert P.mapping_text("1=10, 2=20", "s.f") == "(s.f == 1 ? 10 : (s.f == 2 ? 20 : 0))"
    assert P.mapping_text("s.f ? 1 : 2", "s.f") == "s.f ? 1 : 2" and P.mapping_text("a + b", "s.f") == "a + b"
    with pytest.raises(ValueError):
        P.sql_text("__import__('os').system('x')")


def test_payload_of_rules(spark):
    source = "sources array<struct<protocol:string,field:string>>"
    rows = [
        (1, "T1", "f1", "value * 2 if value > 3 else 0", [("Temp-Sensor", "temp")]),
        (2, "T1", "f1", "ignored", [("Temp-Sensor", "temp")]),
        (3, "T1", "f2", "0", []),
        (4, "T1", "f3", "temp + status", [("Temp-Sensor", "temp"), ("temp sensor", "status")]),
        (5, "T1", "f4", "1=10, 2=20", [("Temp-Sensor", "status")]),
        (6, "T2", "g", "status", [("B", "status")]),
        (7, "T2", " ", "x", []),
        (8, None, "x", "x", None),
        (9, "T3", "only", "5", None),
    ]
    got = {(r.target_protocol, r.mode): r for r in payload.conversions(spark.createDataFrame(rows, f"rule_id int, target_protocol string, target_field string, formula string, {source}"), ["rule_id"]).collect()}
    assert set(got) == {("T1", "simple"), ("T1", "joint"), ("T2", "simple"), ("T3", "simple")}
    one = got["T1", "simple"]
    assert [tuple(s) for s in one.sources] == [("temp_sensor", "Temp-Sensor")]
    assert [(r.target_field, r.formula, list(r.source_fields), r.rule_type) for r in one.rules] == [
        ("f1", "((temp_sensor.temp > 3) ? (temp_sensor.temp * 2) : 0)", ["temp_sensor.temp"], "conditional"),
        ("f2", "0", [], "const"),
        ("f4", "(temp_sensor.status == 1 ? 10 : (temp_sensor.status == 2 ? 20 : 0))", ["temp_sensor.status"], "conditional"),
    ]
    two = got["T1", "joint"]
    assert [tuple(s) for s in two.sources] == [("temp_sensor", "Temp-Sensor"), ("temp_sensor_2", "temp sensor")]
    assert [(r.target_field, r.formula, r.rule_type) for r in two.rules] == [("f3", "temp_sensor.temp + temp_sensor_2.status", "expression")]
    assert [(r.formula, r.rule_type) for r in got["T2", "simple"].rules] == [("b.status", "direct")]
    assert [(r.formula, r.rule_type) for r in got["T3", "simple"].rules] == [("5", "const")]


def test_labels_for_names(spark):
    row = spark.createDataFrame([("a.temp + temperature * temp",)], "f string").select(payload.display_names(F.col("f"), {"temp": "Temp (C)", "temperature": "Heat"}).alias("f")).first()
    assert row.f == "a.temp + Heat * Temp (C)"
