"""Rules out of JSON of any shape."""

import json

from weftline.sources import payloads

RULE = {"target_field": " T1 ", "formula": "a.x * 2", "source_fields": ["a.x"], "description": "d", "default_value": 0}
SHAPES = {
    1: {"conversions": [{"rules": [RULE, 5]}, "no", {"rules": None}]},
    2: {"data": {"body": {"data": {"rules": [RULE]}}}},
    3: {"conversions": [], "generated_rules": [RULE, None]},
    4: {"target_field_rules": [RULE]},
    5: {"normalized_rules": [RULE], "rules": "no list"},
    6: [RULE, [RULE], "x"],
    7: {"rules": [], "generated_rules": [RULE]},
    8: {"nothing": 1},
    9: {"data": [RULE], "rules": [RULE]},
}


def test_lists_are_found_wherever_they_lie(spark):
    rows = [(k, ("﻿" if k % 2 else " ") + json.dumps(v)) for k, v in SHAPES.items()] + [(10, "no json {"), (11, None), (12, "")]
    got = payloads.rules(spark.createDataFrame(rows, "id int, payload string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.id, []).append(r)
    assert {k: len(v) for k, v in found.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 1}
    assert all((r.target_field, r.formula, list(r.source_fields), r.rule_type, r.description, r.default_value) == ("T1", "a.x * 2", ["a.x"], "direct", "d", "0") for r in got)


def test_keys_stand_for_one_another(spark):
    items = [
        {"field_name": "F", "rule": "5"}, {"target_field": "", "field_name": "G", "conversion_formula": "x + 1", "source_fields": " a , b ,"}, {"target_field": "H", "formula": 0, "rule": "0"},
        {"target_field": "I", "formula": "q", "source_field": "p.q", "formula_kind": "PYTHON_EXPR"}, {"target_field": "J", "formula": "7", "source_fields": []}, {"formula": "1"}, {"target_field": "K", "formula": "z", "source_field": "p.q"},
    ]
    got = payloads.rules(spark.createDataFrame([(json.dumps({"rules": items}),)], "payload string")).collect()
    assert [(r.target_field, r.formula, list(r.source_fields), r.rule_type) for r in sorted(got, key=lambda r: r.place)] == [
        ("F", "5", ["F"], "expression"), ("G", "x + 1", ["a", "b"], "expression"), ("H", "0", [], "const"), ("I", "q", ["p.q"], "python_expr"), ("J", "7", [], "const"), ("K", "z", ["p.q"], "expression"),
    ]


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text("﻿" + json.dumps(SHAPES[1], indent=1), encoding="utf-8")
    assert [r.target_field for r in payloads.rules(payloads.files(spark, str(tmp_path))).collect()] == ["T1"]
