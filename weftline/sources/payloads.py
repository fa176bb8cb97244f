"""Rules out of JSON whose shape is not known beforehand, as VARIANT.

A payload is text of a column or of files, with or without a byte order mark. Its
rules may lie under ``data`` or ``body``, again and again, then in the rules of its
conversions, else in one of four lists, else the payload is a list itself. What
is no object is passed over; text that is no JSON has no rules.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as X
from weftline.operators.rules import CONST, DIRECT, EXPR

#: The keys of lists of rules, in order, and the keys that stand for one another.
LISTS = ("rules", "generated_rules", "target_field_rules", "normalized_rules")
TARGET, FORMULA, SOURCE, KIND = ("target_field", "field_name"), ("formula", "rule", "conversion_formula"), ("field_name", "source_field"), ("rule_type", "formula_kind", "conversion_mode")


@F.pandas_udf(T.StringType())
def unwrapped(texts: pd.Series) -> pd.Series:
    """The JSON within any number of ``data`` and ``body`` objects, without a byte order mark; null for other text."""
    out = []
    for text in texts:
        try:
            value = json.loads((text or "").strip().removeprefix("\ufeff"))
        except ValueError:
            out.append(None)
            continue
        while isinstance(value, dict) and (inner := next((value[k] for k in ("data", "body") if isinstance(value.get(k), dict)), None)) is not None:
            value = inner
        out.append(json.dumps(value, ensure_ascii=False))
    return pd.Series(out, dtype=object)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, payload of each JSON file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), r"^\w+", 0)


def _at(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _objects(values: Column) -> Column:
    return F.filter(values, lambda x: _kind(x) == "OBJECT")


def items(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """payloads with place and item (VARIANT), a row a rule; payloads without rules go."""
    rows = payloads.withColumn("__v", F.try_parse_json(unwrapped(F.col(text))))
    v = F.col("__v")
    none = F.array().cast("array<variant>")
    of_conversions = F.flatten(F.transform(_objects(F.coalesce(_at(v, "conversions", "array<variant>"), none)), lambda c: F.coalesce(_at(c, "rules", "array<variant>"), none)))
    lists = F.coalesce(*[_at(v, k, "array<variant>") for k in LISTS], F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")), none)
    rows = rows.withColumn("__c", _objects(of_conversions)).withColumn("__i", F.when(F.size("__c") > 0, F.col("__c")).otherwise(_objects(lists)))
    return rows.select(*payloads.columns, F.posexplode("__i").alias("place", "item"))


def _first(item: Column, keys: tuple[str, ...]) -> Column:
    """The text of the first key that has one: nulls, empty texts, zeros and false count as none, the text "0" as one."""
    out = []
    for k in keys:
        value, text = _at(item, k), _at(item, k, "string")
        out.append(F.when(F.when(_kind(value) == "STRING", text != "").otherwise(~text.rlike(r"^(?:false|-?0(?:\.0+)?(?:E0)?)$")), text))
    return X.strip(F.coalesce(*out, F.lit("")))


def rules(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """payloads' other columns with place, target_field, formula, source_fields, rule_type, default_value, description and when; rules
    without a target go (P14)."""
    rows = items(payloads, text)
    item = F.col("item")
    raw = _at(item, "source_fields")
    listed = F.transform(F.coalesce(_at(item, "source_fields", "array<variant>"), F.array().cast("array<variant>")), lambda x: X.strip(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None"))))
    own = F.filter(F.when(_kind(raw) == "ARRAY", listed).when(_kind(raw) == "STRING", F.transform(F.split(_at(item, "source_fields", "string"), ","), X.strip)).otherwise(F.array().cast("array<string>")), lambda x: x != "")
    rows = rows.withColumns({"target_field": _first(item, TARGET), "formula": _first(item, FORMULA), "__own": own, "__kind": F.lower(_first(item, KIND)), "__one": _first(item, SOURCE)})
    rows = rows.withColumn("source_fields", F.when((F.size("__own") == 0) & (F.col("__one") != ""), F.array("__one")).otherwise(F.col("__own")))
    number, n = F.col("formula").rlike(r"^[+-]?(?:\d+(?:\.\d+)?|\.\d+)$"), F.size("source_fields")
    leaf = X.strip(F.substring_index(F.get("source_fields", F.lit(0)), ".", -1))
    kind = F.when(F.col("__kind").isin(*CONST, *DIRECT, *EXPR), F.col("__kind")).when((n == 0) & number | (F.col("formula") == "0"), "const").when((n == 1) & (leaf != "") & F.col("formula").contains(leaf), "direct").otherwise("expression")
    kept = [c for c in payloads.columns if c != text]
    return rows.filter("target_field <> ''").select(*kept, "place", "target_field", "formula", "source_fields", kind.alias("rule_type"), *[_at(item, k, "string").alias(k) for k in ("default_value", "description", "when")])
