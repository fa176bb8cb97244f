"""Similarities and the correctness metrics of conversions and rules."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 less the relative error, at least 0."""
    return 1 - F.least(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0)), F.lit(1.0))


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of the arguments in this order; two empty texts are equal."""
    return pd.Series([1.0 if not (x or y) else difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def ratio_bound(a: Column, b: Column) -> Column:
    """What text_similarity cannot exceed: twice the shorter by both lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def field_correctness(exact: Column, present: Column, similarity: Column, semantic: Column) -> Column:
    """Weights .20 presence, .20 exactness, .35 value, .25 meaning, as a percentage."""
    return 100 * (0.20 * present.cast("double") + 0.20 * exact.cast("double") + 0.35 * similarity + 0.25 * semantic)


def weighted_summary(fields: DataFrame, keys: list[str], weight: str, values: list[str]) -> DataFrame:
    """Weighted means per key; the weights' sum counts as 1 at least."""
    total = F.greatest(F.sum(weight), F.lit(1.0))
    return fields.groupBy(*keys).agg(*[(F.sum(F.col(weight) * F.col(v)) / total).alias(v) for v in values])


def conversion_rates(fields: DataFrame, keys: list[str], correctness: str, loss: str, exact: str, hit: str, present: str) -> DataFrame:
    """Coverage, exact, conversion-success, high-confidence, low-loss and rule-hit rates and the composite.

    Success is exactness; weights are .35 coverage, .25 success, .20 confidence, .10 low loss, .10 rule hits.
    A missing correctness counts as 0, a missing loss as 100, but as 0 in the mean loss.
    """
    n = F.greatest(F.count("*"), F.lit(1))
    rate = lambda c: F.count_if(c) * 100.0 / n
    out = fields.groupBy(*keys).agg(
        rate(F.col(present)).alias("coverage_rate"), rate(F.col(exact)).alias("exact_rate"), rate(F.col(exact)).alias("conversion_success_rate"), rate(F.coalesce(F.col(correctness), F.lit(0.0)) >= 80).alias("high_confidence_rate"),
        rate(F.coalesce(F.col(loss), F.lit(100.0)) <= 20).alias("low_loss_rate"), rate(F.col(hit)).alias("rule_hit_rate"), F.avg(F.coalesce(F.col(loss), F.lit(0.0))).alias("information_loss_rate"),
    )
    parts = {"coverage_rate": 0.35, "conversion_success_rate": 0.25, "high_confidence_rate": 0.20, "low_loss_rate": 0.10, "rule_hit_rate": 0.10}
    return out.withColumn("composite", sum((F.col(c) * F.lit(w) for c, w in parts.items()), F.lit(0.0)))


def overall_score(field_match: Column, semantic: Column, structure: Column, dimension: Column) -> Column:
    return field_match * 0.30 + semantic * 0.25 + structure * 0.20 + dimension * 0.25


def case_score(correctness: Column, conversion_rate: Column, fragment_hits: Column, extraction_error: Column, source_incomplete: Column) -> Column:
    """.6 correctness, .3 conversion rate and .1 fragment hits, less 20 for a failed extraction and 50 for an incomplete source."""
    of = lambda c: F.coalesce(c, F.lit(0.0))
    less = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0.0)
    return of(correctness) * 0.6 + of(conversion_rate) * 0.3 + of(fragment_hits) * 0.1 - less(extraction_error, 20.0) - less(source_incomplete, 50.0)
