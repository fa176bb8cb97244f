"""Cleaning of document blocks, its issue log and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X


def _steps(blocks: DataFrame, content_col: str) -> DataFrame:
    """blocks with __c0 ... __cN, the content after each rule; blank content passes. A projection a rule keeps every step a column that later ones reuse."""
    raw = F.coalesce(F.col(content_col), F.lit(""))
    out = blocks.select("*", raw.alias("__c0"), (X.strip(raw) == "").alias("__blank"))
    for i, (_, rule) in enumerate(X.CLEANING):
        now = F.col(f"__c{i}")
        out = out.withColumn(f"__c{i + 1}", F.when(F.col("__blank"), now).otherwise(rule(now)))
    return out


def _changed(i: int) -> Column:
    return F.col(f"__c{i}") != F.col(f"__c{i + 1}")


def _names(i: int = len(X.CLEANING)) -> list[str]:
    return ["__blank", *[f"__c{k}" for k in range(i + 1)]]


def clean_blocks(blocks: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """blocks with cleaned_content and issues (type, original, cleaned; 200 characters each) of the rules in order."""
    issues = [
        F.when(_changed(i), F.struct(F.lit(name).alias("issue_type"), X.preview(F.col(f"__c{i}")).alias("original"), X.preview(F.col(f"__c{i + 1}")).alias("cleaned")))
        for i, (name, _) in enumerate(X.CLEANING)
    ]
    out = _steps(blocks, content_col).withColumn("cleaned_content", F.col(_names()[-1])).withColumn("issues", F.array_compact(F.array(*issues)))
    return out.drop(*_names())


def issue_types(blocks: DataFrame, content_col: str) -> DataFrame:
    """blocks with cleaned_content and the names of the rules that changed it, without copies of the text."""
    own = F.array_compact(F.array(*[F.when(_changed(i), F.lit(name)) for i, (name, _) in enumerate(X.CLEANING)]))
    return _steps(blocks, content_col).withColumn("cleaned_content", F.col(_names()[-1])).withColumn("issues", own).drop(*_names())


def cleaning_report(cleaned: DataFrame, id_col: str | None = None) -> DataFrame:
    """total, modified, issues and the rate as text of clean_blocks()' or issue_types()' rows; with id_col the modified ids too."""
    changed = F.size("issues") > 0
    ids = [F.array_sort(F.collect_list(F.when(changed, F.col(id_col)))).alias("modified_ids")] if id_col else []
    rows = cleaned.agg(F.count("*").alias("total_blocks"), F.count_if(changed).alias("modified_blocks"), F.sum(F.size("issues")).cast("long").alias("issue_count"), *ids)
    rate = F.when(F.col("total_blocks") > 0, F.col("modified_blocks") * 100.0 / F.col("total_blocks")).otherwise(0.0)
    return rows.withColumn("cleaning_rate", F.format_string("%.1f%%", rate))


def noise_lines_removed(blocks: DataFrame, content_col: str) -> DataFrame:
    """Stripped lines without blank ones, those of digits, colons and dashes only, and those over 30 characters of eleven or more numbers only."""
    lines = X.nonempty_lines(F.coalesce(F.col(content_col), F.lit("")))
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?U)^[\d:\-\s]+$") & ~((F.length(x) > 30) & x.rlike(r"(?U)^(?:\d+\s+){10,}\d+$")))
    return blocks.withColumn(content_col, F.array_join(kept, "\n"))
