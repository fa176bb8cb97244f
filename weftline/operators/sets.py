"""Set operations on keyed rows: differences, unions, containment, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(current: DataFrame, base: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key and change: added, removed, modified (any compared column differs, nulls equal) or unchanged."""
    a = current.select(F.col(key).alias("__a"), F.struct(*compared).alias("__x"))
    b = base.select(F.col(key).alias("__b"), F.struct(*compared).alias("__y"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("__x").eqNullSafe(F.col("__y")), "unchanged").otherwise("modified")
    return both.select(F.coalesce("__a", "__b").alias(key), change.alias("change"))


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def union_distinct(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of the parts, one a key: that of the earliest part."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged)
    own = Window.partitionBy(*keys).orderBy("__part")
    return rows.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n", "__part")


def prefer_primary(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """The primary's rows of a key if it has any, else the fallback's."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"))


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present.select(key), key, "left_anti")


def contained(rows: DataFrame, needed: str, available: Column) -> DataFrame:
    """Rows all of whose needed values are available."""
    return rows.filter(F.size(F.array_except(F.col(needed), available)) == 0)


def conflicting(files: DataFrame, name: str, content: str) -> DataFrame:
    """Names that stand for more than one content."""
    return files.groupBy(name).agg(F.count_distinct(F.sha2(F.col(content), 256)).alias("contents")).filter("contents > 1")


def null_tolerant(rows: DataFrame, wanted: dict[str, object], weights: dict[str, float], order: list[Column]) -> DataFrame:
    """Rows that match every wanted value or are null there; score adds the weights of what they match."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(name).isNull() | (F.col(name) == F.lit(value)))
    score = reduce(lambda a, b: a + b, [F.when(F.col(n) == F.lit(wanted.get(n)), w).otherwise(0.0) for n, w in weights.items()], F.lit(0.0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), *order)


def merged(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows replace current ones of the same key."""
    return new.unionByName(current.join(new.select(*keys).distinct(), keys, "left_anti"))


def patched(current: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Partial update: non-null changes of allowed columns; another column is an error."""
    if unknown := set(changes.columns) - {key, *allowed}:
        raise ValueError(f"columns that may not be changed: {sorted(unknown)}")
    new = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in changes.columns if c != key])
    rows = current.join(new, key, "left")
    return rows.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in current.columns])
