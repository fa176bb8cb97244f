"""Ordered picks: first wins, best wins, top-k, quotas and pruning.

All are rankings over a partition key; Spark limits ranks before the shuffle
where a filter on row_number allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in the given order, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first (dedupe, first wins)."""
    return top_k(rows, keys, order, 1, "__first").drop("__first")


def best_at_first_place(rows: DataFrame, keys: list[str], priority: Column, position: str) -> DataFrame:
    """One row a key: the best by priority, at the position of the key's first row."""
    own = Window.partitionBy(*keys)
    ranked = rows.withColumn("__best", F.row_number().over(own.orderBy(priority.desc(), F.col(position)))).withColumn("__place", F.min(position).over(own))
    return ranked.filter("__best = 1").withColumn(position, F.col("__place")).drop("__best", "__place")


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def quota_selection(rows: DataFrame, key: str, quotas: list[tuple[str, Column, int]], overall: Column, k: int, tie: Column) -> DataFrame:
    """Fills one quota after the other by its own score, then up to k by the overall score; no row twice.

    quotas: (name, score, rows). The result has ``selected_by`` and ``selected_rank``.
    """
    left, picked, so_far = rows, None, 0
    for name, score, n in [*quotas, ("overall", overall, k)]:
        n = min(n, k - so_far) if name != "overall" else k
        own = left.orderBy(score.desc(), tie).limit(n).withColumn("selected_by", F.lit(name)).withColumn("__score", score.cast("double"))
        picked = own if picked is None else picked.unionByName(own)
        left = left.join(own.select(key), key, "left_anti")
        so_far += 0 if name == "overall" else n
    place = F.when(F.col("selected_by") == "overall", len(quotas)).otherwise(F.array_position(F.array(*[F.lit(q[0]) for q in quotas]) if quotas else F.array(F.lit("")), F.col("selected_by")) - 1)
    ordered = Window.orderBy(place, F.col("__score").desc(), tie)  # k rows and a quota at most
    return picked.withColumn("selected_rank", F.row_number().over(ordered)).filter(F.col("selected_rank") <= k).drop("__score")


def pruned_candidates(rows: DataFrame, keys: list[str], score: str, exact: str, family: str, target_family: str, tie: Column, k: int = 5) -> DataFrame:
    """Candidates of a key: the exact one alone, else a clear winner alone, else the first k.

    A winner is clear with a score of 90 and a lead of 12, or with a lead of 15 if its family is the target's.
    """
    own = Window.partitionBy(*keys)
    order = own.orderBy(F.col(exact).desc(), F.col(score).desc(), tie)
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(k, 2))
    ranked = ranked.withColumn("__next", F.lead(score).over(order))
    lead = F.col(score) - F.col("__next")
    alone = F.col(exact) | F.col("__next").isNull() | ((F.col(score) >= 90) & (lead >= 12)) | ((F.col(target_family) == F.col(family)) & (lead >= 15))
    ranked = ranked.withColumn("__alone", F.max(F.when(F.col("rank") == 1, F.coalesce(alone, F.lit(False)))).over(own))
    return ranked.filter((F.col("rank") == 1) | (~F.col("__alone") & (F.col("rank") <= k))).drop("__next", "__alone")


def rejected_pairs(rows: DataFrame, case: str, score: str, text: str, gap: float = 1.0, k: int = 3) -> DataFrame:
    """Per case the best row as chosen with up to k rejected ones: different texts, worse by the gap, worst first."""
    best = first_of(rows, [case], [F.col(score).desc(), F.col(text)]).select(case, F.col(text).alias("chosen"), F.col(score).alias("chosen_score"))
    other = first_of(rows, [case, text], [F.col(score).asc()]).join(best, case)
    other = other.filter((F.col(text) != F.col("chosen")) & (F.col("chosen_score") - F.col(score) >= gap))
    ranked = top_k(other, [case], [F.col(score).asc(), F.col(text)], k, "pair_rank")
    return ranked.select(case, "chosen", "chosen_score", F.col(text).alias("rejected"), F.col(score).alias("rejected_score"), "pair_rank")


def scored_then_positive(rows: DataFrame, score: str, tie: Column, k: int) -> DataFrame:
    """The first k by score, and of these the positive ones (in this order)."""
    return rows.orderBy(F.col(score).desc(), tie).limit(k).filter(F.col(score) > 0)


def in_request_order(rows: DataFrame, key: str, ids: DataFrame, position: str = "position") -> DataFrame:
    """The rows with the requested ids, ordered as requested; ids has key and position."""
    return ids.join(rows, key).orderBy(position)
