"""Mixing sources to target weights by temperature.

A source's share p of all tokens becomes a weight proportional to p**a. The
exponent a (1: as found, 0: equal weights) is bracketed to a target entropy
of the weights, or to the least a in [0, 1] under which no source is repeated
more than a limit; with both, the larger a holds. Each round evaluates
SECTIONS exponents in one aggregate over the source table and keeps one
section, so it is a bisection with many cuts.

The weights are realised within a token budget as block permutations: each
source's rows are dealt by a keyed hash into BLOCKS blocks and ordered by it
within them. A source takes its whole permutation as often as its budget
holds it, then blocks of one more in order, then rows of the block on the
boundary while they fit. So no row's tokens cross the budget, no source is
ordered as a whole, and texts are not shuffled.

Only DataFrame functions run here. Tokens are runs of anything but ASCII
white space. A null source is a source of its own; a null text has no tokens.
Sources without tokens keep each row once, as they cost nothing. Rows equal
in doc_id and text fall on the same side of a boundary together. An empty
table gives an empty result. Other columns are carried, not read; columns
that this module adds start with ``__mix_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.common import WORD, stored, table, text_or_empty

BLOCKS = 1024
SECTIONS, ROUNDS, STEEPEST = 64, 5, 8.0
#: Sources up to which their table is broadcast; beyond it the join is shuffled with the sources' rows spread by salt.
BROADCAST_SOURCES, SALT = 20_000, 64


def _tokens(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def _marked(docs: DataFrame, key: str, id_col: str, text_col: str, seed: int) -> DataFrame:
    """docs with source, place hash, and block."""
    h = F.xxhash64(F.lit(seed).cast("long"), F.col(id_col), F.col(text_col))
    return docs.withColumns({"__mix_key": F.col(key), "__mix_h": h}).withColumn("__mix_block", F.pmod("__mix_h", F.lit(BLOCKS)).cast("int"))


def curve(sources: DataFrame, low: float, high: float) -> list[dict]:
    """Entropy (nats) of the weights, and their sum and least share, at SECTIONS + 1 exponents."""
    grid = F.explode(F.array(*[F.lit(low + (high - low) * i / SECTIONS) for i in range(SECTIONS + 1)]))
    weighed = sources.select("__mix_share", grid.alias("a")).withColumn("w", F.exp(F.col("a") * F.log("__mix_share")))
    sums = weighed.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("__mix_share")).alias("s"), F.min("__mix_share").alias("least"), F.max("__mix_share").alias("most"))
    return [r.asDict() | {"entropy": math.log(r["z"]) - r["a"] * r["s"] / r["z"]} for r in sums.orderBy("a").collect()]


def _repeats(x: dict, budget_share: float) -> float:
    """How often the most repeated source is passed over."""
    return budget_share * max(x["least"] ** (x["a"] - 1), x["most"] ** (x["a"] - 1)) / x["z"]


def exponent(sources: DataFrame, budget_share: float, target_entropy: float | None, max_repeat: float | None) -> float:
    """The least exponent at which the entropy has fallen to its target and repetition to its limit."""

    def least(met, high: float) -> float:
        low = 0.0
        for _ in range(ROUNDS):
            points = curve(sources, low, high)
            if not points or met(points[0]):
                return low
            at = next((i for i, x in enumerate(points) if met(x)), None)
            if at is None:
                return high
            low, high = points[at - 1]["a"], points[at]["a"]
        return high

    found = [1.0] if target_entropy is None and max_repeat is None else []
    if target_entropy is not None:
        found.append(least(lambda x: x["entropy"] <= target_entropy, STEEPEST))
    if max_repeat is not None:
        found.append(least(lambda x: _repeats(x, budget_share) <= max_repeat, 1.0))
    return round(max(found), 9)


def plan(docs: DataFrame, key: str = "source", id_col: str = "doc_id", text_col: str = "text", budget: int | None = None, target_entropy: float | None = None, max_repeat: float | None = None, seed: int = 7) -> DataFrame:
    """A row a source: weight, whole passes, and where its last, partial pass ends."""
    marked = _marked(docs, key, id_col, text_col, seed)
    narrow = marked.select("__mix_key", "__mix_block", "__mix_h", _tokens(text_col).alias("__mix_n"))
    blocks = stored(narrow.groupBy("__mix_key", "__mix_block").agg(F.sum("__mix_n").alias("__mix_n"), F.count("*").alias("__mix_rows")), "mix-blocks")
    total = blocks.agg(F.sum("__mix_n")).first()[0] or 0
    budget = total if budget is None else budget
    sums = blocks.groupBy("__mix_key").agg(F.sum("__mix_n").alias("__mix_total"))
    sources = stored(sums.filter("__mix_total > 0").withColumn("__mix_share", F.col("__mix_total") / F.lit(float(max(total, 1)))), "mix-sources")
    a = exponent(sources, budget / max(total, 1), target_entropy, max_repeat)
    z = sources.agg(F.sum(F.exp(F.lit(a) * F.log("__mix_share")))).first()[0] or 1.0
    held = sources.withColumn("__mix_weight", F.exp(F.lit(a) * F.log("__mix_share")) / F.lit(z))
    held = held.withColumn("__mix_budget", F.floor(F.col("__mix_weight") * F.lit(budget)).cast("long"))
    held = held.withColumn("__mix_passes", F.floor(F.col("__mix_budget") / F.col("__mix_total")).cast("long"))
    held = held.withColumn("__mix_rest", F.col("__mix_budget") - F.col("__mix_passes") * F.col("__mix_total"))

    ordered = Window.partitionBy("__mix_key").orderBy("__mix_block").rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumn("__mix_through", F.sum("__mix_n").over(ordered)).withColumnRenamed("__mix_key", "k")
    edge = held.join(summed, F.col("__mix_key").eqNullSafe(F.col("k"))).filter("__mix_through > __mix_rest AND __mix_through - __mix_n <= __mix_rest")
    edge = stored(edge.select("__mix_key", "__mix_weight", "__mix_passes", (F.col("__mix_rest") - F.col("__mix_through") + F.col("__mix_n")).alias("__mix_room"), F.col("__mix_block").alias("__mix_edge")), "mix-edges")
    inside = Window.partitionBy("__mix_key").orderBy("__mix_h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = _joined(marked, edge, "__mix_block = __mix_edge").withColumn("__mix_n", _tokens(text_col)).select("__mix_key", "__mix_h", "__mix_n", "__mix_room")
    cuts = near.withColumn("__mix_run", F.sum("__mix_n").over(inside)).filter("__mix_run <= __mix_room").groupBy("__mix_key").agg(F.max("__mix_h").alias("__mix_cut")).withColumnRenamed("__mix_key", "k")
    return stored(edge.join(cuts, F.col("__mix_key").eqNullSafe(F.col("k")), "left").drop("k", "__mix_room"), "mix-plan")


def _joined(marked: DataFrame, sources: DataFrame, extra: str | None = None) -> DataFrame:
    """marked, each row with the columns of its source; inner if a condition is given, else left."""
    how = "inner" if extra else "left"
    side = sources.withColumnRenamed("__mix_key", "k")
    if sources.count() <= BROADCAST_SOURCES:
        on = F.col("__mix_key").eqNullSafe(F.col("k"))
        return marked.join(F.broadcast(side), on & F.expr(extra) if extra else on, how).drop("k")
    side = side.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = marked.withColumn("__mix_salted", F.pmod("__mix_h", F.lit(SALT)).cast("int"))
    on = F.col("__mix_key").eqNullSafe(F.col("k")) & (F.col("__mix_salted") == F.col("__mix_salt"))
    return salted.join(side, on & F.expr(extra) if extra else on, how).drop("k", "__mix_salt", "__mix_salted")


def counted(docs: DataFrame, key: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 7, **targets) -> DataFrame:
    """docs with ``__mix_weight`` of its source and ``__mix_copies``, the times a row is taken (0 and more)."""
    held = plan(docs, key, id_col, text_col, seed=seed, **targets)
    rows = _joined(_marked(docs, key, id_col, text_col, seed), held)
    partial = (F.col("__mix_block") < F.col("__mix_edge")) | ((F.col("__mix_block") == F.col("__mix_edge")) & (F.col("__mix_h") <= F.col("__mix_cut")))
    copies = F.when(F.col("__mix_passes").isNull(), 1).otherwise(F.col("__mix_passes") + F.when(partial, 1).otherwise(0))
    return rows.withColumn("__mix_copies", copies.cast("int")).drop("__mix_key", "__mix_h", "__mix_block", "__mix_passes", "__mix_edge", "__mix_cut")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture: docs' own columns, each row as often as its source's budget takes it."""
    rows = counted(docs, **options).filter("__mix_copies > 0")
    return rows.withColumn("__mix_pass", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: Production setting: as many tokens as the corpus has, no source passed over more than 1.25 times.
MAX_REPEAT = 1.25


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counted(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), max_repeat=MAX_REPEAT)
    return rows.select(F.col("doc_id").cast(T.LongType()).alias("doc_id"), "source", _tokens("text").alias("n_tokens"), F.coalesce("__mix_weight", F.lit(0.0)).alias("weight"), F.col("__mix_copies").alias("n_copies"))
