"""Operators over ordered logs: carried values, progress, checkpoints, history, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def _running(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(log: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each value, or the last one before it that is not null."""
    return log.withColumns({v: F.last(v, ignorenulls=True).over(_running(keys, order)) for v in values})


def monotone(log: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The greatest value so far: regressions are ignored."""
    return log.withColumn(out, F.max(value).over(_running(keys, order)))


def best_checkpoint(log: DataFrame, keys: list[str], accuracy: str, loss: str, tie: str) -> DataFrame:
    """The row of greatest accuracy, then least loss, then first; nulls lose."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(accuracy), F.asc_nulls_last(loss), F.asc(tie))
    return log.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def history(log: DataFrame, keys: list[str], step: str, order: str, values: list[str], limit: int = 2000) -> DataFrame:
    """Keys, order, step and values of the last row of each run of one step, of the last ``limit`` runs."""
    own = Window.partitionBy(*keys).orderBy(order)
    ends = log.withColumn("__next", F.lead(F.struct(step)).over(own)).filter(F.col("__next").isNull() | ~F.col("__next")[step].eqNullSafe(F.col(step)))
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return ends.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= limit).select(*keys, order, step, *values)


def checkpoints(log: DataFrame, keys: list[str], order: list[str], step: str, every: int) -> DataFrame:
    """A row for each multiple of ``every`` that a log row passes."""
    before = F.coalesce(F.lag(step).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))
    crossed = log.withColumn("__from", F.floor(before / every)).withColumn("__to", F.floor(F.col(step) / every)).filter("__to > __from")
    rows = crossed.withColumn("__k", F.explode(F.sequence(F.col("__from") + 1, F.col("__to"))))
    return rows.withColumn("checkpoint_step", F.col("__k") * every).drop("__from", "__to", "__k")


def replayed(events: DataFrame, keys: list[str], event_id: str, last_seen: int, buffer: int = 2000) -> DataFrame:
    """Events after the last one seen that a ring of ``buffer`` events still holds."""
    own = Window.partitionBy(*keys).orderBy(F.desc(event_id))
    return events.withColumn("__r", F.row_number().over(own)).filter((F.col("__r") <= buffer) & (F.col(event_id) > last_seen)).drop("__r")


def event_kind(status: Column, checkpoint: Column) -> Column:
    """finish, checkpoint or update."""
    return F.when(status.isin("completed", "failed", "stopped"), "finish").when(checkpoint.isNotNull(), "checkpoint").otherwise("update")


def repeats(stream: DataFrame, keys: list[str], order: list[str], payload: str, ts: str) -> DataFrame:
    """Runs of one payload: their number, length, and the least gap within each (R01, R02 in batch)."""
    own = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(payload).eqNullSafe(F.lag(payload).over(own))) | (F.row_number().over(own) == 1)
    marked = stream.withColumn("__changed", changed.cast("int")).withColumn("run", F.sum("__changed").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.when(F.col("__changed") == 0, seconds(F.col(ts)) - seconds(F.lag(ts).over(own)))
    return marked.withColumn("__gap", gap).groupBy(*keys, "run").agg(F.first(payload).alias(payload), F.count("*").alias("n"), F.min(ts).alias("since"), F.max(ts).alias("until"), F.min("__gap").alias("least_gap"))


def joint_pairs(left: DataFrame, right: DataFrame, key: str, ts: str, window_s: float, bucket_s: float | None = None) -> DataFrame:
    """Pairs of rows of one key with window + (t_left - t_right) > 0 and t_left <= t_right + window:
    an interval join as an equi-join on time buckets and a rest condition (J20)."""
    size = bucket_s or window_s
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("__b", F.explode(F.array(*[(F.floor(seconds(F.col(f"l_{ts}")) / size) + d) for d in (-1, 0, 1)])))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("__b", F.floor(seconds(F.col(f"r_{ts}")) / size))
    gap = seconds(F.col(f"l_{ts}")) - seconds(F.col(f"r_{ts}"))
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (a["__b"] == b["__b"])).filter((gap + window_s > 0) & (gap < window_s)).drop("__b")


def joint_gate(times: list[Column], matrix: list[list[int | None]]) -> Column:
    """Fires if exactly n - 1 of the pairs i < j pass: no limit, or limit + (t_i - t_j) > 0."""
    passed = F.lit(0)
    for i in range(len(times)):
        for j in range(i + 1, len(times)):
            m = matrix[i][j]
            passed = passed + (F.lit(1) if m is None or m == -1 else F.when(F.lit(m) + (times[i] - times[j]) > 0, 1).otherwise(0))
    return passed == len(times) - 1


def stale(cache: DataFrame, ts: str, now: Column, ttl_ms: int) -> DataFrame:
    """Cached rows that are older than their time to live."""
    return cache.filter((seconds(now) - seconds(F.col(ts))) * 1000 > ttl_ms)
