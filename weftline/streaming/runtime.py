"""Structured Streaming: latest-value cache with repeats, joint conversion, job monitor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions import text as X

CACHE = "name string, payload binary, n long, since long, until long, least_gap long, fires boolean"


def repeat_gate(messages: DataFrame, repeats: int, cycle_ms: int, ttl_ms: int | None = None, exact: bool = False) -> DataFrame:
    """Of each name (name, ts, payload) the run of its latest payload after every batch.

    ``fires`` once the payload has come ``repeats`` times (exactly so if ``exact``) with every gap
    above ``cycle_ms``; the run is then consumed. A run older than ``ttl_ms`` at the next message is dropped, and
    a timer drops the state of a name that no message came for in that time.
    """

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        payload, n, since, until, gap = state.get if state.exists else (None, 0, 0, 0, None)
        rows = pd.concat(list(batches)).assign(ms=lambda d: d["ts"].astype("datetime64[ms]").astype("int64")).sort_values("ms", kind="stable")
        out = []
        for own, ms in zip(rows["payload"], rows["ms"], strict=True):
            own, ms = bytes(own), int(ms)
            if payload is None or own != bytes(payload) or (ttl_ms is not None and ms - until > ttl_ms):
                payload, n, since, gap = own, 0, ms, None
            elif n:
                gap = ms - until if gap is None or gap < 0 else min(gap, ms - until)
            n, until = n + 1, ms
            fires = (n == repeats if exact else n >= repeats) and (gap is None or gap < 0 or gap > cycle_ms)
            out.append((key[0], payload, n, since, until, -1 if gap is None else gap, fires))
            if fires:
                n, gap = 0, None
        state.update((payload, n, since, until, -1 if gap is None else gap))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CACHE.split(", ")])

    timer = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return messages.groupBy("name").applyInPandasWithState(update, CACHE, "payload binary, n long, since long, until long, gap long", "append", timer)


def joint(left: DataFrame, right: DataFrame, key: str, window_ms: int, late: str = "1 minute") -> DataFrame:
    """Stream-stream join of two sources (columns key, ts and others) by the one-sided gate
    window + (t_left - t_right) > 0, bounded by the same window on the other side for the state (J20, R05)."""
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withWatermark("l_ts", late)
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withWatermark("r_ts", late)
    span = F.expr(f"INTERVAL {window_ms} MILLISECONDS")
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("r_ts") < F.col("l_ts") + span) & (F.col("l_ts") < F.col("r_ts") + span))


def converted(messages: DataFrame, decode, verify, convert) -> DataFrame:
    """Decode, verify and convert as one query (R06): decode gives a struct, verify a condition, convert a DataFrame."""
    rows = messages.withColumn("fields", decode(F.col("payload")))
    rows = rows.select("name", "ts", "fields.*").filter(verify)
    return convert(rows)


def log_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """progress, step, epoch, loss, accuracy and rate of each line of a job's log."""
    c = F.col(line)
    progress = F.nullif(F.regexp_extract(c, r"progress=(\d+(?:\.\d+)?)%", 1), F.lit("")).cast("double")
    step, steps = (F.nullif(F.regexp_extract(c, r"step=(\d+)/(\d+)", i), F.lit("")).cast("int") for i in (1, 2))
    return lines.select("*", progress.alias("progress"), step.alias("step"), steps.alias("steps"), *[X.log_metric(c, *names).alias(names[0]) for names in (("epoch",), ("loss", "final_loss"), ("acc", "accuracy"), ("lr",))])


MONITOR = "job string, event_id long, progress double, loss double, acc double, best_acc double, kind string"


def monitor(lines: DataFrame, save_steps: int) -> DataFrame:
    """Events of each job's log lines (job, value): ids that rise, progress that never falls, last metrics,
    the best accuracy, and a checkpoint whenever save_steps are crossed (Q19, W13-W17)."""

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        event, progress, loss, acc, best, step = state.get if state.exists else (0, 0.0, float("nan"), float("nan"), float("nan"), 0)
        out = []
        for batch in batches:
            for row in batch.itertuples():
                event += 1
                progress = max(progress, row.progress) if row.progress == row.progress else progress
                loss = row.loss if row.loss == row.loss else loss
                acc = row.acc if row.acc == row.acc else acc
                best = acc if best != best or acc > best else best
                now = int(row.step) if row.step == row.step else step
                kind = "finish" if progress >= 100 else "checkpoint" if now // save_steps > step // save_steps else "update"
                step = max(step, now)
                out.append((key[0], event, progress, loss, acc, best, kind))
        state.update((event, float(progress), float(loss), float(acc), float(best), step))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MONITOR.split(", ")])

    rows = log_events(lines).withColumn("step", F.col("step").cast("double"))
    return rows.groupBy("job").applyInPandasWithState(update, MONITOR, "event long, progress double, loss double, acc double, best double, step long", "append", GroupStateTimeout.NoTimeout)
