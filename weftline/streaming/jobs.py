"""The job monitor: log lines in order, whatever order they come in.

A line carries a job, a number that rises by one from 0 with each line of the
job, a time and the text. Lines that come early wait in state; those that the
watermark has left behind are given up, and what waits for them goes on.
Progress never falls: a line whose percentage is below the greatest so far
changes neither step nor percentage. Metrics hold until the next value. Every
multiple of ``save_steps`` that the step reaches is a checkpoint; the best one
has the greatest accuracy, then the least loss, and nulls lose.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

EVENTS = "job string, seq long, percent int, step long, steps long, epoch double, loss double, acc double, lr double, checkpoints array<long>, best_step long, kind string"
_PARSED = "seq long, ms long, percent int, step long, steps long, epoch double, loss double, acc double, lr double"
_FOLD = "next long, percent int, step long, steps long, epoch double, loss double, acc double, lr double, checkpoint long, best_step long, best_acc double, best_loss double"
#: The names of the metrics.
METRICS = {"loss": ("loss", "train_loss"), "acc": ("acc", "accuracy", "train_acc"), "lr": ("lr", "learning_rate")}


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """percent, step, steps of the line's progress marker (step=a/b, else progress=p%), epoch, loss, acc, lr; null where it has none."""
    c = F.col(line)
    step, steps = (_number(c, r"(?i)step\s*=\s*(\d+)\s*/\s*(\d+)", k).cast("long") for k in (1, 2))
    percent = _number(c, r"(?i)progress\s*=\s*(\d+)\s*%").cast("long")
    marked = F.when(percent > 100, 100).otherwise(percent)
    whole = F.when(steps < 1, 1).otherwise(steps)
    metric = lambda names: _number(c, rf"(?i)(?:^|[\s,;])(?:{'|'.join(names)})\s*[:=]\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)").cast("double")
    return lines.withColumns({
        "percent": F.coalesce(F.floor(step / whole * 100), marked).cast("int"), "step": F.coalesce(step, marked), "steps": F.coalesce(whole, F.when(marked.isNotNull(), 100)).cast("long"),
        "epoch": _number(c, r"(?i)epoch[:=\s]+(\d+(?:\.\d+)?)").cast("double"), **{k: metric(v) for k, v in METRICS.items()},
    })


def kind_of(percent: Column, checkpoints: Column) -> Column:
    """finish at 100 %, checkpoint where one was reached, else update."""
    return F.when(percent >= 100, "finish").when(F.size(checkpoints) > 0, "checkpoint").otherwise("update")


def job_events(lines: DataFrame, save_steps: int, job: str = "job", seq: str = "seq", line: str = "value") -> DataFrame:
    """An event for each line, in batch: running windows over each job's lines."""
    own = Window.partitionBy("job").orderBy("seq")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parsed(lines.select(F.col(job).alias("job"), F.col(seq).alias("seq"), F.col(line).alias("__line")), "__line").drop("__line")
    top = F.greatest(F.coalesce(F.max("percent").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    rows = rows.withColumn("__taken", F.col("percent") >= top)
    carried = lambda c, when=None: F.last(F.col(c) if when is None else F.when(when, F.col(c)), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"percent": carried("percent", F.col("__taken")), "step": carried("step", F.col("__taken")), "steps": carried("steps", F.col("__taken")), "epoch": F.max("epoch").over(so_far), **{m: carried(m) for m in METRICS}})
    reached = F.floor(F.coalesce("step", F.lit(0)) / save_steps)
    rows = rows.withColumn("__reached", F.max(reached).over(so_far)).withColumn("__before", F.coalesce(F.lag("__reached").over(own), F.lit(0)))
    rows = rows.withColumn("checkpoints", F.when(F.col("__reached") > F.col("__before"), F.transform(F.sequence(F.col("__before") + 1, F.col("__reached")), lambda k: k * save_steps)).otherwise(F.array().cast("array<bigint>")))
    # Of the checkpoints so far the greatest in this order; of equal ones the first.
    rank = F.when(F.size("checkpoints") > 0, F.struct(F.coalesce(F.col("acc"), F.lit(-math.inf)), -F.coalesce(F.col("loss"), F.lit(math.inf)), -F.col("checkpoints")[0]))
    best = F.max(rank).over(so_far)
    rows = rows.withColumn("best_step", -best["col3"])
    return rows.withColumn("kind", kind_of(F.col("percent"), F.col("checkpoints"))).select(*[x.split(" ")[0] for x in EVENTS.split(", ")])


class _Monitor(StatefulProcessor):
    def __init__(self, save_steps: int) -> None:
        self.save_steps = save_steps

    def init(self, handle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", _FOLD)
        self.waiting = handle.getListState("waiting", _PARSED)

    def _better(self, acc, loss, best_acc, best_loss) -> bool:
        rank = lambda a, b: (-math.inf if a is None else a, -math.inf if b is None else -b)
        return rank(acc, loss) > rank(best_acc, best_loss)

    def _events(self, job: str, fresh: list[tuple], watermark: int):
        fold = self.fold.get() if self.fold.exists() else (0, None, None, None, None, None, None, None, self.save_steps, None, None, None)
        following, percent, step, steps, epoch, loss, acc, lr, checkpoint, best_step, best_acc, best_loss = fold
        rows = {r[0]: r for r in [*(self.waiting.get() if self.waiting.exists() else ()), *fresh] if r[0] >= following}
        # Lines before one that the watermark has passed will not come any more.
        given_up = max((r[0] for r in rows.values() if r[1] < watermark), default=-1)
        out = []
        for seq in sorted(rows):
            if seq > following and seq > given_up:
                break
            _, _, p, s, n, e, *metrics = rows.pop(seq)
            following = seq + 1
            if p is not None and p >= (percent or 0):
                percent, step, steps = p, s, n
            if e is not None and e >= (epoch or 0):
                epoch = e
            loss, acc, lr = (old if new is None else new for old, new in zip((loss, acc, lr), metrics, strict=True))
            reached = []
            while (step or 0) >= checkpoint:
                reached.append(checkpoint)
                if best_step is None or self._better(acc, loss, best_acc, best_loss):
                    best_step, best_acc, best_loss = checkpoint, acc, loss
                checkpoint += self.save_steps
            kind = "finish" if (percent or 0) >= 100 else "checkpoint" if reached else "update"
            out.append((job, seq, percent, step, steps, epoch, loss, acc, lr, reached, best_step, kind))
        self.fold.update((following, percent, step, steps, epoch, loss, acc, lr, checkpoint, best_step, best_acc, best_loss))
        self.waiting.clear()
        if rows:
            self.waiting.put([rows[k] for k in sorted(rows)])
            self.handle.registerTimer(min(r[1] for r in rows.values()) + 1)
        if out:
            frame = pd.DataFrame(out, columns=[x.split(" ")[0] for x in EVENTS.split(", ")]).astype({"percent": "Int32", "step": "Int64", "steps": "Int64", "best_step": "Int64"})
            yield frame.astype({c: "Float64" for c in ("epoch", "loss", "acc", "lr")})

    def handleInputRows(self, key, rows, timerValues):
        names = [x.split(" ")[0] for x in _PARSED.split(", ")]
        whole = {"seq", "ms", "percent", "step", "steps"}
        fresh = [tuple(None if pd.isna(v) else int(v) if n in whole else float(v) for n, v in zip(names, r, strict=True)) for batch in rows for r in batch[names].itertuples(index=False, name=None)]
        yield from self._events(key[0], fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._events(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def job_event_stream(lines: DataFrame, save_steps: int, late: str = "1 minute", job: str = "job", seq: str = "seq", ts: str = "ts", line: str = "value") -> DataFrame:
    """job_events() of a stream whose lines come in any order. Needs a RocksDB state store.

    A job's state is one fold and the lines that wait for an earlier one, at most those of the time that ``late`` allows.
    """
    marked = lines.withWatermark(ts, late).select(F.col(job).alias("job"), F.col(seq).cast("long").alias("seq"), F.col(ts).alias("at"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(line).alias("__line"))
    return parsed(marked, "__line").drop("__line").groupBy("job").transformWithStateInPandas(_Monitor(save_steps), EVENTS, "Append", "eventTime")
