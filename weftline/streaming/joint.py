"""Joint conversion of any number of sources: messages of one key that are close in time.

A combination takes one message of each source, all within ``horizon_ms``, and
passes the matrix gate of ``monitor.joint_gate``: of the pairs i < j exactly
n - 1 must pass (so of three sources two pairs, not all three).

Batch and stream share one plan. Time is cut into buckets as wide as the
horizon, a message goes to its own bucket and to the one before, and a
combination belongs to the bucket of its earliest message. A key that holds a
third of all messages is thereby spread over its buckets. In the stream each
(key, bucket) is a state of its own: a list of messages for each source, and one
event-time timer that clears it once the watermark says that nothing can come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from weftline.operators.monitor import joint_gate

Matrix = list[list[int | None]]
#: Combinations that are in work at once.
STEP = 100_000


def passes(times: list[np.ndarray], matrix: Matrix) -> np.ndarray:
    """joint_gate() over arrays of milliseconds."""
    n, found = len(times), np.zeros(len(times[0]), np.int64)
    for i in range(n):
        for j in range(i + 1, n):
            m = matrix[i][j]
            found += 1 if m is None or m == -1 else (m + times[i] - times[j] > 0)
    return found == n - 1


def combinations(times: list[np.ndarray], horizon_ms: int) -> Iterator[list[np.ndarray]]:
    """Places in each array of the combinations whose times are within the horizon, a block after another.

    A range join source by source: sorted times, binary search of the range that is left, and blocks of a bounded number of pairs.
    """
    orders = [np.argsort(t, kind="stable") for t in times]
    ordered = [t[o] for t, o in zip(times, orders, strict=True)]

    def joined(low: np.ndarray, high: np.ndarray, places: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        k = len(places)
        if k == len(times):
            yield places
            return
        begin, end = np.searchsorted(ordered[k], high - horizon_ms, "left"), np.searchsorted(ordered[k], low + horizon_ms, "right")
        sizes = np.maximum(end - begin, 0)
        done = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + STEP, "right")))
            n = sizes[at:to]
            rows = np.repeat(np.arange(at, to), n)
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
            t = ordered[k][other]
            yield from joined(np.minimum(low[rows], t), np.maximum(high[rows], t), [*(p[rows] for p in places), orders[k][other]])
            at = to

    if all(len(t) for t in times):
        yield from joined(ordered[0], ordered[0], [orders[0]])


def bucketed(messages: DataFrame, key: str, source: str, ts: str, payload: str, horizon_ms: int) -> DataFrame:
    """key, bucket, source, ms, payload: each message in its bucket and in the one before."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    own = F.floor(ms / horizon_ms)
    return messages.withColumns({"__ms": ms, "__bucket": F.explode(F.array(own, own - 1))}).select(F.col(key).alias("key"), F.col("__bucket").cast("long").alias("bucket"), F.col(source).cast("int").alias("source"), F.col("__ms").alias("ms"), F.col(payload).alias("payload"))


def joint_rows(messages: DataFrame, matrix: Matrix, horizon_ms: int, key: str = "key", source: str = "source", ts: str = "ts", payload: str = "payload") -> DataFrame:
    """key, ms_0, payload_0, ms_1, ... of each combination, in batch: n - 1 equi-joins on key and bucket.

    Messages with a null key or time take no part. matrix: limits in milliseconds; null or -1 always passes.
    """
    n = len(matrix)
    rows = bucketed(messages.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()), key, source, ts, payload, horizon_ms)
    sides = [rows.filter(F.col("source") == i).select("key", "bucket", F.col("ms").alias(f"ms_{i}"), F.col("payload").alias(f"payload_{i}")) for i in range(n)]
    out = sides[0]
    for i in range(1, n):
        seen = [F.col(f"ms_{j}") for j in range(i)]
        out = out.join(sides[i], ["key", "bucket"]).filter(F.greatest(*seen, F.col(f"ms_{i}")) - F.least(*seen, F.col(f"ms_{i}")) <= horizon_ms)
    times = [F.col(f"ms_{i}") for i in range(n)]
    first = F.floor((F.least(*times) if n > 1 else times[0]) / horizon_ms) == F.col("bucket")
    return out.filter(first & joint_gate(times, matrix)).drop("bucket")


class _Joint(StatefulProcessor):
    """The combinations of one key and bucket."""

    def __init__(self, matrix: Matrix, horizon_ms: int, kind: str, key_kind: str) -> None:
        self.matrix, self.horizon_ms, self.kind, self.key_kind = matrix, horizon_ms, kind, key_kind

    def init(self, handle) -> None:
        self.handle = handle
        self.lists = [handle.getListState(f"source{i}", f"ms long, payload {self.kind}") for i in range(len(self.matrix))]

    def handleInputRows(self, key, rows, timerValues):
        fresh = pd.concat(list(rows))
        bucket = int(fresh["bucket"].iloc[0])
        # Nothing that belongs here is later than the end of the next bucket.
        self.handle.registerTimer((bucket + 2) * self.horizon_ms)
        n = len(self.matrix)
        old = [pd.DataFrame(list(x.get()) if x.exists() else [], columns=["ms", "payload"]) for x in self.lists]
        new = [fresh.loc[fresh["source"] == i, ["ms", "payload"]].reset_index(drop=True) for i in range(n)]
        every = [pd.concat([a, b], ignore_index=True) if len(a) else b for a, b in zip(old, new, strict=True)]
        for i in range(n):  # the first source whose message is new
            if not len(new[i]):
                continue
            parts = [old[k] if k < i else new[k] if k == i else every[k] for k in range(n)]
            for places in combinations([p["ms"].to_numpy(np.int64) for p in parts], self.horizon_ms):
                times = [p["ms"].to_numpy(np.int64)[at] for p, at in zip(parts, places, strict=True)]
                held = passes(times, self.matrix) & (np.min(times, axis=0) // self.horizon_ms == bucket)
                if held.any():
                    columns = {"key": [key[0]] * int(held.sum())}
                    for k, (p, at) in enumerate(zip(parts, places, strict=True)):
                        columns |= {f"ms_{k}": times[k][held], f"payload_{k}": p["payload"].to_numpy()[at[held]]}
                    yield pd.DataFrame(columns)
        for x, rows_of in zip(self.lists, new, strict=True):
            if len(rows_of):
                x.appendList(list(rows_of.itertuples(index=False, name=None)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for x in self.lists:
            x.clear()
        return iter(())

    def close(self) -> None:
        pass


def joint_stream(messages: DataFrame, matrix: Matrix, horizon_ms: int, late: str = "1 minute", key: str = "key", source: str = "source", ts: str = "ts", payload: str = "payload") -> DataFrame:
    """joint_rows() of a stream: each combination as soon as its last message has come, those later than ``late`` left out.

    Needs a RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    marked = messages.withWatermark(ts, late).filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    own = F.floor(ms / horizon_ms)
    rows = marked.withColumn("bucket", F.explode(F.array(own, own - 1))).select(F.col(key).alias("key"), F.col("bucket").cast("long").alias("bucket"), F.col(source).cast("int").alias("source"), ms.alias("ms"), F.col(payload).alias("payload"), F.col(ts).alias("at"))
    fields = ", ".join(f"ms_{i} long, payload_{i} {kinds[payload]}" for i in range(len(matrix)))
    schema = T._parse_datatype_string(f"key {kinds[key]}, {fields}")
    return rows.groupBy("key", "bucket").transformWithStateInPandas(_Joint(matrix, horizon_ms, kinds[payload], kinds[key]), schema, "Append", "eventTime")


def joint_converted(combined: DataFrame, decode: list, verify: list[Column | None], convert, encode) -> DataFrame:
    """The joint converter's chain on combinations of batch or stream: decode each payload, verify, convert, encode.

    decode: for each source a function of the payload's column that gives a struct; verify: conditions over s0, s1, ... or null;
    convert: a function of the columns s0, s1, ... that gives named columns; encode: a function of these that gives the payload.
    """
    n = len(decode)
    rows = combined.select("*", *[f(F.col(f"payload_{i}")).alias(f"s{i}") for i, f in enumerate(decode)])
    for condition in verify:
        rows = rows if condition is None else rows.filter(condition)
    made = convert(*[F.col(f"s{i}") for i in range(n)])
    out = rows.select("key", *[f"ms_{i}" for i in range(n)], *[c.alias(name) for name, c in made.items()])
    return out.withColumn("payload", encode(*[F.col(name) for name in made]))
