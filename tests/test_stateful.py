"""State of joint conversion and job monitor: streams in several batches and any order against the batch plans and plain loops."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import bits
from weftline.functions import formula as X
from weftline.operators import monitor as L
from weftline.streaming import jobs, joint

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
BASE = int(T0.timestamp() * 1000)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def batches(spark, tmp_path, parts, schema):
    """A stream that reads a file, and so a part, each micro-batch."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        (part,) = (tmp_path / f"p{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        target = tmp_path / "in" / f"{k:03d}.parquet"
        part.rename(target)
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collected(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()], q


SCHEMA = "key string, source int, ts timestamp, payload binary"
MATRIX = [[0, 400, -1], [0, 0, 300], [0, 0, 0]]


def gated(rows, matrix, horizon):
    """Every combination, by loops."""
    n, out = len(matrix), []
    for key in {r[0] for r in rows}:
        own = [[r for r in rows if r[0] == key and r[1] == i] for i in range(n)]
        for found in itertools.product(*own):
            t = [int(r[2].timestamp() * 1000) for r in found]
            passed = sum(m in (None, -1) or m + t[i] - t[j] > 0 for i in range(n) for j in range(i + 1, n) for m in [matrix[i][j]])
            if max(t) - min(t) <= horizon and passed == n - 1:
                out.append((key, *(x for ms, r in zip(t, found, strict=True) for x in (ms, bytes(r[3])))))
    return sorted(out)


def message(key, source, ms, payload=b"\x01"):
    return (key, source, T0 + dt.timedelta(milliseconds=ms), payload)


def flat(rows):
    return sorted((r[0], *(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r[1:])) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_joint_rows_are_all_gated_combinations(spark, n):
    rng = random.Random(n)
    matrix = [row[:n] for row in MATRIX[:n]]
    rows = [message(rng.choice("ab"), rng.randrange(n), rng.randrange(5000), bytes([k % 251])) for k in range(150)]
    table = spark.createDataFrame([*rows, *((None, k, T0, b"x") for k in range(n)), *(("a", k, None, b"x") for k in range(n))], SCHEMA)
    assert flat(tuple(r) for r in joint.joint_rows(table, matrix, 700).collect()) == gated(rows, matrix, 700)


def test_two_of_three_pairs_must_pass(spark):
    at = lambda a, b, c: [message("k", 0, a), message("k", 1, b), message("k", 2, c)]
    fires = lambda rows: joint.joint_rows(spark.createDataFrame(rows, SCHEMA), [[0, 200, 200], [0, 0, 200], [0, 0, 0]], 1000).count()
    assert fires(at(500, 500, 500)) == 0  # all three pass
    assert fires(at(500, 750, 600)) == 1  # the first pair fails
    assert fires(at(100, 350, 700)) == 0  # all fail


def test_joint_stream_equals_the_batch_and_forgets(rocks, tmp_path):
    rng = random.Random(4)
    rows = [message(rng.choice("ab"), rng.randrange(3), k * 20 + rng.randrange(400), bytes([k % 251])) for k in range(240)]
    late = [message("a", 0, 5), message("a", 1, 6), message("a", 2, 7)]  # far behind the watermark
    end = [message("z", 0, 60_000)]
    parts = [rows[:80], rows[80:160], rows[160:], end, late, [message("z", 0, 61_000)]]
    stream = joint.joint_stream(batches(rocks, tmp_path, parts, SCHEMA), MATRIX, 700, "1 second")
    got, q = collected(rocks, stream, "joint3")
    assert flat(got) == gated(rows, MATRIX, 700)
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"]) == 6


def test_converter_of_two_sources(spark):
    """Two sources, window 200 ms, sum_value = a.value_a + b.value_b; a checksum-like rule of the second must hold."""
    pair = lambda key, a, b, va, vb: [message(key, 0, a, bytes([va])), message(key, 1, b, bytes([vb]))]
    rows = pair("fire", 1000, 1150, 7, 35) + pair("no", 1000, 1200, 1, 2) + pair("late", 1500, 1000, 200, 55) + pair("bad", 1000, 1001, 1, 0)
    combined = joint.joint_rows(spark.createDataFrame(rows, SCHEMA), [[0, 200], [200, 0]], 1000)
    one = lambda name: bits.decoder([(name, 8)])
    out = joint.joint_converted(combined, [one("value_a"), one("value_b")], [None, F.col("s1.value_b") > 0], lambda a, b: {"sum_value": X.expression("value_a + value_b", {"value_a": a["value_a"], "value_b": b["value_b"]})}, bits.encoder([16]))
    assert sorted((r.key, r.sum_value, bytes(r.payload)) for r in out.collect()) == [("fire", 42, b"\x00\x2a"), ("late", 255, b"\x00\xff")]


LINES = "job string, seq long, ts timestamp, value string"


def log(rng, job, n):
    step, out = 0, []
    for k in range(n):
        step += rng.randrange(0, 9)
        parts = [f"progress={min(100, step // 3)}%"] * (rng.random() < 0.3) + [f"step={step - 20 * (rng.random() < 0.2)}/300".replace("=-", "=")] * (rng.random() < 0.8)
        parts += [f"epoch: {step / 100:.2f}"] * (rng.random() < 0.5) + [f"train_loss={rng.random():.3f}"] * (rng.random() < 0.5) + [f"Acc: {rng.choice([0.5, 0.6, 0.7])}"] * (rng.random() < 0.5) + ["lr=1e-4"] * (rng.random() < 0.1)
        out.append((job, k, T0 + dt.timedelta(seconds=k), " ".join(parts)))
    return out


def events(rows):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((*r[:9], list(r[9]), *r[10:]) for r in rows), key=key)


def test_events_do_not_depend_on_the_order_of_lines(rocks, tmp_path):
    rng = random.Random(8)
    rows = log(rng, "a", 120) + log(rng, "b", 60)
    expected = events(tuple(r) for r in jobs.job_events(rocks.createDataFrame(rows, LINES), 25).collect())
    kinds = {r[-1] for r in expected}
    assert kinds >= {"update", "checkpoint"} and len(expected) == 180
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 25))
    parts = [shuffled[k : k + 45] for k in range(0, 180, 45)]
    got, _ = collected(rocks, jobs.job_event_stream(batches(rocks, tmp_path, parts, LINES), 25, "5 minutes"), "ordered")
    assert events(got) == expected


def test_a_lost_line_holds_the_others_up_until_the_watermark(rocks, tmp_path):
    at = lambda k, s, text: ("j", k, T0 + dt.timedelta(seconds=s), text)
    parts = [[at(0, 0, "step=10/100 acc=0.5"), at(2, 2, "step=30/100 acc=0.9")], [at(4, 4, "step=60/100")], [at(5, 300, "step=5/100 loss=1.5")], [at(6, 301, "step=100/100")]]
    got, _ = collected(rocks, jobs.job_event_stream(batches(rocks, tmp_path, parts, LINES), 20, "10 seconds"), "gaps")
    short = [(r[1], r[2], r[3], list(r[9]), r[10], r[11]) for r in sorted(got, key=lambda r: r[1])]
    assert short == [(0, 10, 10, [], None, "update"), (2, 30, 30, [20], 20, "checkpoint"), (4, 60, 60, [40, 60], 20, "checkpoint"), (5, 60, 60, [], 20, "update"), (6, 100, 100, [80, 100], 80, "finish")]


def test_history_keeps_the_last_of_neighbouring_equal_steps(spark):
    rows = [("j", 0, 1, "a"), ("j", 1, 1, "b"), ("j", 2, 2, "c"), ("j", 3, 1, "d"), ("j", 4, 1, "e")]
    got = L.history(spark.createDataFrame(rows, "job string, seq int, step int, v string"), ["job"], "step", "seq", ["v"])
    assert sorted((r.seq, r.step, r.v) for r in got.collect()) == [(1, 1, "b"), (2, 2, "c"), (4, 1, "e")]
    assert sorted(r.v for r in L.history(spark.createDataFrame(rows, "job string, seq int, step int, v string"), ["job"], "step", "seq", ["v"], 2).collect()) == ["c", "e"]
