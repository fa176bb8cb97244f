import datetime as dt

from weftline.streaming import runtime

T0 = dt.datetime(2024, 1, 1)


def collected(spark, query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def stream(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def test_repeat_gate(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", at(0), b"x"), ("a", at(1), b"x"), ("a", at(2), b"y"), ("b", at(0), b"x"), ("a", at(60), b"y")]
    got = collected(spark, runtime.repeat_gate(stream(spark, tmp_path, rows, "name string, ts timestamp, payload binary", "m"), 2, 500, 30_000), "gate")
    assert sorted((r["name"], bytes(r["payload"]), r["n"], r["fires"]) for r in got) == [("a", b"x", 1, False), ("a", b"x", 2, True), ("a", b"y", 1, False), ("a", b"y", 1, False), ("b", b"x", 1, False)]


def test_joint(spark, tmp_path):
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    a = stream(spark, tmp_path, [(1, at(1000)), (2, at(1000))], "k long, ts timestamp", "a")
    b = stream(spark, tmp_path, [(1, at(1150)), (2, at(1200))], "k long, ts timestamp", "b")
    assert [r["l_k"] for r in collected(spark, runtime.joint(a, b, "k", 200), "joint")] == [1]


def test_monitor(spark, tmp_path):
    rows = [("j", "progress=10% step=10/100 epoch=1 loss=0.9 acc=0.5"), ("j", "progress=5% step=20/100 loss=0.8"), ("j", "progress=100% step=100/100 acc=0.7")]
    got = collected(spark, runtime.monitor(stream(spark, tmp_path, rows, "job string, value string", "l"), 20), "monitor")
    assert [(r["event_id"], r["progress"], r["kind"]) for r in sorted(got, key=lambda r: r["event_id"])] == [(1, 10.0, "update"), (2, 10.0, "checkpoint"), (3, 100.0, "finish")]
