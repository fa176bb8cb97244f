"""The vector store: recall, the lists that are read, appends, deletes and what comes back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import vectors as V


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16)], "id long, v array<double>")
    path = str(tmp_path_factory.mktemp("store") / "vectors")
    V.create(table, path, "id", "v", lists=64)
    return table, path, x


def hits(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.hit_id)
    return out


def test_recall_rises_with_probes_to_exactness(store):
    table, path, x = store
    asked = table.filter("id % 50 = 0 AND id < 4000")
    exact = hits(V.nearest(table, asked, "id", "v", 10))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 3950):
        assert exact[q] == [int(i) for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:10]
    share = {}
    for probes in (1, 10, 64):
        near = hits(V.search(asked, path, "id", "v", 10, probes))
        share[probes] = np.mean([len(set(near.get(q, [])) & set(own)) / 10 for q, own in exact.items()])
    assert share[1] <= share[10] and share[10] >= 0.95 and share[64] == 1.0


def test_only_the_lists_needed_are_read(spark, store):
    table, path, _ = store
    plan = V.search(table.filter("id = 100"), path, "id", "v", 5, 3)._jdf.queryExecution().toString()
    filters = next(line for line in plan.split("\n") if "PartitionFilters" in line and "/rows" in line)
    assert "list#" in filters.split("PartitionFilters")[1]
    read = V.present(spark, path).filter(F.col("list").isin([1, 2, 3]))
    assert all(f"list={k}" in f for f in read.inputFiles() if "/rows/" in f for k in [f.split("list=")[1].split("/")[0]] if int(k) in (1, 2, 3))


def test_deleted_ids_go_and_come_back(spark, store):
    table, path, _ = store
    asked = table.filter("id = 7")
    first = hits(V.search(asked, path, "id", "v", 3, 64))[7]
    V.delete(spark.createDataFrame([(first[0],)], "id long"), path)
    second = hits(V.search(asked, path, "id", "v", 3, 64))[7]
    assert second[:2] == first[1:]
    V.insert(table.filter(F.col("id") == first[0]), path, "id", "v")
    assert hits(V.search(asked, path, "id", "v", 3, 64))[7] == first
    assert V.present(spark, path).count() == 4000


def test_queries_meet_a_block_few_at_a_time(spark, monkeypatch):
    """A bound on the similarities held at once changes nothing in the result."""
    rows = spark.range(300).selectExpr("id", "array(sin(id), cos(id * 3D), double(id % 7 - 3)) AS v")
    asked = rows.filter("id % 4 = 0")
    want = sorted(map(tuple, V.nearest(rows, asked, "id", "v", 6).collect()))
    monkeypatch.setattr(V, "CELLS", 700)
    assert sorted(map(tuple, V.nearest(rows, asked, "id", "v", 6).collect())) == want
    assert len(want) == 75 * 6
