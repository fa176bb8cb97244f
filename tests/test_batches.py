"""Functions of texts over slices of a worker's batch."""

import pyarrow as pa
from pyspark.sql import types as T

from weftline.operators import batches, chunking, retrieval


def test_a_worker_makes_results_of_a_slice_at_a_time(spark):
    schema = T.StructType([T.StructField("n", T.LongType())])
    got = [r["n"] for r in batches.in_slices(spark.range(0, 1000, 1, 1), lambda b: pa.RecordBatch.from_pydict({"n": [b.num_rows]}), schema).collect()]
    assert sum(got) == 1000 and max(got) <= batches.SLICE


def _python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "ArrowEvalPython" in plan, "MapInArrow" in plan


def test_resplit_cuts_in_slices(spark):
    texts = [f"{k} " + "word and more. " * (100 + k) for k in range(150)]
    out = chunking.resplit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string"), "content")
    assert _python_nodes(out) == (False, True)
    want = {(k, i): x for k, t in enumerate(texts) for i, x in enumerate(chunking.split_text(t, 500, 50))}
    assert {(r["doc_id"], r["chunk_index"]): r["content"] for r in out.collect()} == want


def test_paragraphs_wrap_in_slices(spark):
    texts = ["short\n\n" + "long words " * (80 + k) + "\n\nlast" for k in range(150)]
    out = retrieval.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    assert _python_nodes(out) == (False, True)
    got = {(r["doc_id"], r["position"]): r["paragraph"] for r in out.collect()}
    for k, t in enumerate(texts):
        own = [got[k, i] for i in range(sum(d == k for d, _ in got))]
        assert own[0] == "short" and own[-1] == "last" and " ".join(own[1:-1]).split() == t.split()[1:-1]
        assert max(map(len, own)) <= retrieval.PARAGRAPH
