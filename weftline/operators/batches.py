"""Functions of texts run over few rows at a time, so that a Python worker's memory has a bound.

Spark hands a worker 10,000 rows at once. A function of a whole batch holds what
it makes of all of them; here it holds what it makes of SLICE rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE = 64


def in_slices(rows: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, size: int = SLICE) -> DataFrame:
    """What run makes of each ``size`` rows, columns as in schema."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                yield run(batch.slice(i, size))

    return rows.mapInArrow(each, schema)


def with_lists(rows: DataFrame, text: str, out: str, cut: Callable[[str], list[str]]) -> DataFrame:
    """rows with ``out``, the list of texts that cut makes of each text, in the place of ``text``."""
    kept = [c for c in rows.columns if c != text]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [None if t is None else cut(t) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lists, pa.list_(pa.string()))], [*kept, out])

    return in_slices(rows, run, schema)
