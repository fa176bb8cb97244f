"""Aggregates, table functions and checks that a user registers by name.

An aggregate is four functions: ``zero()`` gives a state, ``update(state, value)``
takes a value in, ``merge(a, b)`` joins two states, ``finish(state)`` gives the
result. States are folded within each task, then merged in two steps, so a key
that holds a third of all rows is spread over the tasks, and what a task holds
is a state a key, passed on whenever there are more than HELD of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD, SALT = 50_000, 32


class Aggregate(NamedTuple):
    zero: Callable[[], Any]
    update: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    result: str


AGGREGATES: dict[str, Aggregate] = {}
CHECKS: dict[str, Callable[[], Column]] = {}


def register_aggregate(name: str, aggregate: Aggregate) -> None:
    AGGREGATES[name] = aggregate


def register_check(name: str, check: Callable[[], Column]) -> None:
    """A named condition over a rule's columns, for ``rules.checks``; null counts as failed."""
    CHECKS[name] = check


def aggregated(rows: DataFrame, keys: list[str], name: str, value: str, out: str) -> DataFrame:
    """keys and the registered aggregate of the values of each; null values are taken in as None, null keys are a key."""
    own = AGGREGATES[name]
    kinds = [rows.schema[k] for k in keys]
    partial = T.StructType([*kinds, T.StructField("__state", T.BinaryType())])
    salted = T.StructType([*kinds, T.StructField("__salt", T.IntegerType()), T.StructField("__state", T.BinaryType())])
    final = T.StructType([*kinds, T.StructField(out, T._parse_datatype_string(own.result))])
    plain = lambda v: None if v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else v

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}

        def flushed() -> pd.DataFrame:
            frame = pd.DataFrame([[*k, pickle.dumps(s)] for k, s in states.items()], columns=partial.names)
            states.clear()
            return frame

        for batch in batches:
            for *key, v in batch[[*keys, value]].itertuples(index=False, name=None):
                k = tuple(map(plain, key))
                states[k] = own.update(states[k] if k in states else own.zero(), plain(v))
            if len(states) > HELD:
                yield flushed()
        if states:
            yield flushed()

    def merged(group: pd.DataFrame) -> Any:
        state = None
        for k, data in enumerate(group["__state"]):
            other = pickle.loads(data)  # written by fold() or join() of this very job
            state = own.merge(state, other) if k else other
        return state

    def join(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*group[[*keys, "__salt"]].iloc[0], pickle.dumps(merged(group))]], columns=salted.names)

    def end(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*group[keys].iloc[0], own.finish(merged(group))]], columns=final.names).astype(object)

    states = rows.select(*keys, value).mapInPandas(fold, partial).withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    return states.groupBy(*keys, "__salt").applyInPandas(join, salted).groupBy(*keys).applyInPandas(end, final)


def register_table_function(spark: SparkSession, name: str, function: type, result: str | None = None) -> None:
    """A class with ``eval`` that yields rows, callable in SQL as ``name(...)`` and, with LATERAL, for each row of a table.

    result: its columns; a class with a static method ``analyze`` says them itself, from the arguments.
    """
    spark.udtf.register(name, F.udtf(function, returnType=result) if result else F.udtf(function))


#: Aggregates at hand.
register_aggregate("first_values", Aggregate(dict, lambda s, v: s if v is None else s | {v: s.get(v, 0) + 1}, lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in a | b}, lambda s: sorted(s, key=lambda k: (-s[k], k))[:3], "array<string>"))
register_aggregate("mean_and_spread", Aggregate(lambda: (0, 0.0, 0.0), lambda s, v: s if v is None else (s[0] + 1, s[1] + v, s[2] + v * v), lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)), lambda s: None if not s[0] else [s[1] / s[0], max(0.0, s[2] / s[0] - (s[1] / s[0]) ** 2) ** 0.5], "array<double>"))
