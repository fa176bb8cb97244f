"""Vector search: all rows in blocks, and an inverted file as a table.

The store is a folder of Parquet tables: ``rows`` partitioned by list, the
``centroids``, and ``gone``, the tombstones. A row lies in the list of its nearest
centroid; a query reads the lists of its nearest centroids only, which are
partitions of the table, so the others are never opened. Rows and tombstones
carry a version that rises with time: a row is there unless a later tombstone
has its id, so deleted ids can be inserted again. Centroids are fitted once, on a
bounded sample; all rows are assigned. Null and zero vectors are not kept.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ranking import top_k

#: Lists of an inverted file, rows a list on which centroids are fitted, rounds of fitting, lists a query reads.
LISTS, SAMPLE, FITTING, PROBES = 1024, 32, 8, 10
#: Vectors and queries of a block of exhaustive search; parts into which a list is divided, so that a large one is several tasks.
BLOCK, QUERIES, PARTS = 50_000, 1000, 8
#: Similarities that a task holds at once: as many queries meet a block together as fit in.
CELLS = 1 << 21


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1.0)


def best(query_ids: list, asked: np.ndarray, ids: np.ndarray, held: np.ndarray, k: int) -> pd.DataFrame:
    """The k most similar rows of each query but itself, ties to the smaller id; vectors of length 1."""
    score = asked @ held.T
    np.round(score, 12, out=score)
    score[np.array(query_ids)[:, None] == ids[None, :]] = -np.inf
    out = []
    for query, s in zip(query_ids, score, strict=True):
        edge = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
        near = np.flatnonzero((s >= edge) & (s > -np.inf))
        near = near[np.lexsort((ids[near], -s[near]))][:k]
        out.append(pd.DataFrame({"query_id": query, "hit_id": ids[near], "similarity": s[near]}))
    return pd.concat(out)


def _found(rows: DataFrame, asked: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each query over all groups of ``by`` in which it meets rows; both have id and vector."""
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("hit_id", kind), T.StructField("similarity", T.DoubleType())])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "hit_id": [], "similarity": []})
        ids, held = left["id"].to_numpy(), unit(np.stack(left.pop("vector")).astype(np.float64))
        step = max(1, min(QUERIES, CELLS // len(ids)))
        return pd.concat([best(right["id"].iloc[i : i + step].tolist(), unit(np.stack(right["vector"].iloc[i : i + step]).astype(np.float64)), ids, held, k) for i in range(0, len(right), step)])

    near = rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(meet, schema)
    return top_k(near, ["query_id"], [F.desc("similarity"), F.asc("hit_id")], k)


def _narrow(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vector IS NOT NULL")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """query_id, hit_id, similarity, rank: exact cosine top-k of each query row against all other rows.

    Blocks of rows meet groups of queries, each pair of them once: rows are copied to every group of QUERIES * 50 queries and
    queries to every block of BLOCK rows, and only k rows a query and block are shuffled on.
    """
    rows, asked = _narrow(vectors, id_col, vector_col), _narrow(queries, id_col, vector_col)
    blocks, groups = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // (QUERIES * 50)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.select("*", own(blocks).alias("block"), every(groups).alias("group"))
    right = asked.select("*", own(groups).alias("group"), every(blocks).alias("block"))
    return _found(left, right, ["block", "group"], k)


def fitted(rows: DataFrame, lists: int = LISTS, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means on at most lists * SAMPLE rows (id, vector), the first by a digest of their ids."""
    sample = [r["vector"] for r in rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(lists * SAMPLE).collect()]
    if not sample:
        raise ValueError("no vectors to fit centroids on")
    x = unit(np.array(sample))
    centroids = x[:lists].copy()
    for _ in range(FITTING):
        at = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        full = np.linalg.norm(sums, axis=1) > 0
        centroids[full] = unit(sums[full])  # a list without rows keeps its centroid
    return centroids


def _placed(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """rows with the lists of their ``probes`` nearest centroids, a row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            score = np.stack(batch["vector"]).astype(np.float64) @ centroids.T
            n = min(probes, len(centroids))
            yield batch.assign(list=list(np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, vector array<double>, list array<int>").withColumn("list", F.explode("list"))


def _kept(rows: DataFrame) -> DataFrame:
    return rows.filter(F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: x.isNotNull()))


def create(vectors: DataFrame, path: str, id_col: str, vector_col: str, lists: int = LISTS) -> None:
    """A store of the vectors at a path that must not exist."""
    spark, rows = vectors.sparkSession, _kept(_narrow(vectors, id_col, vector_col))
    centroids = fitted(rows, lists)
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, vector array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    spark.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, version long").write.parquet(f"{path}/gone")
    insert(vectors, path, id_col, vector_col)


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["vector"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])


def insert(vectors: DataFrame, path: str, id_col: str, vector_col: str) -> None:
    """Appends rows, each to its list."""
    rows = _placed(_kept(_narrow(vectors, id_col, vector_col)), _centroids(vectors.sparkSession, path), 1)
    # By list and a part of it: few files a list, and no task with a whole large one.
    spread = rows.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(PARTS))).repartition("list", "__part").drop("__part")
    spread.withColumn("version", F.lit(time.time_ns())).write.mode("append").partitionBy("list").parquet(f"{path}/rows")


def delete(ids: DataFrame, path: str) -> None:
    """Tombstones for the ids of a one-column DataFrame."""
    ids.toDF("id").withColumn("version", F.lit(time.time_ns())).write.mode("append").parquet(f"{path}/gone")


def present(spark: SparkSession, path: str) -> DataFrame:
    """id, vector, list of the rows that are there."""
    gone = spark.read.parquet(f"{path}/gone").groupBy("id").agg(F.max("version").alias("until"))
    rows = spark.read.parquet(f"{path}/rows")
    return rows.join(gone, "id", "left").filter(F.col("until").isNull() | (F.col("version") > F.col("until"))).select("id", "vector", "list")


def search(queries: DataFrame, path: str, id_col: str, vector_col: str, k: int, probes: int = PROBES) -> DataFrame:
    """query_id, hit_id, similarity, rank: the k most similar rows in each query's nearest lists (Q17); all lists, if probes is their number.

    Only the lists that some query needs are read: their numbers, LISTS at most, are a filter on the table's partitions.
    """
    spark = queries.sparkSession
    asked = _placed(_kept(_narrow(queries, id_col, vector_col)), _centroids(spark, path), probes)
    needed = [r["list"] for r in asked.select("list").distinct().collect()]
    rows = present(spark, path).filter(F.col("list").isin(needed)).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    return _found(rows, asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["list", "part"], k)
