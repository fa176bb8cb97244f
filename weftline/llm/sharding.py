"""Sharding by a keyed permutation of global row numbers.

Rows get global numbers 0..N-1 in the order (doc_id, text crc32, size); a
Feistel network over the smallest even-width binary domain that holds N,
walked until it lands below N, permutes them. Row p of the permuted order
goes to shard ``p mod S`` at slot ``p div S``: shard sizes differ by one row
at most, slots have no gaps, and both directions are computable.

Nulls: a null doc_id sorts first and keeps its row; a null text counts as
empty. Equal rows are interchangeable, so any order among them gives the
same result. An empty table gives an empty result. Other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import stored, table, text_or_empty

ROUNDS = 6
#: Fixed multiplier and prime of the round function; products stay below 2**62.
MULTIPLIER, PRIME = 1_103_515_245, 2_147_483_647


def round_keys(seed: str) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:4], "big") >> 2 for i in range(ROUNDS)]


def half_width(n: int) -> int:
    """Bits of each half, so that 2**(2*bits) >= n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (half + key) % PRIME * MULTIPLIER % PRIME
    x = (x ^ (x >> 13)) * 69_069 % PRIME
    return (x ^ (x >> 11)) & mask


def _network(x: np.ndarray, keys: list[int], bits: int, inverse: bool) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys) if inverse else keys:
        if inverse:
            left, right = right ^ _round(left, key, mask), left
        else:
            left, right = right, left ^ _round(right, key, mask)
    return left << bits | right


def permute(x: np.ndarray, n: int, seed: str, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at each of x, by cycle walking."""
    keys, bits = round_keys(seed), half_width(n)
    out = _network(np.asarray(x, dtype=np.int64), keys, bits, inverse)
    while (far := out >= n).any():
        out[far] = _network(out[far], keys, bits, inverse)
    return out


def permuted(n: int, seed: str) -> Callable[[Column], Column]:
    @F.pandas_udf(T.LongType())
    def walk(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    return walk


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with a gapless global ``row_number`` (from 0) in the given order, and their count.

    The rows are range-partitioned and sorted once and written to the shared
    folder with their place in their partition; only the partitions' counts
    come to the driver. A last sort key from the input's place spreads equal
    rows over partitions.
    """
    placed = rows.withColumn("__tie", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__at", 33).cast("int"))
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    if not starts:
        return placed.withColumn("row_number", F.lit(0).cast("long")).drop("__at", "__part"), 0
    offsets = rows.sparkSession.createDataFrame(starts, "__part int, __start long")  # a row a partition
    row = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "__part").withColumn("row_number", row).drop("__at", "__part", "__start"), total


def shard(docs: DataFrame, shards: int, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard, slot of each row (law ``rows``)."""
    text = text_or_empty(text_col)
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    rows, total = numbered(narrow, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("position", permuted(max(total, 1), seed)("row_number"))
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.floor(F.col("position") / shards).cast("long"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
