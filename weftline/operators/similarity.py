"""Pairs of similar texts by an inverted index of grams, without comparing all pairs.

The ratio of two texts is twice the matched characters by both lengths. For a
ratio of at least r they share M >= r (|a| + |b|) / 2 characters, hence as many of
their numbered characters (the first a, the second a, ...). Their matches are
runs with unmatched characters between them, at most |a| + |b| - 2M + 1 runs, so
they share at least 3M - |a| - |b| - 1 numbered pairs of characters, too: the
better filter, where it says anything.

Grams are ordered by how rare they are. Two texts that share n of a and b grams
share one of the first a - n + 1 of one and b - n + 1 of the other, so only these
prefixes are indexed, and a gram at places i and j can begin no more than
1 + min(a - i, b - j) shared ones. Candidates meet the exact bound of equal
characters in native code and then the exact ratio. Equal texts are compared once.
"""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import metrics as M

#: Slots in which the frequency of grams is counted: what the driver gets, whatever the size of the data.
SLOTS = 1 << 16


def least_shared(size, ratio: float, pairs: bool):
    """Grams that two texts of so many characters together share at least; nothing is said by 0 or less. Numbers or Columns."""
    ceil = F.ceil if isinstance(size, Column) else np.ceil
    matched = ceil(size * ratio / 2 - 1e-9)
    return 3 * matched - size - 1 if pairs else matched


def grams(text: str, pairs: bool) -> list[tuple[str, int]]:
    """Numbered characters, or numbered pairs of neighbours."""
    seen: Counter = Counter()
    out = []
    for g in (text[k : k + 2] for k in range(len(text) - 1)) if pairs else text:
        seen[g] += 1
        out.append((g, seen[g]))
    return out


def _keys(text: str, pairs: bool) -> np.ndarray:
    found = grams(text, pairs)
    return pd.util.hash_array(np.array([f"{n}:{g}" for g, n in found], object), categorize=False).astype(np.int64) if found else np.empty(0, np.int64)


def _slot_counts(texts: DataFrame, pairs: bool) -> np.ndarray:
    """How often grams fall into each slot, over all texts."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, _keys(text, pairs) & (SLOTS - 1), 1)
        slots = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slots, "n": total[slots]})

    rows = texts.mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most SLOTS rows
    out = np.zeros(SLOTS, np.int64)
    for r in rows:
        out[r["slot"]] = r["n"]
    return out


def _prefixes(texts: DataFrame, ratio: float, pairs: bool, counts: np.ndarray) -> DataFrame:
    """text, n (grams), gram, place for each gram of the texts' prefixes. The counts are SLOTS numbers, whatever the data."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("place", T.IntegerType())])))
    def prefix(values: pd.Series) -> pd.Series:
        out = []
        for text in values:
            keys, size = _keys(text, pairs), len(text)
            partners = np.arange(np.ceil(size * ratio / (2 - ratio) - 1e-9), np.floor(size * (2 - ratio) / ratio + 1e-9) + 1)
            least = max(1, int(np.min(least_shared(size + partners, ratio, pairs), initial=np.inf, where=partners > 0) if size else 1))
            keep = max(0, len(keys) - least + 1)
            order = np.lexsort((keys, counts[keys & (SLOTS - 1)]))[:keep]
            out.append([{"gram": int(k), "place": p} for p, k in enumerate(keys[order])])
        return pd.Series(out)

    held = texts.withColumn("n", F.greatest(F.length("text") - (1 if pairs else 0), F.lit(0)))
    return held.select("text", "n", F.explode(prefix("text")).alias("g")).select("text", "n", "g.gram", "g.place")


def similarity_of(ratio: float, matched: bool):
    """A function of two texts: their ratio, or null where it is below ``ratio``; matched runs are looked for only where equal characters allow."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list[float | None] = []
        counts: dict[str, Counter] = {}
        for x, y in zip(a, b, strict=True):
            for text in (x, y):
                if text not in counts:
                    counts[text] = Counter(text)
            value = 2.0 * sum(min(n, counts[y][c]) for c, n in counts[x].items()) / (len(x) + len(y))
            if matched and value >= ratio - 1e-12:
                value = SequenceMatcher(None, x, y).ratio()
            out.append(value if value >= ratio else None)
        return pd.Series(out, dtype="Float64")

    return run


def _met(sides: list[DataFrame], ratio: float, pairs: bool) -> DataFrame:
    """Pairs of texts that share a gram of both prefixes."""
    counts = _slot_counts(sides[0].unionByName(sides[1]), pairs)
    a, b = (_prefixes(d, ratio, pairs, counts).select(*[F.col(c).alias(f"{p}_{c}") for c in ("text", "n", "gram", "place")]) for d, p in zip(sides, "ab", strict=True))
    shared = least_shared(F.length("a_text") + F.length("b_text"), ratio, pairs)
    fits = (M.ratio_bound(F.col("a_text"), F.col("b_text")) >= ratio - 1e-12) & (F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= shared)
    return a.join(b, (F.col("a_gram") == F.col("b_gram")) & fits).select(F.col("a_text").alias("a"), F.col("b_text").alias("b"))


def similar_texts(left: DataFrame, right: DataFrame, ratio: float, measure: str = "matched") -> DataFrame:
    """a, b, similarity of all pairs of texts (column text of each side) whose ratio is at least ratio (above 0).

    measure: ``matched`` for the ratio of matched runs, ``equal`` for that of equal characters. Null texts have no pairs; two
    empty texts are equal. Each pair of texts comes once, however many rows hold them.
    """
    if not 0 < ratio <= 1:
        raise ValueError("a ratio above 0 and at most 1")
    sides = [d.filter(F.col("text").isNotNull()).select("text").distinct() for d in (left, right)]
    # Neighbours are no bound of the measure of equal characters; they say little at small ratios, and nothing of two texts of less than `brief` characters.
    if measure == "matched" and 1.5 * ratio - 1 > 0.1:
        brief = math.ceil(2 / (1.5 * ratio - 1))
        met = _met(sides, ratio, True).unionByName(_met([d.filter(F.length("text") < brief) for d in sides], ratio, False))
    else:
        met = _met(sides, ratio, False)
    # Pairs are few bytes but much work: as many tasks as the session has, not as many as the bytes suggest.
    tasks = max(met.sparkSession.sparkContext.defaultParallelism, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = met.repartition(tasks, "a", "b").distinct().withColumn("similarity", similarity_of(ratio, measure == "matched")("a", "b")).filter("similarity IS NOT NULL")
    empty = sides[0].filter("text = ''").join(sides[1].filter("text = ''"), "text").select(F.col("text").alias("a"), F.col("text").alias("b"), F.lit(1.0).alias("similarity"))
    return found.select("a", "b", "similarity").unionByName(empty)
