"""Folds over ordered rows whose groups have no bound: a group is many tasks.

Rows are dealt by ranges of (keys, order) and stored with the number of their
piece, so that a group of a third of all rows is spread over many pieces.
``with_previous`` gives each row the one before it, across pieces too.
``budget_groups`` is the sequential fold "a row starts a new group if it is apart,
or if the group's tokens would exceed the hard budget, or the soft one on a weak
row". Within a piece prefix sums tell for each row where a group that starts
there would end, and pointer doubling where the piece's last group starts. What
a piece does to an open group depends on its tokens only, so a piece is summed
up as a step function of them, and a fold over the pieces of a group (not its
rows) finds the tokens with which each piece really begins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.storage import discard, stored

PIECE = "__piece"


def in_pieces(rows: DataFrame, keys: list[str], order: list[str], name: str = "pieces") -> DataFrame:
    """rows with __piece, stored: pieces are ranges of (keys, order) in order of their numbers. keys and order together name a row."""
    # Ranges are found by a pass over the rows; stored first, they are worked out once.
    once = stored(rows, f"{name}-rows")
    pieces = stored(once.repartitionByRange(*keys, *order).withColumn(PIECE, F.spark_partition_id()), name)
    discard(once)
    return pieces


def with_previous(pieces: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str = "__previous") -> DataFrame:
    """pieces with a struct of the columns of the row before in its keys, null for the first."""
    own = Window.partitionBy(PIECE, *keys).orderBy(*order)
    value = F.struct(*columns)
    # The last row of each piece and keys is the one before the first row of the next piece; keys within one piece have no next.
    last = pieces.groupBy(*keys, PIECE).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    after = last.withColumn(out, F.lag("__last").over(Window.partitionBy(*keys).orderBy(PIECE))).filter(F.col(out).isNotNull())
    seams = after.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(PIECE).alias("__p"), F.col(out).alias("__seam"))
    here = pieces.withColumn("__within", F.lag(value).over(own)).withColumn("__first", F.row_number().over(own) == 1)
    same = F.col("__first") & (F.col(PIECE) == F.col("__p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    # A piece has one seam at most, as only its first keys lie in the piece before, too: rows never move for the seams.
    joined = here.join(F.broadcast(seams), same, "left").withColumn(out, F.coalesce("__within", "__seam"))
    return joined.drop("__within", "__first", "__seam", "__p", *[f"__k{i}" for i in range(len(keys))])


class Piece:
    """The rows of a piece: where a group that starts at each one ends, and what becomes of an open group."""

    def __init__(self, tokens: np.ndarray, apart: np.ndarray, weak: np.ndarray, soft: int, hard: int) -> None:
        n = self.n = len(tokens)
        self.sums, self.hard, self.soft = np.concatenate([[0], np.cumsum(tokens)]), hard, soft
        none = np.full(n + 1, n)
        places = np.arange(n)
        self.next_apart, self.next_weak = none.copy(), none.copy()
        for nearest, held in ((self.next_apart, apart), (self.next_weak, weak)):
            nearest[:n] = np.minimum.accumulate(np.where(held, places, n)[::-1])[::-1]
        self.next = self.cut(self.sums[:n], places + 1)

    def cut(self, base: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The first row from begin on that starts a new group, for groups whose tokens are the running sum less base."""
        over_hard = np.searchsorted(self.sums[1:], base + self.hard, "right")
        over_soft = np.minimum(np.searchsorted(self.sums[1:], base + self.soft, "right"), self.n)
        ends = np.minimum(np.maximum(over_hard, begin), self.next_apart[np.minimum(begin, self.n)])
        return np.minimum(ends, self.next_weak[np.maximum(over_soft, np.minimum(begin, self.n))])

    def lasts(self) -> tuple[np.ndarray, np.ndarray]:
        """For a group that starts at each row: the groups from there to the end, and the last one's start. By pointer doubling."""
        jump = np.append(self.next, self.n)
        count, last = np.append(np.ones(self.n, np.int64), 0), np.arange(self.n + 1)
        while (jump < self.n).any():
            on = jump < self.n
            last = np.where(on, last[jump], last)
            count, jump = count + np.where(on, count[jump], 0), jump[jump]
        return count, last

    def summary(self) -> tuple[list[int], list[int], list[int]]:
        """Steps of an open group's tokens: from which on, groups started (0 for none), tokens of the last group (for none: of the piece)."""
        t = np.arange(self.hard + 2)
        cuts = self.cut(-t, np.zeros(len(t), np.int64))
        begins = np.flatnonzero(np.append(True, cuts[1:] != cuts[:-1]))
        count, last = self.lasts()
        at = cuts[begins]
        left = self.sums[self.n] - np.where(at < self.n, self.sums[np.minimum(last[at], self.n)], 0)
        return t[begins].tolist(), np.where(at < self.n, count[at], 0).tolist(), left.tolist()

    def starts(self, open_tokens: int) -> np.ndarray:
        """Which rows start a group, after an open group of so many tokens."""
        out = np.zeros(self.n, bool)
        at = int(self.cut(np.array([-open_tokens]), np.array([0]))[0])
        while at < self.n:
            out[at] = True
            at = int(self.next[at])
        return out


def budget_groups(pieces: DataFrame, keys: list[str], order: list[str], tokens: str, apart: Column, weak: Column, soft: int, hard: int, out: str) -> DataFrame:
    """keys, order and the number of each row's group. apart must hold for the first row of the keys; tokens are integers from 0."""
    narrow = pieces.select(*keys, *order, PIECE, F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("__n"), F.coalesce(apart, F.lit(True)).alias("__apart"), F.coalesce(weak, F.lit(True)).alias("__weak"))
    kinds = [narrow.schema[c] for c in keys]
    counts = T.StructType([*kinds, T.StructField(PIECE, T.IntegerType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("__from", "__groups", "__left"))])
    begins = T.StructType([*kinds, T.StructField(PIECE, T.IntegerType()), T.StructField("__open", T.LongType()), T.StructField("__before", T.LongType())])
    numbered = T.StructType([*kinds, *(narrow.schema[c] for c in order), T.StructField(out, T.LongType())])

    def piece(rows: pd.DataFrame) -> Piece:
        return Piece(rows["__n"].to_numpy(np.int64), rows["__apart"].to_numpy(bool), rows["__weak"].to_numpy(bool), soft, hard)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        steps = piece(rows.sort_values(order)).summary()
        return pd.DataFrame([[*rows[[*keys, PIECE]].iloc[0], *steps]], columns=counts.names)

    def seams(rows: pd.DataFrame) -> pd.DataFrame:
        found, now, before = [], hard + 1, 0
        for steps, groups, left in zip(*(rows.sort_values(PIECE)[c] for c in ("__from", "__groups", "__left")), strict=True):
            found.append((now, before))
            k = int(np.searchsorted(steps, now, "right")) - 1
            now = min(hard + 1, int(left[k]) + (0 if groups[k] else now))
            before += int(groups[k])
        return rows.sort_values(PIECE)[[*keys, PIECE]].assign(__open=[x for x, _ in found], __before=[x for _, x in found])

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        starts = piece(rows).starts(int(rows["__open"].iloc[0]))
        return rows[[*keys, *order]].assign(**{out: int(rows["__before"].iloc[0]) - 1 + np.cumsum(starts)})

    # Only keys that lie in several pieces are summed up; all others begin with no group.
    spread = narrow.select(*keys, PIECE).distinct().groupBy(*keys).agg(F.min(PIECE).alias("__low"), F.max(PIECE).alias("__high")).filter("__low < __high")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    wide = narrow.alias("n").join(spread.alias("s"), _all(same("n", "s")), "left_semi")
    known = wide.groupBy(*keys, PIECE).applyInPandas(summed, counts).groupBy(*keys).applyInPandas(seams, begins)
    met = narrow.alias("n").join(known.alias("k"), _all([*same("n", "k"), F.col(f"n.{PIECE}") == F.col(f"k.{PIECE}")]), "left")
    rows = met.select("n.*", F.coalesce("k.__open", F.lit(hard + 1)).alias("__open"), F.coalesce("k.__before", F.lit(0)).alias("__before"))
    return rows.groupBy(*keys, PIECE).applyInPandas(number, numbered)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
