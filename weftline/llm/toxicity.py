"""Toxicity by nearest labelled examples.

Texts become TF-IDF vectors over all of their words and word beginnings; the
vectors of labelled texts form an inverted index. Every example takes part,
clean or toxic, and no term is left out: a term's inverse document frequency
is multiplied by how far the odds of a toxic label with it are from the
overall odds (delta TF-IDF), which SHRINK imaginary texts of the overall share
draw to nothing where a term is in few texts only. A text's score comes from
its K nearest examples by exact cosine: the votes of their labels, weighted by
similarity, mapped to a rate by an isotonic fit of leave-one-out votes. The
neighbours are the evidence.

Search is exact. Postings of terms in less than 1 / FREQUENT of the examples
are added up. Frequent terms are kept in blocks of BLOCK examples with the
greatest weight of each term in each block; what was added up and these block
maxima bound a block's similarities, and only blocks whose bound reaches the
K-th similarity found are scored. Ties go to the earlier example of the index.

The index holds at most FIT_ROWS different labelled texts, those of least
keyed hash, and at most FIT_POSTINGS terms of them (both bound what goes through
the driver). A text that was copied is one example, toxic if any label of a copy says
so. Labels of rows with crc32(doc_id as text) mod 5 = 0 are never read. Every row of
the table is scored on its whole text.

A text that shares no term with any example (a null or empty one too) has no
neighbours and gets the overall rate of toxic labels. Where nothing is
labelled the score is 0; where all labels agree it is theirs. Null doc_ids
are not held out. Repeated rows score alike. Very long texts are read whole.
An empty table gives an empty result. Columns other than the id and the text
are not read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, stored, table

FIT_ROWS, FIT_POSTINGS = 3_000, 6_000_000
SHRINK = 50.0
BEGINNINGS = (4, 6)
K, BLOCK, EVIDENCE = 15, 64, 5
FREQUENT = 8
#: Texts searched at once, and words whose terms a worker remembers.
QUERIES, CACHE_WORDS = 64, 100_000
_WORDS = re.compile(r"\w+")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def words(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def beginnings(word: str) -> list[str]:
    """A word's beginnings, marked by a hyphen; they are terms too."""
    return [word[:size] + "-" for size in BEGINNINGS if len(word) >= size]


def hashed(found: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in found], dtype=np.uint64)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of a text's terms."""
    own = words(text)
    per = [[w, *beginnings(w)] for w in own]
    at = hashed([t for x in per for t in x])
    n = np.repeat(np.fromiter(own.values(), np.int64, len(own)), [len(x) for x in per]) if per else np.zeros(0, np.int64)
    found, place = np.unique(at, return_inverse=True)
    return found, np.bincount(place, n, minlength=len(found)).astype(np.int64)


class Vocabulary:
    """The terms of the examples, their weights, and the vectors of texts over them."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        self.hashes, self.weights = hashes, weights
        self.numbers: dict[str, int] = {}
        self.cache: dict[str, list[int]] = {}

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and weights of the terms in each text; the weights have length 1."""
        counted = [words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.numbers.clear()
        new = list({w: None for c in counted for w in c if w not in self.cache})
        begun = list({b: None for w in new for b in beginnings(w) if b not in self.numbers})
        self.numbers.update(zip(begun, self._number(begun), strict=True))
        for w, n in zip(new, self._number(new), strict=True):
            own = [n] if n >= 0 else []
            self.cache[w] = own + [n for b in beginnings(w) if (n := self.numbers[b]) >= 0]
        flat: list[int] = []
        sizes: list[int] = []
        for c in counted:
            for w in c:
                own = self.cache[w]
                flat += own
                sizes.append(len(own))
        # One sort for all texts: key is (text, term).
        width = max(len(self.hashes), 1)
        text = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
        key, place = np.unique(np.repeat(text, sizes) * width + np.array(flat, dtype=np.int64), return_inverse=True)
        times = np.fromiter((n for c in counted for n in c.values()), np.float64, len(sizes))
        counts = np.bincount(place, np.repeat(times, sizes), minlength=len(key))
        ends = np.searchsorted(key, np.arange(len(counted) + 1) * width)
        return [weighed(key[a:b] - i * width, counts[a:b], self.weights) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]

    def _number(self, found: list[str]) -> list[int]:
        """Numbers of terms, -1 where no example has it."""
        if not len(self.hashes):
            return [-1] * len(found)
        own = hashed(found)
        place = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[place] == own, place, -1).tolist()


def weighed(at: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(counts)) * weights[at]
    length = np.linalg.norm(w)
    return (at, w / length) if length > 0 else (at[:0], w[:0])


def term_weights(texts: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Inverse document frequency times the distance of a term's log-odds of a toxic label from the overall ones."""
    idf = np.log((1 + n) / (1 + texts)) + 1
    if not 0 < n_toxic < n:
        return idf
    share = n_toxic / n
    own = (toxic + SHRINK * share) / (texts + SHRINK)
    return idf * np.abs(np.log(own / (1 - own)) - np.log(share / (1 - share)))


class BlockMaxIndex:
    """Postings by term; those of frequent terms in blocks of examples, each with its greatest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(v[0]) for v in vectors])
        cols = np.concatenate([v[0] for v in vectors]) if rows.size else np.zeros(0, np.int64)
        weights = np.concatenate([v[1] for v in vectors]) if rows.size else np.zeros(0)
        texts = np.bincount(cols, minlength=n_terms)
        often = np.flatnonzero(texts * FREQUENT >= max(self.n, 1))
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        order = np.argsort(cols, kind="stable")
        rows, cols, weights = rows[order], cols[order], weights[order]
        dense = self.column[cols] >= 0
        self.often = (rows[dense], self.column[cols[dense]], weights[dense])
        self.rows, self.weights = rows[~dense], weights[~dense]
        self.start = np.searchsorted(cols[~dense], np.arange(n_terms + 1))
        self.held: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None}

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of frequent terms (blocks x BLOCK x terms) and their block maxima; laid out where they are used."""
        if self.held is None:
            width = int(self.column.max(initial=-1)) + 1
            laid = np.zeros((self.blocks * BLOCK, width))
            laid[self.often[0], self.often[1]] = self.often[2]
            laid = laid.reshape(self.blocks, BLOCK, width)
            self.held = laid, laid.max(axis=1) if self.blocks else laid[:, 0]
        return self.held

    def search(self, at: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        return self.search_many([(at, w)], k, [without])[0]

    def search_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """Per query the k nearest (cosine, example), most similar first, ties to the earlier; all have a term in common."""
        if not self.n or not queries:
            return [[] for _ in queries]
        laid, greatest = self._frequent()
        size = len(queries)
        score = np.zeros((size, self.blocks * BLOCK))
        asked = np.zeros((size, laid.shape[2]))
        for i, (at, w) in enumerate(queries):
            column = self.column[at]
            asked[i, column[column >= 0]] = w[column >= 0]
            rare, x = at[column < 0], w[column < 0]
            a = self.start[rare]
            n = self.start[rare + 1] - a
            place = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else a
            score[i] = np.bincount(self.rows[place], np.repeat(x, n) * self.weights[place], minlength=score.shape[1])
        excluded = np.zeros(score.shape, bool)
        excluded[:, self.n :] = True
        for i, r in enumerate(without or []):
            if r >= 0:
                excluded[i, r] = True
        by_block = score.reshape(size, self.blocks, BLOCK)
        bound = by_block.max(axis=2) + asked @ greatest.T
        seen = np.zeros((size, self.blocks), bool)
        first = min(self.blocks, 1 + -(-k // BLOCK))
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        least = np.full(size, -np.inf)
        for i in range(size):
            by_block[i, best[i]] += laid[best[i]] @ asked[i]
            seen[i, best[i]] = True
            own = by_block[i, best[i]][~excluded[i].reshape(self.blocks, BLOCK)[best[i]]]
            if len(own) >= k:
                least[i] = np.partition(own, len(own) - k)[len(own) - k]
        for b in range(self.blocks):
            more = np.flatnonzero(~seen[:, b] & (bound[:, b] >= least - 1e-9))
            if len(more):
                by_block[more, b] += asked[more] @ laid[b].T
                seen[more, b] = True
        score[excluded | ~np.repeat(seen, BLOCK, axis=1)] = 0.0
        score = np.round(score, 12)
        out = []
        for own in score:
            edge = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else 0.0
            chosen = np.flatnonzero((own >= edge) & (own > 0))
            out.append([(float(own[r]), int(r)) for r in chosen[np.argsort(-own[chosen], kind="stable")][:k]])
        return out


def vote(found: list[tuple[float, int]], toxic: np.ndarray) -> float:
    """The share of toxic labels among the neighbours, weighted by similarity."""
    total = sum(s for s, _ in found)
    return sum(s * toxic[r] for s, r in found) / total if total > 0 else 0.0


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y by x, each level drawn a little to the overall mean."""
    merged: list[list[float]] = []
    for a in np.unique(x):
        own = y[x == a]
        merged.append([float(a), float(a), float(own.sum()), float(len(own))])
        while len(merged) > 1 and merged[-2][2] / merged[-2][3] >= merged[-1][2] / merged[-1][3]:
            last = merged.pop()
            merged[-1] = [merged[-1][0], last[1], merged[-1][2] + last[2], merged[-1][3] + last[3]]
    mean = float(y.mean()) if len(y) else 0.0
    level = [(s + mean) / (n + 1) for _, _, s, n in merged]
    return np.array([v for a, b, _, _ in merged for v in (a, b)]), np.array([v for p in level for v in (p, p)])


class Model:
    """Vocabulary, index, labels and calibration; bounded by FIT_ROWS and FIT_POSTINGS."""

    def __init__(self, examples: list[tuple[int | None, int, np.ndarray, np.ndarray]]):
        """examples: doc_id, label, hashes and counts of the terms."""
        n, toxic = len(examples), np.array([x[1] for x in examples], dtype=np.int64)
        every = np.concatenate([x[2] for x in examples]) if n else np.zeros(0, np.uint64)
        hashes, number, texts = np.unique(every, return_inverse=True, return_counts=True)
        with_toxic = np.bincount(number, np.repeat(toxic, [len(x[2]) for x in examples]), minlength=len(hashes)) if n else np.zeros(0)
        self.vocabulary = Vocabulary(hashes, term_weights(texts, with_toxic, n, int(toxic.sum())))
        ends = np.cumsum([0, *[len(x[2]) for x in examples]])
        vectors = [weighed(number[a:b], x[3].astype(np.float64), self.vocabulary.weights) for x, a, b in zip(examples, ends, ends[1:], strict=False)]
        # Examples with the same heaviest term are neighbours, which makes blocks alike and their maxima tight.
        heaviest = [int(at[np.argmax(w)]) if len(at) else -1 for at, w in vectors]
        order = sorted(range(n), key=lambda i: (heaviest[i], i))
        vectors = [vectors[i] for i in order]
        self.ids, self.toxic = [examples[i][0] for i in order], toxic[order]
        self.share = float(toxic.mean()) if n else 0.0
        self.index = BlockMaxIndex(vectors, len(hashes))
        loo = [vote(f, self.toxic) for i in range(0, n, QUERIES) for f in self.index.search_many(vectors[i : i + QUERIES], K, list(range(i, min(i + QUERIES, n))))]
        self.knots = isotonic(np.array(loo), self.toxic)

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Score and neighbours of each text."""
        out = []
        for i in range(0, len(texts), QUERIES):
            for found in self.index.search_many(self.vocabulary.vectors(texts[i : i + QUERIES]), K):
                out.append((float(np.interp(vote(found, self.toxic), *self.knots)) if found else self.share, found))
        return out


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """doc_id, label, terms and counts (packed) of at most fit_rows different labelled texts."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(~held_out())
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("same", F.md5(F.coalesce("text", F.lit(""))))
    # Repeated ids have texts of their own: a bound on ids alone would not bound the texts.
    named = rows.select("doc_id", "same").join(F.broadcast(own), "doc_id").groupBy("same").agg(F.max(F.when(F.col("label") > 0, 1).otherwise(0)).alias("label"), F.min("doc_id").alias("doc_id"))
    named = stored(named.orderBy(F.xxhash64(F.lit(31), "doc_id", "same"), "doc_id", "same").limit(fit_rows), "toxicity-named")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [terms(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "same": batch["same"], "label": batch["label"], "n": [len(a) for a, _ in both], "terms": [a.tobytes() for a, _ in both], "counts": [b.astype(np.int32).tobytes() for _, b in both]})

    texts = rows.join(F.broadcast(named), ["doc_id", "same"]).dropDuplicates(["doc_id", "same"])  # fit_rows rows at most
    return stored(texts.mapInPandas(run, "doc_id long, same string, label int, n long, terms binary, counts binary"), "toxicity-examples")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    small_batches(docs.sparkSession)
    held = examples(docs, labels, id_col, text_col, label_col, fit_rows)
    sizes = held.select("doc_id", "same", "n").orderBy(F.xxhash64(F.lit(31), "doc_id", "same"), "doc_id", "same").collect()
    upto = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), FIT_POSTINGS, side="right"))
    few = {(r["doc_id"], r["same"]) for r in sizes[:upto]}
    if upto < len(sizes):
        held = held.join(F.broadcast(held.sparkSession.createDataFrame(sorted(few), "doc_id long, same string")), ["doc_id", "same"], "left_semi") if few else held.limit(0)
    rows = held.orderBy("doc_id", "same").select("doc_id", "label", "terms", "counts").collect()
    return Model([(r["doc_id"], r["label"], np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int32)) for r in rows])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, similarity: double, toxic: int>>"


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the nearest examples of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for batch in batches:
            found = own.score(batch["text"].tolist())
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "held_out": batch["held_out"],
                    "score": [s for s, _ in found],
                    "predicted": [int(s >= 0.5) for s, _ in found],
                    "evidence": [[{"doc_id": own.ids[r], "similarity": s, "toxic": int(own.toxic[r])} for s, r in near[:EVIDENCE]] for _, near in found],
                }
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out())
    return rows.mapInPandas(run, SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score as toxic."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([s < 0.5 for s, _ in shipped.value.score(texts.tolist())], dtype=bool)

    return docs.filter(clean(F.col(text_col)))


def op6_nearest_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
