"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of M full-dimensional
codebooks. The codebooks start as residual k-means and are refitted by least
squares; a vector's codes come from a beam search over the codebooks, so a
later codeword can make up for an earlier one. The index stores the codes
and the norms of vector and reconstruction. A query is scored against all
codes by lookup tables of its inner products with the codewords; per block of
the index the RERANK best of its different vectors are scored again on the
original vectors in double precision, with all copies of each, and the best K
of all blocks are the result. So copies take no places from other vectors. For cosine and
distance the stored norms turn the table sums into those measures.

The codebooks are fitted on at most FIT_ROWS vectors, those of least keyed
hash; every vector is indexed. Queries and index meet in blocks (QUERY_BLOCK
x INDEX_BLOCK), each a task of its own, so no side is broadcast and none has
to fit one task.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do those of another dimension than most. Equal scores go to the
smaller vec_id. A vec_id that repeats is one query (its least vector); rows
that share the query's vec_id are its own and no candidates. Fewer candidates
than K give fewer rows, an empty table none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import stored, table

BOOKS, WORDS, BEAM, REFITS = 16, 128, 4, 1
FIT_ROWS, K, RERANK = 4_096, 20, 400
INDEX_BLOCK, QUERY_BLOCK = 16_384, 2_048


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]]
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]))])
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        counts = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        held = np.flatnonzero(counts)
        sums = np.zeros_like(centres)
        sums[held] = np.add.reduceat(x[order], np.r_[0, np.cumsum(counts)[:-1]][held], axis=0)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class AdditiveQuantiser:
    def __init__(self, books: np.ndarray):
        if books.shape[1] > 256:
            raise ValueError("a code is one byte: at most 256 codewords a book")
        self.books = books  # M x K x D
        flat = books.reshape(-1, books.shape[2])
        self.products = flat @ flat.T

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n x M): the least squared error among beam sequences, book after book."""
        m, k, _ = self.books.shape
        n = len(x)
        inner = x @ self.books.reshape(m * k, -1).T
        norms = np.diag(self.products)
        codes, error = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1))
        for book in range(m):
            at = slice(book * k, (book + 1) * k)
            step = norms[at] - 2 * inner[:, at]  # n x k
            cross = np.zeros((n, codes.shape[1], k))
            for before in range(book):
                cross += self.products[codes[:, :, before] + before * k, at]
            total = error[:, :, None] + step[:, None, :] + 2 * cross
            flat = total.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None]], axis=2)
            error = flat[rows, best]
        return codes[np.arange(n), np.argmin(error, axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[i][codes[:, i]] for i in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with each codeword (n x M x K)."""
        return np.einsum("qd,mkd->qmk", queries, self.books)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, refits: int = REFITS, seed: int = 3) -> AdditiveQuantiser:
    rng, rest, found = np.random.default_rng(seed), x.copy(), []
    for _ in range(books):
        found.append(_kmeans(rest, words, rng))
        own = np.argmin((found[-1] ** 2).sum(1) - 2 * rest @ found[-1].T, axis=1)
        rest -= found[-1][own]
    model = AdditiveQuantiser(np.stack(found))
    for _ in range(refits if len(x) > words else 0):
        codes = np.concatenate([model.encode(x[i : i + 512]) for i in range(0, len(x), 512)])
        one_hot = np.zeros((books * words, books * words))
        target = np.zeros((books * words, x.shape[1]))
        places = codes + np.arange(books) * words
        rows = np.zeros((len(x), books * words), np.float32)
        rows[np.arange(len(x))[:, None], places] = 1
        one_hot += rows.T @ rows
        target += rows.T @ x
        solved = np.linalg.solve(one_hot + 0.1 * np.eye(books * words), target + 0.1 * model.books.reshape(books * words, -1))
        model = AdditiveQuantiser(solved.reshape(books, words, -1))
    return model


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (double) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.filter("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)")
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vector") == (most["d"] if most else 0))


def codebooks(rows: DataFrame, fit_rows: int = FIT_ROWS) -> AdditiveQuantiser | None:
    sample = rows.select("vec_id", "vector").orderBy(F.xxhash64(F.lit(17), "vec_id"), "vec_id", "vector").limit(fit_rows).collect()
    return fit(np.array([r["vector"] for r in sample])) if sample else None


def index(rows: DataFrame, model: AdditiveQuantiser) -> DataFrame:
    """vec_id, vector, codes, norm and coded_norm of every row."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # codebooks and their products: M*K*(D + M*K) doubles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                x = np.stack(part["vector"])
                codes = own.encode(x)
                yield pd.DataFrame({"vec_id": part["vec_id"], "vector": part["vector"], "codes": [c.astype(np.uint8).tobytes() for c in codes], "norm": np.linalg.norm(x, axis=1), "coded_norm": np.linalg.norm(own.decode(codes), axis=1)})

    return rows.mapInPandas(run, "vec_id long, vector array<double>, codes binary, norm double, coded_norm double")


def measures(products: np.ndarray, query_norms: np.ndarray, norms: np.ndarray, kind: str) -> np.ndarray:
    """Inner products (queries x rows) as the measure of the given kind; larger is nearer."""
    if kind == "cosine":
        return products / (query_norms[:, None] * norms[None, :])
    if kind == "distance":
        return -(query_norms[:, None] ** 2 + norms[None, :] ** 2 - 2 * products)
    return products


def search(rows: DataFrame, queries: DataFrame, k: int = K, rerank: int = RERANK, kind: str = "product", fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query; rows and queries as of usable()."""
    schema = "query_id long, vec_id long, score double"
    model = codebooks(rows, fit_rows)
    if model is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coded = stored(index(rows, model), "vector-index")
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks, groups = (max(1, -(-n // size)) for n, size in ((coded.count(), INDEX_BLOCK), (asked.count(), QUERY_BLOCK)))
    place = lambda n: F.pmod(F.xxhash64(F.lit(23), "vec_id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.withColumn("block", place(blocks)).withColumn("part", every(groups))
    right = asked.withColumn("part", place(groups)).withColumn("block", every(blocks))
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def near(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        quantiser = shipped.value
        own = own.sort_values("vec_id", kind="stable")
        ids, x = own["vec_id"].to_numpy(), np.stack(own["vector"])
        codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), -1)
        norms, coded_norms = own["norm"].to_numpy(), own["coded_norm"].to_numpy()
        q_ids, q = ask["vec_id"].to_numpy(), np.stack(ask["vector"])
        # Equal vectors are scored once.
        plain = np.ascontiguousarray(x + 0.0)  # no negative zeros
        _, first, same = np.unique(plain.view(np.dtype((np.void, plain.itemsize * plain.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by_vector = np.argsort(same, kind="stable")
        ends = np.searchsorted(same[by_vector], np.arange(len(first) + 1))
        out = []
        for i in range(0, len(q), 16):
            part, part_ids = q[i : i + 16], q_ids[i : i + 16]
            lookup = quantiser.tables(part).astype(np.float32)
            rough = np.zeros((len(part), len(first)), np.float32)
            for m in range(codes.shape[1]):
                rough += lookup[:, m, :][:, codes[first, m]]
            lengths = np.linalg.norm(part, axis=1)
            rough = measures(rough, lengths, coded_norms[first], kind)
            for j, query_id in enumerate(part_ids):
                near = np.sort(np.argpartition(-rough[j], rerank - 1)[:rerank]) if len(first) > rerank else np.arange(len(first))
                exact = measures((x[first[near]] * part[j]).sum(axis=1)[None, :], lengths[j : j + 1], norms[first[near]], kind)[0]
                sizes = ends[near + 1] - ends[near]
                rows = np.concatenate([by_vector[a:b] for a, b in zip(ends[near], ends[near + 1], strict=True)])
                score = np.repeat(exact, sizes)
                score, rows = score[ids[rows] != query_id], rows[ids[rows] != query_id]
                best = np.lexsort((ids[rows], -score))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows][best], "score": score[best]}))
        return pd.concat(out)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(near, schema)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)  # blocks x k entries a query
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.filter("vec_id % 20 = 0"))
