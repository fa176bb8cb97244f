"""Quality scores from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on a
text. Expectation-maximisation over the counts of all vote patterns estimates
the share of good texts and, per labeller, how often it casts each vote on
good and on bad texts; from these a text's posterior follows. The posteriors
of a bounded sample train a logistic scorer over hashed features (words,
word shapes, and bands of the labellers' figures), and the scorer rates
every text: it also tells texts apart on which no labeller votes.

Counts cover all rows: patterns are summed before they are shuffled, and
there are at most 3 to the number of labellers. At most FIT_ROWS different
texts, those of least keyed hash, train the scorer, whatever their ids; the
driver gets their hashed features. Ground-truth labels are never read.

A null or empty text has no words; the labeller of short texts votes on it
as on any other. Whole texts are read. Repeated rows score alike; an empty
table gives an empty result. Columns other than the id and the text are not
read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, stored, table
from weftline.llm.quality_rules import Text, measure

FIT_ROWS, DIMENSIONS, EPOCHS, RATE, DECAY = 6_000, 1 << 16, 6, 0.5, 1e-5
#: Words in a worker's table of hashes before it starts anew.
TABLE_WORDS = 200_000


ODD = "\"#$%&'()*+-/0123456789:;<=>@[\\]^_`{|}~!"


def figures(x: Text) -> dict[str, float]:
    n = max(x.n_words, 1)
    return {
        "symbols": x.n_symbols / n,
        "odd": sum(map(x.text.count, ODD)) / max(x.word_chars, 1),
        "marks": x.text.count("!") / n,
        "capitals": sum(map(x.text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / max(x.word_chars, 1) if x.n_words >= 5 else 0.0,
        "different": (int(x.ids.max()) + 1) / n if x.n_words else 0.0,
        "frequent": float(np.bincount(x.ids.astype(np.int64)).max()) / n if x.n_words else 0.0,
        "stutter": int(np.count_nonzero(x.ids[1:] == x.ids[:-1])) / n if x.n_words else 0.0,
        "repeated": x.n_repeat_words / n,
        "stops": sum(map(x.text.count, ".?")) / n,
    }


#: Name, vote and test of each labeller; a labeller that does not vote says 0.
LABELLERS = {
    "symbols": (-1, lambda x, f: f["symbols"] > 0.1),
    "odd": (-1, lambda x, f: f["odd"] > 0.15),
    "marks": (-1, lambda x, f: f["marks"] > 0.1),
    "capitals": (-1, lambda x, f: f["capitals"] > 0.3),
    "different": (-1, lambda x, f: x.n_words >= 20 and f["different"] < 0.35),
    "frequent": (-1, lambda x, f: x.n_words >= 20 and f["frequent"] > 0.2),
    "stutter": (-1, lambda x, f: f["stutter"] > 0.15),
    "repeated": (-1, lambda x, f: f["repeated"] > 0.5),
    "unstopped": (-1, lambda x, f: x.n_words >= 30 and f["stops"] == 0),
    "empty": (-1, lambda x, f: x.n_words == 0),
    "prose": (1, lambda x, f: x.n_words > 0 and f["symbols"] < 0.03 and f["odd"] < 0.08 and f["marks"] < 0.03 and f["capitals"] < 0.2),
    "varied": (1, lambda x, f: x.n_words > 0 and (x.n_words < 20 or f["different"] > 0.4) and f["stutter"] < 0.05 and f["repeated"] < 0.3),
    "sentences": (1, lambda x, f: 0.01 < f["stops"] and f["capitals"] < 0.2 and f["odd"] < 0.15),
}


def votes(x: Text) -> tuple[tuple[int, ...], dict[str, float]]:
    f = figures(x)
    return tuple(vote if test(x, f) else 0 for vote, test in LABELLERS.values()), f


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good, P[labeller, class, vote]) with class 0 bad, 1 good and votes -1, 0, 1.
    Starts with texts as bad if any labeller says so; a labeller's two rows keep one pseudo-count a vote."""
    good = np.where((patterns < 0).any(1), 0.1, 0.9)
    share, rates = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                rates[j, :, v + 1] = weight[:, patterns[:, j] == v].sum(1) + 1
        rates /= rates.sum(2, keepdims=True)
        share = float(np.clip(weight[1].sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3))
        new = posterior(patterns, share, rates)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return share, rates


def posterior(patterns: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    logs = np.log(rates)
    bad, good = (np.full(len(patterns), np.log(p)) + sum(logs[j, c, patterns[:, j] + 1] for j in range(patterns.shape[1])) for c, p in ((0, 1 - share), (1, share)))
    return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


#: Bytes by class: small letters and bytes beyond ASCII, capitals, digits; others stand for themselves.
_CLASSES = bytes(ord("a") if chr(i).islower() or i > 127 else ord("A") if chr(i).isupper() else ord("9") if chr(i).isdigit() else i for i in range(256))
WORD_HASHES: dict[bytes, tuple[int, int]] = {}


def _hashed(word: bytes) -> tuple[int, int]:
    """Places of a word and of its shape: the classes of its first and last three bytes."""
    shape = word.translate(_CLASSES)
    return zlib.crc32(word.lower()) % DIMENSIONS, zlib.crc32(b"\0" + shape[:1] + shape[-3:]) % DIMENSIONS


def features(x: Text, f: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and weights: words, then shapes, each of length 1 as a whole; bands of figures weigh 1 each."""
    if len(WORD_HASHES) > TABLE_WORDS:
        WORD_HASHES.clear()
    words, shapes = [], {}
    for w in set(x.words):
        if (h := WORD_HASHES.get(w)) is None:
            h = WORD_HASHES[w] = _hashed(w)
        words.append(h[0])
        shapes[h[1]] = shapes.get(h[1], 0) + 1
    bands = [zlib.crc32(f"{name}:{int(np.log2(value + 2 ** -8) * 2)}".encode()) % DIMENSIONS for name, value in f.items()]
    s = np.array(list(shapes.values()), float)
    return (
        np.array(words + list(shapes) + bands, dtype=np.int64),
        np.concatenate([np.full(len(words), 1 / np.sqrt(max(len(words), 1))), s / max(np.linalg.norm(s), 1), np.ones(len(bands))]),
    )


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Logistic weights (the last one is the intercept) by AdaGrad over soft targets, in a fixed order."""
    w, g = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, v = np.append(rows[i][0], DIMENSIONS), np.append(rows[i][1], 1.0)
            step = (1 / (1 + np.exp(-np.clip(w[at] @ v, -30, 30))) - target[i]) * v + DECAY * w[at]
            np.add.at(g, at, step**2)
            np.add.at(w, at, -RATE * step / np.sqrt(g[at]))
    return w


SCHEMA = "doc_id long, posterior double, score double, kept boolean"


class Model:
    """Shared by all workers: half a MB of weights and the labellers' rates."""

    def __init__(self, share: float, rates: np.ndarray, weights: np.ndarray):
        self.share, self.rates, self.weights = share, rates, weights
        self.posteriors: dict[tuple[int, ...], float] = {}  # by vote pattern

    def score(self, text: str | None) -> tuple[float, float]:
        """(posterior of the votes, score of the scorer); both are high for good texts."""
        x = measure(text)
        v, f = votes(x)
        at, weight = features(x, f)
        z = float(self.weights[at] @ weight + self.weights[-1])
        if v not in self.posteriors:
            self.posteriors[v] = float(posterior(np.array([v]), self.share, self.rates)[0])
        return self.posteriors[v], 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, ...], int] = {}
        for batch in batches:
            for text in batch["text"]:
                v, _ = votes(measure(text))
                seen[v] = seen.get(v, 0) + 1
        yield pd.DataFrame([(list(v), n) for v, n in seen.items()], columns=["votes", "n"])

    found = rows.select("text").mapInPandas(count, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in found], dtype=np.int64).reshape(-1, len(LABELLERS))
    share, rates = expectation_maximisation(patterns, np.array([r["n"] for r in found], dtype=float))
    # Different texts, whatever their ids: null and repeated ids neither lose nor multiply them.
    named = rows.select("text", F.md5(F.coalesce("text", F.lit(""))).alias("same"))
    least = stored(named.select("same").distinct().orderBy(F.xxhash64(F.lit(41), "same"), "same").limit(fit_rows), "quality-sample")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for same, text in zip(batch["same"], batch["text"], strict=True):
                x = measure(text)
                v, f = votes(x)
                at, weight = features(x, f)
                out.append((same, list(v), at.astype(np.int32).tobytes(), weight.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["same", "votes", "at", "weight"])

    sample = named.join(F.broadcast(least), "same").dropDuplicates(["same"])  # fit_rows rows at most
    own, target = [], []
    for r in sample.mapInPandas(describe, "same string, votes array<int>, at binary, weight binary").orderBy("same").toLocalIterator():
        own.append((np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["weight"], np.float32).astype(float)))
        target.append(float(posterior(np.array([r["votes"]]), share, rates)[0]))
    return Model(share, rates, train(own, np.array(target)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, posterior, score, kept (score of 0.5 or more) of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for batch in batches:
            both = [own.score(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "posterior": [a for a, _ in both], "score": [b for _, b in both], "kept": [b >= 0.5 for _, b in both]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, SCHEMA)


def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs))
