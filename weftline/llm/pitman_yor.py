"""Hierarchical Pitman-Yor language model of word pairs, sampled on Spark.

Every word is a context with a restaurant of its own. Its customers are the
tokens that followed it in training, and the tables of all contexts are the
customers of one parent restaurant, whose base spreads evenly over the V
training words and one unknown word. With c customers at t tables a
restaurant gives a dish the probability

    (c_w - d t_w + (strength + d t) parent(w)) / (strength + c).

Seatings are sampled by Gibbs, a sweep being one pass over the contexts and one
over the parent. A restaurant first draws x from the gamma distribution of shape
strength / d + its tables. Given x its dishes do not depend on one another: the
number of a dish's tables is drawn from

    p(t) ~ Stirling(c, t) (d x parent)^t,

in which generalised Stirling numbers count the seatings of c customers. One rule
holds for dishes and contexts of any size. Only where the Stirling numbers come
from differs: up to TABLED customers from a table, beyond from an integral, which
agree, so that TABLED is no switch of results. Probabilities are averaged over
SAMPLES sweeps after BURN_IN.

Scale: texts become blocks of some BLOCK_TOKENS tokens, cut at documents. All
that moves are messages, packed arrays addressed to a block or a bucket:

    blocks -> word buckets -> blocks    counts and numbers of the block's words
    blocks -> context buckets           the block's different pairs with counts
    context buckets <-> word buckets    a sweep: tables up, parent's counts down
    both -> blocks                      counts and tables of the block's own pairs

Pairs are counted in their block before they travel, so a word or context that
holds a third of all tokens sends a row a block. Contexts of more than SPLIT
customers are divided by their next words over several buckets, which share
their number of tables through the word buckets, and so draw the same x. Random
numbers are hashes of context, word and sweep, so that it makes no difference
where a dish is drawn: results depend neither on SPLIT nor on the number of context
buckets. The number of buckets grows with the tokens; the driver holds sums
alone. The parent is held during the pass over the contexts.

Words are compared by 64-bit hashes. A null text is an empty one, with the end
as its only token. Equal rows score alike; a null id trains the model, as crc32
of no text is not 2 modulo 7. Whole texts are read; a long one is a block of its
own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import discard, discard_parts, quoted, small_batches, stored, table

#: Discount and strength of the contexts and of the parent.
DISCOUNT, STRENGTH = 0.75, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.5, 10.0
BURN_IN, SAMPLES = 2, 3
#: Customers of the largest dish whose Stirling numbers are tabled; points of the integral for larger ones, and of an interpolation.
TABLED, POINTS = 1024, 24
BLOCK_TOKENS, BUCKET_TOKENS, BUCKET_WORDS, SPLIT = 1 << 20, 1 << 20, 1 << 19, 1 << 20
UNKNOWN, START, FIRST_WORD = 0, 1, 2  # numbers of words
END_HASH = 1
FOLDS, HELD_OUT = 7, 2

MESSAGE = "to long, kind int, source long, parts array<binary>"
BLOCK, WORDS, ASKED, FIXED, LAID, SEATED, UP, TOTALS, ROOT, DOWN, SHARED, CUSTOMERS, TABLES = range(13)
Message = tuple[int, int, int, list[bytes]]


def pack(values: np.ndarray) -> bytes:
    """Integers from 0: their number, and by planes the low byte of each, the next byte of each, ..., as many as the largest needs, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.decompress(data[9:], n * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view(kind).reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x2545F4914F6CDD1D
_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    """base to the 0th and further powers, modulo 2 to the 64th."""
    if len(_powers.get(base, ())) < size:
        steps = np.full(max(size, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:size]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens in order, each text's words and then the end; and the number of each text's tokens.

    A word's hash is its own part of a running polynomial over the joined texts, divided by the power at its begin.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.empty(0, np.uint8)
    word = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word]).view(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    running = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * _power(_BASE, len(data)), dtype=np.uint64)])
    found = _mixed((running[ends] - running[begins]) * _power(pow(_BASE, -1, 1 << 64), len(data))[begins])
    found[found <= END_HASH] += np.uint64(2)
    of = np.searchsorted(np.cumsum(sizes + 1), begins, "right")
    per_text = np.bincount(of, minlength=len(texts))
    out = np.full(len(found) + len(texts), END_HASH, np.uint64)
    out[np.arange(len(found)) + of] = found
    return out, per_text + 1


BLOCKS = "block long, ids binary, held binary, sizes binary, words binary, places binary, counts binary, tokens binary, n_tokens long, n_words long, n_training long"


def tokenised(docs: DataFrame, id_col: str, text_col: str, held: object, block_tokens: int) -> DataFrame:
    """Blocks of documents. words: sorted hashes of its different tokens, counts: how often in training; tokens: each token's
    rank among the words by falling frequency in the block, places: the place in words of each rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        apart: list[bool] = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            tokens, lengths = np.concatenate(hashes), np.concatenate(sizes)
            words, at = np.unique(tokens, return_inverse=True)
            training = np.repeat(~np.array(apart), lengths)
            counts = np.bincount(at[training], minlength=len(words))
            places = np.argsort(-np.bincount(at), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[places] = np.arange(len(words))
            row = {"block": number, "ids": np.array([x or 0 for x in ids], np.int64).tobytes() + bytes(x is None for x in ids), "held": bytes(apart), "sizes": pack(lengths)}
            row |= {"words": pack(words), "places": pack(places), "counts": pack(counts), "tokens": pack(rank[at]), "n_tokens": len(tokens), "n_words": len(words), "n_training": apart.count(False)}
            for x in (ids, apart, hashes, sizes):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("ids", "held", "sizes", "words", "places", "counts", "tokens")), *((n, pa.int64()) for n in ("n_tokens", "n_words", "n_training"))])
        held_tokens = 0
        for whole in batches:
            for begin in range(0, len(whole), 64):
                batch = whole.slice(begin, 64)
                found, lengths = hashed_words([(x or b"").translate(LOWER) for x in batch.column("data").to_pylist()])
                ids += batch.column("doc_id").to_pylist()
                apart += batch.column("held_out").to_pylist()
                hashes.append(found)
                sizes.append(lengths)
                held_tokens += len(found)
                if held_tokens >= block_tokens:
                    held_tokens = 0
                    yield block()
        if ids:
            yield block()

    small_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").cast("binary").alias("data"), held.alias("held_out"))
    return rows.mapInArrow(run, BLOCKS)


class Block:
    """A block's tokens as places in its words, and the words' numbers and training counts once word buckets have answered."""

    def __init__(self, ids: bytes, held: bytes, sizes: bytes, words: bytes, places: bytes, tokens: bytes) -> None:
        k = len(ids) // 9
        self.ids = [None if null else x for x, null in zip(np.frombuffer(ids, np.int64, k).tolist(), ids[8 * k :], strict=True)]
        self.held, self.sizes, self.hashes = np.frombuffer(held, bool), unpack(sizes), unpack(words, np.uint64)
        self.tokens, n = unpack(places)[unpack(tokens)], len(self.hashes)
        self.numbers, self.known = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def name(self, answers: list[tuple[int, list[bytes]]], buckets: int) -> None:
        edges = word_edges(self.hashes, buckets)
        for bucket, parts in answers:
            own = slice(edges[bucket], edges[bucket + 1])
            self.numbers[own], self.known[own] = unpack(parts[0]), unpack(parts[1])

    def pairs(self, starts: int, buckets: int, split: int) -> dict:
        """Different pairs of known words in order of (bucket, context, word), and each token's place among them, -1 for the others."""
        first = np.zeros(len(self.tokens), bool)
        first[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])] = True
        before = np.concatenate([[0], self.tokens[:-1]])
        numbers, known = np.append(self.numbers, START), np.append(self.known, starts)
        before[first] = len(self.numbers)
        has = (numbers[before] != UNKNOWN) & (numbers[self.tokens] != UNKNOWN)
        key, at = np.unique(before[has] * len(numbers) + self.tokens[has], return_inverse=True)
        training = np.repeat(~self.held, self.sizes)[has]
        counts = np.bincount(at[training], minlength=len(key))
        context, word = key // len(numbers), key % len(numbers)
        u, w = numbers[context], numbers[word]
        bucket = context_bucket(u, w, known[context], buckets, split)
        order = np.lexsort((w, u, bucket))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        place = np.full(len(self.tokens), -1)
        place[has] = back[at]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        return {"u": u[order], "w": w[order], "counts": counts[order], "edges": edges, "place": place, "customers": known[before], "context": numbers[before]}


def word_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Word buckets are ranges of hashes: where each begins in a sorted array."""
    return np.searchsorted(hashes >> np.uint64(32), np.array([-(-(b << 32) // buckets) for b in range(buckets + 1)], np.uint64))


def context_bucket(u: np.ndarray, w: np.ndarray, customers: np.ndarray, buckets: int, split: int) -> np.ndarray:
    """Contexts of more customers than split are divided by the next word."""
    part = np.where(customers > split, (_mixed(w.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % (customers // split + 1), 0)
    return (_mixed((u.astype(np.uint64) << np.uint64(20)) + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def count_words(bucket: int, asked: list[tuple[int, list[bytes]]], buckets: int) -> Iterator[Message]:
    """Numbers of the words seen in training by falling count, and the counts, to each block; the bucket's words and tokens to the driver."""
    hashes = [unpack(parts[0], np.uint64) for _, parts in asked]
    words, at = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(at, np.concatenate([unpack(parts[1]) for _, parts in asked]), len(words)).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    numbers = np.empty(len(words), np.int64)
    numbers[order] = FIRST_WORD + np.arange(len(words)) * buckets + bucket
    numbers[counts == 0] = UNKNOWN
    begin = 0
    for (block, _), own in zip(asked, hashes, strict=True):
        places = at[begin : begin + len(own)]
        begin += len(own)
        yield block, WORDS, bucket, [pack(numbers[places]), pack(counts[places])]
    yield bucket, CUSTOMERS, int(counts.sum()), []
    yield bucket, TABLES, int(np.count_nonzero(counts)), []


def stirling(discount: float, size: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: seatings of c customers at t tables, weighed by the discount."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0
    for c in range(size):
        t = np.arange(1, c + 2)
        stay = np.log(np.maximum(c - discount * t, 1e-300))
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, :-1][: c + 1], np.where(c >= t, stay + out[c, 1 : c + 2], -np.inf))
    return out


_stirling: dict[float, np.ndarray] = {}


def _tabled(discount: float) -> np.ndarray:
    if discount not in _stirling:
        _stirling[discount] = stirling(discount, TABLED)
    return _stirling[discount]


def _place(before: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Where, from -80 up to 0, before ceases to hold, by halving on a scale that is fine near 0."""
    low, high = np.full(size, math.log(80)), np.full(size, -30.0)
    for _ in range(22):
        middle = (low + high) / 2
        left = before(-np.exp(middle))
        low, high = np.where(left, middle, low), np.where(left, high, middle)
    return -np.exp((low + high) / 2)


def log_seatings(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of Stirling(c, t) d^t t! / c! for large c: of the coefficient of u^c in (1 - (1 - u)^d)^t, by Cauchy's integral.

    The contour is a parabola around the cut from 1 on through the saddle, or, up to POINTS customers that share a table, a circle around 0.
    """
    out = np.empty(len(c))
    near = c - t <= POINTS
    C, T = c[near].astype(float), t[near].astype(float)
    # (1 - (1 - u)^d) / u grows as d exp((1 - d) u / 2) near 0.
    r = np.minimum((C - T + 0.5) / np.maximum(T * (1 - discount) / 2, 1), 0.5)
    u = r[:, None] * np.exp(1j * np.pi * (np.arange(2 * POINTS) + 0.5) / (2 * POINTS))
    f = T[:, None] * np.log(-np.expm1(discount * np.log1p(-u)) / u) - (C - T)[:, None] * np.log(u)
    top = f.real.max(axis=1, initial=-np.inf)
    out[near] = top + np.log(np.exp(f - top[:, None]).real.mean(axis=1))

    C, T = c[~near].astype(float), t[~near].astype(float)
    v = np.exp(_place(lambda v: T * discount * np.expm1(v) * np.exp((discount - 1) * v) / np.expm1(discount * v) > C + 1, len(C)))
    v = np.maximum(v, 1 / (C + 2))
    p = 1 - v**discount
    bend = -T * discount * ((discount - 1) * v ** (discount - 2) * p + discount * v ** (2 * discount - 2)) / p**2 + (C + 1) / (1 - v) ** 2
    scale = 1 / np.sqrt(np.maximum(4 * v * v * bend, 2 * C * v * (1 - discount)))
    step = np.arcsinh(np.sqrt(45 / (C * v * (1 - discount))) / scale) / POINTS
    y = (np.arange(POINTS) + 0.5) * step[:, None]
    way = 1 + 1j * scale[:, None] * np.sinh(y)
    at = v[:, None] * way**2
    top = T * np.log(p) - (C + 1) * np.log1p(-v)
    f = np.exp(T[:, None] * np.log(1 - at**discount) - (C + 1)[:, None] * np.log(1 - at) - top[:, None]) * way * np.cosh(y)
    out[~near] = top + np.log(np.maximum(f.real.sum(axis=1) * step * v * scale * 2 / np.pi, 1e-300))
    return out


def _chosen(weight: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The place in each row of logarithms of weights that its chance falls on."""
    weight -= weight.max(axis=1, keepdims=True)
    sums = np.cumsum(np.exp(weight, out=weight), axis=1, out=weight)
    return (sums < chance[:, None] * sums[:, -1:]).sum(axis=1)


def dish_tables(c: np.ndarray, z: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    """Tables of dishes of c customers, 1 or more, from p(t) ~ Stirling(c, t) (d z)^t: those that the chances, from 0 to 1, fall on."""
    out = np.ones(len(c), np.int64)
    table, each = _tabled(discount), np.log(discount * z)
    order = np.argsort(c, kind="stable")
    size = len(table) - 1
    edges = np.searchsorted(c[order], np.arange(2, size + 2))
    for n, begin, end in zip(range(2, size + 1), edges, edges[1:], strict=False):
        step = max(1, 500_000 // n)
        for k in range(begin, end, step):
            rows = order[k : min(k + step, end)]
            out[rows] = 1 + _chosen(each[rows][:, None] * np.arange(1, n + 1) + table[n, 1 : n + 1], chance[rows])
    large = order[edges[-1] :]
    if len(large):
        out[large] = _large_tables(c[large], z[large], discount, chance[large])
    return out


def _large_tables(c: np.ndarray, z: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    """As dish_tables. Tables are a sum of independent yes-or-no numbers, so their variance is at most their mean, and 8 deviations hold them."""
    # The mean is near z (1 - v^d), where z d (1 - v) v^(d - 1) = c, and at most one more.
    mean = np.minimum(z * -np.expm1(discount * _place(lambda v: z * discount * -np.expm1(v) * np.exp((discount - 1) * v) > c, len(c))), c)
    first = np.clip(np.floor(mean - 8 * np.sqrt(mean + 1) - 4), 1, c).astype(np.int64)
    last = np.clip(np.ceil(mean + 8 * np.sqrt(mean + 1) + 12), 1, c).astype(np.int64)
    width, out = last - first + 1, np.empty(len(c), np.int64)
    smooth = (width > POINTS) & (c - last > width)
    angles = np.pi * (np.arange(POINTS) + 0.5) / POINTS
    series = np.cos(np.outer(angles, np.arange(POINTS))) * np.where(np.arange(POINTS) > 0, 2, 1) / POINTS
    for kind in (False, True):
        order = np.flatnonzero(smooth == kind)
        order = order[np.argsort(width[order], kind="stable")]
        begin = 0
        while begin < len(order):
            # Rows of much the same width, filled up to the widest; some 20,000 integers at a time.
            least = int(width[order[begin]])
            rows = order[begin : min(np.searchsorted(width[order], least * 1.25, "right"), begin + max(1, 20_000 // least))]
            begin += len(rows)
            t = first[rows][:, None] + np.arange(width[rows].max())
            inside, steps = t <= last[rows][:, None], np.log(t)
            weight = t * np.log(z[rows])[:, None] - np.cumsum(steps, axis=1)
            if kind:  # Chebyshev polynomials in t of what, but for a factor t, varies slowly
                middle, half = ((last + first) / 2)[rows][:, None], ((last - first) / 2)[rows][:, None]
                at = middle + half * np.cos(angles)
                values = log_seatings(np.repeat(c[rows], POINTS), at.ravel(), discount).reshape(at.shape) - np.log(at)
                weight += steps + np.polynomial.chebyshev.chebval((t - middle) / half, (values @ series).T[:, :, None], tensor=False)
            else:
                weight[inside] += log_seatings(np.broadcast_to(c[rows][:, None], t.shape)[inside], t[inside], discount)
            out[rows] = first[rows] + _chosen(np.where(inside, weight, -np.inf), chance[rows])
    return out


def chances(key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers between 0 and 1, each settled by its key and the salt, wherever it is drawn."""
    x = key.astype(np.uint64)
    for s in salt:
        x = _mixed(x + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gammas(shape: np.ndarray, key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers of gamma distributions of shapes above 1 (Marsaglia and Tsang), settled as chances are."""
    out, rows, a, k = np.empty(len(shape)), np.arange(len(shape)), shape - 1 / 3, 0
    while len(rows):
        one, two, three = (chances(key[rows], *salt, k + j) for j in range(3))
        normal = np.sqrt(-2 * np.log(one)) * np.cos(2 * np.pi * two)
        v = np.maximum(1 + normal / np.sqrt(9 * a[rows]), 1e-100) ** 3
        good = np.log(three) < normal**2 / 2 + a[rows] * (1 - v + np.log(v))
        out[rows[good]] = (a[rows] * v)[good]
        rows, k = rows[~good], k + 3
    return out


# One restaurant seen alone, its customers seated one by one: what the sampler above is held against.


def draw_tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of c customers, 1 to TABLED, from p(t) ~ Stirling(c, t) (strength + d others)(strength + d (others + 1))... parent^t."""
    table = _tabled(discount)
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(2, TABLED + 2))
    for size, begin, end in zip(range(2, TABLED + 1), edges, edges[1:], strict=False):
        step = max(1, 500_000 // size)
        for k in range(begin, end, step):
            rows = order[k : min(k + step, end)]
            weight = np.log((strength + discount * others[rows])[:, None] + discount * np.arange(size)) + np.log(parent[rows])[:, None]
            weight = np.cumsum(weight, axis=1, out=weight)
            weight += table[size, 1 : size + 1]
            weight -= weight.max(axis=1, keepdims=True)
            chance = np.cumsum(np.exp(weight, out=weight), axis=1, out=weight)
            out[rows] = 1 + (chance < rng.random(len(rows))[:, None] * chance[:, -1:]).sum(axis=1)
    return out


def first_seating(c: int, others: int, parent: float, discount: float, strength: float, rng: np.random.Generator) -> dict[int, int]:
    """Tables by size. For many customers their number less one is negative-binomial; then the others sit down in blocks that double."""
    t = int(min(c, 1 + rng.negative_binomial(strength / discount + others + 1, 1 - min(parent, 0.999))))
    sizes, n = {1: t}, t
    while n < c:
        block = min(n, c - n)
        kinds = list(sizes.items())
        weights = np.array([m * (x - discount) for x, m in kinds])
        sizes = {}
        for (x, m), joined in zip(kinds, rng.multinomial(block, weights / weights.sum()), strict=True):
            each, more = divmod(int(joined), m)
            for size, k in ((x + each, m - more), (x + each + 1, more)):
                if k:
                    sizes[size] = sizes.get(size, 0) + k
        n += block
    return sizes


def reseat(sizes: dict[int, int], c: int, others: int, parent: float, discount: float, strength: float, moves: int, rng: np.random.Generator) -> None:
    """So many Gibbs steps: a customer, any as likely, leaves its table and sits down again."""
    t = sum(sizes.values())

    def change(size: int, by: int) -> None:
        sizes[size] = sizes.get(size, 0) + by
        if not sizes[size]:
            del sizes[size]

    for leave, sit in rng.random((moves, 2)).tolist():
        leave *= c
        for x, m in sizes.items():
            leave -= x * m
            if leave < 0:
                break
        change(x, -1)
        if x > 1:
            change(x - 1, 1)
        else:
            t -= 1
        fresh = (strength + discount * (others + t)) * parent
        sit *= c - 1 - discount * t + fresh
        if sit < fresh:
            change(1, 1)
            t += 1
            continue
        sit -= fresh
        for x, m in sizes.items():
            sit -= m * (x - discount)
            if sit < 0:
                break
        change(x, -1)
        change(x + 1, 1)


def lay_out(bucket: int, asked: list[tuple[int, list[bytes]]], words: int, split: int) -> Iterator[Message]:
    """The restaurants of a context bucket from all blocks' pairs.

    FIXED: its contexts, the customers of each, its dishes of one customer; the dishes of more: context, word and customers. LAID, a
    block each: places of its contexts, of its dishes of more than one customer (plus one, else 0), and of all pairs the customers. UP
    and TOTALS begin with a table a dish.
    """
    pairs = [[unpack(p) for p in parts] for _, parts in asked]
    contexts, of_context = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
    dishes, of_dish = np.unique(np.concatenate([p[2] for p in pairs]), return_inverse=True)
    key, at = np.unique(np.repeat(of_context, np.concatenate([p[1] for p in pairs])) * len(dishes) + of_dish, return_inverse=True)
    c = np.bincount(at, np.concatenate([p[3] for p in pairs]), len(key)).astype(np.int64)
    u, w = key // len(dishes), key % len(dishes)
    customers = np.zeros(len(contexts), np.int64)
    customers[of_context] = np.concatenate([p[4] for p in pairs])
    singles = np.bincount(u[c == 1], minlength=len(contexts))
    large = np.flatnonzero(c > 1)
    place = np.zeros(len(key), np.int64)
    place[large] = np.arange(1, len(large) + 1)
    wide, of_wide = np.unique(w[large], return_inverse=True)
    yield bucket, FIXED, 0, [pack(x) for x in (contexts, customers, singles, u[large], of_wide, dishes[wide], c[large])]
    begin = context = 0
    for (block, _), p in zip(asked, pairs, strict=True):
        own = at[begin : begin + len(p[2])]
        yield bucket, LAID, block, [pack(of_context[context : context + len(p[0])]), pack(place[own]), pack(c[own])]
        begin, context = begin + len(p[2]), context + len(p[0])
    once = np.bincount(w[c == 1], minlength=len(dishes))
    yield from sent_up(bucket, dishes, once, words, -1)
    yield from sent_up(bucket, dishes[wide], np.bincount(of_wide, minlength=len(wide)), words, 0)
    yield from split_totals(bucket, contexts, customers, singles + np.bincount(u[large], minlength=len(contexts)), words, split)


def sent_up(bucket: int, dishes: np.ndarray, tables: np.ndarray, words: int, what: int) -> Iterator[Message]:
    """Tables of each word to its bucket; what: -1 for those that never change. Dishes without tables are sent too: answers keep the order."""
    to = (dishes - FIRST_WORD) % words
    for b in np.unique(to):
        own = to == b
        yield int(b), UP, bucket, [pack(np.array([what + 1])), pack(dishes[own]), pack(tables[own])]


def split_totals(bucket: int, contexts: np.ndarray, customers: np.ndarray, tables: np.ndarray, words: int, split: int) -> Iterator[Message]:
    """Tables of the contexts that are divided over buckets."""
    divided = np.flatnonzero(customers > split)
    to = (contexts[divided] - FIRST_WORD) % words
    for b in np.unique(to):
        own = divided[to == b]
        yield int(b), TOTALS, bucket, [pack(contexts[own]), pack(tables[own])]


def sweep_root(bucket: int, messages: list[tuple[int, int, list[bytes]]], words: int, vocabulary: int, all_tables: int, seed: tuple[int, int]) -> Iterator[Message]:
    """A pass over a word bucket of the parent. ROOT: customers that never change, customers, tables."""
    ups = [(source, [unpack(p) for p in parts]) for kind, source, parts in messages if kind == UP]
    totals = [(source, [unpack(p) for p in parts]) for kind, source, parts in messages if kind == TOTALS]
    old = next((parts for kind, _, parts in messages if kind == ROOT), None)
    rank = [(p[1] - FIRST_WORD) // words for _, p in ups]
    size = max([len(unpack(old[0])) if old else 0, *(int(r.max()) + 1 for r in rank if len(r))], default=0)
    fixed = unpack(old[0]).copy() if old else np.zeros(size, np.int64)
    more = np.zeros(size, np.int64)
    for (_, p), r in zip(ups, rank, strict=True):
        np.add.at(more if p[0][0] else fixed, r, p[2])
    c = fixed + more
    t = np.zeros(size, np.int64)
    served = np.flatnonzero(c)
    x = gammas(np.array([ROOT_STRENGTH / ROOT_DISCOUNT + all_tables]), np.zeros(1), *seed, 1)
    t[served] = dish_tables(c[served], np.repeat(x / (vocabulary + 1), len(served)), ROOT_DISCOUNT, chances(FIRST_WORD + served * words + bucket, *seed, 2))
    yield bucket, ROOT, seed[1], [pack(fixed), pack(c), pack(t)]
    yield bucket, CUSTOMERS, int(c.sum()), []
    yield bucket, TABLES, int(t.sum()), []
    sums: dict[int, int] = {}
    for _, p in totals:
        for u, n in zip(*(x.tolist() for x in p), strict=True):
            sums[u] = sums.get(u, 0) + n
    for source, p in totals:
        yield source, SHARED, seed[1], [pack(p[0]), pack(np.array([sums[u] for u in p[0].tolist()], np.int64))]
    for (source, p), r in zip(ups, rank, strict=True):
        if p[0][0]:
            yield source, DOWN, bucket, [pack(p[1]), pack(c[r]), pack(t[r])]


def sweep_contexts(bucket: int, messages: list[tuple[int, int, list[bytes]]], words: int, vocabulary: int, root: tuple[int, int], cut: int, seed: tuple[int, int]) -> Iterator[Message]:
    """A pass over a context bucket. SEATED: tables of the dishes of more than one customer, of the contexts; the divided contexts, their places."""
    contexts, customers, singles, u, at, dishes, c = (unpack(p) for p in next(parts for kind, _, parts in messages if kind == FIXED))
    old = next((parts for kind, _, parts in messages if kind == SEATED), None)
    totals = unpack(old[1]).copy() if old else singles + np.bincount(u, minlength=len(contexts))
    numerator = np.zeros(len(dishes))
    for kind, _, parts in messages:
        if kind == DOWN:
            asked, root_c, root_t = (unpack(p) for p in parts)
            numerator[np.searchsorted(dishes, asked)] = root_c - ROOT_DISCOUNT * root_t
        elif kind == SHARED:
            divided, tables = (unpack(p) for p in parts)
            totals[np.searchsorted(contexts, divided)] = tables
    parent = (numerator + (ROOT_STRENGTH + ROOT_DISCOUNT * root[1]) / (vocabulary + 1)) / (ROOT_STRENGTH + root[0])
    x = gammas(STRENGTH / DISCOUNT + totals, contexts, *seed, 3)
    pair = _mixed(contexts.astype(np.uint64))[u] + dishes[at].astype(np.uint64)
    t = dish_tables(c, x[u] * parent[at], DISCOUNT, chances(pair, *seed, 4))
    own = singles + np.bincount(u, t, len(contexts)).astype(np.int64)
    divided = np.flatnonzero(customers > cut)
    yield bucket, SEATED, seed[1], [pack(t), pack(own), pack(contexts[divided]), pack(divided)]
    yield from sent_up(bucket, dishes, np.bincount(at, t, len(dishes)).astype(np.int64), words, 0)
    yield from split_totals(bucket, contexts, customers, own, words, cut)


def context_answers(bucket: int, messages: list[tuple[int, int, list[bytes]]]) -> Iterator[Message]:
    """To each block: customers of its pairs, their tables over all samples, and the tables of its contexts in each sample."""
    samples = []
    for kind, k, parts in messages:
        if kind == SEATED:
            t, totals, divided, places = (unpack(p) for p in parts)
            for _, _, (asked, tables) in (m for m in messages if m[:2] == (SHARED, k)):
                totals[places[np.searchsorted(divided, unpack(asked))]] = unpack(tables)
            samples.append((t, totals))
    tables = np.concatenate([[0], np.sum([t for t, _ in samples], axis=0)]).astype(np.int64)
    for kind, block, parts in messages:
        if kind == LAID:
            contexts, place, c = (unpack(p) for p in parts)
            yield block, SEATED, bucket, [parts[2], pack(np.where(place > 0, tables[place], len(samples) * (c == 1))), *(pack(t[contexts]) for _, t in samples)]


def word_answers(bucket: int, messages: list[tuple[int, int, list[bytes]]], words: int) -> Iterator[Message]:
    """To each block: customers and tables in the parent of its words, a sample after another."""
    samples = [[unpack(p) for p in parts[1:]] for kind, _, parts in messages if kind == ROOT]
    for kind, block, parts in messages:
        if kind == WORDS and samples:  # else no word of the bucket is known
            numbers = unpack(parts[0])
            rank = np.where(numbers == UNKNOWN, 0, (numbers - FIRST_WORD) // words)
            yield block, ROOT, bucket, [pack(np.where(numbers == UNKNOWN, 0, x[rank] if len(x) else 0)) for c, t in samples for x in (c, t)]


class Sums:
    """What the driver keeps: tokens and different words of training, training texts, numbers of buckets, customers from which a context is divided, and a sample's customers and tables of the parent."""

    def __init__(self, starts: int, words: int, contexts: int, split: int) -> None:
        self.starts, self.words, self.contexts, self.split = starts, words, contexts, split
        self.tokens = self.vocabulary = 0
        self.samples: list[tuple[int, int]] = []


def block_scores(messages: list[tuple[int, int, list[bytes]]], sums: Sums) -> dict[str, list]:
    """Figures of a block's texts."""
    block = Block(*next(parts for kind, _, parts in messages if kind == BLOCK))
    block.name([(source, parts) for kind, source, parts in messages if kind == WORDS], sums.words)
    pairs = block.pairs(sums.starts, sums.contexts, sums.split)
    S, n = len(sums.samples), len(block.hashes)
    edges, root = word_edges(block.hashes, sums.words), np.zeros((2 * S, n), np.int64)
    c, t = np.zeros(len(pairs["u"]), np.int64), np.zeros(len(pairs["u"]), np.int64)
    contexts, tables = [np.empty(0, np.int64)], [np.empty((S, 0), np.int64)]
    for kind, source, parts in messages:
        if kind == ROOT:
            root[:, edges[source] : edges[source + 1]] = [unpack(p) for p in parts]
        elif kind == SEATED:
            own = slice(pairs["edges"][source], pairs["edges"][source + 1])
            c[own], t[own] = unpack(parts[0]), unpack(parts[1])
            contexts.append(np.unique(pairs["u"][own]))
            tables.append(np.array([unpack(p) for p in parts[2:]]))
    every, first = np.unique(np.concatenate(contexts), return_index=True)
    totals = np.concatenate(tables, axis=1)[:, first]
    at = np.searchsorted(every, pairs["context"])
    at[at == len(every)] = 0
    seen = np.zeros(len(at), bool) if not len(every) else (every[at] == pairs["context"]) & (pairs["customers"] > 0)
    customers = np.where(seen, pairs["customers"], 0)
    score, place = np.zeros(len(at)), pairs["place"]
    for s, (all_c, all_t) in enumerate(sums.samples):
        parent = (root[2 * s] - ROOT_DISCOUNT * root[2 * s + 1] + (ROOT_STRENGTH + ROOT_DISCOUNT * all_t) / (sums.vocabulary + 1)) / (ROOT_STRENGTH + all_c)
        left = np.where(seen, STRENGTH + DISCOUNT * (totals[s][at] if len(every) else 0), 1) / np.where(seen, STRENGTH + customers, 1)
        score += left * parent[block.tokens]
    has = place >= 0
    score[has] += (S * c[place[has]] - DISCOUNT * t[place[has]]) / (STRENGTH + customers[has])
    known = block.known[block.tokens]
    text = np.repeat(np.arange(len(block.sizes)), block.sizes)
    base = np.log10((known + 1) / (sums.tokens + sums.vocabulary + 1))
    add = lambda x: np.bincount(text, x, len(block.sizes))
    return {
        "doc_id": block.ids, "held_out": block.held.tolist(), "n_tokens": block.sizes.tolist(), "n_known": add(known > 0).astype(np.int64).tolist(),
        "train_tokens": [sums.tokens] * len(block.ids), "base_score": add(base).tolist(), "score": add(np.log10(score / S)).tolist(),
    }


_ARROW = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("source", pa.int64()), ("parts", pa.list_(pa.binary()))])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _received(table: pa.Table) -> tuple[int, list[tuple[int, int, list[bytes]]]]:
    rows = zip(*(table.column(c).to_pylist() for c in ("kind", "source", "parts")), strict=True)
    return table.column("to")[0].as_py(), sorted(rows, key=lambda r: r[:2])


def _sent(messages: Iterator[Message]) -> pa.Table:
    rows = list(messages)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * 4, _ARROW, strict=True)], schema=_ARROW)


def at_address(messages: DataFrame, answer: Callable[[int, list[tuple[int, int, list[bytes]]]], Iterator[Message]]) -> DataFrame:
    """What is answered where the messages meet that have one address."""
    return messages.groupBy("to").applyInArrow(lambda table: _sent(answer(*_received(table))), MESSAGE)


def scores(docs: DataFrame, held: object, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, bucket_words: int = BUCKET_WORDS, split: int = SPLIT, sweeps: int = BURN_IN + SAMPLES, samples: int = SAMPLES, seed: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    held: a column that is true for the texts the model does not learn from. block_tokens, bucket_tokens and bucket_words size the work, split is the
    customers beyond which a context is divided; samples of the last sweeps are averaged.
    """
    blocks = stored(tokenised(docs, id_col, text_col, held, block_tokens), "lm-blocks")
    tokens, words, starts = (int(x or 0) for x in blocks.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum("n_training")).first())
    sums = Sums(starts, max(4, -(-words // bucket_words)), max(4, -(-tokens // bucket_tokens)), split)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = unpack(row["words"], np.uint64), unpack(row["counts"])
                edges = word_edges(hashes, sums.words)
                found = ((b, WORDS, row["block"], [pack(hashes[i:j]), pack(counts[i:j])]) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if i < j)
                yield from _sent(found).to_batches()

    def plain(messages: list) -> list[tuple[int, list[bytes]]]:
        return [(source, parts) for _, source, parts in messages]

    named = stored(at_address(blocks.select("block", "words", "counts").mapInArrow(ask_words, MESSAGE), lambda b, m: count_words(b, plain(m), sums.words)), "lm-words", by="kind")
    sums.tokens, sums.vocabulary = _totals(named)
    known = named.filter(F.col("kind") == WORDS)
    own = blocks.select(F.col("block").alias("to"), F.lit(BLOCK).alias("kind"), F.lit(0).cast("long").alias("source"), F.array("ids", "held", "sizes", "words", "places", "tokens").alias("parts"))

    def ask_contexts(block: int, messages: list) -> Iterator[Message]:
        it = Block(*messages[0][2])
        it.name(plain(messages[1:]), sums.words)
        pairs = it.pairs(sums.starts, sums.contexts, sums.split)
        customers = dict(zip(it.numbers.tolist(), it.known.tolist(), strict=True)) | {START: sums.starts}
        for b, (i, j) in enumerate(zip(pairs["edges"], pairs["edges"][1:], strict=False)):
            if i < j:
                u, n = np.unique(pairs["u"][i:j], return_counts=True)
                yield b, ASKED, block, [pack(x) for x in (u, n, pairs["w"][i:j], pairs["counts"][i:j], np.array([customers[x] for x in u.tolist()]))]

    laid = stored(at_address(at_address(own.unionByName(known), ask_contexts), lambda b, m: lay_out(b, plain(m), sums.words, split)), "lm-contexts", by="kind")
    fixed, sent = laid.filter(F.col("kind") == FIXED), laid.filter(F.col("kind").isin(UP, TOTALS))
    root = contexts = None
    kept: list[tuple[DataFrame, DataFrame]] = []
    for k in range(sweeps + 1):
        if k:
            at, was, V, now = sums.words, _totals(root), sums.vocabulary, (seed, k)
            told = fixed.unionByName(root.filter(F.col("kind").isin(DOWN, SHARED)))
            new = stored(at_address(told.unionByName(contexts.filter(F.col("kind") == SEATED)) if contexts else told, lambda b, m, at=at, V=V, was=was, now=now: sweep_contexts(b, m, at, V, was, split, now)), "lm-sweep", by="kind")
            if contexts and not kept:
                discard(contexts)
            contexts = new
            sent = contexts.filter(F.col("kind").isin(UP, TOTALS))
        at, tables, V, now = sums.words, _totals(root)[1] if root else sums.vocabulary, sums.vocabulary, (seed, k)
        told = sent.unionByName(root.filter(F.col("kind") == ROOT)) if root else sent
        new = stored(at_address(told, lambda b, m, at=at, V=V, tables=tables, now=now: sweep_root(b, m, at, V, tables, now)), "lm-parent", by="kind")
        if root and not kept:
            discard(root)
        root = new
        if k > sweeps - samples:
            kept.append((contexts, root))
            sums.samples.append(_totals(root))
    discard_parts(laid, "kind", FIXED, UP, TOTALS)
    answers = laid.filter(F.col("kind") == LAID)
    asked = known.select(F.col("source").alias("to"), "kind", F.col("to").alias("source"), "parts")
    for at_contexts, at_root in kept:
        answers = answers.unionByName(at_contexts.filter(F.col("kind") == SEATED)).unionByName(at_root.filter(F.col("kind") == SHARED))
        asked = asked.unionByName(at_root.filter(F.col("kind") == ROOT))
    back = at_address(answers, context_answers).unionByName(at_address(asked, lambda b, m: word_answers(b, m, sums.words)))

    def figures(table: pa.Table) -> pa.Table:
        return pa.table(block_scores(_received(table)[1], sums), schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())]))

    return own.unionByName(known).unionByName(back).groupBy("to").applyInArrow(figures, SCORES)


def _totals(messages: DataFrame) -> tuple[int, int]:
    """The sums that buckets told the driver: customers, tables."""
    found = {r["kind"]: r["n"] for r in messages.filter(F.col("kind").isin(CUSTOMERS, TABLES)).groupBy("kind").agg(F.sum("source").alias("n")).collect()}
    return int(found.get(CUSTOMERS, 0)), int(found.get(TABLES, 0))


def held_out(id_col: str = "doc_id") -> object:
    """crc32 of the id as text is 2 modulo 7."""
    return F.coalesce(F.crc32(quoted(id_col).cast("long").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def perplexity(found: DataFrame) -> DataFrame:
    """held_out, tokens, base_perplexity, perplexity over all texts of a kind."""
    tokens = F.sum("n_tokens")
    return found.groupBy("held_out").agg(tokens.alias("tokens"), *(F.pow(F.lit(10.0), -F.sum(c) / tokens).alias(n) for c, n in (("base_score", "base_perplexity"), ("score", "perplexity"))))


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), held_out())
