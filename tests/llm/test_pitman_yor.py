"""The Pitman-Yor model against a plain sampler that seats every customer, and its draws against enumeration."""

import itertools
import math
import random
import re
import zlib

import numpy as np
from weftline.llm import pitman_yor as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = "</end>\n"


def tokens(text):
    return [*WORD.findall("".join(c.lower() if c.isascii() else c for c in text or "")), END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_words_have_the_hash_of_their_lower_case_and_no_other():
    texts = ["The cat the CAT", "", "  a\tb\n\x0bc ", "É é ÀB àB", "x" * 5000 + " y", "\x00 \x1f \xa0"]
    found, sizes = P.hashed_words([t.encode().translate(P.LOWER) for t in texts])
    words = [w for t in texts for w in tokens(t)]
    assert sizes.tolist() == [len(tokens(t)) for t in texts]
    pairs = set(zip(words, found.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_packed_integers_come_back():
    for values in ([], [0], [255, 0], [256], [2**24, 7], [2**40 + 3, 1]):
        assert P.unpack(P.pack(np.array(values, np.int64))).tolist() == values


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def exact_tables(c, others, parent, discount, strength):
    """Chances of each number of tables, by all seatings."""
    weights = np.zeros(c + 1)
    for seating in partitions(list(range(c))):
        new = math.prod((strength + discount * (others + k)) * parent for k in range(len(seating)))
        weights[len(seating)] += new * math.prod(math.prod(j - discount for j in range(1, len(s))) for s in seating)
    return weights / weights.sum()


def test_numbers_of_tables_are_drawn_with_the_chances_of_all_seatings():
    rng = np.random.default_rng(3)
    for c, others, parent in itertools.product((2, 3, 5), (0, 7), (0.02, 0.4)):
        expected = exact_tables(c, others, parent, 0.75, 1.0)
        many = P.draw_tables(np.full(40_000, c), np.full(40_000, others), np.full(40_000, parent), 0.75, 1.0, rng)
        assert np.abs(np.bincount(many, minlength=c + 1) / 40_000 - expected).max() < 0.01
        seats, seen = P.first_seating(c, others, parent, 0.75, 1.0, rng), np.zeros(c + 1)
        for _ in range(30_000):
            P.reseat(seats, c, others, parent, 0.75, 1.0, 1, rng)
            assert sum(x * m for x, m in seats.items()) == c
            seen[sum(seats.values())] += 1
        assert np.abs(seen / seen.sum() - expected).max() < 0.03


def test_tables_of_large_dishes_are_drawn_as_those_of_small_ones(monkeypatch):
    rng = np.random.default_rng(5)
    c, z, chance = rng.integers(2, 1000, 3000), np.exp(rng.uniform(-8, 14, 3000)), rng.random(3000)
    for discount in (P.DISCOUNT, P.ROOT_DISCOUNT):
        drawn = []
        for tabled in (16, 200, 1000):
            monkeypatch.setattr(P, "TABLED", tabled)
            monkeypatch.setattr(P, "_stirling", {})
            drawn.append(P.dish_tables(c, z, discount, chance).tolist())
        assert drawn[0] == drawn[1] == drawn[2]


def test_tables_given_a_gamma_number_have_the_chances_of_all_seatings():
    for c, parent in itertools.product((2, 5), (0.02, 0.4)):
        expected, t, key = exact_tables(c, 7, parent, 0.75, 1.0), np.ones(40_000, np.int64), np.arange(40_000)
        for k in range(12):
            x = P.gammas(1 / 0.75 + 7 + t, key, k, 1)
            t = P.dish_tables(np.full(40_000, c), x * parent, 0.75, P.chances(key, k, 2))
        assert np.abs(np.bincount(t, minlength=c + 1) / 40_000 - expected).max() < 0.01


class Plain:
    """The same model, every customer at a table of its own restaurant."""

    def __init__(self, texts, rng):
        self.rng, self.seats, self.parent, self.t, self.c = rng, {}, {}, {}, {}
        self.customers = [(u, w) for t in texts for u, w in zip(["<s>\n", *tokens(t)], tokens(t), strict=False)]
        self.vocabulary = len({w for _, w in self.customers})
        self.root_c = self.root_t = 0
        for u, w in self.customers:
            self.sit(u, w)

    def base(self, w):
        sizes = self.parent.get(w, [])
        return (sum(sizes) - P.ROOT_DISCOUNT * len(sizes) + (P.ROOT_STRENGTH + P.ROOT_DISCOUNT * self.root_t) / (self.vocabulary + 1)) / (P.ROOT_STRENGTH + self.root_c)

    def chance(self, u, w):
        sizes, c = self.seats.get((u, w), []), self.c.get(u, 0)
        if not c:
            return self.base(w)
        return (sum(sizes) - P.DISCOUNT * len(sizes) + (P.STRENGTH + P.DISCOUNT * self.t[u]) * self.base(w)) / (P.STRENGTH + c)

    def seat(self, sizes, discount, new):
        x = self.rng.random() * (sum(sizes) - discount * len(sizes) + new)
        for k, n in enumerate(sizes):
            x -= n - discount
            if x < 0:
                sizes[k] += 1
                return False
        sizes.append(1)
        return True

    def leave(self, sizes):
        k = self.rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    def sit(self, u, w):
        self.c[u] = self.c.get(u, 0) + 1
        if self.seat(self.seats.setdefault((u, w), []), P.DISCOUNT, (P.STRENGTH + P.DISCOUNT * self.t.get(u, 0)) * self.base(w)):
            self.t[u] = self.t.get(u, 0) + 1
            new = (P.ROOT_STRENGTH + P.ROOT_DISCOUNT * self.root_t) / (self.vocabulary + 1)
            self.root_c += 1
            self.root_t += self.seat(self.parent.setdefault(w, []), P.ROOT_DISCOUNT, new)

    def sweep(self):
        for u, w in self.customers:
            self.c[u] -= 1
            if self.leave(self.seats[u, w]):
                self.t[u] -= 1
                self.root_c -= 1
                self.root_t -= self.leave(self.parent[w])
            self.sit(u, w)


def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(25)]
    rows = []
    for k in range(70):
        at, text = rng.randrange(25), []
        for _ in range(rng.randint(1, 30)):
            at = (at + rng.choice([1, 1, 1, 2, 5])) % 25 if rng.random() < 0.8 else rng.randrange(25)
            text.append(words[at].upper() if rng.random() < 0.2 else words[at])
        rows.append((k, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(100, "hot pair " * 300), (101, "new words w1 hot"), (102, None), (103, ""), (None, "w1 w2 w3"), (205, "w1 w2"), (205, "w1 w2"), (104, " \n ")]
    return rows + [(k, "w3 unseen w4 w5") for k in range(300, 320) if held(k)]


def test_scores_are_those_of_the_plain_sampler(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, True, "x") for i, t in rows], "doc_id long, text string, held_out boolean, data string").repartition(3)
    training = [t for i, t in rows if not held(i)]
    plain, n = Plain(training, random.Random(2)), 40
    texts = sorted({t or "" for _, t in rows})
    chances = {t: np.zeros(len(tokens(t))) for t in texts}
    for k in range(20 + n):
        plain.sweep()
        if k >= 20:
            for t in texts:
                chances[t] += [plain.chance(u, w) for u, w in zip(["<s>\n", *tokens(t)], tokens(t), strict=False)]
    counts = {}
    for t in training:
        for w in tokens(t):
            counts[w] = counts.get(w, 0) + 1
    N, V = sum(counts.values()), len(counts)

    for sizes in ({}, {"block_tokens": 150, "bucket_tokens": 60, "bucket_words": 4, "split": 40}):
        found = P.scores(docs, P.held_out(), sweeps=25, samples=15, **sizes).join(docs.select("doc_id", "text").distinct(), "doc_id", "left").collect()
        assert len(found) == len(rows)
        for r in found:
            text = "w1 w2 w3" if r.doc_id is None else (r.text or "")
            own = tokens(text)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(w in counts for w in own), N)
            assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 1) / (N + V + 1)) for w in own), rel_tol=1e-9, abs_tol=1e-9)
            expected = float(np.log10(chances[text] / n).sum())
            assert abs(r.score - expected) < 0.05 + 0.02 * abs(expected), (text, r.score, expected)


def test_scores_do_not_depend_on_how_contexts_are_divided(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = []
    for sizes in ({}, {"split": 40}, {"bucket_tokens": 60, "block_tokens": 150, "split": 7}):
        rows = P.scores(docs, P.held_out(), bucket_words=4, **sizes).collect()
        found.append(sorted((str(r.doc_id), r.n_tokens, round(r.score, 9)) for r in rows))
    assert found[0] == found[1] == found[2]


def test_held_out_text_is_foretold_better_than_by_the_base(spark):
    docs = spark.createDataFrame([(k, f"the {a} of the {b} is {a}") for k, (a, b) in enumerate(itertools.product(["sea", "sun", "sky", "old man", "tree"], repeat=2))] * 4, "doc_id long, text string")
    figures = {r.held_out: r for r in P.perplexity(P.scores(docs, P.held_out())).collect()}
    assert figures[True].perplexity < 0.5 * figures[True].base_perplexity


def test_tables_without_texts_or_training(spark):
    schema = "doc_id long, text string"
    assert P.scores(spark.createDataFrame([], schema), P.held_out()).count() == 0
    alone = next(k for k in range(100) if held(k))
    (row,) = P.scores(spark.createDataFrame([(alone, "some words")], schema), P.held_out()).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
