"""Folds over pieces against the plain fold, the similarity join against all pairs."""

import difflib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import chunking, folding, similarity


def plain(rows, soft, hard):
    """Group numbers of (tokens, apart, weak) in order."""
    out, group, total = [], -1, 0
    for tokens, apart, weak in rows:
        if apart or total + tokens > hard or (weak and total + tokens > soft):
            group, total = group + 1, 0
        total += tokens
        out.append(group)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_a_piece_is_its_step_function(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n, hard = rng.randint(0, 25), rng.randint(1, 30)
        soft = rng.randint(0, hard)
        rows = [(rng.choice([0, 1, 3, 9, 40]), rng.random() < 0.1, rng.random() < 0.4) for _ in range(n)]
        piece = folding.Piece(*(np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, bool, bool))), soft, hard)
        steps, groups, left = piece.summary()
        for t in range(hard + 2):
            total, starts = t, []
            for tokens, apart, weak in rows:
                new = apart or total + tokens > hard or (weak and total + tokens > soft)
                total = tokens if new else total + tokens
                starts.append(new)
            k = int(np.searchsorted(steps, t, "right")) - 1
            assert piece.starts(t).tolist() == starts
            assert groups[k] == sum(starts)
            assert left[k] + (0 if groups[k] else t) == total


def test_groups_of_one_source_over_many_pieces(spark):
    rng = random.Random(1)
    rows = {k: [(rng.randrange(0, 700), rng.random() < 0.02, rng.random() < 0.5) for _ in range(n)] for k, n in (("hot", 20_000), ("a", 30), ("b", 1), (None, 3000))}
    flat = [(k, i, t, bool(apart or i == 0), weak) for k, own in rows.items() for i, (t, apart, weak) in enumerate(own)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        pieces = folding.in_pieces(spark.createDataFrame(flat, "k string, i int, n int, apart boolean, weak boolean"), ["k"], ["i"])
        sizes = pieces.groupBy(folding.PIECE).count().agg(F.max("count")).first()[0]
        got = folding.budget_groups(pieces, ["k"], ["i"], "n", F.col("apart"), F.col("weak"), 1024, 1382, "g").collect()
        before = folding.with_previous(pieces, ["k"], ["i"], ["i"]).select("k", "i", F.col("__previous.i").alias("b")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes < len(flat) / 30
    assert len(got) == len(flat)
    for k, own in rows.items():
        expected = plain([(t, apart or i == 0, weak) for i, (t, apart, weak) in enumerate(own)], 1024, 1382)
        assert [r.g for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)] == expected
    assert {(r.k, r.i): r.b for r in before} == {(k, i): i - 1 if i else None for k, own in rows.items() for i in range(len(own))}


def test_merge_scores_look_at_the_row_before_in_another_piece(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), i, rng.choice(["P1", "P2", ""]), [rng.choice("ABC")], i // 3, rng.choice(["text", "table"]), rng.choice(["q", "r"]), rng.randrange(2), float(rng.choice([5, 20])), float(rng.choice([0, 9])), rng.randrange(300)) for i in range(400)]
    schema = "k string, i int, anchor string, names array<string>, page_num int, block_type string, hint string, formulas int, evidence double, noise double, tokens int"
    table = spark.createDataFrame(rows, schema)
    got = {r.i: (r.merge_score, r.chunk) for r in chunking.greedy_groups(chunking.merge_scores(table, ["k"], ["i"]), ["k"], ["i"]).collect()}
    one = chunking.merge_scores(table.coalesce(1).withColumn(folding.PIECE, F.lit(0)), ["k"], ["i"]).collect()
    assert {r.i: r.merge_score for r in one} == {i: s for i, (s, _) in got.items()}
    for k in "xy":
        own = sorted((r for r in one if r.k == k), key=lambda r: r.i)
        score = [r.merge_score for r in own]
        expected = plain([(r.tokens, s is None or s < 3, s is None or s < 5) for r, s in zip(own, score, strict=True)], 1024, 1382)
        assert [got[r.i][1] for r in own] == expected


WORDS = ["speed", "heading", "altitude", "status", "valid", "range", "target", "track", "time", "count"]


def names(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))).replace("e", rng.choice("ee3"), 1) for _ in range(n)] + ["", "a", "ab", "ba", "aa", "漢字", "漢", None]


@pytest.mark.parametrize("ratio", [0.3, 0.6, 0.75, 0.85, 1.0])
@pytest.mark.parametrize("measure", ["matched", "equal"])
def test_similar_texts_are_those_of_all_pairs(spark, ratio, measure):
    rng = random.Random(7)
    left, right = names(rng, 90), names(rng, 110)
    got = similarity.similar_texts(spark.createDataFrame([(x,) for x in left], "text string"), spark.createDataFrame([(x,) for x in right], "text string"), ratio, measure).collect()

    def of(a, b):
        if not (a or b):
            return 1.0
        return difflib.SequenceMatcher(None, a, b).ratio() if measure == "matched" else 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))

    expected = {(a, b): of(a, b) for a in set(left) - {None} for b in set(right) - {None}}
    assert {(r.a, r.b): r.similarity for r in got} == pytest.approx({k: v for k, v in expected.items() if v >= ratio})
    assert len(got) == len({(r.a, r.b) for r in got})


def test_the_index_emits_few_candidates_of_many_names(spark):
    rng = random.Random(9)
    many = [f"{rng.choice(WORDS)}_{rng.choice(WORDS)}_{''.join(rng.choice('abcdefghijklmnop') for _ in range(12))}" for _ in range(10_000)]
    table = spark.createDataFrame([(x,) for x in many], "text string").repartition(4)
    near = [(m, m[:-1] + "z") for m in many[:50]]
    right = spark.createDataFrame([(b,) for _, b in near] + [(x,) for x in many[5000:]], "text string")
    got = {(r.a, r.b) for r in similarity.similar_texts(table, right, 0.9).collect()}
    assert got >= set(near) and got >= {(x, x) for x in many[5000:]}
    blocks = {}
    for k, x in enumerate(sorted(set(many))):
        blocks.setdefault(x[:4], []).append(x)
    for own in list(blocks.values())[:3]:  # all pairs of a few hundred names
        for a in own[:150]:
            for b in own[:150]:
                if b in set(many[5000:]) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9:
                    assert (a, b) in got
