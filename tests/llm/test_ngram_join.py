import random

import numpy as np
import pytest

from weftline.llm import ngram_join as J


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for _ in range(40):
        base = make(rng.randrange(30, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            other = list(base)
            for _ in range(rng.randrange(0, 3)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    core = make(80)
    for i in range(90):  # a large bucket: more nodes than SMALL
        other = list(core)
        other[i % 80] = f"x{i}"
        texts.append(" ".join(other))
    texts += ["", None, "", "one two", "one two", "one  two", "a b c d e f", texts[0], texts[0]]
    return list(enumerate(texts)) + [(None, texts[3]), (7, texts[7])]


def brute(rows):
    sets = [set(J.shingles(t).tolist()) for _, t in rows]
    n = len(rows)
    texts = [t or "" for _, t in rows]
    near = [[i != j and (texts[i] == texts[j] or bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            m = min([label[i]] + [label[j] for j in range(n) if near[i][j]])
            if m != label[i]:
                label[i], changed = m, True
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        different = {texts[j] for j in range(n) if near[i][j] and texts[j] != texts[i]}
        out.append((rows[i][0], min(ids) if ids else None, sum(near[i]), len(different)))
    return sorted(out, key=str)


def test_prefix_meets_recall():
    d = J.prefix_length()
    assert 1 - (1 - 0.8**d) ** J.TREES >= J.RECALL and (d == J.DEPTH or 1 - (1 - 0.8 ** (d + 1)) ** J.TREES < J.RECALL)


def test_signatures_estimate_similarity():
    a, b = J.permutations(2000)
    x, y = np.arange(100, dtype=np.uint64) * J._MIX[0], np.arange(20, 120, dtype=np.uint64) * J._MIX[0]
    assert abs((J.signature(x, a, b) == J.signature(y, a, b)).mean() - 80 / 120) < 0.05


@pytest.mark.parametrize("block", [512, 40])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x").selectExpr("*", "1 AS id", "2 AS node", "3 AS key")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_linked_texts"]) for r in J.joined(docs).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node int")
    out = J.deduplicated(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(kept) == sorted({c for _, c, _, _ in brute(rows)})
    assert J.deduplicated(docs.limit(0)).count() == 0


def test_recall_is_judged_from_the_links_found():
    near, edge = np.zeros(J.BINS), np.zeros(J.BINS)
    near[-1], edge[0] = 5000, 5000
    assert J.recall_so_far(near, J.DEPTH, 0.8) > J.RECALL > J.recall_so_far(edge, J.DEPTH, 0.8) and J.recall_so_far(np.zeros(J.BINS), J.DEPTH, 0.8) == 0.0
    assert J.recall_so_far(edge, J.prefix_length(), 0.8) >= J.RECALL


def test_prefixes_are_shortened_only_as_far_as_needed(spark, monkeypatch):
    depths = []
    buckets = J._buckets
    monkeypatch.setattr(J, "_buckets", lambda trie, depth: depths.append(depth) or buckets(trie, depth))
    monkeypatch.setattr(J, "LEAST_LINKS", 50)
    rng = random.Random(4)
    texts = [" ".join(f"{i}v{rng.randrange(99)}" for _ in range(150)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts + [f"{t} end" for t in texts])), "doc_id long, text string")
    got = J.joined(docs).collect()
    assert all(r["n_links"] == 1 and r["class_id"] == r["doc_id"] % 120 for r in got)
    assert depths == [J.DEPTH]
    depths.clear()
    J.joined(spark.createDataFrame(corpus(), "doc_id long, text string")).count()
    assert depths == list(range(J.DEPTH, J.prefix_length() - 1, -1))


def test_large_cluster_is_counted_once(spark, monkeypatch):
    """A cluster in all trees' buckets: every pair of different texts counts once, whatever the blocks."""
    monkeypatch.setattr(J, "BLOCK", 60)
    core = [f"c{i}" for i in range(400)]
    texts = [" ".join(core[:k] + [f"x{k}"] + core[k + 1 :]) for k in range(300)]
    got = J.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 300 and {(r["class_id"], r["n_links"], r["n_linked_texts"]) for r in got} == {(0, 299, 299)}
