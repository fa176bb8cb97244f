"""Evidence of tasks against all pairs."""

import random
import re

from pyspark.sql import functions as F

from weftline.operators import evidence


def strip(x):
    return re.sub(r"\d+$", "", x)


def by_pairs(snippets, tasks):
    out = {}
    for task, field, label, path, sources in tasks:
        target = {(x or "").strip().upper() for x in (field, label, path[-1] if path else None)} - {""}
        target |= {strip(x) for x in target} - {""}
        source = {(x or "").strip().upper() for x in sources or []} - {""}
        source |= {strip(x) for x in source} - {""}
        for i, role, query, title, content, score in snippets:
            text, best = f"{title or ''}\n{content or ''}".upper(), 0.0
            terms, worth = {"target": (target, (20.0, 12.0)), "source": (source, (18.0, 10.0))}.get((role or "").strip().lower(), (set(), (0, 0)))
            if (query or "").strip().upper() in terms:
                best = worth[0]
            elif any(t in text for t in terms):
                best = worth[1]
            if best:
                out[task, i] = best + (score or 0.0)
    return out


def test_relevance_is_that_of_all_pairs(spark):
    rng = random.Random(2)
    words = ["alt", "altitude", "speed2", "spd", "x", "id", "高度", "heading", "r_1", "status12"]
    tasks = [(k, rng.choice([*words, None, " "]), rng.choice([*words, None]), rng.choice([None, [], ["a", rng.choice(words)]]), rng.choice([None, rng.sample(words, 2)])) for k in range(25)]
    texts = ["The altitude is set", "SPEED and heading", "nothing here", "", None, "高度 field", "id", "xx r_ status", "spd" * 50]
    snippets = [(k, rng.choice(["target", "Source ", "other", None]), rng.choice([*words, None, "SPEED"]), rng.choice(["T", None, "speed"]), rng.choice(texts), rng.choice([0.5, None, 2.0])) for k in range(80)]
    s = spark.createDataFrame(snippets, "snippet_id int, role string, query string, title string, content string, score double")
    t = spark.createDataFrame(tasks, "task_id int, field_name string, label string, path_parts array<string>, candidates array<string>")
    expected = by_pairs(snippets, tasks)
    assert {(r.task_id, r.snippet_id): r.score for r in evidence.relevance(s, t).collect()} == expected
    best = {}
    for (_, i), score in expected.items():
        best[i] = max(best.get(i, 0), score)
    assert {r.snippet_id: r.score for r in evidence.selected(s, t).collect()} == best
    top = {}
    for r in evidence.task_evidence(s, t, 3).orderBy("task_id", "rank").collect():
        top.setdefault(r.task_id, []).append(r.snippet_id)
    title = {x[0]: x[3] or "" for x in snippets}
    for task in {a for a, _ in expected}:
        assert top[task] == [i for _, _, i in sorted((-v, title[i], i) for (a, i), v in expected.items() if a == task)][:3]


def test_candidates_come_once(spark):
    tree = spark.createDataFrame([("a", "T", "one"), ("a", "T", " ")], "path string, title string, snippet string")
    raw = spark.createDataFrame([("a", "Other", "one"), ("b", "B", "one")], tree.schema)
    assert sorted(tuple(r) for r in evidence.candidates(tree, raw).collect()) == [("a", "T", "one"), ("b", "B", "one")]


def test_runs_of_characters_are_numbers():
    """Different runs have different numbers, of characters beyond 16 bits and NUL too; each is given once."""
    from weftline.operators.evidence import grams

    for text in ("", "ab", "abcabcab", "a\0b\0\0a\0b", "x😀y😀xé一", "\U0010ffff\0\U0010ffff\0"):
        for size in (1, 2, 3):
            runs = {text[i : i + size] for i in range(len(text) - size + 1)}
            numbers = {r: grams(r, size).tolist() for r in runs}
            assert all(len(n) == 1 for n in numbers.values()) and len({n[0] for n in numbers.values()}) == len(runs)
            assert sorted(grams(text, size).tolist()) == sorted(n[0] for n in numbers.values())
