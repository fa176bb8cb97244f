import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, html_wrapper, mixing, quality_rules, sharding, toxicity, weak_labels

EDGE = [(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, None, None), (3, "plain words " * 20000, "a"), (4, "x", "a")]
SCHEMA = "doc_id long, text string, source string"


def edge(spark):
    """Nulls, empties, repeats, a long text, and columns whose names the operators use themselves."""
    return spark.createDataFrame(EDGE, SCHEMA).selectExpr("*", "1 AS score", "2 AS kept", "3 AS size", "4 AS n_words", "5 AS shard")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    y = sharding.permute(x, n, "k")
    assert sorted(y) == list(range(n)) and (sharding.permute(y, n, "k", inverse=True) == x).all()


def test_shards_are_even_and_reproducible(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(997)] + [(5, "t5")] * 3, "doc_id long, text string")
    a = sorted((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(rows, 7).collect())
    assert a == sorted((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(rows.repartition(9), 7).collect())
    by = Counter(s for _, _, s, _ in a)
    assert max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(slot for _, _, x, slot in a if x == s) == list(range(by[s]))
    out = sharding.shard(edge(spark), 4).collect()
    assert len(out) == len(EDGE) and sorted(r["size"] for r in out)[:4] == [16] * 4
    assert sharding.shard(edge(spark).limit(0), 4).count() == 0


def brute_repeats(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) for k in range(5) if grams[tuple(words[i : i + 5])] > 1})


def test_rules_measure_and_order(spark):
    rng = random.Random(1)
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        x = quality_rules.measure(" ".join(words))
        assert (x.n_words, x.n_repeat_words) == (len(words), brute_repeats(words))
    ticks = iter(range(10**6))
    names = {"never": lambda x: False, "often": lambda x: "!" in x.text}
    sample = [quality_rules.measure(f"one two three four five six seven eight nine ten{i} !") for i in range(9)]
    assert [n for n, _, _ in quality_rules.plan(sample, names, lambda: next(ticks))] == ["often", "never"]
    good = "It was a fine day and the river ran past the old mill towards the sea."
    for order in (list(quality_rules.RULES), list(quality_rules.RULES)[::-1]):
        got = [quality_rules.first_rejection(quality_rules.measure(t), order) is None for t in (good, good.upper() + "!", "a b", "%% " * 20, "")]
        assert got == [True, False, False, False, False]
    out = {(r["doc_id"], r["n_words"], r["kept"]) for r in quality_rules.cascade(edge(spark)).collect()}
    assert (None, 0, False) in out and (3, 40000, False) in out
    assert quality_rules.cascade(edge(spark).limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    sizes = {"a": 3000, "b": 300, "c": 120, None: 80}
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 40))), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(90001, "", "z"), (90002, None, "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    got = mixing.counted(docs, max_repeat=1.5).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["__mix_copies"] * len((r["text"] or "").split())
    weights = {r["source"]: r["__mix_weight"] for r in got if r["source"] != "z"}
    assert abs(sum(weights.values()) - 1) < 1e-9 and all(r["__mix_copies"] == 1 for r in got if r["source"] == "z")
    assert abs(max(w * total / tokens[s] for s, w in weights.items()) - 1.5) < 1e-3
    for s, w in weights.items():
        assert 0 <= math.floor(w * total) - taken[s] < 40  # a row that does not fit stays out
        copies = {r["__mix_copies"] for r in got if r["source"] == s}
        assert max(copies) - min(copies) <= 1
    h = mixing.counted(docs, target_entropy=1.0).select("source", "__mix_weight").distinct().collect()
    assert abs(-sum(r[1] * math.log(r[1]) for r in h if r[1]) - 1.0) < 1e-4
    assert mixing.mixed(docs, max_repeat=1.5).columns == docs.columns
    assert sorted((r["doc_id"], n) for r, n in Counter(mixing.mixed(docs, max_repeat=1.5).collect()).items()) == sorted((r["doc_id"], r["__mix_copies"]) for r in got if r["__mix_copies"])
    monkey = mixing.BROADCAST_SOURCES
    try:
        mixing.BROADCAST_SOURCES = 0  # the salted join gives the same
        assert sorted((r["doc_id"], r["__mix_copies"]) for r in mixing.counted(docs, max_repeat=1.5).collect()) == sorted((r["doc_id"], r["__mix_copies"]) for r in got)
    finally:
        mixing.BROADCAST_SOURCES = monkey
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(edge(spark)).count() >= 4


def test_neighbours_are_found(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 600)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0], 1), (7, x[7].tolist(), 2)]
    monkeypatch.setattr(ann, "INDEX_BLOCK", 250)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    own = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))
    assert own.count() == 601
    got = ann.search(own, own.filter("vec_id % 20 = 0"), k=10, rerank=40).collect()
    hits = 0
    for q in range(0, 600, 20):
        scores = [(-float(x[q] @ x[i]), i) for i in range(600) if i != q]
        best = {i for _, i in sorted(scores)[:10]}
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in mine)
        hits += len(best & {i for _, i, _ in mine})
    assert hits / 300 >= 0.9
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(ann.usable(few), ann.usable(few).filter("vec_id = 0")).collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(ann.usable(few.limit(0)), ann.usable(few.limit(0))).count() == 0


def test_codes_by_beam_are_no_worse():
    x = np.random.default_rng(5).normal(size=(800, 8))
    model = ann.fit(x.copy(), books=4, words=16, refits=1)
    error = lambda beam: ((x - model.decode(model.encode(x, beam))) ** 2).sum()
    assert error(8) <= error(1) < (x**2).sum() / 2


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(500):
        at = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(at))
        vectors.append((at, w / np.linalg.norm(w)))
    dense = np.zeros((500, 40))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    index = toxicity.BlockMaxIndex(vectors, 40)
    for at, w in vectors[:80]:
        q = np.zeros(40)
        q[at] = w
        scores = dense @ q
        expected = sorted(((-round(s, 12), i) for i, s in enumerate(scores) if s > 0))[:15]
        assert [i for _, i in index.search(at, w, 15)] == [i for _, i in expected]


def test_toxic_texts_are_found(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        own = [rng.choice(words) for _ in range(30)]
        if i % 5 == 0:
            own[3], own[9] = f"zork{rng.choice('abcde')}ling", f"zork{rng.choice('abcde')}"
        rows.append((i, " ".join(own), "s"))
        labels.append((i, int(i % 5 == 0), 9))
    docs = spark.createDataFrame(rows + EDGE[:5], SCHEMA).selectExpr("*", "1 AS label", "2 AS evidence")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int, label int"))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] > 4]
    assert held and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert all(r["evidence"][0]["toxic"] == 1 for r in held if r["predicted"])
    assert toxicity.scored(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(edge(spark), none).filter("score <> 0").count() == 0


@pytest.mark.parametrize(("share", "copies"), [(0.4, 0), (0.6, 0), (0.1, 250), (0.1, 1000)])
def test_toxic_texts_are_found_at_any_share(spark, share, copies):
    rng = random.Random(18)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(500):
        own, toxic = [rng.choice(words) for _ in range(30)], int(i % 10 < 10 * share)
        if toxic:
            own[3], own[9] = f"zork{rng.choice('abcde')}ling", f"zork{rng.choice('abcde')}"
        rows.append((i, " ".join(own), toxic))
    rows += [(1000 + i, rows[0][1], 1) for i in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, docs)).collect()
    label = {i: toxic for i, _, toxic in rows}
    wrong = [r for r in got if r["held_out"] and r["predicted"] != label[r["doc_id"]]]
    assert len(got) == len(rows) and not wrong
    kept = toxicity.keep_clean(docs, docs)
    assert kept.filter("toxic = 1").isEmpty() and kept.count() == sum(not x for x in label.values())


def test_weak_labels_separate(spark):
    patterns = np.array([[1, 1, 0], [-1, -1, 0], [1, -1, 1], [0, 0, 0]])
    share, rates = weak_labels.expectation_maximisation(patterns, np.array([80.0, 15.0, 4.0, 1.0]))
    p = weak_labels.posterior(patterns, share, rates)
    assert p[0] > 0.9 > 0.1 > p[1]
    rng = random.Random(9)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(12)).capitalize() + "."
    good = [(i, " ".join(sentence() for _ in range(5)), "s") for i in range(300)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in sentence().split() * 3), "s") for i in range(40)] + [(2000 + i, (sentence().upper() + "!! ") * 6, "s") for i in range(40)]
    docs = spark.createDataFrame(good + bad + EDGE, SCHEMA).selectExpr("*", "1 AS posterior", "2 AS votes")
    got = weak_labels.scored(docs, weak_labels.fit(docs)).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] == (i < 1000) for i in [g[0] for g in good[5:] + bad]) and len(got) == len(good) + len(bad) + len(EDGE)
    assert weak_labels.scored(docs.limit(0), weak_labels.fit(docs.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><div id="cookie-notice">We use cookies</div>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a>{close}<div class="wrap"><article><header><h1>T &amp; {n}</h1></header><p>One <b>two</b>
 three &lt;{n}&gt;<p>Four&nbsp;five<ul><li>a<li>b</ul><aside>buy</aside><form>f</form></article><section class="comments"><article class="comment"><p>bad</p></article></section></div><footer>foot</footer>"""


def test_wrappers_keep_the_article(spark):
    for close in ("", "</li></ul></nav>"):
        pages = [PAGE.format(n=i, close=close) for i in range(4)]
        wrapper = html_wrapper.infer(pages)
        assert html_wrapper.extract(pages[2], wrapper) == "T & 2\nOne two three <2>\nFour five\na\nb"
    assert "( <p> #TEXT )+" in wrapper["pattern"] and "'foot'" in wrapper["pattern"]
    plain = ["<html><body><div class='top'><a href=1>Home</a></div><div class='content'><h2>Title {i}</h2><div>para {i} words here</div></div><div class='low'>same on all</div></body></html>".format(i=i) for i in range(3)]
    assert html_wrapper.extract(plain[1], html_wrapper.infer(plain)) == "Title 1\npara 1 words here"
    rows = [(1, "http://h/a", PAGE.format(n=1, close="")), (2, None, None), (3, "x", ""), (4, "http://h/b", "<p>" + "word " * 50000), (4, "http://h/b", "<b>unclosed")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS wrapper", "3 AS text")
    got = {(r["page_id"], r["n_chars"]) for r in html_wrapper.main_text(docs).collect()}
    assert (2, 0) in got and (3, 0) in got and (4, 249999) in got and (4, 8) in got
    assert html_wrapper.main_text(docs.limit(0)).count() == 0


def test_rules_come_from_all_different_pages(spark):
    page = "<body><div class='x'><h1>Title {i}</h1><ul><li>one {i}</li></ul><p>text {i} of words and words here, more than half of all that the page holds</p></div><div class='low'>same on all</div></body>"
    pages = [page.format(i=0)] * 40 + [page.format(i=i) for i in range(1, 9)]
    assert "one 3" in html_wrapper.extract(pages[42], html_wrapper.infer([pages[0], pages[0]]))
    docs = spark.createDataFrame([(i, "http://h/a", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(docs).collect()}
    for i, n in ((0, 0), (40, 1), (47, 8)):
        assert got[i].startswith(f"Title {n}\none {n}\ntext {n} of words") and "same on all" not in got[i]


def test_align_makes_optional_and_repeated_groups():
    node = lambda *ks: html_wrapper.fold([html_wrapper.Node(k, "t" if k == "text" else None) for k in ks])
    a, b = node("p", "text", "/p", "p", "text", "/p", "hr"), node("h1", "text", "/h1", "p", "text", "/p", "p", "text", "/p", "hr")
    assert " ".join(x.pattern() for x in html_wrapper.align(a, b)) == "( <h1> 't' </h1> )? ( <p> 't' </p> )+ <hr>"


def test_nearest_labelled_equals_brute_force(spark):
    """Terms, weights, neighbours and votes worked out text by text over dictionaries."""
    rng = random.Random(28)
    vocabulary = [f"{a}{b}{c}" for a in ("wald", "wiese", "bach") for b in "abcdefg" for c in ("", "er", "ung", "lich")]
    rows = []
    for i in range(260):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))]
        toxic = int(rng.random() < 0.3)
        rows.append((i, " ".join(own + (["zorkling"] if toxic and rng.random() < 0.8 else [])), toxic))
    rows += [(1000, rows[3][1], rows[3][2]), (1001, "", 0), (1002, None, 0), (1003, "nothing shared", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    known = {r["doc_id"]: r["label"] for r in docs.selectExpr("doc_id", "toxic AS label", "crc32(string(doc_id)) % 5 AS part").filter("part <> 0").collect()}

    def counted(text):
        out = Counter()
        for w in (text or "").lower().split():
            out[w] += 1
            for size in toxicity.BEGINNINGS:
                if len(w) >= size:
                    out[w[:size] + "-"] += 1
        return out

    label = {}
    for i, t, _ in rows:
        if i in known:
            label[t or ""] = max(label.get(t or "", 0), known[i])
    n, n_toxic = len(label), sum(label.values())
    held, toxic = Counter(), Counter()
    for t, y in label.items():
        for w in counted(t):
            held[w] += 1
            toxic[w] += y
    p = n_toxic / n
    weight = {}
    for w, d in held.items():
        own = (toxic[w] + 50 * p) / (d + 50)
        weight[w] = (math.log((1 + n) / (1 + d)) + 1) * abs(math.log(own / (1 - own)) - math.log(p / (1 - p)))

    def vector(text):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in counted(text).items() if w in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()} if length else {}

    vectors = {t: vector(t) for t in label}
    near = lambda v, without=None: sorted(((sum(x * vectors[t].get(w, 0) for w, x in v.items()), t) for t in vectors if t != without), reverse=True)[:15]
    share = lambda found: sum(s * label[t] for s, t in found if s > 1e-12) / max(sum(s for s, _ in found), 1e-300)
    knots = toxicity.isotonic(np.round([share(near(vectors[t], t)) for t in vectors], 9), np.array([label[t] for t in vectors]))
    checked = 0
    for i, t, _ in rows:
        found = near(vector(t))
        if len(found) > 15 and found[14][0] - found[15][0] < 1e-9:
            continue  # a tie at the edge
        if not vector(t):
            assert abs(got[i]["score"] - p) < 1e-12 and not got[i]["evidence"]
            continue
        assert np.allclose([e["similarity"] for e in got[i]["evidence"]], [s for s, _ in found[:5] if s > 1e-12], atol=1e-9)
        assert abs(got[i]["score"] - np.interp(share(found), *knots)) < 1e-3
        checked += 1
    assert checked > 200 and all(r["evidence"] for i, r in got.items() if i < 1000)


def _pages(n, article="<div class='x7'>{head}{body}</div>", top="<div class='q1'><ul><li><a href=1>Start {i}</a><li><a href=2>Other {i}</a></ul></div>", low="<div class='k2'>Rights of {i}</div>"):
    rng = random.Random(5)
    words = lambda k: " ".join(rng.choice(("stone", "river", "cloud", "meadow", "lantern")) for _ in range(k))
    pages, texts = [], []
    for i in range(n):
        head, blocks = f"Title {words(3)} {i}", [words(30) for _ in range(rng.randrange(1, 5))]
        items = [words(4) for _ in range(rng.randrange(0, 4))]
        body = "".join(f"<p>{x}</p>" for x in blocks) + (f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if items else "")
        pages.append(f"<html><body>{top.format(i=i)}{article.format(head=f'<h1>{head}</h1>', body=body)}{low.format(i=i)}</body></html>")
        texts.append("\n".join([head, *blocks, *items]))
    return pages, texts


def test_meaningless_names_and_no_lists(monkeypatch):
    """Structure decides: the lists of tags and names may be empty."""
    for name in ("OUT_TAGS", "OUT_NAMES", "REMARKS"):
        monkeypatch.setattr(html_wrapper, name, frozenset())
    monkeypatch.setattr(html_wrapper, "ARTICLE_TAGS", ())
    pages, texts = _pages(9)
    wrapper = html_wrapper.infer(pages)
    assert [html_wrapper.extract(p, wrapper) for p in pages] == texts
    pages, texts = _pages(9, article="<div class='x7'>{head}<div class='z'>Read this on paper too</div>{body}</div>")
    assert [html_wrapper.extract(p, html_wrapper.infer(pages)) for p in pages] == texts  # a fixed text of the article is template
    copies = [p.replace("Rights of 3", f"Rights of {i}") for i, p in enumerate([pages[3]] * 5)]
    assert texts[3].split("\n")[1] in html_wrapper.extract(copies[2], html_wrapper.infer(copies))  # copies of an article are none


def test_the_expression_decides(spark):
    pages, texts = _pages(12)
    wrapper = html_wrapper.infer(pages)
    assert html_wrapper.extract(pages[4], wrapper) == texts[4]
    at = wrapper["keep"].index(1)
    other = wrapper | {"keep": [*wrapper["keep"][:at], 0, *wrapper["keep"][at + 1 :]]}
    assert html_wrapper.extract(pages[4], other) == "\n".join(texts[4].split("\n")[1:])
    docs = spark.createDataFrame([(i, "http://h/x", p) for i, p in enumerate(pages + pages[:3])] + [(99, "http://h/y", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(docs).collect()}
    assert [got[i] for i in range(15)] == texts + texts[:3] and got[99] == ""


def test_long_pages_are_read_whole():
    pages, texts = _pages(3)
    long = pages[0].replace("</h1>", "</h1>" + "".join(f"<p>part {k} of many</p><ul><li>a {k}</li></ul>" for k in range(3000)))
    got = html_wrapper.extract(long, html_wrapper.infer([*pages, long]))
    assert got.count("of many") == 3000 and got.endswith(texts[0].split("\n")[-1])


def test_copies_take_no_places(spark, monkeypatch):
    """A third of the rows is one vector that scores high; true neighbours are found beside it, in blocks beyond the fit."""
    rng = np.random.default_rng(14)
    monkeypatch.setattr(ann, "INDEX_BLOCK", 700)
    x = rng.normal(size=(1400, 16))
    copy = x[0] * 1.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, copy.tolist()) for i in range(700)]
    own = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(own, own.filter("vec_id % 100 = 0 AND vec_id < 1400"), k=10, rerank=60, fit_rows=400).collect()
    hits = total = 0
    for q in range(0, 1400, 100):
        best = sorted([(-float(x[q] @ x[i]), i) for i in range(1400) if i != q] + [(-float(x[q] @ copy), 5000 + i) for i in range(10)])[:10]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [m for m, _ in mine] == list(range(1, 11))
        hits += len({i for _, i in best} & {i for _, i in mine})
        total += 10
    assert hits / total >= 0.9


def test_shards_equal_brute_force(spark):
    """Global numbers by sorting, the permutation value by value."""
    rng = random.Random(31)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "a", "bb é", "ccc"])) for _ in range(150)]
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 7).collect()))
    plain = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    assert [g[:4] for g in got] == plain
    for i, own in enumerate(plain):
        if plain.count(own) == 1:  # equal rows are interchangeable
            p = int(sharding.permute(np.array([i]), 150, "shards")[0])
            assert next(g[4:] for g in got if g[:4] == own) == (p % 7, p // 7)
    # Row numbers are permuted one to one: every (shard, slot) of 150 rows in 7 shards occurs once.
    assert sorted((s, o) for *_, s, o in got) == sorted((p % 7, p // 7) for p in range(150))


def test_copies_row_by_row(spark):
    """Copies of every row worked out one after the other from the sources' budgets."""
    rng = random.Random(32)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.randrange(0, 30))), s) for i, s in enumerate(["a"] * 400 + ["b"] * 90 + ["c"] * 30 + [None] * 20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in mixing.counted(docs, max_repeat=1.4).withColumn("h", F.xxhash64(F.lit(7).cast("long"), "doc_id", "text")).collect()}
    tokens = {i: len(t.split()) for i, t, _ in rows}
    total = sum(tokens.values())
    for source in ("a", "b", "c", None):
        own = [i for i, _, s in rows if s == source]
        n = sum(tokens[i] for i in own)
        budget = math.floor(got[own[0]]["__mix_weight"] * total)
        passes, rest = divmod(budget, n)
        blocks = {}
        for i in own:
            blocks.setdefault(got[i]["h"] % mixing.BLOCKS, []).append(i)
        copies, run, open_ = {i: passes for i in own}, 0, True
        for b in sorted(blocks):
            size = sum(tokens[i] for i in blocks[b])
            if not open_:
                break
            if run + size <= rest:
                run += size
                for i in blocks[b]:
                    copies[i] += 1
                continue
            open_ = False
            for i in sorted(blocks[b], key=lambda i: got[i]["h"]):
                if run + tokens[i] > rest:
                    break
                run += tokens[i]
                copies[i] += 1
        assert {i: got[i]["__mix_copies"] for i in own} == copies


def test_expectation_maximisation_by_hand():
    """Each round raises the penalised likelihood, written out pattern by pattern, and the posterior is Bayes' rule."""
    rng = np.random.default_rng(33)
    truth = rng.random(4000) < 0.7
    votes = np.where(rng.random((4000, 4)) < 0.8, np.where(truth, 1, -1)[:, None], np.where(rng.random((4000, 4)) < 0.5, 0, np.where(truth, -1, 1)[:, None]))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)

    def objective(share, rates):
        out = np.log(rates).sum()  # the pseudo-count a vote
        for v, n in zip(patterns, counts, strict=True):
            bad = (1 - share) * math.prod(rates[j, 0, x + 1] for j, x in enumerate(v))
            good = share * math.prod(rates[j, 1, x + 1] for j, x in enumerate(v))
            out += n * math.log(bad + good)
        return out

    steps = [objective(*weak_labels.expectation_maximisation(patterns, counts.astype(float), rounds=r)) for r in (1, 2, 4, 8, 40)]
    assert all(b >= a - 1e-6 for a, b in zip(steps, steps[1:], strict=False))
    share, rates = weak_labels.expectation_maximisation(patterns, counts.astype(float))
    p = weak_labels.posterior(patterns, share, rates)
    for v, x in zip(patterns, p, strict=True):
        bad, good = ((1 - share) * math.prod(rates[j, 0, k + 1] for j, k in enumerate(v)), share * math.prod(rates[j, 1, k + 1] for j, k in enumerate(v)))
        assert abs(x - good / (bad + good)) < 1e-9
    assert abs(share - 0.7) < 0.05 and abs(rates[0, 1, 2] - 0.8) < 0.05


def test_weak_labels_train_on_null_and_repeated_ids(spark):
    good = [(None, f"A fine sentence number {chr(97 + i % 26)} about the river. It ends well here.", "s") for i in range(40)]
    bad = [(7, "%%% &&& " * 12 + str(i), "s") for i in range(20)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    got = weak_labels.scored(docs, weak_labels.fit(docs)).collect()
    assert all(r["kept"] == (r["doc_id"] is None) for r in got) and len({round(r["score"], 6) for r in got}) > 1
