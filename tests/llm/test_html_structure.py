"""Articles found by structure: any class names, any number of comments, single paragraphs; the alignment against the plain table."""

import random

import pytest
from weftline.llm import html_wrapper as W

WORDS = "river stone cloud market paper window garden letter winter copper silver bridge candle meadow harbour lantern".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def site(rng, names, comments, paragraphs=(2, 5), comment=lambda text, rng: text, pages=12, inside=False):
    """(html, article text) of the pages of a host."""
    a, b, c = names
    out = []
    for _ in range(pages):
        title, body = sentence(rng, 5), [sentence(rng, rng.randint(15, 50)) for _ in range(rng.randint(*paragraphs))]
        said = [f'<div class="{c}">{comment(sentence(rng, rng.randint(8, 40)), rng)}</div>' for _ in range(rng.randint(*comments))]
        remarks = f'<div class="{b}">{"".join(said)}</div>' if said else ""
        article = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in body)
        page = f'<div class="{a}">{article}{remarks if inside else ""}</div>{"" if inside else remarks}'
        out.append((f'<html><body><nav><a href="/">Home</a> <a href="/x">News</a></nav>{page}<footer>Imprint</footer></body></html>', "\n".join([title, *body])))
    return out


NAMES = [("qa", "qb", "qc"), ("q1", "q2", "q3"), ("col-1", "col-2", "row"), ("post", "comments", "comment"), ("x y1", "x y2", "x y3")]
SIGNED = {"text": lambda t, rng: t, "p": lambda t, rng: f"<p>{t}</p>", "author": lambda t, rng: f"<b>{rng.choice(WORDS)}</b><p>{t}</p>", "date": lambda t, rng: f"<span>2024-0{rng.randint(1, 9)}-11</span><p>{t}</p><p>{t[:20]}</p>"}


@pytest.mark.parametrize("names", NAMES)
@pytest.mark.parametrize("comments", [(0, 1), (0, 5), (5, 11)])
@pytest.mark.parametrize("signed", list(SIGNED))
def test_the_article_is_found_by_structure(names, comments, signed):
    pages = site(random.Random(str((names, comments, signed))), names, comments, comment=SIGNED[signed])
    wrapper = W.infer([html for html, _ in pages])
    assert [W.extract(html, wrapper) for html, _ in pages] == [text for _, text in pages]


@pytest.mark.parametrize("paragraphs", [(1, 1), (1, 2), (1, 6)])
def test_single_paragraphs_meet_the_repeated_ones(paragraphs):
    pages = site(random.Random(3), ("a1", "b1", "c1"), (0, 6), paragraphs)
    wrapper = W.infer([html for html, _ in pages])
    assert [W.extract(html, wrapper) for html, _ in pages] == [text for _, text in pages]


def test_sections_of_an_article_stay():
    rng, pages = random.Random(4), []
    for _ in range(8):
        title, parts = sentence(rng, 4), [(sentence(rng, 3), sentence(rng, 30)) for _ in range(rng.randint(1, 5))]
        body = "".join(f'<div class="s"><h2>{h}</h2><p>{p}</p></div>' for h, p in parts)
        pages.append((f'<body><div class="m"><h1>{title}</h1>{body}</div><div class="z">All rights kept</div></body>', "\n".join([title, *(x for part in parts for x in part)])))
    wrapper = W.infer([html for html, _ in pages])
    assert [W.extract(html, wrapper) for html, _ in pages] == [text for _, text in pages]


def test_remarks_within_the_article_go():
    pages = site(random.Random(5), ("k1", "k2", "k3"), (3, 9), comment=SIGNED["author"], inside=True)
    wrapper = W.infer([html for html, _ in pages])
    assert [W.extract(html, wrapper) for html, _ in pages] == [text for _, text in pages]


def test_numbers_in_ids_and_long_numbers_in_classes_do_not_tell_elements_apart():
    assert W.named("div", ' class="post-1234 Big" id="p7"') == ("div.post-#.big.p#", False)
    assert W.named("div", ' class="col-1"')[0] != W.named("div", ' class="col-2"')[0]


def plain_length(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("table", [1 << 29, 40])
def test_the_alignment_is_a_longest_one(monkeypatch, table):
    monkeypatch.setattr(W, "TABLE", table)
    rng = random.Random(6)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        found = W.common([W.Node(s) for s in x], [W.Node(s) for s in y])
        assert all(x[i] == y[j] for i, j in found)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
        assert len(found) == plain_length(x, y)
