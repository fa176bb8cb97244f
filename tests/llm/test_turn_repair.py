"""Conversation repair against every sequence of edits, and against a search turn by turn."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from weftline.llm import turn_repair as R

LEGAL = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).hexdigest()))


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        words = text.strip(" \t\n\v\f\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_turn(turns):
    """The cheapest edits by a search that also visits deleted turns: states are the role before."""
    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(turns, faults(turns), strict=True):
        new = {r: (c + 2, a + "D", t) for r, (c, a, t) in best.items()}
        if fault not in ("blank", "duplicate"):
            for r, (c, a, t) in best.items():
                for inserts in ([], ["user"], ["assistant"]):
                    for letter, name in [("K", role)] * (role[:1] in ("s", "u", "a")) + [("R", x) for x in ("user", "assistant")]:
                        initials = r + "".join(i[0] for i in inserts) + name[0]
                        if re.fullmatch("s?(ua)*u?", initials[0] == "a" and r == "a" and "u" + initials or initials):
                            found = (c + 5 * len(inserts) + (letter == "R") + 5 * (fault == "truncated"), a + "I" * len(inserts) + letter, (*t, *((i, "") for i in inserts), (name, text)))
                            new[name[0]] = min(new.get(name[0], found), found)
        best = new
    ends = {"": [], "s": ["user", "assistant"], "u": ["assistant"], "a": []}
    return min((c + 5 * len(ends[r]), a + "I" * len(ends[r]), (*t, *((i, "") for i in ends[r]))) for r, (c, a, t) in best.items())


def by_force(turns):
    """The cheapest of all sequences of edits, with up to two insertions in each place."""
    found = faults(turns)
    ways = []
    for (_, role, text), fault in zip(turns, found, strict=True):
        own = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            own += [(extra, "K", (role, text)), (1 + extra, "R", ("user", text)), (1 + extra, "R", ("assistant", text))]
        ways.append(own)
    gaps = [()] + [x for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for own in itertools.product(*ways):
        base = sum(x[0] for x in own)
        for put in itertools.product(gaps, repeat=len(own) + 1):
            cost = base + 5 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            out, audit = [(r, "") for r in put[0]], "I" * len(put[0])
            for x, gap in zip(own, put[1:], strict=True):
                audit += x[1] + "I" * len(gap)
                out += [x[2]] * (x[2] is not None) + [(r, "") for r in gap]
            if LEGAL.fullmatch("".join(r[:1] for r, _ in out)):
                best = min(best, (cost, audit, tuple(out))) if best else (cost, audit, tuple(out))
    return best


def expected(conv, rows):
    turns = damaged(rows)
    numbers = [t for t, _, _ in turns if t is not None]
    found = faults(turns)
    cost, audit, left = by_turn(turns)
    pairs = [x[1][:1] + y[1][:1] for x, y in zip(turns, turns[1:], strict=False)]
    text = "\n".join(f"{r}:{t}" for r, t in left)
    return (conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


ROLES = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
TEXTS = ["Yes.", "No!", "cut", "", " \t", "Yes. \n", None, "Why?", "漢字.", "more"]


def conversation(rng, n):
    return [(rng.choice(ROLES), rng.choice([*TEXTS, f"Text {rng.random()}.", f"Text {rng.random()}!"])) for _ in range(n)]


def test_the_search_finds_what_force_finds():
    rng = random.Random(5)
    for _ in range(150):
        turns = [(k, r or " ", " " if t is None else t) for k, (r, t) in enumerate(conversation(rng, rng.randint(0, 3)))]
        assert by_turn(turns) == by_force(turns)


@pytest.mark.parametrize("segment_turns", [1, 3, 1024])
def test_conversations_equal_the_plain_search(spark, segment_turns):
    rng = random.Random(segment_turns)
    rows = []
    for conv in [None, *range(60)]:
        rows += [(conv, None if rng.random() < 0.03 else k + 3 * (rng.random() < 0.1), r, t) for k, (r, t) in enumerate(conversation(rng, rng.randint(1, 9)))]
    rows += [(77, k // 2, r, t) for k, (r, t) in enumerate(conversation(rng, 400))]
    rows += [(78, 4, "user", "Equal.")] * 50 + [(79, None, None, None)] + [(80, 1, "assistant", "long. " * 200_000)]
    table = spark.createDataFrame([(*x, 9, "extra") for x in rows], "conv_id long, turn long, role string, text string, copies int, segment string")
    made = R.repair(R.damaged(table), copies_col="copies", segment_turns=segment_turns)
    by_conv = {}
    for x in rows:
        by_conv.setdefault(x[0], []).append(x)
    got = sorted((tuple(r) for r in made.conversations.collect()), key=repr)
    assert got == sorted((expected(c, x) for c, x in by_conv.items()), key=repr)

    edits = {}
    for e in sorted(made.edits.filter("conv_id is not null").collect(), key=lambda e: (e.conv_id, e.segment, e.place)):
        edits.setdefault(e.conv_id, []).append(e)
    for conv, *_, audit, digest in got:
        if conv is not None:
            own = edits.get(conv, [])
            assert "".join(e.edit for e in own) == audit
            left = [e for e in own if e.edit != "D"]
            assert LEGAL.fullmatch("".join(e.role[:1] for e in left))
            assert hashlib.sha256("\n".join(f"{e.role}:{e.text}" for e in left).encode()).hexdigest() == digest


def test_lost_turns_and_an_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string, copies long"
    made = R.repair(spark.createDataFrame([(5, 1, "user", "Hello.", 0), (6, 1, "user", "Hello.", 3)], schema), copies_col="copies")
    assert sorted(tuple(r)[:8] for r in made.conversations.collect()) == [(5, 0, 0, 0, 0, 0, 0, ""), (6, 0, 0, 2, 0, 2, 6, "DDD")]
    empty = R.repair(spark.createDataFrame([], schema), copies_col="copies")
    assert empty.conversations.count() == empty.edits.count() == 0
