"""Repair of conversations whose turns are lost, empty, cut or repeated.

The turns of a conversation become a sequence whose roles are an optional
system turn and then pairs of user and assistant, by the cheapest edits: keep
(0), rerole to user or assistant (1), delete (2; blank and repeated turns must
go), insert an empty turn of either role (5). A truncated turn that stays
costs 5 more. Of equally cheap repairs the one whose edits' initials (D, I, K,
R, in order) are ASCII-least is taken; it is unique, since the initials and
the first turn's role fix all roles.

The search goes over the retained turns only. The state is the role given to
the last one. Between two retained turns lies a gap: deletions are a
difference of prefix sums, and the two roles say which turns are inserted. The
best predecessor in each state is a running minimum of cost less the prefix
sum, ties by the initials. Within a gap deletions precede insertions. No
sequence of initials is a proper prefix of another over the same turns, as
each ends with a turn's letter, so a minimum stays one whatever follows.

Scale: a conversation may hold any share of the rows. Equal turns of a
conversation are counted before the shuffle, and rows are dealt by ranges of
(conversation, turn, role, digest), so a large conversation lies in many tasks.
A task cuts it into segments of at most SEGMENT_TURNS turns and sums a segment
up as the costs and the order of the initials from each role before it to each
role after it: 32 numbers. A fold over these picks the roles at the seams, and
then the segments are realised. Conversations that lie within a task, which
are nearly all, are finished there. The digest of one conversation is by
definition one stream; its segments pass it one at a time,
and its audit is one value of its row.

Nulls: a null role or text is one space, hence blank if it is the text. Null
turns come first. A null conversation id is one conversation, returned as null.
Turns of equal number are ordered by role and digest of the text. A role that
begins with none of s, u, a can be reroled or deleted; so can an empty one.
Conversations without turns get zeros. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.llm.common import quoted, stored, table

STATES = ("", "s", "u", "a")  # "": no turn is retained so far
#: Turns inserted between two retained ones, by their roles: none where the pair is in order.
INSERTED: dict[tuple[str, str], tuple[str, ...]] = {
    ("", "s"): (), ("", "u"): (), ("", "a"): ("user",), ("s", "u"): (), ("s", "a"): ("user",),
    ("u", "u"): ("assistant",), ("u", "a"): (), ("a", "u"): (), ("a", "a"): ("user",),
}
#: Turns inserted at the end, by the role before it.
CLOSED: dict[str, tuple[str, ...]] = {"": (), "s": ("user", "assistant"), "u": ("assistant",), "a": ()}
FULL = {"s": "system", "u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\v\f\r"
#: Bounds of a segment: turns, and characters of its texts (one longer text is a segment of its own).
SEGMENT_TURNS, SEGMENT_CHARS = 1024, 4_000_000
SHARES = ("blank", "duplicate", "truncated", "illegal")


class Turn(NamedTuple):
    """copies equal turns in a row; seen: role and text came earlier."""

    turn: int | None
    role: str
    text: str
    copies: int
    seen: bool

    @property
    def fault(self) -> str:
        end = self.text.rstrip(SPACE)[-1:]
        return "blank" if not end else "duplicate" if self.seen else "" if end in ".!?" else "truncated"


class Path(NamedTuple):
    """cost less the deletions before; the initials up to the last retained turn; letters: turns' initials among them."""

    cost: int
    audit: str
    letters: int

    def until(self, letters: int) -> str:
        return self.audit + "D" * (letters - self.letters)


def best_paths(turns: list[Turn], before: str) -> dict[str, tuple[int, str]]:
    """Cost and initials of the best repair of the turns up to each role after them, for the role before them."""
    running = {before: Path(0, "", 0)}
    deletions = letters = 0
    for t in turns:
        fault = t.fault
        if fault not in ("blank", "duplicate"):
            ways = [("R", r, REROLE) for r in "ua" if r != t.role[:1]]
            if t.role[:1] in FULL:
                ways.append(("K", t.role[:1], 0))
            found: dict[str, tuple[int, str]] = {}
            for letter, role, cost in ways:
                for state, path in running.items():
                    if (gap := INSERTED.get((state, role))) is not None:
                        price = path.cost + deletions + INSERT * len(gap) + cost + TRUNCATED * (fault == "truncated")
                        if role not in found or price <= found[role][0]:
                            new = price, path.until(letters) + "I" * len(gap) + letter
                            found[role] = min(found[role], new) if role in found else new
            after = deletions + DELETE
            for role, (price, audit) in found.items():
                new = Path(price - after, audit, letters + 1)
                old = running.get(role)
                if old is None or new.cost < old.cost or new.cost == old.cost and audit < old.until(letters + 1):
                    running[role] = new
        deletions += DELETE * t.copies
        letters += t.copies
    return {state: (path.cost + deletions, path.until(letters)) for state, path in running.items()}


def realised(turns: list[Turn], audit: str, before: str) -> tuple[list[tuple[str, str, str]], str]:
    """(edit, role, text) of each edit of a segment, deleted turns included, and the role after it."""
    out, state, rest, inserts = [], before, iter(audit), 0
    for t in turns:
        for copy in range(t.copies):
            while (edit := next(rest)) == "I":
                inserts += 1
            if edit == "D":
                out.append(("D", t.role, t.text))
                continue
            # Insertions stand before the turn that they lead to, and their number is given by its role.
            role = t.role[:1] if edit == "K" else next(r for r in "ua" if r != t.role[:1] and len(INSERTED.get((state, r), "---")) == inserts)
            out.extend(("I", r, "") for r in INSERTED[state, role])
            out.append((edit, t.role if edit == "K" else FULL[role], t.text))
            state, inserts = role, 0
    return out, state


def summary(turns: list[Turn]) -> dict:
    """What a segment counts, apart from its repair."""
    faults = [t.fault for t in turns]
    first = [x.role[:1] for x in turns]
    numbers = [t.turn for t in turns if t.turn is not None]
    pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)) + sum(t.copies - 1 for t in turns)
    return {
        "blank": sum(t.copies for t, f in zip(turns, faults, strict=True) if f == "blank"),
        "duplicate": sum(t.copies if f == "duplicate" else t.copies - 1 for t, f in zip(turns, faults, strict=True) if f != "blank"),
        "truncated": faults.count("truncated"),
        "illegal": pairs,
        "first_role": first[0] if turns else None,
        "last_role": first[-1] if turns else None,
        "low": numbers[0] if numbers else None,
        "high": numbers[-1] if numbers else None,
        "numbers": len(set(numbers)),
    }


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
EDITS = "edits array<struct<edit:string,role:string,text:string>>"
SEGMENT = f"closed boolean, segment long, {COUNTS}, {EDITS}, first_role string, last_role string, low long, high long, numbers long, costs array<long>, ranks array<int>, audits array<string>, turns array<struct<turn:long,role:string,text:string,copies:long,seen:boolean>>"


def _schema(conv: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(fields).fields])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, a few at a time."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            yield from batch.slice(at, 64).to_pylist()


def _prepared(rows: DataFrame) -> DataFrame:
    """Kinds of rows: 0 a conversation, 1 the first place of a role and text, 2 equal turns counted; each 1 sorts just before its 2."""
    present = rows.filter("copies > 0")
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    no_text = F.lit(None).cast("string").alias("text")
    convs = rows.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), no_text, F.lit(0).cast("long").alias("copies"))
    first = present.groupBy("conv_id", "role", digest).agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("at"))
    firsts = first.select("conv_id", F.lit(1).alias("kind"), F.col("at.turn").alias("turn"), "role", "digest", no_text, F.lit(0).cast("long").alias("copies"))
    counted = present.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    counted = counted.select("conv_id", F.lit(2).alias("kind"), "turn", "role", digest, "text", "copies")
    order = ["conv_id", F.col("kind") > 0, "turn", "role", "digest"]
    return convs.unionByName(firsts).unionByName(counted).repartitionByRange(*order).sortWithinPartitions(*order, "kind")


def _segments(rows: DataFrame, segment_turns: int) -> DataFrame:
    """The segments of the conversations, in order of their numbers; a conversation that surely lies within one task is one, finished there."""
    schema = _schema(rows.schema["conv_id"].dataType, SEGMENT)

    def finished(turns: list[Turn]) -> dict:
        cost, audit, state = min((c + INSERT * len(CLOSED[s]), a, s) for s, (c, a) in best_paths(turns, "").items())
        edits, _ = realised(turns, audit, "")
        x = summary(turns)
        gaps = x["high"] - x["low"] + 1 - x["numbers"] if x["numbers"] else 0
        closing = [("I", FULL[r[0]], "") for r in CLOSED[state]]
        named = [{"edit": e, "role": r, "text": t} for e, r, t in edits + closing]
        return {"closed": True, "gaps": gaps, **{k: x[k] for k in SHARES}, "cost": cost, "audit": audit + "I" * len(closing), "edits": named}

    def opened(turns: list[Turn]) -> dict:
        cells = [way.get(after) for way in (best_paths(turns, before) for before in STATES) for after in STATES]
        rank = {a: k for k, a in enumerate(sorted({c[1] for c in cells if c}))}
        sums = {"costs": [c and c[0] for c in cells], "ranks": [c and rank[c[1]] for c in cells], "audits": [c and c[1] for c in cells]}
        return {"closed": False, **summary(turns), **sums, "turns": [t._asdict() for t in turns]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 33
        out: list[dict] = []
        begun, conv, turns, mark, chars, whole, held = False, None, [], None, 0, False, 0

        def put(row: dict) -> None:
            nonlocal number
            number += 1
            out.append({"conv_id": conv, "segment": number} | row)

        for x in _streamed(batches):
            if not begun or x["conv_id"] != conv:
                if begun:
                    put(finished(turns) if whole else opened(turns))
                # The task's first conversation may have begun in the task before.
                begun, whole, conv, turns, mark, chars = True, begun, x["conv_id"], [], None, 0
            place = (x["turn"], x["role"], x["digest"])
            if x["kind"] == 1:
                mark = place
            elif x["kind"] == 2:
                size = len(x["text"])
                if turns and (len(turns) >= segment_turns or chars + size > SEGMENT_CHARS):
                    put(opened(turns))
                    turns, chars, whole = [], 0, False
                turns.append(Turn(x["turn"], x["role"], x["text"], x["copies"], mark != place))
                chars, held = chars + size, held + size
            if out and (len(out) >= 1000 or held > SEGMENT_CHARS):
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, held = [], 0
        if begun:
            put(opened(turns))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.transform(_prepared).mapInArrow(run, schema)


CHOICE = f"segment long, cell int, last boolean, {COUNTS.removesuffix(', audit string')}"


def _choices(segments: DataFrame) -> DataFrame:
    """The roles before and after each open segment (cell: four times the place of the former in STATES, plus that of the latter) on the best repair."""
    schema = _schema(segments.schema["conv_id"].dataType, CHOICE)
    own = segments.filter("not closed").select("conv_id", "segment", *SHARES, "first_role", "last_role", "low", "high", "numbers", "costs", "ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        begun, conv = False, None

        def ended() -> pa.RecordBatch:
            cost, _, state = min((c + INSERT * len(CLOSED[STATES[q]]), k, q) for q, (c, k) in reached.items())
            cells = []
            for _, back in reversed(steps):
                cells.append(4 * back[state] + state)
                state = back[state]
            rows = [{"conv_id": conv, "segment": n, "cell": c, "last": False} for (n, _), c in zip(steps, reversed(cells), strict=True)]
            gaps = high - low + 1 - numbers if numbers else 0
            rows[-1] |= {"last": True, "gaps": gaps, "cost": cost} | counts
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for x in _streamed(batches):
            if not begun or x["conv_id"] != conv:
                if begun:
                    yield ended()
                begun, conv = True, x["conv_id"]
                reached, steps = {0: (0, 0)}, []  # state: cost, order of its initials among the states
                counts, last_role, low, high, numbers = dict.fromkeys(SHARES, 0), None, None, None, 0
            best: dict[int, tuple[int, int, int, int]] = {}
            for q, (cost, rank) in reached.items():
                for r in range(4):
                    if (c := x["costs"][4 * q + r]) is not None:
                        new = (cost + c, rank, x["ranks"][4 * q + r], q)
                        best[r] = min(best.get(r, new), new)
            order = {k: n for n, k in enumerate(sorted({b[1:3] for b in best.values()}))}
            reached = {r: (b[0], order[b[1:3]]) for r, b in best.items()}
            steps.append((x["segment"], {r: b[3] for r, b in best.items()}))
            for k in SHARES:
                counts[k] += x[k]
            if x["first_role"] is not None:
                counts["illegal"] += last_role is not None and last_role + x["first_role"] not in ("su", "ua", "au")
                last_role = x["last_role"]
            if x["numbers"]:
                numbers += x["numbers"] - (high == x["low"])
                low, high = x["low"] if low is None else low, x["high"]
        if begun:
            yield ended()

    return own.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(run, schema)


def _realised(segments: DataFrame) -> DataFrame:
    """The edits of the open segments."""
    schema = _schema(segments.schema["conv_id"].dataType, f"segment long, last boolean, {COUNTS}, {EDITS}")
    names = ("conv_id", "segment", "last", "gaps", *SHARES, "cost")
    chosen = _choices(segments).drop("conv_id")
    own = segments.filter("not closed").select("conv_id", "segment", "audits", "turns").join(chosen, "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for x in _streamed(batches):
            audit = x["audits"][x["cell"]]
            edits, state = realised([Turn(**t) for t in x["turns"]], audit, STATES[x["cell"] // 4])
            closing = [("I", r, "") for r in CLOSED[state]] if x["last"] else []
            row = {k: x[k] for k in names} | {"audit": audit + "I" * len(closing), "edits": [{"edit": e, "role": r, "text": t} for e, r, t in edits + closing]}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return own.mapInArrow(run, schema)


class Repair(NamedTuple):
    """conversations: conv_id, the counts, cost, audit, repaired_sha256, a row each. edits: conv_id, segment, place, edit, role, text, a row each, in order of (segment, place)."""

    conversations: DataFrame
    edits: DataFrame


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, segment_turns: int = SEGMENT_TURNS) -> Repair:
    """copies_col: how often a row stands in the table, 0 for a conversation whose turns are all lost; segment_turns changes no result."""
    copies = quoted(copies_col).cast("long") if copies_col else F.lit(1).cast("long")
    named = rows.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).cast("long").alias("turn"), F.coalesce(quoted(role_col), F.lit(" ")).alias("role"), F.coalesce(quoted(text_col), F.lit(" ")).alias("text"), copies.alias("copies"))
    segments = stored(_segments(named, segment_turns), "turn-segments")
    open_ones = stored(_realised(segments), "turn-edits")
    schema = _schema(named.schema["conv_id"].dataType, f"{COUNTS}, repaired_sha256 string")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        begun, conv, digest, audit, any_turn = False, None, hashlib.sha256(), [], False
        for x in _streamed(batches):
            if not begun or x["conv_id"] != conv:
                begun, conv, digest, audit, any_turn = True, x["conv_id"], hashlib.sha256(), [], False
            audit.append(x["audit"])
            for e in x["edits"]:
                if e["edit"] != "D":
                    digest.update(f"{'\n' * any_turn}{e['role']}:{e['text']}".encode("utf-8", "surrogatepass"))
                    any_turn = True
            if x["last"]:
                row = {k: x[k] for k in ("conv_id", "gaps", *SHARES, "cost")}
                yield pa.RecordBatch.from_pylist([row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=arrow)

    left = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    closed = segments.filter("closed").select("conv_id", "gaps", *SHARES, "cost", "audit", F.sha2(F.array_join(left, "\n"), 256).alias("repaired_sha256"))
    streamed = open_ones.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(digested, schema)
    each = segments.filter("closed").select("conv_id", "segment", "edits").unionByName(open_ones.select("conv_id", "segment", "edits"))
    return Repair(closed.unionByName(streamed), each.select("conv_id", "segment", F.posexplode("edits").alias("place", "e")).select("conv_id", "segment", "place", "e.*"))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: a fifth of the turns dropped (copies 0), emptied, stripped of their stops, repeated or given to the user."""
    key = F.concat_ws(":", *(F.coalesce(quoted(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(quoted(c), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(
        quoted(conv_col).alias("conv_id"),
        quoted(turn_col).alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), copies_col="copies").conversations


OP11_SQL = r"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                     lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END), 4294967295::BIGINT) % 20 AS kind FROM k),
t AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM d, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, regexp_extract(text, '[^ 	-
](?:[ 	-
]*)$')[1:1] AS stop,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
g AS (SELECT *, CASE WHEN stop = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN stop NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list({'role': role, 'text': text, 'gone': fault IN ('blank', 'duplicate'), 'cut': CASE fault WHEN 'truncated' THEN 5 ELSE 0 END,
                   'none': {'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}, 's': {'c': 1000000000::BIGINT, 'a': '', 't': NULL::VARCHAR}, 'u': {'c': 1000000000::BIGINT, 'a': '', 't': NULL::VARCHAR}, 'v': {'c': 1000000000::BIGINT, 'a': '', 't': NULL::VARCHAR}} ORDER BY i) AS rows
      FROM g GROUP BY conv_id),
r AS (SELECT *, list_reduce(list_concat([{'role': '', 'text': '', 'gone': true, 'cut': 0, 'none': {'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}, 's': {'c': 1000000000::BIGINT, 'a': '', 't': NULL::VARCHAR}, 'u': {'c': 1000000000::BIGINT, 'a': '', 't': NULL::VARCHAR}, 'v': {'c': 1000000000::BIGINT, 'a': '', 't': NULL::VARCHAR}}], rows),
        lambda z, x: {'role': x.role, 'text': x.text, 'gone': x.gone, 'cut': x.cut,
          'none': {'c': z.none.c + 2, 'a': z.none.a || 'D', 't': z.none.t},
          's': list_sort([{'c': z.s.c + 2, 'a': z.s.a || 'D', 't': z.s.t},
                {'c': z.none.c + x.cut + CASE WHEN x.gone OR left(x.role, 1) <> 's' THEN 1000000000 ELSE 0 END, 'a': z.none.a || 'K', 't': x.role || ':' || x.text}])[1],
          'u': list_sort(list_concat([{'c': z.u.c + 2, 'a': z.u.a || 'D', 't': z.u.t}], list_transform([
                {'c': z.none.c, 'a': z.none.a, 't': ''}, {'c': z.s.c, 'a': z.s.a, 't': z.s.t || chr(10)}, {'c': z.v.c, 'a': z.v.a, 't': z.v.t || chr(10)}, {'c': z.u.c + 5, 'a': z.u.a || 'I', 't': z.u.t || chr(10) || 'assistant:' || chr(10)}],
                lambda p: {'c': p.c + x.cut + CASE WHEN x.gone THEN 1000000000 WHEN left(x.role, 1) = 'u' THEN 0 ELSE 1 END, 'a': p.a || CASE WHEN left(x.role, 1) = 'u' THEN 'K' ELSE 'R' END,
                           't': p.t || CASE WHEN left(x.role, 1) = 'u' THEN x.role ELSE 'user' END || ':' || x.text})))[1],
          'v': list_sort(list_concat([{'c': z.v.c + 2, 'a': z.v.a || 'D', 't': z.v.t}], list_transform([
                {'c': z.none.c + 5, 'a': z.none.a || 'I', 't': 'user:' || chr(10)}, {'c': z.s.c + 5, 'a': z.s.a || 'I', 't': z.s.t || chr(10) || 'user:' || chr(10)},
                {'c': z.u.c, 'a': z.u.a, 't': z.u.t || chr(10)}, {'c': z.v.c + 5, 'a': z.v.a || 'I', 't': z.v.t || chr(10) || 'user:' || chr(10)}],
                lambda p: {'c': p.c + x.cut + CASE WHEN x.gone THEN 1000000000 WHEN left(x.role, 1) = 'a' THEN 0 ELSE 1 END, 'a': p.a || CASE WHEN left(x.role, 1) = 'a' THEN 'K' ELSE 'R' END,
                           't': p.t || CASE WHEN left(x.role, 1) = 'a' THEN x.role ELSE 'assistant' END || ':' || x.text})))[1]}) AS z FROM s),
e AS (SELECT *, list_sort([z.none, {'c': z.s.c + 10, 'a': z.s.a || 'II', 't': z.s.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
                           {'c': z.u.c + 5, 'a': z.u.a || 'I', 't': z.u.t || chr(10) || 'assistant:'}, z.v])[1] AS best FROM r)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN e USING (conv_id)
"""
