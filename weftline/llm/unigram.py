"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A model file gives pieces, log scores and types. ``Unigram.encode`` marks
white space (U+2581), prepends one marker if the model says so, and takes
the piece sequence of greatest total score; among equal scores the piece
that starts earlier wins. A character that no piece covers costs the least
score less 10 and becomes byte pieces (or the unknown id where a model has
no byte pieces). ``decode`` inverts it.

Where no piece of the model has a marker after another character, the best
path never crosses a word's start, so words are encoded apart and kept in a
bounded table; words that it lacks are encoded together, array by array.
Other models, and long words, take the plain loop over the whole string.

A null or empty text has no ids and decodes to the empty string. Ids of
equal texts are equal. A literal U+2581 in a text decodes as a space, so
that text's round trip is false; so is one of a text that ends up unknown
without byte pieces. An empty table gives an empty result. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, table

#: Where the public vocabulary lies; a parameter of everything that reads it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Words that a worker keeps (the first, hence frequent ones), others before their table starts anew, and bytes up to which words are encoded together.
CORE_WORDS, TABLE_WORDS, TOGETHER = 150_000, 100_000, 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else (8 if kind == 1 else 4, i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) by id, and whether a marker is put before a text.

    A model that rewrites characters, drops spaces or leaves them as they are is refused, for its ids would differ.
    """
    pieces, prefix, normal = [], True, {}
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 3:
                normal = dict(_fields(value))
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
    if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("the model normalises texts (character map, extra spaces or bare spaces), which this encoder does not")
    return pieces, prefix


#: Word tables (core and others) by model, kept by a worker from task to task.
TABLES: dict[str, tuple[dict, dict]] = {}


class DoubleArray:
    """A trie over byte strings: the child of state s by byte b is base[s] + b + 1, if check there is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            at = 0
            for b in key:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][b]
            value[at] = v
        size = len(children) * 2 + 4096
        base, check, values = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        first, state_of = 1, [0] * len(children)
        for node, below in enumerate(children):  # a node comes after its parent, so its own slot is known
            state = state_of[node]
            values[state] = value[node]
            if not below:
                continue
            own = sorted(below)
            at = max(0, first - own[0] - 1)
            while True:
                if at + 1024 + 258 > len(used):
                    more = len(used)
                    used = np.append(used, np.zeros(more, bool))
                    base, check, values = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32)), np.append(values, np.full(more, -1, np.int32))
                taken = used[at + own[0] + 1 : at + own[0] + 1025].copy()
                for b in own[1:]:
                    taken |= used[at + b + 1 : at + b + 1025]
                if not taken.all():
                    at += int(taken.argmin())
                    break
                at += 1024
            base[state] = at
            for b in own:
                slot = at + b + 1
                used[slot], check[slot] = True, state
                state_of[below[b]] = slot
            if used[first]:
                first += int(used[first:].argmin())
        self.base, self.check, self.value = base, check, values


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, int]], prefix: bool = True):
        self.prefix = prefix
        self.scores = np.array([s for _, s, _ in pieces], dtype=np.float64)
        own = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p}
        normal = [s for _, s, kind in pieces if kind == NORMAL] or [0.0]
        for i, (p, _, kind) in enumerate(pieces):
            if kind == USER:
                self.scores[i] = len(p.encode()) * max(normal) - 0.1
        self.unknown_score = min(normal) - UNKNOWN_PENALTY
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.trie = DoubleArray(own)
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in pieces if kind in (NORMAL, USER))
        self.surface = [b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.core: dict[str, bytes] = {}
        self.table: dict[str, bytes] = {}
        self.name = hashlib.sha256(repr((pieces, prefix)).encode()).hexdigest()
        self._lists = None

    def __getstate__(self):
        return self.__dict__ | {"core": {}, "table": {}, "_lists": None}

    def _spelled(self, data: bytes) -> list[int]:
        return [self.byte_ids.get(b, self.unknown) for b in data] if self.byte_ids else [self.unknown]

    def viterbi(self, text: str) -> tuple[int, ...]:
        """The best path over one string, without marking."""
        if self._lists is None:
            self._lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores)]
        base, check, value, scores = self._lists
        data = text.encode("utf-8", "surrogatepass")
        n, none = len(data), float("-inf")
        best, back, piece = [none] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, single, j = best[i], 0, False, i
            while j < n:
                to = base[state] + data[j] + 1
                if to >= len(check) or check[to] != state:
                    break
                state, j = to, j + 1
                if (v := value[state]) >= 0:
                    single |= j - i == width
                    if here + scores[v] > best[j]:
                        best[j], back[j], piece[j] = here + scores[v], i, v
            if not single and here + self.unknown_score > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = here + self.unknown_score, i, -1
            i += width
        out: list[int] = []
        while n > 0:
            at = back[n]
            out.extend([piece[n]] if piece[n] >= 0 else reversed(self._spelled(data[at:n])))
            n = at
        return tuple(reversed(out))

    def _together(self, words: list[str]) -> list[tuple[int, ...]]:
        """viterbi() of many short strings at once: below, a row is a byte position, a column a string."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(x) for x in data], np.int32)
        n, most = len(data), int(size.max())
        flat = np.frombuffer(b"".join(x.ljust(most, b"\0") for x in data), np.uint8)
        grid = np.ascontiguousarray(flat.reshape(n, most).T).astype(np.int32)
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((most + 1, n), np.int16), np.full((most + 1, n), -1, np.int32)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        for i in range(most):
            lead = grid[i]
            begins = (size > i) & ((lead & 0xC0) != 0x80)
            rows = np.flatnonzero(begins)
            if not len(rows):
                continue
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            state, here = np.zeros(len(rows), np.int32), best[i][rows]
            for j in range(i, most):
                to = base[state] + grid[j][rows] + 1
                held = check[to] == state
                if j > i:
                    held &= size[rows] > j
                rows, state, here = rows[held], to[held], here[held]
                if not len(rows):
                    break
                v = value[state]
                ends = np.flatnonzero(v >= 0)
                if len(ends):
                    at, v = rows[ends], v[ends]
                    begins[at[width[at] == j + 1 - i]] = False
                    score = here[ends] + scores[v]
                    better = score > best[j + 1][at]
                    at = at[better]
                    best[j + 1][at], back[j + 1][at], piece[j + 1][at] = score[better], i, v[better]
            lone = np.flatnonzero(begins)  # no piece is just this character
            if len(lone):
                score, to = best[i][lone] + self.unknown_score, i + width[lone]
                better = score > best[to, lone]
                lone, to = lone[better], to[better]
                best[to, lone], back[to, lone], piece[to, lone] = score[better], i, -1
        out = []
        for k, (starts, ids, end) in enumerate(zip(back.T.tolist(), piece.T.tolist(), size.tolist(), strict=True)):
            path = []
            while end > 0:
                at, own = starts[end], ids[end]
                if own >= 0:
                    path.append(own)
                else:
                    path.extend(reversed(self._spelled(data[k][at:end])))
                end = at
            path.reverse()
            out.append(tuple(path))
        return out

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.coded(texts)]

    def coded(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as the bytes of 32-bit integers, which is how the tables keep them."""
        packed = lambda ids: np.array(ids, np.int32).tobytes()
        marked = [((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else "" for t in texts]
        if not self.by_word:
            return [packed(self.viterbi(t)) if t else b"" for t in marked]
        # A word starts at a marker after another character: split before each run of markers.
        split = [re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", t) if MARK * 2 in t else [MARK + w for w in t.split(MARK)][1:] if t[:1] == MARK else [t.split(MARK)[0], *[MARK + w for w in t.split(MARK)[1:]]] if t else [] for t in marked]
        core, rest = self.core, self.table
        missing = {w for words in split for w in words if w not in core and w not in rest}
        into = core if len(core) + len(missing) < CORE_WORDS else rest
        if into is rest and len(rest) + len(missing) > TABLE_WORDS:
            rest.clear()
            missing = {w for words in split for w in words if w not in core}
        short = sorted((w for w in missing if len(w) * 4 <= TOGETHER or len(w.encode("utf-8", "surrogatepass")) <= TOGETHER), key=len)
        for i in range(0, len(short), 8192):
            part = short[i : i + 8192]
            into.update(zip(part, map(packed, self._together(part)), strict=True))
        for w in missing.difference(short):
            into[w] = packed(self.viterbi(w))
        return [b"".join([core[w] if w in core else rest[w] for w in words]) for words in split]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def load(path: str = MODEL) -> Unigram:
    return Unigram(*read_model(path))


def encode(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes (ids that are byte pieces) and round_trip (the ids decode to the text)."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # some 2 MB: bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftline.llm import unigram

        own = shipped.value
        own.core, own.table = unigram.TABLES.setdefault(own.name, ({}, {}))
        byte_ids = np.zeros(len(own.surface), bool)
        byte_ids[list(own.byte_ids.values())] = True
        for whole in batches:
            at = 0
            while at < len(whole):
                batch = whole.slice(at, 512)
                at += 512
                texts = batch.column(1).to_pylist()
                coded = own.coded(texts)
                sizes = np.array([len(x) // 4 for x in coded], np.int64)
                flat = np.frombuffer(b"".join(coded), np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                running = np.concatenate([[0], np.cumsum(byte_ids[flat])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(sizes.astype(np.int32)),
                        pa.array((running[offsets[1:]] - running[offsets[:-1]]).astype(np.int32)),
                        pa.array([own.decode(np.frombuffer(x, np.int32).tolist()) == (t or "") for x, t in zip(coded, texts, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "n_bytes", "round_trip"],
                )

    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, n_bytes int, round_trip boolean")


def op9_unigram_encode(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), load(model))
