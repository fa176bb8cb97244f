import random

import pytest
import sentencepiece

from weftline.llm import unigram

TEXTS = [
    "", " ", "   ", "a", "Hello world", "  two  spaces ", "tab\tand\nnewline\r\n", "naïve café Übergrößenträger", "日本語のテキスト 🙂🙂 ok",
    "x" * 300, "ththtionation " * 40, "▁ literal", "a▁b", "\x00\x01 control", "Ñandú ßß éèê", "1234567890 3.14159", "word" + " " * 9 + "end",
]


@pytest.fixture(scope="module")
def model():
    return unigram.load()


@pytest.fixture(scope="module")
def library(model):
    # A later trainer_spec is merged over the first: the same pieces, as a unigram model.
    with open(unigram.MODEL, "rb") as file:
        return sentencepiece.SentencePieceProcessor(model_proto=file.read() + b"\x12\x02\x18\x01")


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("abcdethéñ ßö  .,\n19🙂語") for _ in range(rng.randrange(1, 90))) for _ in range(400)]
    return TEXTS + made


def test_ids_match_library(model, library):
    """The library adds 32-bit scores: beside unknown characters (-1e9) it can miss the best path, never beat it."""
    for t, own in zip(texts(), model.encode_many(texts()), strict=True):
        other = library.encode(t)
        if own != other:
            assert set(own) & set(model.byte_ids.values())
            assert model.scores[own].sum() >= model.scores[other].sum()
            assert model.decode(own) == model.decode(other)


def test_both_searches_agree(model):
    words = [w for t in texts() for w in t.replace(" ", unigram.MARK).split("\n") if 0 < len(w.encode()) <= 200]
    assert model._together(words) == [model.viterbi(w) for w in words]


@pytest.mark.parametrize(("core", "table"), [(0, 0), (3, 5), (40, 10), (10, 400)])
def test_small_tables_change_nothing(model, monkeypatch, core, table):
    monkeypatch.setattr(unigram, "CORE_WORDS", core)
    monkeypatch.setattr(unigram, "TABLE_WORDS", table)
    own = unigram.load()
    rng = random.Random(core)
    many = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    for i in range(0, 300, 7):
        assert own.encode_many(many[i : i + 7]) == [list(own.viterbi(unigram.MARK + t.replace(" ", unigram.MARK))) for t in many[i : i + 7]]


def test_decode_inverts(model):
    for t in texts():
        assert model.decode(model.encode(t)) == t.replace("▁", " ")


def test_model_with_inner_markers_takes_the_plain_loop():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("a▁a", -1.0, 1), ("b", -3.0, 1)]
    own = unigram.Unigram(pieces)
    assert not own.by_word
    assert own.encode("a a") == [1, 3]
    assert own.encode("ac") == [1, 2, 0]


def test_query_handles_nulls_and_repeats(spark, model):
    rows = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (2, "", "z"), (2, "", "z"), (3, "long " * 20000, None)], "doc_id long, text string, ids string")
    got = {(r["doc_id"], r["n_tokens"]): r for r in unigram.encode(rows, model).collect()}
    assert got[(None, 0)]["ids"] == [] and got[(2, 0)]["round_trip"]
    assert [r for k, r in got.items() if k[0] == 3][0]["ids"] == model.encode("long " * 20000)
    assert unigram.encode(rows.limit(0), model).count() == 0
