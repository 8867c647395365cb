import random

import pytest
import sentencepiece

from lumidoc.llm import pieces

SP = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
PARTS = ["the", "an", "in", "  ", " ", "\n", "é", "日", "er", "tion", "ing", "a", "b", "​", "\U0001f600", "....", "=", "\t"]


def texts():
    rnd = random.Random(4)
    fixed = ["", " ", "  ", "\n", "a\n", " \n ", "\n\n a", "x  y   z ", "日本\n語 x", "\t\t x", "a" * 900, " " * 700, "the" * 500 + " " * 40 + "x"]
    return fixed + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 150))) for _ in range(150)]


@pytest.mark.parametrize("chunk", [3, 17, 64])
def test_scan_gives_the_library_ids(chunk):
    model = pieces.loaded(pieces.MODEL)
    for t in texts():
        if t:
            assert pieces.encode_giant(model, t, chunk) == SP.encode(t), repr(t)


def test_combine_is_associative():
    model = pieces.loaded(pieces.MODEL)
    text = pieces.BLANK + "internationalisation" * 12
    cuts = [0, 31, 77, 118, len(text)]
    a, b, c, d = (model.transfer(*pieces._window(text, s, e, model.longest)) for s, e in zip(cuts, cuts[1:]))
    assert pieces.combine(pieces.combine(a, b), pieces.combine(c, d)) == pieces.combine(a, pieces.combine(b, pieces.combine(c, d)))


def test_round_trip_on_spark(spark):
    rnd = random.Random(5)
    giant = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 12))) for _ in range(20_000))
    solid = "".join(rnd.choice("abc") for _ in range(4 * pieces.CHUNK + 500))
    rows = [(1, None), (2, ""), (3, "plain text"), (4, giant), (4, giant), (None, "no id"), (6, solid), (7, "two  blanks\n")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, ids int, key string")
    got = pieces.decode(pieces.encode(df)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    assert sorted(map(str, got)) == sorted(map(str, pieces.round_trip(df).collect()))
    assert all(r.ids == (None if r.text is None else SP.encode(r.text)) for r in got)


def test_empty_table(spark):
    assert pieces.decode(pieces.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_blank_sign_decodes_to_a_blank():
    model = pieces.loaded(pieces.MODEL)
    assert model.decode(model.encode("a" + pieces.BLANK + "b")) == "a b"
