import random

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import pieces

from .corpus import documents, rows, texts

DATA = pieces.public_model()
ODD = [None, "", "a", " ", "  ", " " * 40, "a   b    c", "Hello  world\nfoo é 漢字 😀", "   lead", "trail   ", "\t\t x\n\n\ny", "-" * 49 + "=", "▁x ▁▁ y", "<s> </s> <unk> <0x0A>", "a" * 700, "\x00a", "ﬁ Å", " " * 17 + "x" + " " * 33]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=DATA)


def check(items, library):
    model, pool = pieces._model(DATA)
    ids, at = model.encode(pa.array(items, pa.string()), pool)
    want = [library.encode(x or "") for x in items]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert model.decode(ids, at) == [library.decode(w) for w in want]


def test_same_ids_as_the_library(library):
    check(ODD + texts(), library)
    rng = random.Random(4)
    check(["".join(rng.choice(["ab", "the", " ", "  ", "\n", "é", "漢", "ing", "=", "0", "▁"]) for _ in range(rng.randint(0, 60))) for _ in range(400)], library)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(items):
    check(items, sentencepiece.SentencePieceProcessor(model_proto=DATA))


def test_unigram_finds_the_best_score():
    model = pieces.PieceModel(DATA)
    model.type = pieces.UNIGRAM
    words = [b"Hello", b" world", b" international", b"aaaaaaaaa", " été漢".encode(), b"x"]
    ids, counts = model.viterbi(words)
    at = 0
    for word, n in zip(words, counts.tolist()):
        text = word.decode().replace(" ", pieces.SPACE_MARK)
        best = [0.0] + [float("-inf")] * len(text)
        for i in range(1, len(text) + 1):
            for j in range(max(0, i - model.longest), i):
                k = model.normal.get(text[j:i])
                score = model.scores[k] if k is not None else model.unknown_score if i - j == 1 else None
                if score is not None:
                    best[i] = max(best[i], best[j] + score)
        own, total, known = ids[at : at + n], 0.0, 0
        for k in own.tolist():
            if model.kinds[k] == pieces.NORMAL:
                total += model.scores[k]
                known += len(model.pieces[k])
        assert total + (len(text) - known) * model.unknown_score == pytest.approx(best[-1])
        at += n


def test_bounded_pair_table(library):
    model = pieces.PieceModel(DATA)
    from factloom.llm.wordpool import WordPool

    ids, at = model.encode(pa.array(texts()), WordPool(model.viterbi, most=5))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(x or "") for x in texts()]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(b"")


def test_documents(spark, library):
    docs = documents(spark)
    got = pieces.with_pieces(docs, DATA, decoded_col="back").collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.back == r.text and (r.piece_ids is None) == (r.text is None)
        assert r.text is None or r.piece_ids == library.encode(r.text)
    assert pieces.with_pieces(docs.limit(0), DATA).count() == 0
