import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import tokenfile

from .corpus import documents, rows, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> a<|startoftext|>b", "It's  THE Ärger x y\u0085z é Σας ΟΔΟΣ", "😀 漢字 it's we'll 3½ 12345", "\x00\x1f \x0b\x0c", "ǅ İstanbul ﬁ", "'s 't''re"]


@pytest.fixture(scope="module")
def json():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_same_ids_as_the_library(json):
    t, items = Tokenizer.from_file(PATH), texts() + ODD
    for end in (2, None):
        ids, at = tokenfile.encode_texts(tokenfile._pool(json), pa.array(items), end)
        for i, x in enumerate(items):
            assert ids[at[i] : at[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids + [end] * (end is not None), x


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(items):
    with open(PATH, encoding="utf-8") as f:
        pool = tokenfile._pool(f.read())
    ids, at = tokenfile.encode_texts(pool, pa.array(items, pa.string()), 2)
    t = Tokenizer.from_file(PATH)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [t.encode(x, add_special_tokens=False).ids + [2] for x in items]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=2000))
def test_segment_round_trip(values):
    ids = np.array(values, np.uint32)
    cut = len(ids) // 3
    s = tokenfile.Segment(tokenfile.pack([None, 7, -5], np.array([0, cut, cut, len(ids)]), ids))
    assert s.doc_ids == [None, 7, -5] and s.all_tokens().tolist() == values
    assert s.tokens(np.arange(len(ids))).tolist() == values
    assert s.document(0).tolist() == values[:cut] and s.document(1).tolist() == [] and s.document(2).tolist() == values[cut:]
    assert [int(s.tokens([i])[0]) for i in range(0, len(ids), 97)] == values[::97]


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        tokenfile.Segment(b"something else")


def test_files(spark, json):
    t = Tokenizer.from_file(PATH)
    want = []
    for r in rows():
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r[0], len(ids), zlib.crc32(ids.tobytes())))
    for step, segment in ((10_000, tokenfile.SEGMENT), (7, 50)):
        files = tokenfile.write_tokens(documents(spark), json, rows_per_range=step, segment=segment)
        got = sorted(tokenfile.read_tokens(files).collect(), key=lambda r: r.start)
        assert sorted((str(r.id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(a), b, c) for a, b, c in want)
        order = [-1 if r.id is None else r.id for r in got]
        assert order == sorted(order)
        assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert tokenfile.read_tokens(tokenfile.write_tokens(documents(spark).limit(0), json)).count() == 0


def test_bounded_pool_gives_the_same(json):
    from factloom.llm.wordpool import WordPool

    pool = WordPool(tokenfile._pool(json).encode, most=3)
    for x in texts():
        ids, _ = tokenfile.encode_texts(pool, pa.array([x], pa.string()), 2)
        assert ids.tolist() == Tokenizer.from_file(PATH).encode(x or "", add_special_tokens=False).ids + [2]
