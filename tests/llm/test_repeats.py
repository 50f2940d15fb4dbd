import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import repeats

from .corpus import documents, rows


def brute(docs, window):
    """docs: (id, text) by id."""
    seen, out = set(), {}
    for key, text in docs:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - window + 1):
            s = raw[i : i + window]
            if s in seen:
                gone[i : i + window] = [True] * window
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[key] = (len(raw), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 260))) for _ in range(8)]
    out = [None, "", "x", "a" * 400, "ab" * 300, "a" * 99, "a" * 100, "\0" * 150 + "q" + "\0" * 130]
    for _ in range(n):
        out.append("".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdé \n") for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(0, 8))))
    return out + [out[-1], out[-2] + "!", out[20]]


def test_contexts_cover_every_window_once():
    rng = np.random.default_rng(1)
    buf, off = rng.integers(97, 100, 3000).astype(np.uint8), np.array([0, 0, 1200, 1250, 1350, 3000])
    x = repeats.contexts(buf, off, 100, 24)
    starts = [(d, m - lo + i) for d, m, lo, hi in zip(x["doc"], x["m"], x["lo"], x["hi"]) for i in range(lo - hi + 1)]
    want = [(d, s) for d in range(5) for s in range(off[d + 1] - off[d] - 99)]
    assert sorted(map(lambda t: (int(t[0]), int(t[1])), starts)) == want


def test_equal_windows_share_anchors():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 256, 100).astype(np.uint8)
    a = np.concatenate([rng.integers(0, 256, 77), passage, rng.integers(0, 256, 50)]).astype(np.uint8)
    b = np.concatenate([rng.integers(0, 256, 31), passage, rng.integers(0, 256, 190)]).astype(np.uint8)
    found = []
    for buf, at in ((a, 77), (b, 31)):
        x = repeats.contexts(buf, np.array([0, len(buf)]))
        found += [(int(h), int(m - at)) for h, m, lo, hi in zip(x["h"], x["m"], x["lo"], x["hi"]) if m - lo <= at <= m - hi]
    assert len(found) == 2 and found[0] == found[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=4, max_size=60), min_size=1, max_size=8))
def test_levels(batches):
    family, seen = repeats.SuffixLevels(4), set()
    for b in batches:
        buf = np.array(b, np.uint8)
        got = family.add(buf, np.arange(len(b) - 3))
        want = []
        for i in range(len(b) - 3):
            s = bytes(buf[i : i + 4])
            want.append(s in seen)
            seen.add(s)
        assert got.tolist() == want
        sizes = [len(x.sa) for x in family.levels]
        assert all(a > 2 * z for a, z in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)
        for x in family.levels:  # suffix arrays: places in the order of their windows
            windows = [bytes(x.buf[i : i + 4]) for i in x.sa]
            assert windows == sorted(set(windows))
        assert [x.first for x in family.levels] == [0, *[x.last + 1 for x in family.levels]][: len(family.levels)]


def test_documents_by_brute_force(spark):
    data = [(i * 2, t) for i, t in enumerate(corpus())]
    random.Random(1).shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = brute(sorted(data), 100)
    for options in ({}, {"hot": 1, "shard": 10, "batch": 7}, {"shard": 30, "batch": 3}):
        got = repeats.without_repeats(docs, **options).collect()
        assert {r.id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_short_window(spark):
    data = [(i, t) for i, t in enumerate(corpus(9, 20))]
    got = repeats.without_repeats(spark.createDataFrame(data, "doc_id int, text string"), window=30, gram=12).collect()
    assert {r.id: tuple(r)[1:] for r in got} == brute(data, 30)


def test_repeated_ids_and_nulls(spark):
    got = repeats.without_repeats(documents(spark)).collect()
    assert len(got) == len(rows())
    kept = sorted({(r.id is not None, r.id or 0, r.kept_sha256) for r in got})
    assert len(kept) == len({(r[0], r[1]) for r in rows()})


def test_text_in_pieces():
    import pyarrow as pa

    rng = random.Random(8)
    text = "".join(rng.choice("abc") for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 9]), pa.array([text, "zz" + text[500:900]])], ["id", "text"])
    found = set()
    for piece in (1 << 22, 700):
        rows = [r for b in repeats._anchors(100, 24, piece)([batch]) for r in b.to_pylist()]
        windows = {(r["id"], s) for r in rows if r["h"] >= 0 for m, lo, hi in [repeats._unpack(r["p"])] for s in range(m - lo, m - hi + 1)}
        gone = {(r["id"], s) for r in rows if r["h"] < 0 for s in range(r["p"], r["e"] - 99)}
        found.add(frozenset(windows | gone))
        assert {s for i, s in windows if i == 5} == set(range(2901)) and (not gone or piece > 1000)
    assert len(found) == 1


def test_met_gives_parts_of_hot_grams():
    import pyarrow as pa

    h = np.sort(np.array([1, 2, 2, 3] + [4] * 9 + [5] * 3 + [6] + [7] * 20 + [8, 8]))
    for cut in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(h[a : a + cut]), pa.array(np.arange(len(h))[a : a + cut]), pa.array(h[a : a + cut]), pa.nulls(len(h[a : a + cut]), pa.int64())], ["h", "id", "p", "e"]) for a in range(0, len(h), cut)]
        rows = [r for b in repeats._met(4)(iter(batches)) for r in b.to_pylist()]
        parts = {k: [r["part"] for r in rows if r["h"] == k] for k in (1, 2, 3, 4, 5, 6, 7, 8)}
        assert parts == {1: [], 2: [0, 0], 3: [], 4: [1] * 4 + [2] * 4 + [3], 5: [0] * 3, 6: [], 7: sum(([k] * 4 for k in range(1, 6)), []), 8: [0, 0]}


def test_batches_meet_the_levels_before(spark, tmp_path):
    """Batches one by one give what brute force gives for all of them, in order; with hot k-grams and an index built anew."""
    data = [(i * 2, t) for i, t in enumerate(corpus(5, 50))]
    cuts = [0, 3, 4, 20, 21, 40, len(data)]
    seen, want = set(), {}
    for key, text in data:
        raw = (text or "").encode()
        want[key] = {s for s in range(len(raw) - 99) if raw[s : s + 100] in seen or raw[s : s + 100] in {raw[i : i + 100] for i in range(s)}}
        seen |= {raw[i : i + 100] for i in range(len(raw) - 99)}
    for name, options in (("plain", {"batch": 5}), ("hot", {"hot": 2, "shard": 40, "batch": 7}), ("anew", {"shard": 3, "batch": 2})):
        index = repeats.SuffixIndex(spark, f"file://{tmp_path}/{name}", **options)
        got = {}
        for a, b in zip(cuts, cuts[1:]):
            docs = spark.createDataFrame(data[a:b], "id long, text string")
            spans = {r.id: r.spans for r in index.add(docs).collect()}
            assert set(spans) <= {k for k, _ in data[a:b]}
            got |= spans
        cover = lambda places: {p for s in places for p in range(s, s + 100)}
        for key, _ in data:
            assert {p for x in got.get(key, []) for p in range(x["s"], x["e"])} == cover(want[key]), (name, key)
        assert index._state()[0] == len(cuts) - 1 and (name != "anew" or index._state()[1] > 1)


def test_a_hot_passage_is_dealt_out(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(180))
    data = [(i, f"{rng.random()} " + passage + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90)))) for i in range(300)]
    got = repeats.without_repeats(spark.createDataFrame(data, "doc_id long, text string"), hot=16, shard=200).collect()
    assert {r.id: tuple(r)[1:] for r in got} == brute(data, 100)


def test_window_must_fit(spark):
    with pytest.raises(ValueError):
        repeats.without_repeats(documents(spark), window=20)
