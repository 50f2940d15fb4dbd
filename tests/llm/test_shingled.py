import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import shingled, simhash

import corpus_pipeline


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute_pairs(sets):
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


@pytest.fixture(scope="module")
def corpus():
    """Texts of 5 to 600 words, each with two copies of up to a fifth of their shingles changed: pairs about 0.7 to 1."""
    rng = random.Random(5)
    texts = []
    for k in range(300):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([5, 7, 9, 15, 30, 60, 150, 600]))]
        texts.append(" ".join(base))
        for _ in range(2):
            n = rng.randint(0, max(1, len(base) // 40))
            texts.append(" ".join(edited(rng, base, n) if k % 3 else base + [f"z{rng.randint(0, 99)}" for _ in range(rng.randint(1, 1 + len(base) // 7))]))
    return texts + ["Same Words here and there", "same words  here\nand there", "", None]


def test_recall_and_precision(spark, corpus):
    pairs = brute_pairs(brute_sets(corpus))
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    for options in ({}, {"most": 8, "group": 100}):
        got = {r.id: r.component_id for r in shingled.near_duplicates(docs, **options).collect()}
        assert len(got) == len(corpus)
        root = list(range(len(corpus)))
        for i, j in pairs + [(len(corpus) - 1, len(corpus) - 2)]:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        assert all(root[i] == root[c] for i, c in got.items())  # nothing below 0.8 is joined
        found = sum(got[i] == got[j] for i, j in pairs)
        assert len(pairs) > 300 and found >= 0.99 * len(pairs)


def test_pipeline_stage_takes_similarity(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
    near, far = (" ".join(edited(rng, base, n)) for n in (5, 20))
    data = [(1, " ".join(base), "en", "s", 1), (2, near, "en", "s", 1), (3, far, "en", "s", 1), (None, near, "en", "s", 1)]
    assert brute_pairs(brute_sets([data[0][1], near])) and not brute_pairs(brute_sets([data[0][1], far]))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.deduplicated(spark, docs, "").collect()) == ["1", "3", "None"]


def test_smallest_shingles_suffice():
    for n in range(1, shingled.SHORT + 1):
        assert shingled.least_shared(n) > n - np.ceil(0.8 * n)


def flipped(rng, print_, n):
    bits = np.unpackbits(print_.view(np.uint8))
    bits[rng.choice(128, n, replace=False)] ^= 1
    return np.packbits(bits).view(np.uint64)


def as_nodes(spark, prints, n_shingles=200):
    rows = [(i, int(a), int(b), [], n_shingles) for i, (a, b) in enumerate(np.array(prints).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "node long, fa long, fb long, keys array<long>, n int")


def test_large_group_of_near_copies_has_few_links(spark):
    """Copies of one text, each with other edits, meet in many tables under many least texts; most of these links are needless."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    links = shingled.candidate_links(as_nodes(spark, [flipped(rng, base, 12) for _ in range(400)])).collect()
    assert len({r.a for r in links} | {r.b for r in links}) == 400
    assert len(links) <= 4 * 400


def rows_of(key, node, fps, n):
    signed = np.ascontiguousarray(fps).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(signed[:, 0]), pa.array(signed[:, 1]), pa.array(n, pa.int32())], ["key", "node", "fa", "fb", "n"])


def test_unrelated_texts_of_a_key_cost_no_step_each(monkeypatch):
    """At 6 GB a key of 16 bits has about 40 unrelated texts; only those that are alike may be gone through one by one."""
    rng = np.random.default_rng(4)
    keys, each = 200, 40
    fps = rng.integers(0, 1 << 63, (keys * each, 2), dtype=np.uint64)
    for k in range(0, keys, 2):  # a pair in one key, four of a kind in the next but one
        for j in range(1, 2 if k % 4 else 4):
            fps[k * each + 10 * j] = flipped(rng, fps[k * each], 10)
    gone, plain = [], shingled.close
    monkeypatch.setattr(shingled, "close", lambda node, *rest: gone.append(len(node)) or plain(node, *rest))
    key, node = np.repeat(np.arange(keys), each), np.arange(keys * each)
    batch = rows_of(key, node, fps, np.full(len(key), 100))
    out = pa.Table.from_batches(list(shingled._candidates(1000)(iter([batch.slice(0, 3333), batch.slice(3333)])))).to_pylist()
    found = {frozenset((r["a"], r["b"])) for r in out}
    want = {frozenset((k * each, k * each + 10 * j)) for k in range(0, keys, 2) for j in range(1, 2 if k % 4 else 4)}
    assert found == want and len(out) == len(want)
    assert sum(gone) <= 4 * keys / 4


def test_sizes_bound_candidates():
    """No pair at 0.8 has a text with under 0.8 of the other's shingles, however near the fingerprints are."""
    fps = np.zeros((3, 2), np.uint64)
    batch = rows_of(np.zeros(3, np.int64), np.arange(3), fps, np.array([100, 80, 79]))
    out = pa.Table.from_batches(list(shingled._candidates(1000)(iter([batch])))).to_pylist()
    assert sorted((r["a"], r["b"]) for r in out) == [(0, 1), (1, 2)]


def test_larger_keys_give_the_same_components(monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    fps = np.array([flipped(rng, base[i % 60], int(rng.integers(0, 25))) for i in range(240)])
    key, n = np.sort(rng.integers(0, 4, 240)), rng.integers(80, 120, 240)
    near = (np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= shingled.DISTANCE) & (5 * np.minimum(n[:, None], n) >= 4 * np.maximum(n[:, None], n)) & (key[:, None] == key)
    for scan in (256, 10):
        monkeypatch.setattr(shingled, "SCAN", scan)
        out = pa.Table.from_batches(list(shingled._candidates(1000)(iter([rows_of(key, np.arange(240), fps, n)])))).to_pylist()
        assert all(near[r["a"], r["b"]] for r in out)
        assert united(240, [(r["a"], r["b"]) for r in out]) == united(240, np.argwhere(near).tolist())


def united(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        a, b = root[a], root[b]
        root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_sets_that_share_no_rare_member_are_dropped_first():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 1 << 60, 60)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 60, 40)])) for _ in range(50)]
    sets += [np.unique(np.concatenate([sets[i][: -int(rng.integers(1, 12))], rng.integers(0, 1 << 60, 5)])) for i in range(20)]
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    pairs = [(i, j) for i in range(70) for j in range(i) if 5 * len(x := np.intersect1d(sets[i], sets[j])) >= 4 * (size[i] + size[j] - len(x))]
    some = shingled.sharing(flat, np.repeat(np.arange(70), size), size)
    assert pairs and {i for p in pairs for i in p} <= set(np.flatnonzero(some).tolist()) and some.sum() < 50
    assert united(70, zip(*shingled.similar(np.arange(70), sets))) == united(70, pairs)


def test_tables_cover_the_radius(spark):
    """Fingerprints within 19 of 128 bits share a key whatever the bits are: some block of 32 differs in at most 4."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (400, 2), dtype=np.uint64)
    prints = np.concatenate([base, [flipped(rng, fp, 19) for fp in base]])
    links = shingled.candidate_links(as_nodes(spark, prints)).collect()
    root = united(800, [(r.a, r.b) for r in links])
    assert all(root[i] == root[400 + i] for i in range(400))


def test_keys_of_each_block_are_the_covering_ones():
    fps = np.array([[0, 0], [(1 << 64) - 1, (1 << 64) - 1]], np.uint64)
    keys = shingled.table_keys(fps, list(range(shingled.TABLES)))
    assert shingled.REACH == 19 and keys.shape == (2, 4 * 31)
    assert [int(k) & 0xFFFFFFFF for k in keys[1]] == 4 * simhash.covering_masks(4, 32)
    assert [int(k) >> 32 for k in keys[0]] == list(range(4 * 31))
