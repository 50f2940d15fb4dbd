import itertools
import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from factloom.llm import simhash

from .corpus import documents, rows, texts

MASK = (1 << 64) - 1


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    assert simhash.text_fingerprints(pa.array(texts())).tolist() == [brute_print(t) for t in texts()]
    assert simhash.text_fingerprints(pa.array([], pa.string())).tolist() == []
    assert simhash.text_fingerprints(pa.array([None, ""], pa.string())).tolist() == [0, 0]


def test_every_near_pair_collides():
    rng, masks = random.Random(1), simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not flip & m for m in masks)


def brute_components(prints):
    root = {p: p for p in prints}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            ra, rb = root[a], root[b]
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    return root


def test_links_with_large_buckets(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        for _ in range(6):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.add(p)
    prints |= {1 << b for b in range(64)} | {MASK, 0}
    want = brute_components(sorted(prints))
    for most in (16384, 8):
        df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
        links = simhash.near_links(df, most=most)
        pairs = [(a & MASK, b & MASK) for a, b in links.collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        found = {r.node & MASK: r.root for r in simhash.components(links).collect()}
        groups = {}
        for p in prints:
            groups.setdefault((found[p] if p in found else simhash._signed(p)), set()).add(p)
        expected = {}
        for p, r in want.items():
            expected.setdefault(r, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_documents(spark):
    got = simhash.simhash_components(documents(spark)).collect()
    assert len(got) == len(rows())
    prints = {brute_print(r[1]) for r in rows()}
    root = brute_components(sorted(prints))
    least = {}
    for r in rows():
        if r[0] is not None:
            k = root[brute_print(r[1])]
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted((str(r[0]), brute_print(r[1]), least[root[brute_print(r[1])]] if root[brute_print(r[1])] in least else None) for r in rows())
    assert sorted((str(r.id), r.fp & MASK, r.component_id) for r in got) == want


def test_distinct_documents(spark):
    docs = documents(spark)
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    with_id = [i for i in ids if i is not None]
    assert len(with_id) == len(set(with_id)) and ids.count(None) == 2
    found = {r.id: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert set(with_id) == {i for i, c in found.items() if i is not None and i == c}
    assert simhash.distinct_documents(docs.limit(0)).count() == 0


def test_spanning_is_a_forest():
    fps = np.array([0, 1, 3, 7, 1 << 40], np.int64)
    left, right = simhash.spanning(fps, 1)
    assert len(left) == 4 and simhash.spanning(fps[1:4], 1)[0] == [1, 3]
