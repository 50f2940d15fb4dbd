import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import repetition as rep

from .corpus import documents, rows, texts


def brute(text, window=8, least=8):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)

    def cover(size):
        seen, flags = {}, [False] * n
        for i in range(n - size + 1):
            seen.setdefault(tuple(words[i : i + size]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                for i in places:
                    flags[i : i + size] = [True] * size
        return sum(flags)

    longest = 0
    while longest < n and cover(longest + 1):
        longest += 1
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup,
        "n_repeat_words": cover(window), "n_covered_words": cover(least), "longest_repeat": longest,
    }


def same(items, **k):
    got = rep.repetition(pa.array(items, pa.string()), **k)
    for i, t in enumerate(items):
        want = brute(t, **k)
        assert {x: int(got[x][i]) for x in want} == want, t


def test_brute_force():
    same([t for t in texts() if len(t or "") < 3000])
    same(["the " * 40, "a b a b a b a b a b", None, "", "\n", "x"], least=3, window=2)


def test_empty():
    assert all(len(v) == 0 for v in rep.repetition(pa.array([], pa.string())).values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t#é", max_size=60)), max_size=5))
def test_random(items):
    same(items, window=2, least=3)


def test_lcp_order():
    ids = np.array([1, 2, 1, 2, 1, 3, 3, 3], np.int64)
    order, lcp = rep.suffix_arrays(ids, np.array([0, 5, 5, 8]))
    assert order.tolist()[:5] == [4, 2, 0, 3, 1] and lcp.tolist()[:5] == [0, 1, 3, 0, 2]
    assert order.tolist()[5:] == [7, 6, 5] and lcp.tolist()[5:] == [0, 1, 2]


def verdict(text):
    b = brute(text, least=5)
    failed = b["n_words"] < 20 or 100 * b["n_repeat_words"] > 30 * b["n_words"]
    return failed, not failed and 100 * b["n_covered_words"] <= 30 * b["n_words"] and b["longest_repeat"] <= 64


def test_query(spark, tmp_path):
    """All rows and the verdict, the long texts of the table too."""
    documents(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in rep.op4_repetition(spark, f"file://{tmp_path}").collect()}
    long = {t for t in texts() if len(t or "") >= 3000}
    assert got == {(r[0], brute(r[1])["n_words"], brute(r[1])["n_repeat_words"], *verdict(r[1])) for r in rows()} and long
    assert rep.repetition_rules(documents(spark).limit(0)).count() == 0
