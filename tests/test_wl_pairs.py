"""wl_similarity compares conversations of different lengths."""

import itertools
import os

import pytest

from factloom.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_sizes_up_to_a_factor_of_two(spark):
    shapes = {}
    turns = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append(r.role)
    for g in sorted(turns):
        shapes.setdefault(tuple(turns[g]), g)
    size = {g: len(s) for s, g in shapes.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(size), 2) if max(size[a], size[b]) <= 2 * min(size[a], size[b])}
    got = {(r.a, r.b): r.similarity for r in catalog.wl_similarity(spark, SF).filter("not member").collect()}
    assert len(want) > len(size) and got.keys() == want
    assert any(v > 0 for (a, b), v in got.items() if size[a] != size[b])
