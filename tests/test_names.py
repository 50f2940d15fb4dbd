"""Name pairs against brute force."""

import itertools
import os

import pytest

from factloom.functions.text import jaro_winkler
from factloom.operators import similarity
from factloom.plans import catalog

SF = "/root/testdata/sf0.01"


def brute(names, least):
    return sorted((a, b, jaro_winkler(a, b)) for a, b in itertools.combinations(sorted(set(names)), 2) if jaro_winkler(a, b) >= least)


@pytest.mark.parametrize("block", [1024, 3])
def test_all_pairs(spark, block):
    names = ["red widget", "large gear", "small bolt", "red gear", "tiny bolt", "", "bolt", "x", "red widget", None, "größe", "grosse"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = sorted(map(tuple, similarity.similar_names(df, "p", 0.5, block).collect()))
    assert got == brute([n for n in names if n is not None], 0.5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_compares_names_without_a_common_word(spark):
    names = [r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()]
    want = brute(names, 0.5)
    assert any(not set(a.split()) & set(b.split()) for a, b, _ in want)
    assert sorted(map(tuple, catalog.name_similarity(spark, SF).collect())) == want
