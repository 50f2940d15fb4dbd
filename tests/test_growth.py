"""What only shows on larger tables."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import groups, records, rules
from factloom.plans import catalog


@pytest.fixture(scope="module")
def long_table(spark, tmp_path_factory):
    """15 million lines of four orders, between three nations: 150 times their number is more than an int holds."""
    sf = str(tmp_path_factory.mktemp("long"))
    spark.range(15_000_000).selectExpr("id % 4 AS l_orderkey", "id % 3 AS l_suppkey").write.parquet(f"{sf}/lineitem.parquet")
    spark.range(3).selectExpr("id AS s_suppkey", "CAST(id AS INT) AS s_nationkey").write.parquet(f"{sf}/supplier.parquet")
    spark.range(2).selectExpr("id AS c_custkey", "CAST(id AS INT) AS c_nationkey").write.parquet(f"{sf}/customer.parquet")
    spark.range(4).selectExpr("id AS o_orderkey", "id % 2 AS o_custkey").write.parquet(f"{sf}/orders.parquet")
    spark.range(3).selectExpr("CAST(id AS INT) AS n_nationkey", "0 AS n_regionkey").write.parquet(f"{sf}/nation.parquet")
    return sf


def test_flow_of_many_lines(spark, long_table):
    got = {tuple(r) for r in catalog.QUERIES["reachability"](spark, long_table).collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_bits_and_joins_agree(spark, seed, monkeypatch):
    rng = random.Random(seed)
    weight = {f"i{k}": rng.choice([0.04, 0.2, 0.5, 0.9, 0.97]) for k in range(14)}
    sets = spark.createDataFrame([(b, i) for b in range(500) for i, w in weight.items() if rng.random() < w] + [(None, "i0")], "id int, item string")
    monkeypatch.setattr(rules, "BLOCK", 192)
    monkeypatch.setattr(rules, "DEALT", 400)
    of = lambda r: [sorted(map(tuple, x.collect())) for x in (r.pairs(), r.single(), r.double(), r.disjunctive())]
    bits = of(rules.Baskets(sets))
    monkeypatch.setattr(rules, "DENSE", 3)
    assert bits == of(rules.Baskets(sets)) and bits[2]


def test_double_rules_of_large_baskets(spark):
    """1.4 billion triples in baskets, 34,220 of items: joined, they take minutes."""
    items = F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.format_string("i%02d", i)))
    sets = spark.range(40_000).select("id", items.alias("item")).filter("NOT (item = 'i07' AND id % 5 = 0)")
    began = time.time()
    got = rules.Baskets(sets).double().select("a", "b", "c", "n", "n_ab").collect()
    assert time.time() - began < 60
    assert len(got) == 34_220 - 21  # i07 after two of the seven before it
    assert {(r.n, r.n_ab) for r in got} == {(40_000, 40_000), (32_000, 32_000)}


def test_sets_of_arrays(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", ""]), (2, None), (3, []), (4, ["c", None]), (4, ["c", "d"]), (None, ["e"]), (None, ["e"])], "k int, words array<string>")
    got = rules.array_sets(docs, "k", F.col("words")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a"), (1, "b"), (4, "c"), (4, "d"), (None, "e")]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
@pytest.mark.parametrize("name, most", [("diff_lines", 400_000), ("diff_ranges", 50_000)])
def test_rows_of_a_task(spark, name, most):
    """Tasks follow the table, not the default number of partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = catalog.QUERIES[name](spark, "/root/testdata/sf0.1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(r["count"] for r in got) <= most


def test_pairs_of_sets(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], [("x",)]), (["a", "c"], [("x",), (None,)]), (["a"], [("x",)]), ([], [("y",)])], "ts array<string>, gs array<struct<g: string>>")
    got = {tuple(r) for r in records.pairs_of_sets(rows, "ts", "gs").collect()}
    assert got == {("x", "a", "b", 1), ("x", "b", "c", 1), ("x", "a", "c", 3), (None, "a", "c", 2)}


def test_clumps_give_runs(monkeypatch):
    """What two blocks have in common goes out in runs of bounded length, not as one list of lists."""
    short = [(np.full(n, n), np.full((n, 2), n, np.uint64)) for n in range(1, 40)]
    monkeypatch.setattr(groups, "EMIT", 100)
    runs = list(groups._runs(iter(short)))
    assert len(runs) > 10 and all(len(k) == len(m) and m.size < 100 + 80 for k, m in runs)
    for part in (0, 1):
        assert np.array_equal(np.concatenate([r[part] for r in runs]), np.concatenate([r[part] for r in short]))
