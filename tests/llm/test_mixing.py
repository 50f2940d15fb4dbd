import re
from collections import Counter

import pytest

from factloom.llm import mixing

from .corpus import documents, rows


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        for s in over:
            fixed[s] = cap * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def test_targets_and_copies(spark):
    docs = documents(spark)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows())
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += words(r[1])
    want = targets(sizes)
    for r in got:
        assert r.mix_size == words(r.text) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(want[r.source])
        assert r.mix_copies in (int(r.mix_target / r.mix_source_size), int(r.mix_target / r.mix_source_size) + 1) and r.mix_copies <= 2
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and out.count() == sum(r.mix_copies for r in got)
    assert sorted(map(str, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(str, got))


def test_empty_and_wordless(spark):
    docs = documents(spark)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert {r.mix_copies for r in mixing.mixed(docs.filter("text is null")).collect()} == {0}


def test_taken_is_near_target(spark):
    from pyspark.sql import functions as F

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    for r in mixing.mixed(docs).groupBy("source").agg(F.first("mix_target").alias("t"), F.sum(F.col("mix_copies") * F.col("mix_size")).alias("n")).collect():
        assert abs(r.n / r.t - 1) < 0.05
