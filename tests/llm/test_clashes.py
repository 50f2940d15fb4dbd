"""Columns of the input that are named as the operators' own keep their values."""

from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import langid, mixing, shingled

NAMES = ["__lang_rejected", "__copy", "__gone", "mix_copies", "mix_size", "id", "node", "component_id", "spans", "rank"]


def clashing(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("the water and the house number of a road by "), F.expr("repeat(concat(cast(id as string), ' light '), 9)")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    return docs.select(*docs.columns, *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def test_stages(spark):
    docs = clashing(spark)
    for stage in (corpus_pipeline.identified, corpus_pipeline.deduplicated, corpus_pipeline.private, corpus_pipeline.mixed):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, stage
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in NAMES)


def test_operators(spark):
    docs = clashing(spark)
    model = langid.fit(docs)
    assert langid.with_language(docs, model).columns[:-1] == docs.columns
    assert mixing.mixture(docs).columns == docs.columns and shingled.distinct_documents(docs).columns == docs.columns
