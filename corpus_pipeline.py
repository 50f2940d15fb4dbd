"""The corpus pipeline: language ID, near-duplicate removal, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns of
documents. run() applies them in turn; what a stage gives is written to the shared folder and read again by the next, so no stage is
computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, mixing, pieces, pii, shingled
from factloom.llm.common import store


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nearest-centroid language ID, learnt from the labelled rows that aren't held out; documents that it rejects go: null
    texts, texts without a letter, and those unlike every language's centroids."""
    model = langid.fit(docs.filter(~langid.held_out()))
    flagged = langid.with_language(docs, model)
    return flagged.filter(~F.col(flagged.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of Jaccard similarity 0.8 or more on five-word shingles: of each component the document of
    smallest id stays."""
    return shingled.distinct_documents(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets."""
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its own draw say."""
    return mixing.mixture(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text's pieces, and whether they decode to the text: doc_id, lang, source, n_tokens, piece_ids, round_trip."""
    coded = pieces.with_pieces(docs.select("doc_id", "lang", "source", "text"), pieces.public_model(), decoded_col="__decoded")
    return coded.select("doc_id", "lang", "source", F.size("piece_ids").alias("n_tokens"), "piece_ids", (F.col("__decoded") == F.col("text")).alias("round_trip"))


STAGES = [("language_id", identified), ("near_duplicates", deduplicated), ("personal_data", private), ("mixing", mixed), ("pieces", tokenized)]

#: No SQL expresses the trained models and the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
