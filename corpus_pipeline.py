"""The corpus pipeline: documents go through the stages in order, each written and read again before the next.

A stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the
last returns one row per document of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediacat.llm import curriculum, decontaminate, language, near_copies, token_files
from mediacat.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays unclear, go. Learned from the labelled rows that aren't held out."""
    model = language.fit(language.with_fold(docs.select("doc_id", "text", "lang")).where("not held_out"))
    return language.known_language(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    return near_copies.near_dedup(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, each as often as its source's target asks."""
    return curriculum.mixed_copies(docs, whole=True)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in the order in which they are stored, read back: one row per document."""
    return token_files.token_output(docs, cached=REMEMBERED, order=token_files.stored_order())


#: Pieces of text that a worker remembers for the tokenizer; workers also serve the other stages.
REMEMBERED = 100_000

STAGES = [
    ("language ID", identify_language),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate_benchmark),
    ("source mixing", mix_sources),
    ("token-ID output", write_tokens),
]

#: SQL can't express SimHash, BM25 passages or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
