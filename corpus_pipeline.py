"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept. All but
the last return the columns of ``documents``; the last adds how much of each document the
mix takes and leaves out documents of which it takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.llm import copies, decontaminate, mixing, secrets, toxicity
from partloom.llm.common import table
from partloom.session import cut

#: The groups of near duplicates and the classifier have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. Labels are learnt from ``docs`` outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(spark, model)("text")["score"] < 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return copies.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with ``size``, ``source_size``, ``target`` and ``taken``."""
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
