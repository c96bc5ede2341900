"""The corpus pipeline: stages that take documents to the mix that is trained on.

Each stage takes what its predecessor kept.  All but the last return the columns of
documents; a stage's operator tells how nulls, ties and repeated rows are treated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import decontaminate, language, line_dedup, mixing, simhash
from featloom.llm.common import table
from featloom.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or of no language that was learned."""
    return language.keep_known(docs, language.learn(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines that stand earlier; documents with no line left of some go."""
    left = line_dedup.dedup(docs)
    return left.where(F.col("text").isNull() | (F.regexp_count("text", F.lit(line_dedup.WORDS)) > 0))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked SimHash fingerprints."""
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which 5 % or more of the words are inside benchmark windows."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document left the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
]

# SimHash groups and language profiles are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before has kept, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
