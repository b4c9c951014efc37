"""From raw documents to a mixed training corpus, in five stages.

Each stage is written as Parquet in the shared folder and read back as the next one's input.

Cases: a null or empty text has no words, fails the base rule and goes in the first stage; a null id is near nothing and
stays, a null source is a source; of repeated rows one stays; texts of any length are read whole; an empty table passes
all stages as one, and without labels the base rule alone decides; without a benchmark nothing is contaminated.  Other
columns, whatever their names, go through all stages as they are; the last one adds ``copy``, or ``copy_`` where that is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontaminate, mixing, pii, quality_rules, similarity_join
from pagemill.llm.common import saved, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned quality rules keep."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def single_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return similarity_join.drop_near_copies(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs, chars="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken for the mix, a row for each copy."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", single_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("PII", without_personal_data),
    ("mixing sources", mixed),
]
#: The learned rules have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
