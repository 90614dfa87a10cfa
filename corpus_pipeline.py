"""A training corpus from raw documents: five stages, each written and read again before the next one.

Each stage takes the columns of documents, whatever others come with them and however these are called, and returns them
(the last one also copy_no). Rows without a doc_id pass the stages that need one unchanged. Null, empty and very long
texts are judged as each operator says: a null text stays null; a text without words is no copy of another, holds no
benchmark item and is never taken by the mix. Of repeated rows the near-duplicate stage keeps one; ties go to the smaller
doc_id. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm._spark import cut, ship, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mix
from tessera.llm.ngram_join import one_of_each
from tessera.llm.quality_classifier import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go, but for their first occurrence."""
    ship(spark)
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links on word shingles stays."""
    ship(spark)
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, with copy_no."""
    ship(spark)
    return mix(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram join", near_duplicates), ("decontamination", benchmark), ("mixing", mixture)]
#: The classifier is trained and the rounding drawn: SQL can't state the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
