"""A training-data pipeline over documents: quality rules, near-duplicates, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, mixing, near_dedup, quality, sharding
from tidemark.llm.common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled cutoffs reject go.

    Null and wordless texts fail the base rules. A label of a document that is not there counts for nothing, several labels of
    one count once; without labels the base rules alone decide. Repeated rows are judged each; texts are read whole.
    """
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id (null last), of equal ones that of the
    least md5 of the text; of rows that repeat, one. Null text is the empty text."""
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go. Null and wordless texts and items match nothing; repeated
    rows go or stay alike; without items all stay."""
    return decontam.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document. Sources by code point, null last, have the weights in turn; documents
    without words give none; repeated rows count each."""
    return mixing.emit(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot in a reproducible shuffle; rows that are equal are interchangeable, a table without
    rows has none."""
    return sharding.shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]
#: The learned cutoffs and the signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each one's result written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
