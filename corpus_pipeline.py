"""The corpus pipeline: five stages, each on all documents that the one before kept.

Each stage's rows are written and read again, so that a lost executor costs no more
than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import bpe, exact_dedup, mixing, near_dedup, quality
from meridia.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like texts without words; rows that repeat a doc_id share its fate; without labels, and of
    an empty table, no rows are left.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that of the largest doc_id.

    Null and empty texts are equal; a null doc_id stays only where its text has no other; repeated rows become one; an empty
    table gives no rows.
    """
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, 0.8) the smallest doc_id stays.

    Null and empty texts are linked with nothing and stay; a null doc_id stays unless an exact copy has one; repeated rows become
    one; an empty table gives no rows.
    """
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are thinned or repeated, mixing.COPIES times at most, by the factors that meet the target weights.

    Null sources, languages and texts count as ''; documents without tokens are never repeated; rows that repeat a doc_id are
    drawn alike; an empty table gives no rows.
    """
    return mixing.sample(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and decoded texts, as digests, one row for each that comes in.

    Null and empty texts have no tokens; rows that repeat are encoded each; a null doc_id stays null; an empty table gives no rows.
    """
    return bpe.encode_decode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The classifier, the MinHash stage and the encoder are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
