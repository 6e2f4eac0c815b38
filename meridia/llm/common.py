"""What the operators of this subpackage share; lineage is cut as in the rest of the library."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.shared import join_bounded, scratch, stored

__all__ = ["by_bytes", "documents", "join_bounded", "kept_rows", "scratch", "stored", "table"]

#: Bytes of texts that a task turns into Python objects at a time.
TOGETHER = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Iterable[str] = ()) -> DataFrame:
    """doc_id long and text string (null: empty), and of the other columns only those named."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose values of `column`, strings or binaries, have `most` bytes at most, or are one row. Nulls have none; batches without rows are left out."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def kept_rows(docs: DataFrame, kept: DataFrame, mark: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose doc_id and mark are in kept(doc_id, mark, times), where `times` rows of docs share the two.

    Of rows that share both one stays: a text that isn't null before one that is, then the one whose other
    columns come first as JSON. A null doc_id is matched like any other.
    """
    kept = stored(kept.select(F.col("doc_id").alias("_kept_id"), F.col("mark").alias("_kept_mark"), "times"), "kept")
    own, of = F.col(id_col).cast("long"), F.col("_kept_mark")
    lone = docs.join(kept.where("times = 1"), own.eqNullSafe(F.col("_kept_id")) & (mark == of), "left_semi")
    many = kept.where("times > 1")
    if many.isEmpty():
        return lone
    row = F.struct(*[F.col(c) for c in docs.columns])
    order = F.struct(F.col(text_col).isNull(), F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text_col])))
    same = docs.join(many, own.eqNullSafe(F.col("_kept_id")) & (mark == of), "left_semi").groupBy(own.alias("_kept_id"), mark.alias("_kept_mark"))
    return lone.unionByName(same.agg(F.min_by(row, order).alias("_kept_row")).select("_kept_row.*"))
