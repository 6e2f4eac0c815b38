"""Exact length histogram of a corpus in tokens.

Documents are encoded and counted by length; what any context limit asks for follows
from sums over the histogram, never from the documents again. The histogram is summed
from its end in blocks of lengths, so no task orders all lengths.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import documents, stored

BLOCK = 512
#: Blanks as the public pattern knows them (Unicode's white space), and how many in a row are counted apart.
BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 1000


def rank_file() -> str:
    """The public byte-level BPE ranks of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def load(ranks: bytes, split: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=split, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


@lru_cache(maxsize=4)
def _runs(least: int) -> re.Pattern:
    return re.compile(f"[{BLANKS}]{{{least},}}")


def token_count(encoding, text: str, blanks_apart: bool = True, least: int = LONG_RUN) -> int:
    """How many tokens a text has.

    The library's matcher overflows on very long runs of blanks, so these are counted apart. The public pattern parts such a run in a
    known way: all of it is one piece at the end of the text; else its last blank goes to what follows, and the rest is one piece.
    """
    if not blanks_apart:
        return len(encoding.encode_ordinary(text))
    total, start = 0, 0
    for run in _runs(least).finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if end > run.start():
            total += len(encoding.encode_ordinary(text[start : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end].encode()))
            start = end
    return total + len(encoding.encode_ordinary(text[start:]))


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split, public = shared.value
        encoding = load(ranks, split)
        for batch in batches:
            n = [token_count(encoding, t.as_py(), public) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def encoded_lengths(docs: DataFrame, path: str | None = None, split: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of each document.

    `split` is a pattern other than the public one. Null texts count as empty, a null doc_id stays null, rows that repeat are encoded each, other columns aren't looked at, an
    empty table gives no rows.
    """
    with open(path or rank_file(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), split or pattern(), split is None))
    return documents(docs, id_col, text_col).mapInArrow(_counter(shared), "doc_id long, n_tokens long")


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per length that occurs: context_limit, documents, and for a limit of that length documents_within,
    documents_beyond, tokens_within (of documents that fit), tokens_truncated (of all, cut to the limit), tokens_total and share_within.

    Null lengths are left out. An empty table gives no rows.
    """
    counts = stored(lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("context_limit")).agg(F.count(F.lit(1)).alias("documents")).withColumn("block", F.expr(f"context_limit div {BLOCK}")), "lengths")
    tokens = F.col("context_limit") * F.col("documents")
    blocks = counts.groupBy("block").agg(F.sum("documents").alias("d"), F.sum(tokens).alias("t"))
    # One row per BLOCK lengths: as many as the longest document has blocks.
    after, every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    beyond = Window.partitionBy("block").orderBy(F.col("context_limit").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda x, more: F.coalesce(F.sum(x).over(beyond), F.lit(0)) + F.col(more)
    rows = counts.join(blocks, "block").select("context_limit", "documents", rest(F.col("documents"), "d_after").alias("documents_beyond"), rest(tokens, "t_after").alias("tokens_beyond"), "d_all", "t_all")
    return rows.select(
        "context_limit",
        "documents",
        (F.col("d_all") - F.col("documents_beyond")).alias("documents_within"),
        "documents_beyond",
        (F.col("t_all") - F.col("tokens_beyond")).alias("tokens_within"),
        (F.col("t_all") - F.col("tokens_beyond") + F.col("documents_beyond") * F.col("context_limit")).alias("tokens_truncated"),
        F.col("t_all").alias("tokens_total"),
        ((F.col("d_all") - F.col("documents_beyond")) / F.col("d_all")).alias("share_within"),
    )


def truncated_total(table: DataFrame, limit: int) -> Column | int:
    """Tokens of the corpus with documents cut to `limit`, from a histogram table."""
    got = table.agg(F.sum(F.least(F.col("context_limit"), F.lit(limit)) * F.col("documents")).alias("t")).first()["t"]
    return int(got or 0)


def quantile(table: DataFrame, share: float) -> int | None:
    """The least length within which that share of the documents lies."""
    return table.where(F.col("share_within") >= share).agg(F.min("context_limit").alias("q")).first()["q"]
