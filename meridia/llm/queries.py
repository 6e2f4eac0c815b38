"""The queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import alignment, bpe, chat, exact_dedup, importance, lengths, licences, mixing, near_dedup, quality, suffix_dedup, transport, warc
from meridia.llm.common import stored, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(licences.bound_paths(table(spark, sf_dir, "documents")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    messages = stored(chat.chains(rows.unionByName(chat.own_conversation(spark))), "messages")
    return chat.digests(chat.read_back(stored(chat.format_paths(messages), "formatted")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(transport.write_streams(table(spark, sf_dir, "documents")), "media")
    return transport.read_streams(media)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_quality_classifier,
        op3_license_scan,
        op4_chat_format,
        op5_exact_dedup,
        op6_token_lengths,
        op7_bpe,
        op8_transport_stream,
        op9_mixing,
        op10_warc,
        op11_importance_resampling,
        op12_suffix_dedup,
        op13_tokenizer_alignment,
    )
}

OP5_SQL = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

SQL: dict[str, str] = {
    "op4_chat_format": chat.CHAT_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op9_mixing": f"WITH RECURSIVE {mixing.mix_sql('documents')}\nSELECT * FROM mixed",
    "op10_warc": warc.WARC_SQL,
    "op11_importance_resampling": importance.RESAMPLE_SQL,
}
