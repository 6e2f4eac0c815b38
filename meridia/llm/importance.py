"""Importance resampling towards a target distribution, by bit-sliced aggregation.

A document's features fall into buckets, and a bucket's gain says how much more common
it is in the target than in the corpus. The counts of a document's buckets are laid out
as bit planes: plane p holds a bit per bucket, set where the count has the bit 2^p. Gains
are laid out in the same way, positive and negative ones apart. The sum of count times
gain then is that of 2^(p+q) times the population count of count plane p AND gain plane
q, exact and without a multiplication per bucket.

Corpus counts are summed in each task before they are shuffled: a task puts out a row
per bucket at most. What is broadcast has the size of the buckets' number. Drawing takes a range-partitioned rank.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import documents, stored
from meridia.operators.joins import global_rank

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bytes of a text that are split at once, and words whose buckets a task remembers.
PIECE, REMEMBERED = 1 << 20, 1 << 20
#: Documents whose planes are laid out at once.
TOGETHER = 64

_UPPER = {ord("A") + i: ord("a") + i for i in range(26)}
_PLAIN = bytes(_UPPER.get(c, c) if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def runs_of_words(text: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """Pieces of a text's features (runs of 1 to `longest` words, joined by a space), each with the number of its words."""
    before: list[bytes] = []
    start = 0
    while start < len(text):
        end = start + PIECE
        gap = _GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        words = text[start:end].translate(_PLAIN).split()
        start = end
        out = list(words)
        both = before + words
        for n in range(2, longest + 1):
            # Runs that end in this piece; those that end before it came with the piece before.
            out += [b" ".join(both[i - n : i]) for i in range(max(n, len(before) + 1), len(both) + 1)]
        before = both[len(both) - longest + 1 :] if longest > 1 else []
        yield out, len(words)


class Bucketer:
    """Buckets of features, remembered."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.known = buckets, longest, {}

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
        """A text's buckets in ascending order, their counts, and the numbers of its features and words."""
        counts: Counter = Counter()
        words = 0
        for features, n in runs_of_words(text, self.longest):
            words += n
            if len(self.known) > REMEMBERED:
                self.known = {}
            new = set(features).difference(self.known)
            self.known.update((f, zlib.crc32(f) % self.buckets) for f in new)
            counts.update(map(self.known.__getitem__, features))
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        order = np.argsort(at)
        return at[order], n[order], int(n.sum()), words


def _totals(buckets: int, longest: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucketer, total = Bucketer(buckets, longest), np.zeros(buckets, np.int64)
        for batch in arrow:
            for text in batch.column("text"):
                at, n, _, _ = bucketer.count(text.as_py().encode())
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """bucket and n, how many features of texts(text) fall into it; buckets without any have no row. Null texts count as empty."""
    text = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(_totals(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, a whole number of thousandths, of every bucket, from two tables of bucket_counts."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    sides = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    whole = sides.agg(F.sum("s").cast("double").alias("every"), F.sum("t").cast("double").alias("aim"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("every") + buckets) / ((s + 1) * (F.col("aim") + buckets))
    return sides.join(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def bit_planes(at: np.ndarray, row: np.ndarray, rows: int, buckets: int) -> np.ndarray:
    """Of each row a plane of bits, set at its entries' buckets, in 64-bit words."""
    bits = np.zeros((rows, -(-buckets // 64) * 64), np.uint8)
    bits[row, at] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Signed powers of two, each with the plane of the buckets whose gain has that bit."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        for q in range(int(size.max()).bit_length()):
            at = np.flatnonzero(size >> q & 1)
            out.append((sign << q, bit_planes(at, np.zeros(len(at), np.int64), 1, len(gain))[0]))
    return out


def plane_sums(at: np.ndarray, counts: np.ndarray, row: np.ndarray, rows: int, planes: list[tuple[int, np.ndarray]], buckets: int) -> np.ndarray:
    """Of each row the sum of count times gain over its entries (bucket, count)."""
    out = np.zeros(rows, np.int64)
    for p in range(int(counts.max(initial=0)).bit_length()):
        has = (counts >> p & 1).astype(bool)
        these, place = np.unique(row[has], return_inverse=True)
        bits = bit_planes(at[has], place, len(these), buckets)
        for power, plane in planes:
            out[these] += (power << p) * np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64)
    return out


def _weigher(shared, buckets: int, longest: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucketer, planes = Bucketer(buckets, longest), gain_planes(np.frombuffer(shared.value, np.int64))
        for batch in arrow:
            for start in range(0, len(batch), TOGETHER):
                part = batch.slice(start, TOGETHER)
                got = [bucketer.count(t.as_py().encode()) for t in part.column("text")]
                row = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
                sums = plane_sums(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), row, len(got), planes, buckets)
                n = np.array([g[2] for g in got], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array([g[3] for g in got], pa.int64()), pa.array(sums // np.maximum(n, 1))], ["doc_id", "n_features", "n_words", "weight"])

    return run


def weights(docs: DataFrame, gain: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """doc_id, n_features, n_words and weight, the floored mean gain of its features, of each row of docs(doc_id, text)."""
    # One row per bucket, a parameter of the caller's.
    rows = dict(gain.select("bucket", "gain").toPandas().itertuples(index=False))
    shared = docs.sparkSession.sparkContext.broadcast(np.array([rows[b] for b in range(buckets)], np.int64).tobytes())
    return docs.select("doc_id", "text").mapInArrow(_weigher(shared, buckets, longest), "doc_id long, n_features long, n_words long, weight long")


def noise(seed: int) -> Column:
    """A document's Gumbel noise in thousandths, a function of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank (null: not drawn).

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Of the documents with at least `least` words the given
    percentage, rounded down, of highest scores is drawn, ties to the smaller doc_id. Null and
    empty texts have no features, a weight of 0, and are drawn only where `least` is 0. A null doc_id is scored like the empty
    string and comes after all others in a tie; rows that repeat a doc_id are drawn each. An empty target gives every bucket that the
    corpus uses a loss; an empty table of documents gives no rows. Other columns aren't looked at.
    """
    rows = documents(docs, id_col, text_col)
    corpus = bucket_counts(rows, buckets, longest)
    wanted = bucket_counts(target.select(F.col(target_col).alias("text")), buckets, longest)
    scored = stored(weights(rows, stored(gains(corpus, wanted, buckets), "gains"), buckets, longest).withColumn("score", F.col("weight") + noise(seed)), "scored")
    fit = scored.where(F.col("n_words") >= least)
    drawn = fit.count() * percent // 100
    ranked = global_rank(fit, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")], "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, rank.cast("long").alias("rank")).unionByName(rest)


#: The cyclic redundancy check of distinct words, byte by byte; its table follows from the reversed polynomial.
RESAMPLE_SQL = f"""WITH shifts AS (SELECT list_reduce(range(0, 9), lambda c, s: CASE WHEN s = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v, i FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS lookup FROM shifts),
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
uses AS (SELECT word, count(*) AS n FROM words GROUP BY word), wanted AS (SELECT word, count(*) AS n FROM target GROUP BY word),
distinct_words AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM uses UNION SELECT word FROM wanted)),
bucketed AS (SELECT word, xor(list_reduce(list_transform(range(0, length(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT),
    lambda c, b: xor(c >> 8, lookup[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM distinct_words, crc),
s AS (SELECT bucket, sum(n) AS s FROM uses JOIN bucketed USING (word) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM wanted JOIN bucketed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM uses)::DOUBLE AS every, (SELECT coalesce(sum(n), 0) FROM wanted)::DOUBLE AS aim),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (every + {BUCKETS}) / ((s::DOUBLE + 1) * (aim + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM words JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - (((total % n) + n) % n)) // n, 0)::BIGINT AS weight,
  ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS fit FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * fit // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
