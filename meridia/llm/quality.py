"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has a fixed sparse ternary index vector, and its word vector is the sum of
the index vectors around all its occurrences in the corpus: integers, summed by Spark
over all documents. Words are runs of one kind of character (lower case, capitals,
digits, other marks), hashed to BUCKETS rows, so the table has the same few megabytes
for any corpus. A run that repeats one of the two runs before it is read as a word of
its own, one per kind. A document is the mean of its words' unit vectors; a network with
one hidden layer, fitted in numpy on a bounded sample of labelled rows, gives a logit,
and a temperature fitted on rows kept apart makes it a calibrated probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import documents
from meridia.llm.words import batches as runs_of
from meridia.llm.words import span_hashes

BUCKETS, DIMENSIONS, REACH, HIDDEN = 1 << 15, 32, 2, 24
#: The most labelled rows that the network is fitted on, taken by the hash of doc_id.
SAMPLE = 20_000
KEEP_FROM = 0.7

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[0x80:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4


def index_vectors() -> np.ndarray:
    """Ternary, four entries of each sign in a row."""
    rng = np.random.default_rng(11)
    order = rng.random((BUCKETS, DIMENSIONS)).argsort(axis=1)
    return ((order < 4).astype(np.int8) - (order >= DIMENSIONS - 4).astype(np.int8)).astype(np.int8)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word of the texts, in order, and at i the number of words before text i."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = np.concatenate((np.zeros(1, np.uint8), _KIND[buffer]))
    # A capital that begins a word goes with it.
    edge = (kind[1:] != kind[:-1]) & ~((kind[1:] == 1) & (kind[:-1] == 2) & (np.concatenate((np.zeros(1, np.uint8), kind[:-2])) != 2))
    edge = np.flatnonzero(edge)
    starts, ends = edge, np.append(edge[1:], len(buffer))
    real = kind[starts + 1] != 0
    starts, ends = starts[real], ends[real]
    bucket = (span_hashes(buffer, starts, ends) % np.uint64(BUCKETS - 8)).astype(np.uint16)
    before = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    text = np.repeat(np.arange(len(texts)), np.diff(before))
    again = np.zeros(len(bucket), bool)
    for d in (1, 2):  # within a text: what stands beside it in a batch says nothing of it
        again[d:] |= (bucket[d:] == bucket[:-d]) & (text[d:] == text[:-d])
    bucket = np.where(again, (kind[starts + 1].astype(np.uint16) + (BUCKETS - 8)).astype(np.uint16), bucket)
    return bucket, before


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _gatherer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    total = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    for batch in batches:
        for _, part in runs_of(_texts(batch)):
            bucket, before = words_of(part)
            if not len(bucket):
                continue
            text = np.repeat(np.arange(len(part)), np.diff(before))
            around = np.zeros((len(bucket), DIMENSIONS), np.int16)
            for d in range(1, min(REACH, len(bucket) - 1) + 1):
                same = (text[d:] == text[:-d])[:, None]
                around[d:] += index[bucket[:-d]] * same
                around[:-d] += index[bucket[d:]] * same
            order = np.argsort(bucket, kind="stable")
            there, first = np.unique(bucket[order], return_index=True)
            total[there] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
    used = np.flatnonzero(total.any(axis=1))
    for i in range(0, len(used), 4096):
        rows = used[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *[pa.array(total[rows, d]) for d in range(DIMENSIONS)]], ["bucket", *[f"v{d}" for d in range(DIMENSIONS)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets (zero: unused), from all of docs(doc_id, text); a table of fixed size."""
    names = [f"v{d}" for d in range(DIMENSIONS)]
    rows = docs.select("text").mapInArrow(_gatherer, "bucket int, " + ", ".join(f"{n} long" for n in names))
    got = rows.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((BUCKETS, DIMENSIONS), np.float64)
    if len(got):
        out[got["bucket"].to_numpy()] = got[names].to_numpy()
        out -= np.outer(np.abs(out).sum(axis=1), out.sum(axis=0) / max(1, np.abs(out).sum()))
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """The mean word vector of each text and, last, the logarithm of one plus its words."""
    out = np.zeros((len(texts), DIMENSIONS + 1))
    for start, part in runs_of(texts):
        bucket, before = words_of(part)
        n = np.diff(before)
        some = np.flatnonzero(n)
        if len(some):
            sums = np.add.reduceat(vectors[bucket], before[:-1][some], axis=0, dtype=np.float64)
            out[start + some, :-1] = sums / n[some, None]
        out[start : start + len(part), -1] = np.log1p(n)
    return out


class Network:
    """Two layers, tanh between, fitted by full-batch Adam; with the inputs' scale and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(5)
        fit = ~apart if (~apart).any() else apart
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        self.layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        z, t = (x[fit] - self.mean) / self.scale, y[fit]
        first, second = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers]
        for step in range(1, rounds + 1):
            w1, b1, w2, b2 = self.layers
            h = np.tanh(z @ w1 + b1)
            err = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - t) / len(t)
            back = np.outer(err, w2) * (1 - h * h)
            grads = [z.T @ back + decay * w1, back.sum(axis=0), h.T @ err + decay * w2, err.sum(keepdims=True)]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.layers[i] = self.layers[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        rest = apart if apart.any() else fit
        logit, t = self.logit(x[rest]), y[rest]
        loss = lambda s: np.logaddexp(0, -(2 * t - 1) * logit / s).mean()
        self.temperature = float(min(np.geomspace(0.5, 8, 49), key=loss))

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _pooler(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(_texts(batch), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return run


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            texts = _texts(batch)
            score = network(pool(texts, vectors)) if network is not None and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: likelier label 1), predicted.

    Labels of rows whose crc32 of the doc_id's text modulo 4 is 2 are never looked at.
    Of the others `sample` at most are fitted on, those of the smallest hash; a fifth
    of these only sets the temperature. Null and empty texts are scored like a text
    without words. A null doc_id is not held out; labels that are null, or disagree for one
    doc_id, are left out. Without labels each score is 0.5. Rows that repeat a
    doc_id are scored each, and of their texts that of the least pooled vector is fitted on; other columns aren't looked at; an empty table gives no rows.
    """
    docs = documents(docs, id_col, text_col)
    context = docs.sparkSession.sparkContext
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held)
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y")
    vectors = word_vectors(docs)
    texts = docs.join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers
    rows = texts.select("doc_id", "text").mapInArrow(_pooler(context.broadcast(vectors)), "doc_id long, x array<double>").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    network = None
    if len(rows):
        apart = np.array([zlib.crc32(b"t%d" % i) % 5 == 0 for i in rows["doc_id"]])
        network = Network(np.stack(rows["x"].to_list()), rows["y"].to_numpy(float), apart)
    scored = docs.mapInArrow(_scorer(context.broadcast((vectors, network))), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that are predicted good.

    Rows that repeat a doc_id stay together where one of them is predicted good; null ids, texts and labels as in score(); an
    empty table, or one without labels (each score is 0.5), gives no rows.
    """
    good = score(docs, labels, id_col, text_col, **options).where("predicted = 1").select(F.col("doc_id").alias("_good_id")).distinct()
    return docs.join(good, F.col(id_col).cast("long").eqNullSafe(F.col("_good_id")), "left_semi")
