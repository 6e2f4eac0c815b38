"""MinHash near-dedup with odd sketches.

Each text becomes a set of word shingles, MinHash samples of the set, band keys of
the samples, and an odd sketch: the samples folded into a parity bitmap. Where two
samples agree their bits cancel, so the population count of two bitmaps' XOR tells
how many differ, most precisely where few do. Texts with one set stand for each
other. Band keys propose pairs of sets, sketches strike off those clearly below the
threshold, and full sets confirm the rest.

A bucket of up to SMALL sets proposes all its pairs. A larger one first proposes
its members with a few hubs; where the links found so far leave it in several
components, the members outside of the largest are held against all members by
their sketches, in blocks of bounded size; members with a possible partner come again
with their full sets, in blocks of bounded numbers and bytes. Blocks put out members and links, never
mere candidates. So no group is ever gathered whole, pairs
already known to be connected are never formed, and no link that could join two
components goes unlooked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import by_bytes, documents, join_bounded, kept_rows, stored
from meridia.llm.words import mix, shingle_sets
from meridia.operators.graph import components

BANDS, ROWS, BITS = 52, 6, 1024
#: BLOCK counts sets, HEAVY shingles: a block deals with about BLOCK by BLOCK sets, of about HEAVY shingles on each side at most.
SMALL, HUBS, BLOCK, HEAVY = 16, 3, 256, 1 << 18


def sketch_limit(threshold: float, samples: int = BANDS * ROWS, bits: int = BITS, deviations: float = 4.5) -> int:
    """The XOR population count that a pair at the threshold exceeds less than once in a hundred thousand times."""
    differing = samples * (1 - threshold) + deviations * sqrt(samples * threshold * (1 - threshold))
    expected = bits * (1 - exp(-4 * differing / bits)) / 2
    return ceil(expected + 2 * sqrt(expected * (1 - expected / bits)))


def _signer(k: int, bands: int, rows: int, bits: int):
    samples = bands * rows
    rng = np.random.default_rng(7)
    odd = rng.integers(1, 2**63, (samples, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(1, 2**63, samples, dtype=np.uint64)
    place = np.arange(bands, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            marks = [hashlib.md5(t).digest() for t in texts]
            texts = [t.lower() for t in texts]  # bytes: A-Z alone
            n, ids, keys, sketches = [], [], [], []
            for s in shingle_sets(texts, k):
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if not len(s):
                    keys.append([])
                    sketches.append([])
                    continue
                low = np.full(samples, 2**64 - 1, np.uint64)
                for i in range(0, len(s), 1024):
                    np.minimum(low, (s[None, i : i + 1024] * odd).min(axis=1), out=low)
                got = mix(low + salt)
                band = np.zeros(bands, np.uint64)
                for r in range(rows):
                    band = mix(band + got.reshape(bands, rows)[:, r])
                keys.append(mix(band ^ place).view(np.int64).tolist())
                parity = np.bincount((got % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
                sketches.append(np.packbits(parity).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(marks, pa.binary()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "mark", "n", "set_id", "keys", "sketch"],
            )

    return sign


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, mark (the text's MD5), n (set size), set_id, keys (one per band) and sketch of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_signer(k, bands, rows, bits), "doc_id long, mark binary, n long, set_id binary, keys array<long>, sketch array<long>")


def _set_maker(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = [t.lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sets = [s.tobytes() for s in shingle_sets(texts, k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return make


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "sa"):
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _apart(a: str, b: str) -> Column:
    """How many bits of two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _near_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _near(table: pa.Table, limit: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of asking and of held rows, in different components, whose sketches and sizes leave a link possible."""
    comp, n = table.column("component").to_numpy(), table.column("n").to_numpy()
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    words = np.array(table.column("sketch").to_pylist(), np.int64).view(np.uint64).reshape(len(n), -1)
    q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
    for i in range(0, len(q), 128):
        part = q[i : i + 128]
        apart = np.zeros((len(part), len(d)), np.uint16)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[part, w][:, None] ^ words[d, w][None, :])
        small, large = np.minimum(n[part][:, None], n[d]), np.maximum(n[part][:, None], n[d])
        x, y = np.nonzero((apart <= limit) & (comp[part][:, None] != comp[d]) & (100 * small >= percent * large))
        yield part[x], d[y]


def _possible(limit: int, percent: int):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        hit = np.zeros(len(table), bool)
        for x, y in _near(table, limit, percent):
            hit[x] = hit[y] = True
        return table.select(["key", "rep"]).filter(pa.array(hit))

    return compare


def _linked(limit: int, percent: int):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        rep, sets = table.column("rep").to_numpy(), table.column("shingles").to_pylist()
        out = []
        for x, y in _near(table, limit, percent):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                s, t = np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[j], np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return compare


def _in_blocks(rows: DataFrame, pieces: DataFrame, more: list[str]) -> DataFrame:
    """Every row of rows(key, rep, component, n, sketch) once per block of its bucket's asking rows, and asking rows (outside the main component) once per block of all.

    pieces(key, main, p, q) says into how many parts all rows, and the asking ones, are dealt. The
    rows come out dealt by block: a grouping on (key, i, j) alone would be content with rows dealt by
    key, and all blocks of a bucket would then be one task's.
    """
    rows = join_bounded(rows, stored(pieces, "pieces"), ["key"], "inner")
    spread = F.xxhash64("rep")
    kept = ["rep", "component", "n", "sketch", *more]
    held = rows.select("key", F.pmod(spread, F.col("p")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), *kept, F.lit(False).alias("asks"))
    asks = rows.where("component <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.pmod(spread, F.col("q")).cast("int").alias("j"), *kept, F.lit(True).alias("asks"))
    return held.unionByName(asks).repartition("key", "i", "j")


def _residual(members: DataFrame, sets: DataFrame, links: DataFrame, docs: DataFrame, k: int, limit: int, percent: int) -> DataFrame | None:
    """Links between members of large buckets that are in different components, None if no sketch leaves one possible."""
    of = members.join(links, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = of.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"))
    buckets = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("parts"))
    # Buckets of other bands with the same members add nothing.
    buckets = stored(buckets.where("parts > 1").groupBy("m", "h").agg(F.min(F.struct("key", "main", "most")).alias("b")).select("b.*", "m"), "buckets")
    pieces = buckets.select("key", "main", F.ceil(F.col("m") / BLOCK).cast("int").alias("p"), F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("int").alias("q"))
    rows = stored(of.join(buckets.select("key"), "key").join(sets.select("rep", "n", "sketch"), "rep"), "bucket-rows")
    found = _in_blocks(rows, pieces, []).groupBy("key", "i", "j").applyInArrow(_possible(limit, percent), "key long, rep long").distinct()
    found = stored(found, "possible")
    if found.isEmpty():
        return None
    full = shingles(docs, found.select(F.col("rep").alias("doc_id")), k)
    rows = stored(rows.join(found, ["key", "rep"]), "bucket-rows")
    asking = F.when(F.col("component") != F.col("main"), F.col("n"))
    sums = [F.sum("n").alias("all"), F.count(F.lit(1)).alias("all_n"), F.coalesce(F.sum(asking), F.lit(0)).alias("own"), F.count(asking).alias("own_n")]
    weights = rows.join(buckets.select("key", "main"), "key").groupBy("key", "main").agg(*sums).where("own > 0")
    dealt = lambda shingles_, sets_: F.greatest(F.ceil(F.col(shingles_) / HEAVY), F.ceil(F.col(sets_) / BLOCK)).cast("int")
    pieces = weights.select("key", "main", dealt("all", "all_n").alias("p"), dealt("own", "own_n").alias("q"))
    rows = rows.join(full, F.col("rep") == F.col("doc_id")).drop("doc_id")
    return stored(_in_blocks(rows, pieces, ["shingles"]).groupBy("key", "i", "j").applyInArrow(_linked(limit, percent), "a long, b long").distinct(), "residual")


def _grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, mark, n, set_id and component of each row of docs(doc_id, text)."""
    signed = stored(signatures(docs, k, bands, rows), "signatures")
    found = signed.where("n > 0")
    # Tables that a common set or key is joined with are stored first: Spark then can split that key's rows over tasks.
    of_set = stored(found.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "set-ids")
    own = found.join(of_set.select(F.col("rep").alias("doc_id"), "set_id"), ["doc_id", "set_id"]).dropDuplicates(["doc_id", "set_id"])
    sets = stored(own.select(F.col("doc_id").alias("rep"), "set_id", "n", "keys", "sketch"), "sets")
    limit = sketch_limit(percent / 100, bands * rows)

    keyed = sets.select(F.explode("keys").alias("key"), "rep")
    hubs = [F.min_by("rep", F.xxhash64(F.lit(i), "rep")).alias(f"h{i}") for i in range(1, HUBS)]
    buckets = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("h0")).where("m > 1"), "buckets")
    members = stored(keyed.join(buckets, "key"), "members")
    few = members.where(F.col("m") <= SMALL)
    lists = few.groupBy("key").agg(F.collect_set("rep").alias("l"))  # SMALL at most
    ones = lists.select(F.explode("l").alias("a"), "l").select("a", F.explode(F.filter("l", lambda x: x > F.col("a"))).alias("b"))
    many = members.where(F.col("m") > SMALL)
    stars = many.select(F.col("h0").alias("a"), F.col("rep").alias("b"))
    others = stored(many.groupBy("key").agg(*hubs), "hubs")
    for i in range(1, HUBS):
        stars = stars.union(many.join(others, "key").select(F.least("rep", f"h{i}"), F.greatest("rep", f"h{i}")))
    asked = ones.union(stars).where("a <> b").distinct()
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    likely = stored(asked.join(side("a"), "a").join(side("b"), "b").where(_near_sizes("na", "nb", percent) & (_apart("ka", "kb") <= limit)).select("a", "b"), "likely")
    links = confirmed(likely, docs, k, percent)
    groups = stored(components(links), "components")

    more = _residual(many.select("key", "rep"), sets, groups, docs, k, limit, percent)
    if more is not None:
        groups = stored(components(links.union(more)), "components")
    of_rep = of_set.join(groups, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("c"))
    joined = signed.join(of_rep, "set_id", "left")
    component = F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "mark", "n", "set_id", component.alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of
    distinct k-word shingles (A-Z lower-cased, words parted by ASCII white space; fewer
    words: the whole sequence). component_id is the smallest doc_id reachable. Null and
    empty texts have no shingles and are linked with nothing. A null doc_id takes the
    component of its exact copies that have one, else it stays by itself, with a null
    component_id. Rows that repeat a doc_id are looked at each. Other columns are not looked
    at; an empty table gives no rows.
    """
    got = _grouped(documents(docs, id_col, text_col), k, percent, bands, rows)
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def shingles(docs: DataFrame, wanted: DataFrame, k: int, most: int = 1_000_000) -> DataFrame:
    """The stored full sets of the documents whose doc_id is wanted. Up to `most` ids, of eight bytes, are broadcast; more are joined by a shuffle of the texts."""
    ids = stored(wanted.distinct(), "wanted")
    return stored(join_bounded(docs, ids, ["doc_id"], "left_semi", most).mapInArrow(_set_maker(k), "doc_id long, shingles binary"), "shingles")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The stored pairs (a, b) of doc_ids whose full sets meet the threshold."""
    sets = shingles(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), k)
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return stored(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long").distinct(), "links")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, of each component: that with its smallest doc_id.

    Null and empty texts are linked with nothing and stay, one row per doc_id. Where rows repeat the
    doc_id that stays, one of each set of shingles stays: that of the smallest MD5 of its text, and of equal
    texts the one that kept_rows() says. A null doc_id stays only where no exact copy has one. An empty
    table gives no rows.
    """
    got = _grouped(documents(docs, id_col, text_col), k, percent, BANDS, ROWS).where(F.col("doc_id").eqNullSafe(F.col("component")))
    texts = got.groupBy("doc_id", "set_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    kept = texts.groupBy("doc_id", "set_id").agg(F.min(F.struct("mark", "times")).alias("one")).select("doc_id", "one.mark", "one.times")
    return kept_rows(docs, kept, F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), id_col, text_col)
