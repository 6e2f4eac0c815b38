"""Removal of passages that occur more than once, with suffix arrays in a logarithmic index family.

A window is a run of `length` bytes of one text. Windows are dealt out so that equal ones
meet: each belongs to its anchor, the smallest hash of the runs of bytes within it, and
consecutive windows with one anchor form a stretch, dealt by the anchor. A stretch's place, anchor and digest are some
per cent of the text; only they are counted over all documents.

- A stretch whose anchor occurs once holds nothing that occurs again.
- All windows of a stretch that occurs twice do.
- Stretches that share an anchor but not their bytes are looked at byte by byte. Each task
  keeps a family of suffix arrays over the stretches dealt to it: a new batch gets a suffix array of its
  windows, is merge-scanned against every level for matches as long as a window, and what is
  left of it becomes a level; levels of equal size are merged, so sizes
  grow geometrically and a window moves a logarithmic number of times.

One anchor may have very many different stretches (a passage behind which each document
goes on in its own way). Beyond a bound these do not go to one task: blocks of their windows
are compared by 128-bit digests, counted before the shuffle, and only blocks that hold both
windows that occur again and windows that may not are cut into smaller ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import documents, stored
from meridia.llm.words import batches, span_hashes

LENGTH = 200
#: Windows of a stretch, and of a text that are looked at at once.
STRETCH, SEGMENT = 256, 1 << 18
#: Different stretches of an anchor beyond which they are compared in blocks of windows; stretches of a batch and about those of a task.
HOT, BATCH, TASK = 512, 512, 4096
#: Places in an anchor's reach that a hot stretch's windows are looked at together, round by round.
BLOCK = (64, 16, 4, 1)


def anchor_size(length: int) -> int:
    return max(1, length * 28 // 100)


def _over(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    got, size = values, 1
    while size * 2 <= width:
        got = pick(got[:-size], got[size:])
        size *= 2
    return pick(got[: len(values) - width + 1], got[width - size :][: len(values) - width + 1])


def stretches(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the texts buffer[start:end]: text, first window, number of windows, anchor, and whether a window might occur in it twice."""
    size = anchor_size(length)
    width = length - size + 1
    none = np.zeros(0, np.int64)
    if len(buffer) < length:
        return none, none, none, none, none.astype(bool)
    at = np.arange(len(buffer) - size + 1)
    hashes = span_hashes(buffer, at, at + size)
    least = _over(hashes, width, np.minimum)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + length <= ends[text])
    if not len(inside):
        return none, none, none, none, none.astype(bool)
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) != 1) | (least[inside][1:] != least[inside][:-1]) | (text[inside][1:] != text[inside][:-1])
    # Runs of more windows than STRETCH (of periodic text) are cut.
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(inside)))
    pieces = -(-n // STRETCH)
    begin = np.repeat(first, pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    n = np.minimum(np.diff(np.append(begin, len(inside))), STRETCH)
    begin = inside[begin]
    anchor = least[begin]
    # Places of anchors: where a run's hash is the least of some window. Two of one hash in a stretch: a window may occur in it twice.
    most = _over(np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64))), width, np.maximum)
    place = np.flatnonzero(hashes == most)
    kinds, kind = np.unique(hashes[place], return_inverse=True)
    ordered = np.sort(kind.astype(np.int64) << 32 | place)
    key = np.searchsorted(kinds, anchor).astype(np.int64) << 32
    twice = np.searchsorted(ordered, key | (begin + n - 1 + width)) - np.searchsorted(ordered, key | begin) > 1
    return text[begin], begin, n, anchor.view(np.int64), twice


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of whole texts, or windows of long ones: numbers of the texts, offsets, bytes."""
    for i, part in batches(texts, SEGMENT):
        if len(part) > 1 or len(part[0]) <= 2 * SEGMENT:
            yield list(range(i, i + len(part))), [0] * len(part), part
        else:
            for start in range(0, len(part[0]) - length + 1, SEGMENT):
                yield [i], [start], [part[0][start : start + SEGMENT + length - 1]]


def _slices(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of bounded bytes, or of one longer text, with their texts."""
    column, start = batch.column("text").cast(pa.binary()), 0
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    while start < len(batch):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most, "right")))
        yield batch.slice(start, n), column.slice(start, n).to_pylist()
        start += n


def _finder(length: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for part, texts in _slices(batch):
                found = [[np.zeros(0, np.int64)] * 5]
                for numbers, offsets, group in _segments(texts, length):
                    sizes = np.array([len(t) for t in group])
                    ends = np.cumsum(sizes)
                    data = b"".join(group)
                    text, begin, n, anchor, twice = stretches(np.frombuffer(data, np.uint8), ends - sizes, ends, length)
                    digests = [int.from_bytes(hashlib.blake2b(data[b : b + k + length - 1], digest_size=8).digest(), "little", signed=True) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
                    # Where a window may occur twice, the number of windows is put out as negative.
                    found.append([np.array(numbers)[text], begin - (ends - sizes)[text] + np.array(offsets, np.int64)[text], np.where(twice, -n, n), anchor, np.array(digests, np.int64)])
                of, start, n, anchor, digest = (np.concatenate(x) for x in zip(*found, strict=True))
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts))))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (start, n.astype(np.int32), anchor, digest)]
                marks = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([marks, part.column("doc_id"), *lists], ["mark", "doc_id", "start", "n", "anchor", "digest"])

    return run


def _cutter(length: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
                data, cuts = text.as_py().encode(), cuts.as_py()
                for i in range(0, len(cuts), 4096):
                    part = cuts[i : i + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([c["anchor"] for c in part], pa.int64()),
                            pa.array([c["digest"] for c in part], pa.int64()),
                            pa.array([c["kinds"] for c in part], pa.int64()),
                            pa.array([data[c["start"] : c["start"] + c["n"] + length - 1] for c in part], pa.binary()),
                        ],
                        ["anchor", "digest", "kinds", "bytes"],
                    )

    return run


class Level:
    """A suffix array: slots of windows in the order of the bytes that begin there, which are kept beside them so that a scan is sequential."""

    def __init__(self, windows: np.ndarray, slot: np.ndarray):
        self.windows, self.slot = windows, slot

    def __len__(self) -> int:
        return len(self.slot)

    def only(self, keep: np.ndarray) -> Level:
        return Level(self.windows[keep], self.slot[keep])

    def places(self, other: Level) -> np.ndarray:
        """Where the other's windows stand in this one's order."""
        return np.searchsorted(self.windows, other.windows)

    def merged(self, other: Level) -> Level:
        """The level of two that have no window in common."""
        at = self.places(other)
        return Level(np.insert(self.windows, at, other.windows), np.insert(self.slot, at, other.slot))


class Family:
    """Suffix arrays of geometrically growing sizes over the windows seen so far, one window of each content."""

    def __init__(self, length: int):
        self.length, self.levels, self.again, self.slots = length, [], [], 0

    def add(self, parts: list[bytes]) -> None:
        """Take in a batch of stretches; their windows get the next slots. `again` gathers slots whose window occurs elsewhere."""
        buffer = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        n = sizes - self.length + 1
        place = np.arange(n.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n)
        # All have one length, so comparing them as strings is comparing their bytes.
        windows = np.lib.stride_tricks.sliding_window_view(buffer, self.length)[place].view(f"S{self.length}").ravel()
        slot = np.argsort(windows, kind="stable")
        new = Level(windows[slot], slot + self.slots)
        self.slots += len(place)
        same = new.windows[1:] == new.windows[:-1]
        self.again.append(new.slot[np.concatenate((same, [False])) | np.concatenate(([False], same))])
        new = new.only(np.concatenate(([True], ~same)))
        for level in self.levels:
            at = np.minimum(level.places(new), len(level) - 1)
            hit = level.windows[at] == new.windows
            self.again += [new.slot[hit], level.slot[at[hit]]]
            new = new.only(~hit)
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = self.levels.pop().merged(new)
        if len(new):
            self.levels.append(new)

    def repeated(self) -> np.ndarray:
        """Of each slot, whether its window occurs elsewhere."""
        out = np.zeros(self.slots, bool)
        for slots in self.again:
            out[slots] = True
        return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def _family(length: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, anchors, digests, counts, met = Family(length), [], [], [], set()
        for batch in arrow:
            for i in range(0, len(batch), BATCH):
                part = batch.slice(i, BATCH)
                # Rows that repeat in all put out a stretch more than once.
                names = list(zip(part.column("anchor").to_pylist(), part.column("digest").to_pylist(), strict=True))
                once = {name: j for j, name in enumerate(names) if name not in met}
                met.update(once)
                part = part.take(pa.array(list(once.values()), pa.int64()))
                if not len(part):
                    continue
                parts = part.column("bytes").to_pylist()
                family.add(parts)
                anchors.append(part.column("anchor").to_numpy())
                digests.append(part.column("digest").to_numpy())
                counts.append(np.array([len(p) - length + 1 for p in parts], np.int64))
        if not anchors:
            return
        anchor, digest, n = map(np.concatenate, (anchors, digests, counts))
        first, last = runs(family.repeated())
        # A run over several stretches is cut at their ends.
        begins = np.cumsum(n) - n
        a, b = np.searchsorted(begins, first, "right") - 1, np.searchsorted(begins, last, "left") - 1
        times = b - a + 1
        of = np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start = np.maximum(np.repeat(first, times), begins[of]) - begins[of]
        end = np.minimum(np.repeat(last, times), begins[of] + n[of]) - begins[of]
        yield pa.RecordBatch.from_arrays([pa.array(anchor[of]), pa.array(digest[of]), pa.array(start), pa.array(end)], ["anchor", "digest", "first", "last"])

    return run


def blocks(piece: bytes, first: int, n: int, q: int, size: int, length: int) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    """The n windows of a piece, whose first stands at q from the left of its anchor's reach, in blocks of `size` such places: first window, windows, place, bytes, digests of core and of bytes.

    The core is what all windows have in common that the block's places can hold, seen by any of them alike.
    """
    width = length - anchor_size(length) + 1
    for block in range(q // size, (q + n - 1) // size + 1):
        begin, end = max(0, block * size - q), min(n, (block + 1) * size - q)
        core = piece[min((block + 1) * size, width) - 1 - q : block * size - q + length]
        part = piece[begin : end + length - 1]
        yield first + begin, end - begin, q + begin, part, *(hashlib.blake2b(x, digest_size=16).digest() for x in (core, part))


def segments(buffer: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the stretches in buffer, one after the other, in which the anchor first stands at one place: stretch, first window, windows, place q."""
    size = anchor_size(length)
    n, start = sizes - length + 1, np.cumsum(sizes) - sizes
    at = np.arange(len(buffer) - size + 1)
    of = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    place = np.flatnonzero((span_hashes(buffer, at, at + size) == anchors.view(np.uint64)[of]) & (at + size <= (start + sizes)[of]))
    stretch = np.repeat(np.arange(len(n)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    near = place[np.searchsorted(place, start[stretch] + window)]
    begin = np.flatnonzero(np.concatenate(([True], (np.diff(near) != 0) | (np.diff(stretch) != 0))))
    return stretch[begin], window[begin], np.diff(np.append(begin, len(near))), (start[stretch] + window - near)[begin] + length - size


BLOCKS = "anchor long, digest long, known boolean, first long, n long, q long, bytes binary, core binary, outer binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 2 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()] * 3
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)


def _blocks(length: int, size: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i in range(0, len(batch), BATCH):
                part = batch.slice(i, BATCH)
                data, anchors, digests = (part.column(c).to_pylist() for c in ("bytes", "anchor", "digest"))
                found = segments(np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data]), np.array(anchors, np.int64), length)
                yield _rows([(anchors[k], digests[k], False, *b) for k, first, n, q in zip(*(x.tolist() for x in found), strict=True) for b in blocks(data[k][first : first + n + length - 1], first, n, q, size, length)])

    return run


def _split(length: int, size: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i in range(0, len(batch), BATCH):
                rows = zip(*(batch.slice(i, BATCH).column(c).to_pylist() for c in ("anchor", "digest", "known", "first", "n", "q", "bytes")), strict=True)
                yield _rows([(anchor, digest, known, *b) for anchor, digest, known, first, n, q, piece in rows for b in blocks(piece, first, n, q, size, length)])

    return run


def hot_ranges(stretches: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor, digest, first, last: runs of windows that occur again, of different stretches(anchor, digest, bytes) that may be very many to an anchor.

    Equal windows hold their anchor at one place, so windows are looked at in blocks of places. All windows of a block
    repeat if its bytes do, none does if its core occurs once; what is neither is looked at in smaller blocks, down to single windows.
    """
    sizes = [s for s in BLOCK if s <= length]
    rows, hits = stretches.mapInArrow(_blocks(length, sizes[0]), BLOCKS), None
    own = F.struct("anchor", "digest", "first")
    for i, size in enumerate(sizes):
        rows = stored(rows, "hot-blocks")
        if i and rows.isEmpty():
            break
        outer = stored(rows.groupBy("outer").agg(F.count(F.lit(1)).alias("c"), F.min(own).alias("one")).where("c > 1").drop("c"), "hot-outer")
        met = stored(rows.join(outer, "outer", "left"), "hot-met")
        hit = met.where("one is not null and not known").select("anchor", "digest", "first", (F.col("first") + F.col("n")).alias("last"))
        hits = hit if hits is None else hits.unionByName(hit)
        if size > 1:
            # Of blocks with equal bytes one goes on, known to repeat, as blocks that cover other windows may share some with it.
            left = met.where(F.col("one").isNull() | (F.col("one") == own)).withColumn("known", F.col("known") | F.col("one").isNotNull())
            core = stored(left.groupBy("core").agg(F.count(F.lit(1)).alias("c"), F.min("known").alias("known")).where("c > 1 and not known").select("core"), "hot-core")
            rows = left.join(core, "core", "left_semi").select("anchor", "digest", "known", "first", "n", "q", "bytes").mapInArrow(_split(length, sizes[i + 1]), BLOCKS)
    return hits


def _finisher(keep: bool):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for part, texts in _slices(batch):
                rows, left = [], []
                for data, spans in zip(texts, part.column("spans"), strict=True):
                    removed = n = 0
                    if spans.is_valid:
                        pairs = spans.values
                        a, b = (pairs.field(x).to_numpy() for x in ("a", "b"))
                        order = np.argsort(a, kind="stable")
                        a, b = a[order], np.maximum.accumulate(b[order])
                        cut = np.concatenate(([True], a[1:] > b[:-1]))
                        a, b = a[cut], b[np.append(np.flatnonzero(cut)[1:], len(b)) - 1]
                        n, removed, size = len(a), int((b - a).sum()), len(data)
                        data = b"".join([data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), size], strict=True)])
                    rows.append((len(data) + removed, removed, n, hashlib.sha256(data).hexdigest()))
                    left.append(data if keep else None)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                more = [pa.array(left, pa.binary())] if keep else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, *more], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep)

    return run


def repeated_spans(rows: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """mark (a text's digest) and spans, the byte ranges a to b of its stretches' repeated windows, for texts of rows(doc_id, mark, text) that have any."""
    schema = "mark binary, doc_id long, start array<long>, n array<int>, anchor array<long>, digest array<long>"
    found = rows.select("doc_id", "text").mapInArrow(_finder(length), schema).where(F.size("start") > 0)
    # A text that repeats is one text that occurs often.
    lists = ["start", "n", "anchor", "digest"]
    texts = stored(found.groupBy("mark").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in lists]), "texts")
    occurs = texts.select("mark", "doc_id", "copies", F.explode(F.arrays_zip(*lists)).alias("s")).select("mark", "doc_id", "copies", "s.start", F.abs("s.n").alias("n"), "s.anchor", "s.digest", (F.col("s.n") < 0).alias("twice"))
    where = F.min(F.struct("mark", "doc_id", "start", "n")).alias("at")
    contents = stored(occurs.groupBy("anchor", "digest").agg(F.sum("copies").alias("times"), F.bool_or("twice").alias("twice"), where), "contents")
    anchors = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    contents = stored(contents.join(anchors, "anchor").where((F.col("kinds") > 1) | (F.col("times") > 1) | F.col("twice")), "contents")
    whole = contents.where("times > 1").select("anchor", "digest", F.lit(0).cast("long").alias("first"), F.col("at.n").cast("long").alias("last"))

    # Bytes of one occurrence of each stretch in question.
    asked = contents.where("kinds > 1 or (twice and times = 1)").select("at.mark", "at.doc_id", F.struct("at.start", "at.n", "anchor", "digest", "kinds").alias("cut"))
    cuts = stored(asked.groupBy("mark", "doc_id").agg(F.collect_list("cut").alias("cuts")), "cuts")  # of one text
    of = (F.col("mark") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("by"))
    own = rows.join(cuts.select(F.col("mark").alias("of"), F.col("doc_id").alias("by"), "cuts"), of).select("text", "cuts")
    bytes_ = stored(own.mapInArrow(_cutter(length), "anchor long, digest long, kinds long, bytes binary"), "bytes")
    some, many = bytes_.where(F.col("kinds") <= hot), bytes_.where(F.col("kinds") > hot)
    tasks = max(1, -(-some.count() // TASK))
    ranges = some.repartition(tasks, "anchor").select("anchor", "digest", "bytes").mapInArrow(_family(length), "anchor long, digest long, first long, last long")
    parts = whole.unionByName(ranges)
    if not many.isEmpty():
        parts = parts.unionByName(hot_ranges(many.select("anchor", "digest", "bytes").dropDuplicates(["anchor", "digest"]), length))

    # One row per stretch, so that an occurrence meets one.
    every = parts.groupBy("anchor", "digest").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    hits = occurs.select("mark", "start", "anchor", "digest").join(stored(every, "ranges"), ["anchor", "digest"])
    span = lambda r: F.struct((F.col("start") + r["first"]).alias("a"), (F.col("start") + r["last"] + (length - 1)).alias("b"))
    return stored(hits.groupBy("mark").agg(F.flatten(F.collect_list(F.transform("ranges", span))).alias("spans")), "spans")  # of one text


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep also kept, the bytes that are left.

    Removed is each byte that a run of `length` bytes covers which also starts elsewhere, in the same or another row;
    runs do not cross rows. Null texts count as empty, and shorter texts lose nothing. A row that repeats another loses all, if it is long enough. A null doc_id stays null,
    other columns aren't looked at, an empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col).withColumn("mark", F.unhex(F.md5("text")))
    # Many rows may have one text: joined with a stored table, Spark can split that key's rows over tasks.
    joined = rows.join(repeated_spans(rows, length, hot), "mark", "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")
    return joined.mapInArrow(_finisher(keep), schema)
