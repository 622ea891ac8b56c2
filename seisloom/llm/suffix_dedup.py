"""Operator 2: removal of repeated byte strings by suffix arrays.

A byte goes if some string of `LENGTH` bytes that covers it starts anywhere else as well, in any document. Five steps:

1. Anchors. Of the runs of `GRAM` bytes inside a window of `LENGTH` bytes, the one with the least hash (the last of
   equals) is the window's anchor. It depends on the window's bytes alone, so equal windows have equal anchors. The
   windows that share an anchor are consecutive; with the bytes they cover they form a segment, one for some 85 bytes.
   Anchors that occur once cannot belong to repeated windows; a bounded bitmap keeps most of them out.
2. Segments with equal digests of their bytes are one kind; thousands of copies become one row. The bytes of its first
   and its last occurrence meet in a shard, and if they are equal, the kind repeats whole.
3. Anchors are dealt over shards. Where an anchor has several kinds, the shard's suffix array decides which windows are
   shared: suffixes are sorted by Larsson and Sadakane's refinement, ranks by the first bytes, then by ranks at a
   doubled distance, for the groups still tied; Kasai's algorithm gives the common prefixes of neighbours. Text beyond
   one array is split over several, whose sorted windows are looked up in each other by binary search.
4. An anchor with more than `GROUP_SEGMENTS` kinds is split over several shards, tasks of their own. Their windows meet
   across shards: those that another shard may hold too, by bitmaps of digests that err on the side of too much (first of
   what neighbouring windows have in common, then of the windows left), are
   dealt by ranges of their bytes, each found by binary search among the ranges' bounds, and equal neighbours are shared.
   A window that its own shard has found repeated goes there once for the shard.
5. The shared windows' spans go to the occurrences, are merged by document and cut from its bytes.

Bitmaps only let too much pass, never too little, and do not grow with the data. Digests have 64 bits and are compared
within one anchor only.

Cases: null and empty texts, and those shorter than `LENGTH` bytes, lose nothing; matches never cross documents;
repeated rows lose every byte that they share; ids may repeat or be null (rows are then told apart by a number of their
own); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import checkpointed, column, mix64, powers, small_batches

LENGTH = 200
GRAM = 32
#: A text longer than this is cut for step 1; windows over the cuts are seen once.
SLICE = 1 << 20
#: Bytes of one suffix array.
ARRAY_BYTES = 1 << 20
#: Kinds of segments of one anchor that one shard takes.
GROUP_SEGMENTS = 1000
#: So many windows that follow one another are looked for by what they have in common, before each is by itself.
SPREAD = 8
BITMAP_BITS = 26


def segments(parts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts: the text's position, first window, windows before the anchor, windows, anchor hash and hash of the bytes covered, for each segment."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(C._CODES[data] * up[:n], out=total[1:])
        hashes = mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    # the least hash of each window, the last of equals: the position, counted from the end, is part of the key
    bits = np.uint64(max(1, int(n).bit_length()))
    key = ((hashes >> bits) << bits) | (np.uint64(n) - np.arange(len(hashes), dtype=np.uint64))
    span = length - gram + 1
    rows = -(-len(key) // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    anchor = n - (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)[:windows]
    inside = np.arange(windows) + length <= (begin + sizes)[owner]
    first = np.flatnonzero(inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([(anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~inside[1:], [True]]))
    count, left = ends - first + 1, anchor[first] - first
    with np.errstate(over="ignore"):
        digest = mix64(mix64((total[ends + length] - total[first]) * down[first]) + (left * 65536 + count).astype(np.uint64))
    return owner[first], first - begin[owner[first]], left, count, hashes[anchor[first]], digest


def cut(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Pieces of about SLICE bytes in all, with their rows and places; pieces of one text share length - 1 bytes."""
    parts, rows, places, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SLICE):
            part = text[at : at + SLICE + length - 1]
            parts.append(part)
            rows.append(row)
            places.append(at)
            size += len(part)
            if size >= SLICE:
                yield parts, rows, places
                parts, rows, places, size = [], [], [], 0
    if parts:
        yield parts, rows, places


def suffix_array(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of suffixes in order, by Larsson and Sadakane's refinement.

    Symbols are 0 (the end of a segment) to 256. left[p]: symbols from p to the end of its segment. Suffixes that are
    equal up to their segments' ends stay in the order of their positions: all sorts are stable, and nothing beyond an
    end is compared. Kasai's rule needs this order to be the same one symbol further on.
    """
    n, known = len(symbols), 7
    wide = np.concatenate([symbols.astype(np.uint64), np.zeros(known, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(known):
        key = (key << np.uint64(9)) | np.where(left >= k, wide[k : k + n], 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    slots = np.arange(n)  # of `order`, where suffixes are still tied
    while len(slots):
        own = order[slots]
        group = rank[own]
        tied = np.concatenate([group[1:] == group[:-1], [False]])
        tied[1:] |= group[1:] == group[:-1]
        tied &= left[own] >= known
        slots, own, group = slots[tied], own[tied], group[tied]
        if not len(slots):
            break
        after = own + known
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        inner = np.argsort(group * (n + 1) + second, kind="stable")
        own, group, second = own[inner], group[inner], second[inner]
        order[slots] = own  # groups keep their slots
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank[own] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        known *= 2
    return order


def kasai(symbols: np.ndarray, before: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffix at p with the one at before[p], up to `most`, for the first counts[k] positions of each segment.

    By Kasai's rule a position's is at least the last one's less 1. All segments advance side by side.
    """
    out = np.zeros(len(symbols), np.int64)
    have = np.zeros(len(starts), np.int64)
    padded = np.concatenate([symbols, np.zeros(most + 8, symbols.dtype)])
    for step in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > step)
        p = starts[live] + step
        q = before[p]
        n = np.maximum(have[live] - 1, 0)
        n[q < 0] = 0
        going = np.flatnonzero((q >= 0) & (n < most))
        while len(going):
            a, b = p[going] + n[going], q[going] + n[going]
            same = (padded[a] == padded[b]) & (padded[a] != 0)
            n[going[same]] += 1
            going = going[same]
            going = going[n[going] < most]
        have[live] = n
        out[p] = n
    return out


class Shard:
    """The suffix array of some segments, and which of their windows occur more than once in it."""

    def __init__(self, parts: list[bytes], counts: np.ndarray, length: int):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.starts = np.cumsum(sizes) - sizes
        self.counts, self.length = counts, length
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        symbols = data.astype(np.uint16) + 1
        symbols[self.starts + sizes - 1] = 0
        left = np.repeat(self.starts + sizes - 1, sizes) - np.arange(len(data))
        window = np.zeros(len(data), bool)
        for_each = np.repeat(self.starts, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        window[for_each] = True
        order = suffix_array(symbols, left)
        before = np.full(len(data), -1, np.int64)
        before[order[1:]] = order[:-1]
        common = kasai(symbols, before, self.starts, counts, length)
        both = np.flatnonzero(common >= length)
        self.data, self.order = data, order[window[order]]
        self.shared = np.zeros(len(data), bool)
        self.shared[both] = True
        self.shared[before[both]] = True

    def _strings(self, at: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.data, np.zeros(self.length, np.uint8)]), self.length)
        return np.ascontiguousarray(view[at]).view(f"S{self.length}").ravel()

    def merge(self, other: Shard) -> None:
        """Mark the windows that both have: each of the other's is looked up among this one's sorted ones by binary search."""
        if not len(self.order) or not len(other.order):
            return
        mine = self._strings(self.order)
        for at in range(0, len(other.order), 50_000):
            asked = other.order[at : at + 50_000]
            strings = other._strings(asked)
            low = np.searchsorted(mine, strings)
            found = low < len(mine)
            found[found] = mine[low[found]] == strings[found]
            other.shared[asked[found]] = True
            high = np.searchsorted(mine, strings[found], "right")
            for a, b in {*zip(low[found].tolist(), high.tolist(), strict=True)}:
                self.shared[self.order[a:b]] = True

    def masks(self) -> list[bytes]:
        return [np.packbits(self.shared[s : s + n]).tobytes() for s, n in zip(self.starts, self.counts, strict=True)]


def shared_windows(parts: list[bytes], counts: list[int], length: int = LENGTH, array_bytes: int = ARRAY_BYTES) -> list[bytes]:
    """For each segment a bit for each window: whether it occurs elsewhere in these segments."""
    shards, at, size = [], 0, 0
    for k, part in enumerate(parts):
        size += len(part)
        if size >= array_bytes or k == len(parts) - 1:
            shards.append(Shard(parts[at : k + 1], np.asarray(counts[at : k + 1], np.int64), length))
            at, size = k + 1, 0
    for i, one in enumerate(shards):
        for other in shards[:i]:
            one.merge(other)
    return [m for s in shards for m in s.masks()]


def _shard_masks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, shard, d, kinds, part, windows) in the order of (h, shard, d) to (h, d, mask); a null mask means all windows. Whole shards go into one call."""
    held: list[list] = []  # h, shard, d, whether alone, whether whole, part, windows
    size = 0

    def decide() -> pa.RecordBatch:
        asked = [r for r in held if not r[3]]
        masks = iter(shared_windows([r[5] for r in asked], [r[6] for r in asked], length))
        out: list[tuple] = []
        for h, _, d, alone, whole, _, _ in held:
            mask = b"" if alone else next(masks)
            if whole or any(mask):
                out.append((h, d, None if whole else mask))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["h", "d", "mask"])

    for batch in small_batches(batches, 5000):
        for h, shard, d, kinds, part, windows in zip(*(batch[c].to_pylist() for c in ("h", "shard", "d", "kinds", "part", "windows")), strict=True):
            if held and held[-1][0] == h and held[-1][2] == d and held[-1][5] == part:
                held[-1][4] = True  # the kind's other occurrence
                continue
            if (size >= ARRAY_BYTES * 0.9 or len(held) >= 20_000) and held[-1][:2] != [h, shard]:
                yield decide()
                held, size = [], 0
            held.append([h, shard, d, kinds == 1, False, part, windows])
            size += 0 if kinds == 1 else len(part)
    if held:
        yield decide()


def digests(h: int, part: bytes, left: int, windows: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of a segment's windows, of its cores, and each window's core. `left` windows begin before the anchor.

    A core is what SPREAD windows that follow one another have in common, counted from the anchor; equal windows have equal cores.
    """
    spread = min(SPREAD, length)
    data = np.frombuffer(part, np.uint8)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    group = (left - np.arange(windows)) // spread
    core = group[0] - group
    at = left - np.arange(group[0], group[-1] - 1, -1) * spread
    with np.errstate(over="ignore"):
        np.cumsum(C._CODES[data] * up[: len(data)], out=total[1:])
        own = np.uint64(h % 2**64)
        each = mix64((total[length : length + windows] - total[:windows]) * down[:windows]) + own
        common = mix64((total[at + length - spread + 1] - total[at]) * down[at] + (at - left).astype(np.uint64)) + own
    return each.view(np.int64), common.view(np.int64), core


def equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, d, k) of rows (h, d, k, known, window), sorted by (h, window), that are not known yet and have a neighbour with the same window."""
    last, told = (), True  # the row before, and whether it went out or need not
    for batch in small_batches(batches):
        out: list[tuple] = []
        for row in zip(*(batch[c].to_pylist() for c in ("h", "window", "d", "k", "known")), strict=True):
            same = last[:2] == row[:2]
            out += [r for r in ([last] * (not told) + [row] * (not row[4]) if same else [])]
            last, told = row, same or row[4]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, pa.int64()), (2, pa.int64()), (3, pa.int32()))], names=["h", "d", "k"])


def _merged_masks(split: DataFrame, verdict: DataFrame, length: int) -> DataFrame:
    """(h, d, mask) of the windows that different shards (h, shard, d, part, left, windows) of one anchor have in common, but for those of which the shards' own `verdict` (h, d, mask) knows.

    Cores that several shards have lead to windows that several shards may have, and these are compared by their bytes.
    """
    spark = split.sparkSession
    judged, path = C.written(split.join(verdict.withColumn("whole", F.isnull("mask")), ["h", "d"], "left").repartition("h", "shard").sortWithinPartitions("h", "shard"))

    def bitmap(chosen: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Broadcast:
        """Of the digests that several shards choose from (windows, cores, cores of windows)."""

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at: tuple | None = None
            own: list[np.ndarray] = []

            def unique() -> pa.RecordBatch:
                w = np.unique(np.concatenate(own))
                return pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.full(len(w), at[1]))], names=["w", "shard"])

            for batch in small_batches(batches):
                for h, shard, part, left, windows in zip(*(batch[c].to_pylist() for c in ("h", "shard", "part", "left", "windows")), strict=True):
                    if at != (h, shard):
                        if own:
                            yield unique()
                        at, own = (h, shard), []
                    own.append(chosen(*digests(h, part, left, windows, length)))
            if own:
                yield unique()

        found = judged.mapInArrow(find, "w long, shard long").groupBy("w").agg(F.min("shard").alias("a"), F.max("shard").alias("b"))
        return spark.sparkContext.broadcast(C.Bitmap.of(found.where("a != b").select("w"), BITMAP_BITS))

    cores = bitmap(lambda each, common, core: common)
    maybe = bitmap(lambda each, common, core: each[cores.value.has(common)[core]])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A window that a shard has found repeated is sent once for the shard, as what other shards' may equal."""
        at: tuple = ()
        sent: set[bytes] = set()
        for batch in small_batches(batches, 200):
            out: list[tuple] = []
            for h, shard, d, part, left, count, mask, whole in zip(*(batch[c].to_pylist() for c in ("h", "shard", "d", "part", "left", "windows", "mask", "whole")), strict=True):
                if at != (h, shard):
                    at, sent = (h, shard), set()
                known = np.ones(count, bool) if whole else np.unpackbits(np.frombuffer(mask or bytes(length), np.uint8))[:count].astype(bool)
                each, common, core = digests(h, part, left, count, length)
                for k in np.flatnonzero(maybe.value.has(each) & cores.value.has(common)[core]).tolist():
                    window = part[k : k + length]
                    if known[k]:
                        if window in sent:
                            continue
                        sent.add(window)
                    out.append((h, d, k, bool(known[k]), window))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["h", "d", "k", "known", "window"])

    ranges = judged.mapInArrow(windows, "h long, d long, k int, known boolean, window binary").repartitionByRange("h", "window").sortWithinPartitions("h", "window")
    places = ranges.mapInArrow(equal_neighbours, "h long, d long, k int").groupBy("h", "d").agg(F.collect_list("k").alias("places"))  # at most 169 of a segment

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for at in batch["places"].to_pylist():
                bits = np.zeros(length, np.uint8)
                bits[at] = 1
                masks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch["h"], batch["d"], pa.array(masks, pa.binary())], names=["h", "d", "mask"])

    masks, _ = C.written(places.mapInArrow(pack, "h long, d long, mask binary"))
    C.dropped(spark, path)
    return masks


def keyed(docs: DataFrame) -> DataFrame:
    """(key, text, row): the id as key if it names a row, else a number kept with a copy of the rows. All columns are inside `row`, so that no name can clash."""
    rows = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text"), F.struct(*map(column, docs.columns)).alias("row"))
    named = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int") and docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    if named:
        return rows.select(F.col("doc_id").cast("long").alias("key"), "text", "row")
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("key"), "text", "row"))


def _parts(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(h, shard, d, kinds, part, left, windows): the bytes of segments `asked` for (h, shard, d, kinds, key, at), read from the documents that have some."""
    own = checkpointed(asked.groupBy("key").agg(F.collect_list(F.struct("h", "shard", "d", "kinds", "at")).alias("asked")))  # a document's own segments

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            out: list[tuple] = []
            for text, wanted in zip(raw_bytes_of(batch), batch["asked"].to_pylist(), strict=True):
                for a in wanted:
                    first, count = a["at"] >> 16, a["at"] & 255
                    out.append((a["h"], a["shard"], a["d"], a["kinds"], text[first : first + count + length - 1], a["at"] >> 8 & 255, count))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["h", "shard", "d", "kinds", "part", "left", "windows"])

    sources = C.passing(texts, C.Bitmap.of(own.select("key"), BITMAP_BITS), "key")
    return sources.join(own, "key").select("text", "asked").mapInArrow(read, "h long, shard long, d long, kinds long, part binary, left int, windows int")


def spans(texts: DataFrame, length: int = LENGTH, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """(key, spans) of the texts (key, text) that lose something: the removed runs of bytes as pairs of little-endian 64-bit integers, in order."""
    spark = texts.sparkSession
    C.lean_batches(spark)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for batch in small_batches(batches):
            keys = batch["key"].to_numpy()
            for parts, rows, places in cut(raw_bytes_of(batch), length):
                part, first, left, count, h, d = segments(parts, length)
                at = ((np.asarray(places, np.int64)[part] + first) << 16) | (left << 8) | count
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), pa.array(keys[np.asarray(rows, np.int64)[part]]), pa.array(at)], names=["h", "d", "key", "at"])

    every, path = C.written(texts.mapInArrow(cut_up, "h long, d long, key long, at long"))
    repeated = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found, _ = C.written(C.passing(every, C.Bitmap.of(repeated, BITMAP_BITS), "h"))
    C.dropped(spark, path)
    place = F.struct("key", "at")
    kinds, _ = C.written(found.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")))
    groups = kinds.groupBy("h").agg(F.count("*").alias("n"), F.sum("n").alias("total"))
    anchors = groups.where("total > 1").select("h", F.col("n").alias("kinds"))
    listed = C.joined(kinds, anchors, ["h"], groups.select("h", "n"))
    shard = F.pmod(F.xxhash64("d"), F.ceil(F.col("kinds") / group_segments))
    occurrences = F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array("first"))
    asked = listed.select("h", shard.alias("shard"), "d", "kinds", F.explode(occurrences).alias("place")).select("h", "shard", "d", "kinds", "place.*")
    masks = _parts(texts, asked, length).repartition("h", "shard").sortWithinPartitions("h", "shard", "d").mapInArrow(lambda batches: _shard_masks(batches, length), "h long, d long, mask binary")
    verdict, _ = C.written(masks)
    wide = listed.where(F.col("kinds") > group_segments).select("h", shard.alias("shard"), "d", "kinds", "first.*")
    if not wide.isEmpty():
        split, split_path = C.written(_parts(texts, wide, length))
        merged = _merged_masks(split, verdict, length)
        C.dropped(spark, split_path)
        verdict = verdict.unionByName(merged)
    marks = C.joined(found, verdict, ["h", "d"], kinds.select("h", "d", "n")).groupBy("key").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))  # a document's own segments

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([runs(m, length) for m in batch["marks"].to_pylist()], pa.binary())], names=["key", "spans"])

    return checkpointed(marks.mapInArrow(merge, "key long, spans binary"))


def _applied(docs: DataFrame, found: DataFrame, each: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: object) -> DataFrame:
    """each(batch, spans) over all documents (key, text, row); only those that lose something are shuffled."""
    marked = C.Bitmap.of(found.select("key"), BITMAP_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            batch = batch.filter(pa.array(~shared.value.has(batch["key"].to_numpy())))
            yield each(batch, [None] * batch.num_rows)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield each(batch, batch["spans"].to_pylist())

    return docs.mapInArrow(clean, schema).unionByName(C.passing(docs, marked, "key").join(found, "key", "left").mapInArrow(cut_out, schema))


def raw_bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    return C.raw_bytes(batch["text"])


def runs(marks: list[dict], length: int) -> bytes:
    """Maximal runs of bytes that marked windows cover."""
    begin: list[np.ndarray] = []
    for m in marks:
        count = m["at"] & 255
        bits = np.arange(count) if m["mask"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(m["mask"], np.uint8))[:count])
        begin.append((m["at"] >> 16) + bits)
    starts = np.sort(np.concatenate(begin))
    new = np.concatenate([[True], starts[1:] > starts[:-1] + length])
    ends = np.concatenate([starts[:-1][new[1:]], starts[-1:]]) + length
    return np.stack([starts[new], ends], 1).astype("<i8").tobytes()


def kept(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many runs."""
    if not spans:
        return text, 0, 0
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
    edges = [0, *pairs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs)


def removed(docs: DataFrame, length: int = LENGTH, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def each(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        texts = raw_bytes_of(batch)
        rows = [kept(t, s) for t, s in zip(texts, spans, strict=True)]
        arrays = [batch["row"].field(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = keyed(docs.select("doc_id", "text"))
    own = rows.select("key", "text", F.struct("row.doc_id").alias("row"))
    return _applied(own, spans(rows.select("key", "text"), length, group_segments), each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs`, whole rows, their texts without the repeated bytes; a character of which a part would go goes as a whole.

    A null text stays null; other columns, whatever their names, stay as they are; ids may repeat or be null; an empty table gives no rows.
    """
    names = docs.columns
    place = names.index("text")

    def each(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        fields = [batch["row"].field(k) for k in range(len(names))]
        texts = batch["text"].to_pylist()
        if any(s is not None for s in spans):
            texts = [t if s is None else kept(t.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)]
        fields[place] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(fields, names=names)

    rows = keyed(docs)
    return _applied(rows, spans(rows.select("key", "text"), length), each, docs.schema)
