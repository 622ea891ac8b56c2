"""Operator 7: near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

A document's set holds the hashes of its distinct runs of `words` lower-cased words. The hash deals a shingle to one of
`BUCKETS`; a bucket keeps the least of its scrambled hashes as a register of 16 bits: 6 for the leading zeros, 10 for
the bits that follow. An empty bucket takes the register of another, tried in an order of its own, so that registers
agree as often as the sets' similarity, however small the sets.

Equal sets are one class, whatever their number, and one row from then on. Classes that agree in all `ROWS` registers
of a band are candidates; a pair at the threshold shares no band with probability (1 - s^ROWS)^(BUCKETS / ROWS), 3e-6 at
s = 0.8. Only components are asked for, so pairs are never listed:

- In some rounds, each class is tried against one class of the band that it shares most often: first the least, then
  one at random from another component. The registers' similarity, corrected for registers that agree by chance, can
  rule a pair out; the full sets confirm the others. Near copies end up in one component.
- Bands that still hold several components are then decided whole: in blocks of `BLOCK` members, every class outside
  the band's main component is counted against all others through the shingles they share. What comes out is at most
  one link for each component, not pairs.

Components come from repeated minimum labels with pointer jumping, over linked classes only, as tables; up to `SMALL`
links are joined by one task instead.

Cases: a null text or one without words has an empty set and is linked with nothing; with fewer words than `words` the
whole sequence is the one shingle; rows that repeat an id are nodes of their own; a null id never names a component
unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import any_names, checkpointed, mix64, slices, small_batches, word_hashes

BUCKETS = 96
ROWS = 4
MANTISSA = 10
#: A pair whose estimate is this many standard deviations below the threshold is not compared in full.
SIGMAS = 6
ROUNDS = 3
BLOCK = 500
#: Members that a copy of their centre's text is compared with.
CELL = 64
SMALL = 100_000
_WEIGHTS = mix64(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def _probes() -> np.ndarray:
    """For each bucket, an order in which it tries others; the last resort is a full round."""
    tries = mix64(np.arange(BUCKETS * 256, dtype=np.uint64)).reshape(BUCKETS, 256) % np.uint64(BUCKETS)
    around = (np.arange(BUCKETS)[:, None] * 7 + np.arange(BUCKETS)[None, :]) % BUCKETS
    return np.concatenate([tries.astype(np.int64), around], axis=1)


_PROBES = _probes()


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of lower-cased texts."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        hashes, counts, _, _ = word_hashes(texts[a:b])
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
            for k in range(words):
                rolled += hashes[k : k + len(rolled)] * _WEIGHTS[k]
            rolled = mix64(rolled)
            ends = np.cumsum(counts)
            for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                if n >= words:
                    out.append(np.unique(rolled[end - n : end - words + 1]))
                elif n:
                    own = hashes[end - n : end]
                    out.append(mix64(np.array([(own * _WEIGHTS[:n]).sum() + np.uint64(n)], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a non-empty sorted set."""
    bucket = ((shingles >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    least = np.minimum.reduceat(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)), first)
    zeros = 63 - np.floor(np.log2(least.astype(np.float64).clip(1))).astype(np.int64).clip(0, 63)
    zeros = np.where((least >> (63 - zeros).astype(np.uint64)) == 0, zeros + 1, zeros)  # log2 may round up
    body = np.where(zeros < 63, least << (zeros + 1).clip(0, 63).astype(np.uint64), 0).astype(np.uint64) >> np.uint64(64 - MANTISSA)
    out = np.zeros(BUCKETS, np.uint16)
    filled = np.zeros(BUCKETS, bool)
    out[bucket[first]] = (zeros.clip(0, 63) << MANTISSA | body.astype(np.int64)).astype(np.uint16)
    filled[bucket[first]] = True
    if len(first) < BUCKETS:
        empty = np.flatnonzero(~filled)
        for part in (slice(0, 16), slice(0, None)):
            tries = filled[_PROBES[empty, part]]
            hit = tries.any(1)
            out[empty[hit]] = out[_PROBES[empty[hit], tries[hit].argmax(1)]]
            if hit.all():
                break
            empty = empty[~hit]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers, without those that agree by chance: 2^-MANTISSA / 3 of the others."""
    chance = 2.0**-MANTISSA / 3
    return np.maximum(0, ((a == b).mean(1) - chance) / (1 - chance))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest binary, registers binary); both null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for batch in small_batches(batches):
            sets = shingle_sets([t.lower() for t in C.raw_bytes(batch["text"])], words)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            packed = [registers(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "n_shingles", "digest", "registers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(band long, node) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = BUCKETS // ROWS
        for batch in small_batches(batches, 5000):
            rows = np.frombuffer(b"".join(batch["registers"].to_pylist()), np.uint64).reshape(-1, per)  # ROWS registers of 16 bits
            with np.errstate(over="ignore"):
                band = mix64(rows ^ mix64(np.arange(1, per + 1, dtype=np.uint64))[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(band.view(np.int64).ravel()), pa.array(np.repeat(batch["node"].to_numpy(), per))], names=["band", "node"])

    return classes.select("node", "registers").mapInArrow(run, "band long, node long")


def _confirmed(stars: DataFrame, sources: DataFrame, words: int, percent: int) -> DataFrame:
    """Of stars (a, b), each a once, those with 100 * intersection >= percent * union of the full sets.

    A centre's text meets its members' in cells of about `CELL` members; it goes once to each cell, a member's once.
    """
    least = percent / 100 - SIGMAS * np.sqrt(percent / 100 * (1 - percent / 100) / BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, own = None, None  # the centre at hand and its set
        for batch in small_batches(batches, 500):
            signs = np.frombuffer(b"".join(batch["registers"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
            member, nodes = batch["member"].to_numpy(zero_copy_only=False), batch["node"].to_numpy()
            centres = np.flatnonzero(~member)
            of = np.searchsorted(centres, np.arange(len(member)), "right") - 1  # -1: the centre came with an earlier batch
            if len(centres):
                before = np.concatenate([signs[centres], signs[:1] if b is None else last[None, :]])[of]
            else:
                before = np.broadcast_to(last, signs.shape)
            wanted = ~member | (estimate(signs, before) >= least)
            texts = C.raw_bytes(batch["text"].filter(pa.array(wanted)))
            sets = iter(shingle_sets([t.lower() for t in texts], words))
            out: list[tuple[int, int]] = []
            for k in np.flatnonzero(wanted).tolist():
                p = next(sets)
                if not member[k]:
                    b, own, last = int(nodes[k]), p, signs[k].copy()
                elif 100 * min(len(p), len(own)) >= percent * max(len(p), len(own)):
                    both = len(np.intersect1d(p, own, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(own) - both):
                        out.append((int(nodes[k]), b))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], names=["a", "b"])

    sizes = stars.groupBy("b").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    members = stars.join(sizes, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("cell"), F.lit(True).alias("member"))
    cells = members.select("b", "cell").distinct().select(F.col("b").alias("node"), "b", "cell", F.lit(False).alias("member"))
    rows = sources.join(members.unionByName(cells), "node").repartition("b", "cell").sortWithinPartitions("b", "cell", "member")
    return rows.select("node", "member", "text", "registers").mapInArrow(run, "a long, b long")


def block_links(sets: list[np.ndarray], roots: np.ndarray, outside: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions of linked sets of different components, one link for each two components that it joins. Each set that is outside is counted against all."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    roots, found = roots.copy(), []
    mine = np.zeros(int(ids.max()) + 1, bool)
    for x in np.flatnonzero(outside):
        if (roots == roots[x]).all():
            break
        own = ids[begin[x] : begin[x] + sizes[x]]
        mine[own] = True
        both = np.bincount(owner[mine[ids]], minlength=len(sets))
        mine[own] = False
        for y in np.flatnonzero((100 * both >= percent * (sizes[x] + sizes - both)) & (roots != roots[x])):
            if roots[y] != roots[x]:
                found.append((x, y))
                roots[roots == roots[y]] = roots[x]
    return found


def _block_links(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) from rows (band, i, j, node, root, outside, text) of whole groups, in the order of the groups."""

    def decide(held: list[tuple]) -> pa.RecordBatch:
        texts = {r[3]: r[6] for r in held}
        sets = dict(zip(texts, shingle_sets([(t or "").encode().lower() for t in texts.values()], words), strict=True))
        out: list[tuple[int, int]] = []
        at = 0
        while at < len(held):
            to = at
            while to < len(held) and held[to][:3] == held[at][:3]:
                to += 1
            group = held[at:to]
            found = block_links([sets[r[3]] for r in group], np.array([r[4] for r in group]), np.array([r[5] for r in group]), percent)
            out += [(group[x][3], group[y][3]) for x, y in found]
            at = to
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in small_batches(batches, 500):
            for row in zip(*(batch[c].to_pylist() for c in ("band", "i", "j", "node", "root", "outside", "text")), strict=True):
                if len(held) >= 300 and held[-1][:3] != row[:3]:
                    yield decide(held)
                    held = []
                held.append(row)
        if held:
            yield decide(held)

    keys = ["band", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", "root", "outside", "text").mapInArrow(run, "a long, b long")


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "root"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), cut off from their lineage: the least node that it reaches.

    Each round gives a node the least label among itself and its neighbours, then that label's own label; the number of
    rounds grows with the logarithm of the longest path.
    """
    if edges.count() <= SMALL:
        return C.written(edges.select("a", "b").coalesce(1).mapInArrow(_union, "node long, root long"))[0]
    both, links = C.written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels, path = C.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved, new = C.written(step.join(jump, "next").select("node", F.least("next", "far").alias("root"), "was"))
        C.dropped(edges.sparkSession, path)
        path = new
        if moved.where("root != was").isEmpty():
            C.dropped(edges.sparkSession, links)
            return moved.select("node", "root")
        labels = moved.select("node", "root")


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) after more links: components of components."""
    a, b = (labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    between = links.join(a, "a").join(b, "b").where("root_a != root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    moved = connected(checkpointed(between)).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return C.written(labels.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")))[0]


def components_of(signed: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `signed` (doc_id, n_shingles, digest), from its classes (digest, doc_id, node, copies) and the labels (node, root) of linked ones."""
    ids = classes.select("digest", "doc_id", "node", "copies")
    least = labels.join(ids, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = C.joined(labels, least, ["root"], labels.groupBy("root").agg(F.count("*").alias("n")))
    named = ids.join(linked.select("node", "component_id"), "node", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    whole = signed.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest")
    found = C.joined(whole, named, ["digest"], ids.select("digest", F.col("copies").alias("n"))).select("doc_id", "n_shingles", "component_id")
    empty = signed.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(empty)


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    C.lean_batches(docs.sparkSession)
    signed = checkpointed(signatures(docs, words))
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("registers").alias("registers"), F.count("*").alias("copies"))
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    bands = checkpointed(_bands(classes))
    shared = bands.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where("centre != other").drop("other")
    shared = checkpointed(bands.join(shared, "band"))  # bands of at least two classes
    nodes = shared.select("node").distinct()
    wanted = checkpointed(classes.join(nodes, "node"))
    spark = docs.sparkSession
    maybe = spark.sparkContext.broadcast(C.Bitmap.of(wanted.select(F.xxhash64("doc_id").alias("k"))))
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            batch = batch.filter(pa.array(maybe.value.has(batch["k"].to_numpy())))  # before any work, in the same worker
            sets = shingle_sets([t.lower() for t in C.raw_bytes(batch["text"])], words)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(digest, pa.binary())], names=["doc_id", "text", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = texts.mapInArrow(digested, f"doc_id {kind}, text string, digest binary")
    same = (F.col("w.digest") == F.col("t.digest")) & F.col("w.doc_id").eqNullSafe(F.col("t.doc_id"))
    sources = named.alias("t").join(wanted.alias("w"), same).select("w.node", "t.text", "w.registers")
    # where ids repeat, a class may have several of its texts here
    unique = wanted.where("doc_id IS NULL").isEmpty() and docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    sources = checkpointed(sources if unique else sources.groupBy("node").agg(F.min("text").alias("text"), F.first("registers").alias("registers")))
    labels = nodes.select("node", F.col("node").alias("root"))
    for turn in range(ROUNDS + 1):
        placed = checkpointed(shared.select("band", "node").join(labels, "node"))
        tried = F.struct(F.lit(0) if turn == 0 else F.xxhash64("node", F.lit(turn)), "node")
        bands = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("node", "root"), tried).alias("centre"), F.count("*").alias("n"))
        bands = bands.where("low != high").select("band", "centre", "n")
        if turn == ROUNDS:
            break
        apart = placed.join(bands, "band").where("root != centre.root").groupBy("node", F.col("centre.node").alias("b")).agg(F.count("*").alias("shared"))
        stars = apart.groupBy(F.col("node").alias("a")).agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
        labels = joined_labels(labels, checkpointed(_confirmed(stars, sources, words, percent)))
    if not bands.isEmpty():
        counts = placed.groupBy("band", "root").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
        parts = F.ceil(F.col("n") / BLOCK)
        cell = F.pmod(F.xxhash64("node"), F.col("parts"))
        members = placed.join(bands.select("band", parts.alias("parts")), "band").join(counts, "band").withColumn("own", cell)
        members = members.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        members = members.select("band", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "root", (F.col("root") != F.col("main")).alias("outside"))
        some = members.groupBy("band", "i", "j").agg(F.bool_or("outside").alias("any")).where("any").drop("any")
        rows = members.join(some, ["band", "i", "j"]).join(sources.select("node", "text"), "node")
        labels = joined_labels(labels, checkpointed(_block_links(rows, words, percent)))
    found = components_of(signed, classes, labels)
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull()))


@any_names
def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that are kept: of each component one row, that of the least id. Where ids repeat or are null, each row is decided on its own; null ids come last."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        gone = components(docs, words, percent).where("NOT kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = checkpointed(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")))  # no name can clash
    named = rows.select(F.struct(F.col("row.doc_id").isNull().alias("unnamed"), F.col("row.doc_id"), "key").alias("doc_id"), F.col("row.text"))
    gone = components(named, words, percent).where("NOT kept").select(F.col("doc_id.key").alias("key"))
    return rows.join(gone, "key", "left_anti").select("row.*")
