"""Helpers that the operators of this subpackage share.

Everything here works on whole texts; nothing caps, samples or truncates rows.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

#: The bytes that end a word: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
#: Text is hashed in slices of about so many bytes, to stay in the CPU's cache.
SLICE_BYTES = 1 << 20
#: The columns of documents that the operators read.
NAMED = ("doc_id", "text", "lang", "source", "n_chars")
#: A key with more than one in SHARES of a table's rows, and more than SHARE_ROWS of them, is joined on its own.
SHARES, SHARE_ROWS = 512, 200
_BASE = 0x9E3779B97F4A7C15 | 1
_pow: list[np.ndarray] = []
#: So many powers are kept.
_POWERS = SLICE_BYTES * 9 // 8
_held: dict[str, Any] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder of spark.checkpoint.dir, with its lineage cut; a folder of our own only where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` as Parquet below the shared folder, and where. Unlike a checkpoint, its size is known from its files, so that a loop's estimates do not multiply."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete what written() has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def lean_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches for the session, from here on: rows hold whole texts, often two."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def held(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at most, so that a worker that stages share does not pile up all of theirs."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what this worker keeps; tasks that keep nothing begin with it."""
    if _held:
        _held.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give memory that is free back to the system: idle workers stay alive beside the busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def any_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`stage` for tables with columns of any other names, dots and repeated names too: they are numbered inside and named again after it. The stage returns the columns that it was given."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args: Any, **named: Any) -> DataFrame:
        names = docs.columns
        inner = [c if c in NAMED and c not in names[:k] else f"_{k}" for k, c in enumerate(names)]
        return stage(docs.toDF(*inner), *args, **named).toDF(*names)

    return run


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the decimal id modulo `divisor`; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor, F.lit(0))


def column(name: str) -> Column:
    """A top-level column by its name, whatever signs that holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts empty; other columns, whatever their names, go."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64 and their inverses, at least; those for the longest texts are not kept."""
    if n > _POWERS:
        return _powers(n)
    if not _pow:
        _pow.extend(_powers(_POWERS))
    return _pow[0], _pow[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        seq = np.full(n, base, np.uint64)
        seq[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(seq, out=seq))
    return out[0], out[1]


_CODES = _byte_codes()
_IS_SPACE = np.isin(np.arange(256), list(SPACES))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes (xxh3) of all words of `texts`, one after the other; the number of words in each text; the last two bytes of each word as an integer; the words' lengths."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, joined.split()), np.uint64, len(begin))  # split() knows the same spaces
    cuts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    counts = np.diff(np.searchsorted(begin, cuts), prepend=0)
    tail = data[end - 1].astype(np.int64) | (np.where(end - begin > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64) << 8)
    return hashes, counts, tail, end - begin


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES each; a longer text is alone."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= SLICE_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def lowered(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8 with A-Z lower-cased; null is empty."""
    return [(x or "").encode("utf-8", "surrogatepass").lower() for x in column.to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`. After the last one, a task's free memory goes back to the system."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
        batch = None
    finally:
        trim()


def raw_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Bitmap:
    """A set of 64-bit keys that may hold more than was put in, of fixed size: it only keeps rows out of a shuffle."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def of(keys: DataFrame, bits: int = 26) -> Bitmap:
        """Of the one long column of `keys`. At most 2^bits / 64 words reach the driver, whatever the number of keys."""
        name = keys.columns[0]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, 1 << 20):
                at = Bitmap.places(batch[name].to_numpy(zero_copy_only=False), bits)
                word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
                mask = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

        frame = keys.mapInArrow(place, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[frame["word"].to_numpy()] = frame["mask"].to_numpy().view(np.uint64)
        return Bitmap(bits, words)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        return mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = Bitmap.places(keys, self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def joined(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """The inner join of `left` with `right`, where a few keys may hold most of `left`.

    `counts` (keys, n) tells how many rows of `left` have a key. Keys with more than one in `SHARES` of all rows are
    fewer than `SHARES`: these, a table of proven size, are broadcast, and their rows dealt over salts of a share each.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(SHARE_ROWS, total // SHARES)
    heavy = counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).alias("_salts"))
    found = heavy.collect()  # fewer than SHARES rows
    if not found:
        return left.join(right, keys)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, heavy.schema))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts)).drop("_salts")
    copied = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def passing(df: DataFrame, bitmap: Bitmap, key: str) -> DataFrame:
    """The rows of `df` whose long `key` may be in the bitmap, in one Python step."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(shared.value.has(batch[key].to_numpy())))

    return df.mapInArrow(run, df.schema)
