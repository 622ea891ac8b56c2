"""A write-ahead log of binary entries, as files with one byte layout, read and written by Spark tasks.

    seq u64 | op u8 | length u32 | payload | crc32 u32      (little-endian; the checksum leaves the length out)

A scan stops at the first short header, zero header past the start, unknown op, cut entry or wrong checksum: what a
crash can leave is a valid prefix. A log may be larger than memory: entries are decoded as they are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.framing import ordinal
from ..storage import fresh

HEADER = struct.Struct("<QBI")
#: The operations of entries.
INSERT, UPDATE, DELETE = 0, 1, 2


def encode(seq: int, op: int, payload: bytes) -> bytes:
    checksum = zlib.crc32(struct.pack("<QB", seq, op) + payload)
    return HEADER.pack(seq, op, len(payload)) + payload + struct.pack("<I", checksum)


def scan(data: bytes | memoryview, start_seq: int = 0) -> Iterator[tuple[int, int, bytes, int]]:
    """(seq, op, payload, end) of the valid prefix's entries from start_seq on."""
    view, at = memoryview(data), 0
    while at + HEADER.size <= len(view):
        head = bytes(view[at : at + HEADER.size])
        seq, op, size = HEADER.unpack(head)
        end = at + HEADER.size + size + 4
        if (at and not any(head)) or op > DELETE or end > len(view):
            return
        payload = bytes(view[at + HEADER.size : end - 4])
        if zlib.crc32(struct.pack("<QB", seq, op) + payload) != int.from_bytes(view[end - 4 : end], "little"):
            return
        if seq >= start_seq:
            yield seq, op, payload, end
        at = end


def entries(rows: DataFrame) -> DataFrame:
    """(seq, entry) of rows (seq, op, payload), by column expressions alone."""
    little = lambda c, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 2 * n, "0"), 2 * k - 1, 2) for k in range(n, 0, -1)]))
    signed = F.concat(little(F.col("seq"), 8), little(F.col("op").cast("long"), 1))
    return rows.select("seq", F.concat(signed, little(F.octet_length("payload").cast("long"), 4), F.col("payload"), little(F.crc32(F.concat(signed, F.col("payload"))), 4)).alias("entry"))


def append(rows: DataFrame, folder: str) -> None:
    """Write rows (seq, op, payload) as segments of the log in Parquet: the commit protocol makes them whole."""
    entries(rows).write.mode("append").parquet(folder)


def read(spark: SparkSession, folder: str, start_seq: int = 0) -> DataFrame:
    """(seq, op, payload) of all valid entries from start_seq on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [found[:3] for entry in batch["entry"] for found in scan(entry, start_seq)]
            yield pd.DataFrame(out, columns=["seq", "op", "payload"])

    return spark.read.parquet(folder).select("entry").mapInPandas(run, "seq long, op int, payload binary")


def read_files(spark: SparkSession, path: str, start_seq: int = 0) -> DataFrame:
    """The same of plain log files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame([x[:3] for x in scan(content, start_seq)], columns=["seq", "op", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "seq long, op int, payload binary")


def next_seq(log: DataFrame) -> int:
    """Where a reopened log goes on."""
    top = log.agg(F.max("seq")).first()[0]
    return 0 if top is None else top + 1


def round_trip(rows: DataFrame, key: str) -> DataFrame:
    """Rows numbered by `key`, logged as insertions of the key's eight bytes, and read back."""
    spark = rows.sparkSession
    numbered = ordinal(rows.withColumn("_all", F.lit(1)), "_all", [key], F.floor(F.col(key) / 1000), "seq")
    payload = F.unhex(F.concat(*[F.substring(F.lpad(F.hex(key), 16, "0"), 2 * k - 1, 2) for k in range(8, 0, -1)]))
    folder = fresh(spark, "log")
    append(numbered.select("seq", F.lit(INSERT).alias("op"), payload.alias("payload")), folder)
    return read(spark, folder)

