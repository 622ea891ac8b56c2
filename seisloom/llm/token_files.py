"""Operator 3: token files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is a valid zstandard stream in the seekable layout:

    frame ... frame     ids as little-endian unsigned 32-bit integers, whole documents, about FRAME_BYTES each
    skippable frame     the index: for each document its doc_id (signed 64 bits) and number of ids (unsigned 32), zstandard
    skippable frame     the seek table: for each frame its compressed size, its size and the low 32 bits of the XXH64 of
                        its content, then the number of frames, a descriptor byte and the magic number

A reader that has the index and the table fetches and decompresses only the frames of the documents it wants.
Documents are in ascending doc_id order within a file and from file to file. A file is written under a name of its own
task attempt and then renamed, so that a lost or repeated task leaves one whole file.

Cases: a null or empty text has the end id only; ids (null included, which comes first and is stored as the smallest
integer) may repeat: equal ids are in the order of their texts; a very long document is one large frame; an empty table
gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, texts_of
from .tokens import library
from .trie_bpe import MEMORY

FRAME_BYTES = 1 << 18
LEVEL = 3
#: Fixed values of the seekable zstandard layout.
SKIPPABLE, INDEX_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
NO_ID = -(1 << 63)
_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")


class _Folder:
    """Files of a folder, local to all (file:) or of a store that pyarrow reaches."""

    def __init__(self, url: str):
        self.local = url.removeprefix("file://") if url.startswith(("file:", "/")) else None
        if self.local is None:
            from pyarrow.fs import FileSystem

            self.store, self.root = FileSystem.from_uri(url)
        else:
            self.local = self.local.removeprefix("file:")
            os.makedirs(self.local, exist_ok=True)

    def create(self, name: str):
        return open(f"{self.local}/{name}", "wb") if self.local is not None else self.store.open_output_stream(f"{self.root}/{name}")

    def open(self, name: str):
        return open(f"{self.local}/{name}", "rb") if self.local is not None else self.store.open_input_file(f"{self.root}/{name}")

    def rename(self, old: str, new: str) -> None:
        if self.local is not None:
            os.replace(f"{self.local}/{old}", f"{self.local}/{new}")
        else:
            self.store.move(f"{self.root}/{old}", f"{self.root}/{new}")


class TokenWriter:
    """Writes one file; add documents in order, then finish."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[bytes] = []
        self.open: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append(struct.pack("<qI", NO_ID if doc_id is None else doc_id, len(ids) // 4))
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        data = b"".join(self.open)
        frame = self.zstd.compress(data)
        self.out.write(frame)
        self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.held = [], 0

    def finish(self) -> None:
        if self.open:
            self._frame()
        index = self.zstd.compress(b"".join(self.index))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        # the index counts as a frame without content, so that offsets of the table stay true
        entries = b"".join(_ENTRY.pack(*x) for x in [*self.table, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)])
        footer = _FOOTER.pack(len(self.table) + 1, 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class TokenReader:
    """Reads one file; only the frames that hold the documents asked for are read and decompressed."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - _FOOTER.size)
        frames, descriptor, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEK_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table")
        source.seek(end - _FOOTER.size - frames * _ENTRY.size)
        table = list(_ENTRY.iter_unpack(source.read(frames * _ENTRY.size)))
        self.frames, at, first = [], 0, 0
        for packed, size, checksum in table[:-1]:
            self.frames.append((at, packed, first, size // 4, checksum))
            at, first = at + packed, first + size // 4
        source.seek(at)
        magic, size = struct.unpack("<II", source.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("no index")
        self.documents, start = [], 0
        for doc_id, n in struct.iter_unpack("<qI", zstandard.ZstdDecompressor().decompress(source.read(size))):
            self.documents.append((None if doc_id == NO_ID else doc_id, start, n))
            start += n

    def frame(self, k: int) -> bytes:
        at, packed, _, n, checksum = self.frames[k]
        self.source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(packed))
        if len(data) != 4 * n or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return data

    def read(self, positions: list[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start in the file, ids) of the documents at these ascending positions of the index, or of all."""
        k, held = -1, b""
        for p in range(len(self.documents)) if positions is None else positions:
            doc_id, start, n = self.documents[p]
            while k < 0 or start >= self.frames[k][2] + self.frames[k][3]:
                k, held = k + 1, b""
            held = held or self.frame(k)
            at = 4 * (start - self.frames[k][2])
            yield doc_id, start, held[at : at + 4 * n]


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 0, files: int | None = None, memory: int = MEMORY) -> list[tuple[str, int, int]]:
    """Write all documents and return (file, documents, ids) in order: as many rows as files. An encoder remembers `memory` chunks, twice at most."""
    spark = docs.sparkSession
    docs = texts_of(docs)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, n, ids_n, out = TaskContext.get().partitionId(), f".{uuid.uuid4().hex}", 0, 0, None
        place, encoder = _Folder(folder), library(tokenizer, memory)
        for batch in small_batches(batches):
            if not batch.num_rows:
                continue
            if out is None:
                out = place.create(own)
                writer = TokenWriter(out)
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist()), strict=True):
                writer.add(doc_id, ids + last)
                n, ids_n = n + 1, ids_n + len(ids) // 4 + 1
        if out is not None:
            writer.finish()
            out.close()
            place.rename(own, f"tokens-{part:06d}.zst")
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"tokens-{part:06d}.zst", "documents": n, "ids": ids_n}])

    ordered = docs.repartitionByRange(files, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = ordered.mapInArrow(run, "part long, file string, documents long, ids long").collect()
    return [(r["file"], r["documents"], r["ids"]) for r in sorted(made, key=lambda r: r["part"])]


def read(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files."""
    rows, start = [], 0
    for name, _, ids in manifest:
        rows.append((name, start))
        start += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _Folder(folder)
        for batch in batches:
            for name, first in zip(batch["file"].to_pylist(), batch["first"].to_pylist(), strict=True):
                with place.open(name) as source:
                    held: list[tuple] = []
                    for doc_id, at, ids in TokenReader(source).read():
                        held.append((doc_id, first + at, len(ids) // 4, zlib.crc32(ids)))
                        if len(held) == 10_000:
                            yield _rows(held)
                            held = []
                    yield _rows(held)

    files = spark.createDataFrame(rows, "file string, first long")
    return files.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, memory: int = MEMORY) -> DataFrame:
    """Write token files to a folder of their own below the shared one and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    return read(spark, folder, write(docs, tokenizer, folder, memory=memory))
