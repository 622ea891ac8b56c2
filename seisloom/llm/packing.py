"""Operator 1: best-fit packing of token sequences, planned over the histogram of lengths.

The plan needs only how many pieces have each length: at most `size` numbers, whatever the table's size. Best fit, in
descending order of length, places whole runs of equal pieces into whole runs of equally filled sequences. Pieces then
take the planned slots by their rank within their length. Ranks are dealt over `SALTS` groups of each length, so that
a length that most rows share is no single task's work.

Cases: a null or empty text is one piece that holds the end id only; a document of more than `size` ids is cut, its
first piece being the shorter one; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean_batches, small_batches, texts_of
from .tokens import library
from .trie_bpe import MEMORY

SALTS = 128


def cut(n: int, size: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    whole = (n - 1) // size
    return [n - whole * size, *[size] * whole]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces, and `ids` binary if asked for. An encoder remembers `memory` chunks, twice at most."""
    lean_batches(docs.sparkSession)
    docs = texts_of(docs)
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library(tokenizer, memory)
        for batch in small_batches(batches):
            rows: list[tuple] = []
            for row, ids in enumerate(encoder.encode(batch["text"].to_pylist())):
                ids, at = ids + last, 0
                for k, n in enumerate(cut(len(ids) // 4, size)):
                    own = ids[4 * at : 4 * (at + n)]
                    rows.append((row, k, at, n, zlib.crc32(own), own if with_ids else b""))
                    at += n
            row, *rest = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [batch["doc_id"].take(pa.array(row)), *(pa.array(x, kind) for x, kind in zip(rest, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: rows (length, first rank, ranks, first sequence, ranks in a sequence, offset)."""
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
    rows, made = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = next((r for r in range(length, size + 1) if free.get(r)), None)
            if room is None:
                per = min(size // length, left)
                first, n, room = made, -(-left // per), size
                made += n
            else:
                first, n = free[room].pop()
                per = min(room // length, left)
            use = min(n, left // per)  # sequences that get `per` pieces each
            if use < n and room < size:
                free[room].append((first + use, n - use))
            elif use < n:  # the last new sequence gets fewer
                few = left - use * per
                rows.append((length, rank + use * per, few, first + use, few, 0))
                free.setdefault(size - few * length, []).append((first + use, 1))
                left -= few
            rows.append((length, rank, use * per, first, per, size - room))
            free.setdefault(room - per * length, []).append((first, use))
            left -= use * per
            rank = histogram[length] - left
        free.pop(0, None)
    return rows


def pack(parts: DataFrame, size: int = 2048) -> DataFrame:
    """`parts` (doc_id, piece, length, ...) with sequence_id and offset. It is read twice: give it cut off from its lineage."""
    spark = parts.sparkSession
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    groups = checkpointed(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))  # at most size * SALTS rows
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most size rows
    slots = spark.createDataFrame(plan(histogram, size), "length long, _rank long, _ranks long, _sequence long, _per long, _offset long")
    before = groups.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]
    ranked = salted.withColumn("_local", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)))
    ranked = ranked.join(F.broadcast(before), ["length", "_salt"]).withColumn("_rank_of", F.col("_local") + F.col("_before") - 1)
    at = F.col("_rank_of") - F.col("_rank")
    placed = ranked.join(F.broadcast(slots), "length").where((at >= 0) & (at < F.col("_ranks")))
    return placed.select(*[F.col(c) for c in parts.columns], (F.col("_sequence") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_offset") + F.pmod(at, F.col("_per")) * F.col("length")).cast("long").alias("offset"))


def packed(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, memory: int = MEMORY) -> DataFrame:
    """Every document's pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(checkpointed(pieces(docs, tokenizer, size, end, memory=memory)), size)


def sequences(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>, doc_ids, lengths) of packed sequences, for training. A sequence has at most `size` ids."""
    placed = pack(checkpointed(pieces(docs, tokenizer, size, end, with_ids=True)), size)
    kind = placed.schema["doc_id"].dataType.simpleString()

    def join(batch):
        import numpy as np
        import pandas as pd

        batch = batch.sort_values("offset")
        ids = np.frombuffer(b"".join(batch["ids"]), "<u4").astype("int32")
        return pd.DataFrame({"sequence_id": [batch["sequence_id"].iloc[0]], "ids": [ids], "doc_ids": [list(batch["doc_id"])], "lengths": [list(batch["length"])]})

    return placed.groupBy("sequence_id").applyInPandas(join, f"sequence_id long, ids array<int>, doc_ids array<{kind}>, lengths array<long>")
