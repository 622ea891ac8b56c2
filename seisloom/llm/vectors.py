"""What the two vector searches share: blocks of candidates, each met by blocks of queries, and the merge of their best.

Candidates are dealt over blocks of about `BLOCK` rows by a hash of the id, queries over groups of about `GROUP`. A block
is read and indexed once, and all groups, which are much smaller, stream past it; where there are fewer blocks than
`TASKS`, a block is copied to a few tasks that share the groups. Memory is bounded by one block and some groups; the
best rows of each pair are merged by query. No side is broadcast, and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32_768
GROUP = 256
TASKS = 16


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, embedding array<double>) without rows whose id is null or whose vector is null, empty or has null or non-finite components, or, if asked, is zero."""
    v = F.col("embedding")
    whole = F.size(v) > 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    df = df.where(F.col("vec_id").isNotNull() & v.isNotNull() & whole & F.coalesce(finite, F.lit(False)))
    return df.where(F.exists(v, lambda x: x != 0)) if nonzero else df


def _packed(rows: DataFrame, parts: int, dtype: str) -> DataFrame:
    """One row for each width of vectors and each of `parts` shares of them: part, ids and vectors as binary matrices."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        matrix = np.stack([np.asarray(x, dtype) for x in group["embedding"]])
        return pd.DataFrame({"width": [matrix.shape[1]], "part": [int(group["part"].iloc[0])], "ids": [group["vec_id"].to_numpy("int64").tobytes()], "rows": [matrix.tobytes()]})

    dealt = rows.withColumn("width", F.size("embedding")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    return dealt.groupBy("width", "part").applyInPandas(pack, "width int, part long, ids binary, rows binary")


def search(vectors: DataFrame, k: int, divisor: int, prepare: Callable, find: Callable, score_type: str, dtype: str = "float64") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `divisor`, the k best of all others, ties to the smaller id.

    prepare(ids, matrix) makes a block's index; find(index, ids, matrix, query_id, query, k) gives positions and scores.
    `vectors` is read more than once: give it cut off from an expensive lineage. Vectors of different widths do not meet.
    """
    queries = vectors.where(F.col("vec_id") % divisor == 0)
    n, n_queries = vectors.count(), queries.count()
    parts, shares = max(1, -(-n // BLOCK)), max(1, -(-n_queries // GROUP))
    slices = min(shares, max(1, TASKS // parts))
    numbers = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    blocks = _packed(vectors, parts, dtype).select("width", F.col("part").alias("block"), numbers(slices).alias("slice"), F.lit(False).alias("asks"), "ids", "rows")
    groups = _packed(queries, shares, dtype).select("width", numbers(parts).alias("block"), F.pmod("part", F.lit(slices)).alias("slice"), F.lit(True).alias("asks"), "ids", "rows")
    keys = ["width", "block", "slice"]
    met = blocks.unionByName(groups).repartition(*keys).sortWithinPartitions(*keys, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, matrix, index = None, None, None, None
        for batch in batches:
            for k_row in range(batch.num_rows):
                width, block, part, asks, own_ids, own_rows = (batch.column(c)[k_row].as_py() for c in range(6))
                own_ids, own = np.frombuffer(own_ids, "int64"), np.frombuffer(own_rows, dtype).reshape(-1, width)
                if not asks:
                    at, ids, matrix, index = (width, block, part), own_ids, own, prepare(own_ids, own)
                elif at == (width, block, part):  # else the block has no rows
                    for query_id, query in zip(own_ids, own, strict=True):
                        found, scores = find(index, ids, matrix, int(query_id), query, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query_id)), pa.array(ids[found]), pa.array(scores)], names=["query_id", "vec_id", "score"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in run(batches):
            held.append(batch)
            if len(held) == 2000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held and (found := pa.Table.from_batches(held).combine_chunks().to_batches()):
            yield found[0]

    best = met.mapInArrow(joined, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of these positions, ties to the smaller id."""
    if len(at) > 8 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        at, scores = at[keep], scores[keep]
    order = np.lexsort((-ids[at], scores))[::-1][:k]
    return at[order], scores[order]
