"""A proximity-graph index that is kept as Parquet: appended to by batches, searched without a rebuild.

A batch of new vectors is dealt to shards of about `SHARD` rows. Each shard's layered graph is built once, in its own
task, and written as one row for each node: shard, id, vector, level and its neighbours on each layer. An append only
writes shards of its own, so earlier shards stay as they are, and readers see whole appends: a folder `append=<name>` is
written by one Spark job, and a repeated append of the same name replaces it.

A search sends each block of queries to every shard, loads a shard once, and merges the best k by query. Within a shard
all queries of a block walk the graph in step: each step gathers the neighbours of every query's best open node as one
array, measures them in one product and merges them into all beams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import XorShift

SHARD, QUERIES, TOGETHER = 4_096, 512, 64
#: Neighbours on upper layers, on the lowest one, and the width of the beam that builds.
M, M_BOTTOM, EF_BUILD = 16, 32, 200
NODE = "shard long, vec_id long, vector array<float>, level int, links array<array<int>>"


class Layers:
    """Unit vectors and, for each layer, a table of neighbours padded by -1."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.levels, self.links = vectors, levels, links
        self.size = len(vectors)

    def _best(self, queries: np.ndarray, start: np.ndarray, layer: int, ef: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """For all queries at once, the `ef` nearest nodes found from each one's start among the first `known`, nearest first: (nodes, distances), padded by -1 and infinity."""
        n, rows = len(queries), np.arange(len(queries))
        nodes, far = np.full((n, ef), -1), np.full((n, ef), np.inf)
        done = np.zeros((n, ef), bool)
        seen = np.zeros((n, known + 1), bool)  # the last column takes the padding
        nodes[:, 0], far[:, 0] = start, 1 - np.einsum("ij,ij->i", queries, self.vectors[start])
        seen[rows, start] = True
        while True:
            open_far = np.where(done | (nodes < 0), np.inf, far)
            at = open_far.argmin(1)
            live = np.flatnonzero(np.isfinite(open_far[rows, at]))
            if not len(live):
                return nodes, far
            done[live, at[live]] = True
            near = self.links[layer][nodes[live, at[live]]]
            near = np.where((near < 0) | seen[live[:, None], near], -1, near)
            seen[live[:, None], near] = True
            new = np.where(near < 0, np.inf, 1 - np.einsum("ij,ikj->ik", queries[live], self.vectors[near]))
            every = np.concatenate([far[live], new], axis=1)
            order = np.argsort(every, axis=1, kind="stable")[:, :ef]
            far[live] = np.take_along_axis(every, order, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], near], axis=1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(near, bool)], axis=1), order, 1)
            nodes[live] = np.where(np.isfinite(far[live]), nodes[live], -1)

    def entry(self, known: int) -> int:
        """The first of the highest nodes."""
        return int(self.levels[:known].argmax())

    def descend(self, queries: np.ndarray, to: int, known: int) -> np.ndarray:
        """Each query's nearest node after a greedy walk on the layers above `to`."""
        at = np.full(len(queries), self.entry(known))
        for layer in range(int(self.levels[:known].max()), to, -1):
            at = self._best(queries, at, layer, 1, known)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of each query's k nearest, padded by -1 and infinity."""
        nodes, far = self._best(queries, self.descend(queries, 0, self.size), 0, max(ef, k), self.size)
        return nodes[:, :k], far[:, :k]

    def _linked(self, layer: int, of: int, others: np.ndarray) -> None:
        """The nearest of a node's neighbours and `others`, as many as the layer allows."""
        most = self.links[layer].shape[1]
        every = np.unique(np.concatenate([self.links[layer][of], others]))
        every = every[(every >= 0) & (every != of)]
        far = 1 - self.vectors[every] @ self.vectors[of]
        kept = every[np.argsort(far, kind="stable")[:most]]
        self.links[layer][of] = -1
        self.links[layer][of, : len(kept)] = kept

    def insert(self, begin: int, end: int, ef: int) -> None:
        """Link the nodes from begin to end, which see the nodes before them and each other."""
        own = np.arange(begin, end)
        among = 1 - self.vectors[own] @ self.vectors[own].T
        top = int(self.levels[:begin].max())
        shared = range(min(top, int(self.levels[own].max())) + 1)
        mine = {layer: own[self.levels[own] >= layer] for layer in shared}
        found = {layer: self._best(self.vectors[at], self.descend(self.vectors[at], layer, begin), layer, ef, begin)[0] for layer, at in mine.items()}  # all before any is linked
        for layer in shared:
            most = self.links[layer].shape[1]
            for node, near in zip(mine[layer].tolist(), found[layer], strict=True):
                peers = mine[layer][np.argsort(among[node - begin][mine[layer] - begin], kind="stable")[: most + 1]]
                self._linked(layer, node, np.concatenate([near[near >= 0][:most], peers]))
                for other in self.links[layer][node]:
                    if other >= 0:
                        self._linked(layer, int(other), np.array([node]))
        for layer in range(top + 1, int(self.levels[own].max()) + 1):  # layers that begin here
            above = own[self.levels[own] >= layer]
            for node in above.tolist():
                self._linked(layer, node, above)


def built(vectors: np.ndarray) -> Layers:
    """The graph of a shard. Levels are drawn as -ln(u) / ln(M), rounded down."""
    random = XorShift(0xDEADBEEFCAFEBABE)  # fixed value: the seed of layer draws
    levels = np.array([int(-math.log(random.bits() / 0xFFFFFFFFFFFFFFFF) / math.log(M)) for _ in vectors])
    links = [np.full((len(vectors), M if layer else M_BOTTOM), -1) for layer in range(int(levels.max()) + 1)]
    graph = Layers(vectors, levels, links)
    at = 1
    while at < len(vectors):
        to = min(len(vectors), at + min(TOGETHER, at))  # no more than there are already
        graph.insert(at, to, EF_BUILD)
        at = to
    return graph


def append(vectors: DataFrame, folder: str, name: str) -> None:
    """Add (vec_id, embedding) to the index at `folder` as the append `name`. Null vectors are left out."""
    rows = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    parts = max(1, -(-rows.count() // SHARD))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        graph = built(np.stack(group["embedding"]).astype(float))
        links = [[[int(x) for x in table[n] if x >= 0] for table in graph.links[: level + 1]] for n, level in enumerate(graph.levels)]
        return pd.DataFrame({"shard": group["shard"], "vec_id": group["vec_id"], "vector": group["embedding"], "level": graph.levels.astype("int32"), "links": links})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    dealt.groupBy("shard").applyInPandas(build, NODE).write.mode("overwrite").parquet(f"{folder}/append={name}")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes (append, shard, vec_id, vector, level, links); lookups by id and counts reach the files as filters."""
    return spark.read.schema(f"{NODE}, append string").parquet(folder)


def search(queries: DataFrame, folder: str, k: int, ef: int = 64) -> DataFrame:
    """(query_id, vec_id, rank, distance): approximately each query's k nearest in the index, ties to the smaller id."""
    spark = queries.sparkSession
    kept = nodes(spark, folder)
    appends = kept.groupBy("append").agg(F.max("shard").alias("last"))  # one row for each directory, which the driver lists anyway
    asked = queries.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    parts = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    packed = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("vec_id", "vector")).alias("rows"))  # about QUERIES of a block
    none = F.lit(None).cast("array<array<int>>")
    asks = packed.join(F.broadcast(appends)).select("append", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard"), "rows")
    asks = asks.select("append", "shard", F.lit(True).alias("asks"), F.explode("rows").alias("r"))
    asks = asks.select("append", "shard", "asks", "r.vec_id", "r.vector", F.lit(0).alias("level"), none.alias("links"))
    rows = kept.select("append", "shard", F.lit(False).alias("asks"), "vec_id", "vector", "level", "links").unionByName(asks)
    met = rows.repartition("append", "shard").sortWithinPartitions("append", "shard", "asks", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting = None, [], []
        graph, ids = None, None

        def loaded() -> tuple[Layers, np.ndarray]:
            vectors = np.array([r[3] for r in held], float)
            levels = np.array([r[4] for r in held])
            links = []
            for layer in range(int(levels.max()) + 1):
                table = np.full((len(held), M if layer else M_BOTTOM), -1)
                for n, r in enumerate(held):
                    if layer < len(r[5]):
                        table[n, : len(r[5][layer])] = r[5][layer]
                links.append(table)
            return Layers(vectors, levels, links), np.array([r[2] for r in held])

        def told() -> pa.RecordBatch:
            found, far = graph.search(np.array([r[3] for r in waiting], float), k, ef)
            i, j = np.nonzero(found >= 0)
            own = np.array([r[2] for r in waiting])
            return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[found[i, j]]), pa.array(far[i, j])], names=["query_id", "vec_id", "distance"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("append", "shard", "vec_id", "vector", "level", "links", "asks")), strict=True):
                if row[:2] != at or len(waiting) == QUERIES:
                    if waiting:
                        yield told()
                    waiting = []
                if row[:2] != at:
                    at, held, graph = row[:2], [], None
                if not row[6]:
                    held.append(row)
                elif graph is not None or held:  # else no vector has fallen into this shard
                    if graph is None:
                        graph, ids = loaded()
                        held = []
                    waiting.append(row)
        if waiting:
            yield told()

    best = met.mapInArrow(run, "query_id long, vec_id long, distance double").withColumn("_d", F.round("distance", 12))
    order = Window.partitionBy("query_id").orderBy("_d", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))
