"""Vector store operators: exact nearest neighbours, pruning, tiers and a sharded proximity graph."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import XorShift
from .graph_index import Layers

#: Rows of a block of candidates and of a block of queries.
BLOCK, QUERIES = 16_384, 2_048
#: Blocks of queries share the copies of a candidate block, so that there are about so many tasks.
TASKS = 64
#: Queries that walk a graph in step.
TOGETHER = 512


def _blocks(df: DataFrame, name: str, rows: int, same: str | None) -> tuple[DataFrame, int]:
    """One row for each block: its ids and vectors as arrays of binary matrices; and the number of blocks. A block holds about `rows` rows, of one value of `same`."""
    parts = max(1, -(-df.count() // rows))
    keys = [same] if same else []
    dealt = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), *keys)
    dealt = dealt.where("embedding IS NOT NULL").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(parts)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = {name: [group[name].iloc[0]], f"{name}_ids": [group["vec_id"].to_numpy("int64").tobytes()], f"{name}_rows": [np.stack(group["embedding"]).astype("float32").tobytes()]}
        return pd.DataFrame(out | {k: [group[k].iloc[0]] for k in keys})

    schema = f"{name} long, {name}_ids binary, {name}_rows binary" + "".join(f", {k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.groupBy(name, *keys).applyInPandas(pack, schema), parts


def _met(left: tuple[DataFrame, int], right: tuple[DataFrame, int], keys: list[str]) -> DataFrame:
    """(keys, c, s, asks, ids, rows): each block of candidates, once for each of a few slices, and behind it the blocks of queries that it answers. A candidate block moves once for each slice, not for each block of queries."""
    (queries, n_queries), (candidates, n_blocks) = left, right
    slices = min(n_queries, max(1, TASKS // n_blocks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = candidates.select(*keys, "c", numbers(slices).alias("s"), F.lit(False).alias("asks"), F.col("c_ids").alias("ids"), F.col("c_rows").alias("rows"))
    asked = queries.select(*keys, numbers(n_blocks).alias("c"), F.pmod("q", F.lit(slices)).alias("s"), F.lit(True).alias("asks"), F.col("q_ids").alias("ids"), F.col("q_rows").alias("rows"))
    return held.unionByName(asked).repartition(*keys, "c", "s").sortWithinPartitions(*keys, "c", "s", "asks")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", same: str | None = None, skip_self: bool = False, earlier: bool = False) -> DataFrame:
    """(query_id, vec_id, rank, distance): each query's k nearest rows, ties to the smaller id.

    A block of candidates is read once and blocks of queries stream past it, as matrices; the best k of each pair are
    merged by query. `same` keeps candidates whose value of that column is the query's; `earlier` keeps those whose id is
    not above the query's, for searches that must not see the future. Null vectors take no part.
    """
    keys = [same] if same else []
    met = _met(_blocks(queries, "q", QUERIES, same), _blocks(vectors, "c", BLOCK, same), keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, b_ids, b = None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = tuple(getattr(row, c) for c in (*keys, "c", "s"))
                ids = np.frombuffer(row.ids, "int64")
                rows = np.frombuffer(row.rows, "float32").reshape(len(ids), -1).astype(float)
                if not row.asks:
                    at, b_ids, b = own, ids, rows
                    squares = (b * b).sum(1)[None, :]
                elif own == at:  # else the block has no candidates
                    for begin in range(0, len(ids), 256):
                        part, part_ids = rows[begin : begin + 256], ids[begin : begin + 256]
                        dots = part @ b.T
                        far = 1 - dots if metric == "cosine" else np.sqrt(np.maximum(0, (part * part).sum(1)[:, None] + squares - 2 * dots))
                        if skip_self:
                            far[part_ids[:, None] == b_ids[None, :]] = np.inf
                        if earlier:
                            far[part_ids[:, None] < b_ids[None, :]] = np.inf
                        m = min(k, far.shape[1])
                        bound = np.partition(far, m - 1, axis=1)[:, m - 1]
                        i, j = np.nonzero((far <= bound[:, None] + 1e-9) & np.isfinite(far))
                        yield pd.DataFrame({"query_id": part_ids[i], "vec_id": b_ids[j], "distance": far[i, j]})

    best = met.mapInPandas(run, "query_id long, vec_id long, distance double").withColumn("_d", F.round("distance", 12))
    order = Window.partitionBy("query_id").orderBy("_d", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def pruned(edges: DataFrame, m: int, by: str = "distance") -> DataFrame:
    """The m nearest edges of each source."""
    order = Window.partitionBy("src").orderBy(by, "dst")
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= m).drop("_r")


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, which keep the edge's id."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id"))


def tiers(accesses: DataFrame, key: str, at: str, threshold: int) -> DataFrame:
    """Hot, or Warm once the last access is more than `threshold` before the newest of all; nothing is ever Cold."""
    last = accesses.groupBy(key).agg(F.max(at).alias("_last"))
    now = accesses.agg(F.max(at).alias("_now"))
    return last.join(F.broadcast(now)).select(key, F.when(F.col("_now") - F.col("_last") > threshold, "Warm").otherwise("Hot").alias("tier"))


class ProximityGraph:
    """Layers of neighbour lists over unit vectors; a search descends greedily, then widens a beam at the bottom."""

    def __init__(self, m: int = 16, m_bottom: int = 32, ef_build: int = 200):
        self.m, self.m_bottom, self.ef_build = m, m_bottom, ef_build
        self.rows: list[np.ndarray] = []
        self.links: list[list[list[int]]] = []  # node -> layer -> neighbours
        self.top, self.entry = 0, -1
        self.random = XorShift(0xDEADBEEFCAFEBABE)  # fixed value: the seed of layer draws

    def layer(self) -> int:
        return int(-math.log(self.random.bits() / 0xFFFFFFFFFFFFFFFF) / math.log(self.m))

    def _far(self, query: np.ndarray, nodes: list[int]) -> list[float]:
        return [1 - float(self.rows[n] @ query) for n in nodes]

    def _descend(self, query: np.ndarray, node: int, layer: int) -> int:
        best = self._far(query, [node])[0]
        while near := self.links[node][layer]:
            far = self._far(query, near)
            at = int(np.argmin(far))
            if far[at] >= best:
                break
            node, best = near[at], far[at]
        return node

    def _beam(self, query: np.ndarray, start: int, ef: int, layer: int) -> list[tuple[float, int]]:
        first = self._far(query, [start])[0]
        seen, todo, found = {start}, [(first, start)], [(-first, start)]
        while todo:
            d, node = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            fresh = [n for n in self.links[node][layer] if n not in seen]
            seen.update(fresh)
            for far, n in zip(self._far(query, fresh), fresh, strict=True):
                if len(found) < ef or far < -found[0][0]:
                    heapq.heappush(todo, (far, n))
                    heapq.heappush(found, (-far, n))
                    if len(found) > ef:
                        heapq.heappop(found)
        return sorted((-d, n) for d, n in found)

    def insert(self, row: np.ndarray) -> int:
        node, level = len(self.rows), self.layer()
        self.rows.append(row)
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry, self.top = node, level
            return node
        at = self.entry
        for layer in range(self.top, level, -1):
            at = self._descend(row, at, layer)
        for layer in range(min(level, self.top), -1, -1):
            most = self.m_bottom if layer == 0 else self.m
            near = self._beam(row, at, self.ef_build, layer)
            at = near[0][1]
            for _, other in near[:most]:
                self.links[node][layer].append(other)
                back = self.links[other][layer]
                back.append(node)
                if len(back) > most:
                    order = sorted(zip(self._far(self.rows[other], back), back, strict=True))
                    self.links[other][layer] = [n for _, n in order[:most]]
        if level > self.top:
            self.entry, self.top = node, level
        return node

    def search(self, query: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = self.entry
        for layer in range(self.top, 0, -1):
            at = self._descend(query, at, layer)
        return self._beam(query, at, max(ef, k), 0)[:k]


def linked(rows: np.ndarray) -> Layers:
    """The graph that inserting `rows` one after the other gives where each finds its exact nearest: links are the nearest of those that a node chose among earlier ones and of later ones that chose it.

    Blocks of rows are measured against all before them as one product, so a shard takes less than a second, where
    inserts with a beam take many.
    """
    draw = ProximityGraph()
    levels = np.array([draw.layer() for _ in rows])
    links = []
    for layer in range(int(levels.max()) + 1):
        at = np.flatnonzero(levels >= layer)
        own, most, ends = rows[at], draw.m if layer else draw.m_bottom, []
        for begin in range(0, len(at), 256):
            far = 1 - own[begin : begin + 256] @ own[: begin + 256].T
            far[np.arange(far.shape[1])[None, :] >= np.arange(begin, begin + len(far))[:, None]] = np.inf
            near = np.argpartition(far, min(most, far.shape[1]) - 1, axis=1)[:, :most]
            d = np.take_along_axis(far, near, 1)
            i, j = np.nonzero(np.isfinite(d))
            ends.append((i + begin, near[i, j], d[i, j]))
        node, other, d = (np.concatenate(x) for x in zip(*ends, strict=True))
        node, other, d = np.concatenate([node, other]), np.concatenate([other, node]), np.concatenate([d, d])
        order = np.lexsort((other, d, node))
        node, other = node[order], other[order]
        place = np.arange(len(node)) - np.searchsorted(node, node)
        table = np.full((len(rows), most), -1)
        table[at[node[place < most]], place[place < most]] = at[other[place < most]]
        links.append(table)
    return Layers(rows.astype("float32"), levels, links)


def graph_search(vectors: DataFrame, queries: DataFrame, k: int, ef: int = 64, shard_rows: int = 4_096) -> DataFrame:
    """Approximate (query_id, vec_id, rank, distance): a proximity graph for each shard of vectors, built once for each slice of the queries, merged by query. A block of queries walks a graph in step, in single precision; what it finds is measured in double."""
    met = _met(_blocks(queries, "q", QUERIES, None), _blocks(vectors, "c", shard_rows, None), [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, graph, shard, held = None, None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.ids, "int64")
                rows = np.frombuffer(row.rows, "float32").reshape(len(ids), -1)
                if not row.asks:
                    held = rows.astype(float)
                    at, graph, shard = (row.c, row.s), linked(held), ids
                elif at == (row.c, row.s):
                    for begin in range(0, len(ids), TOGETHER):
                        asked = rows[begin : begin + TOGETHER]
                        nodes, _ = graph.search(asked, max(ef, k), ef)
                        far = np.where(nodes < 0, np.inf, 1 - np.einsum("ij,ikj->ik", asked.astype(float), held[nodes]))
                        best = np.lexsort((shard[nodes], far), axis=1)[:, :k]
                        nodes, far = np.take_along_axis(nodes, best, 1), np.take_along_axis(far, best, 1)
                        i, j = np.nonzero(np.isfinite(far))
                        yield pd.DataFrame({"query_id": ids[begin : begin + TOGETHER][i], "vec_id": shard[nodes[i, j]], "distance": far[i, j]})

    best = met.mapInPandas(run, "query_id long, vec_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))
