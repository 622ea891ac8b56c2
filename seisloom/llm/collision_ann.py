"""Operator 8: approximate nearest neighbours by collision counting over single projections.

A block of unit vectors keeps `LINES` random projections, each as one sorted array. A query opens a window around its
own projection in every array. Windows grow by virtual rehashing: each round multiplies the width, and only the newly
covered ends of each array are counted. A vector that falls into the windows of at least `SHARE` of the arrays has
collided often enough to be verified by its exact cosine. A query ends when at least k verified vectors are nearer than
the current radius, whatever part of the block that takes: there is no budget. It is approximate only as a nearer vector
can collide on fewer than its share of the projections; recall is measured in the tests.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; fewer
candidates than k are all returned; equal cosines go to the smaller id; repeated rows are candidates each; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import vectors as V

LINES = 64
SHARE = 0.6
WIDTH = 0.5
GROWTH = 1.2
SEED = 20240229


def projections(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, LINES))


def index(ids: np.ndarray, matrix: np.ndarray) -> dict[str, np.ndarray]:
    norm = np.sqrt((matrix * matrix).sum(1))
    lines = projections(matrix.shape[1])
    place = ((matrix / norm[:, None]) @ lines).astype(np.float32)
    order = np.argsort(place, axis=0, kind="stable")
    return {"norm": norm, "lines": lines, "order": np.ascontiguousarray(order.T.astype(np.int32)), "place": np.ascontiguousarray(np.take_along_axis(place, order, 0).T)}


def cosine(rows: np.ndarray, norm: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (rows * query).sum(1) / (norm * np.sqrt((query * query).sum()))


def collision_search(made: dict[str, np.ndarray], ids: np.ndarray, matrix: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n, order, place = len(ids), made["order"], made["place"]
    centre = ((query / np.sqrt((query * query).sum())) @ made["lines"]).astype(np.float32)
    need = max(1, int(np.ceil(SHARE * LINES)))
    hits, verified = np.zeros(n, np.int64), ids == query_id
    others = int(n - verified.sum())
    low = [int(place[j].searchsorted(centre[j])) for j in range(LINES)]
    high = list(low)
    held, scores = np.zeros(0, np.int64), np.zeros(0)
    radius, done = WIDTH, 0
    while done < others:
        ends = []
        for j in range(LINES):
            line = place[j]
            a, b = line.searchsorted((centre[j] - np.float32(radius), centre[j] + np.float32(radius))).tolist()
            if a < low[j]:
                ends.append(order[j, a : low[j]])
                low[j] = a
            if b > high[j]:
                ends.append(order[j, high[j] : b])
                high[j] = b
        if ends:
            hits += np.bincount(np.concatenate(ends), minlength=n)
        fresh = np.flatnonzero((hits >= need) & ~verified)
        if not ends and not len(fresh) and all(a == 0 for a in low) and all(b == n for b in high):
            fresh = np.flatnonzero(~verified)
        if len(fresh):
            verified[fresh] = True
            done += len(fresh)
            held, scores = V.best(ids, np.concatenate([held, fresh]), np.concatenate([scores, cosine(matrix[fresh], made["norm"][fresh], query)]), k)
        # on unit vectors, squared distance = 2 - 2 cosine; a projection spreads as the distance
        if len(held) == min(k, others) and np.sqrt(max(0.0, 2 - 2 * scores[-1])) <= radius:
            break
        radius *= GROWTH
    return held, scores


def nearest(vectors: DataFrame, k: int = 5, divisor: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, embedding): cosines in double precision."""
    return V.search(V.usable(vectors, nonzero=True), k, divisor, index, collision_search, "double")
