"""Operator 4: exact top-k by Fagin's threshold algorithm.

A block of candidates keeps, for each dimension, its rows sorted by that component. A query goes down all lists at
once, from the end that its own component favours. What it meets is scored in full. The sum, over the dimensions, of
the query's component times the component reached is a bound for all rows not met yet: once the k-th best score is
above it, the search stops. A row equal to the bound could still win a tie, so equality goes on.

Components become floor(256 x), as 64-bit integers; scores are integer inner products, exact whatever their size, and
held to the range of 64 bits.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; fewer
candidates than k are all returned; repeated rows are candidates each, and a query meets no row of its own id; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V

STEP = 64


def sorted_lists(ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Row positions by descending component, for each dimension; the components in that order; the rows as narrow floats; the largest component."""
    order = np.argsort(-matrix.astype(np.float64), axis=0, kind="stable")
    values = np.ascontiguousarray(np.take_along_axis(matrix, order, 0).T).astype(np.float64)
    return np.ascontiguousarray(order.T.astype(np.int32)), values, matrix.astype(np.float32), float(np.abs(matrix.astype(np.float64)).max())


def exact(rows: np.ndarray, narrow: np.ndarray, query: np.ndarray, at: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of rows with the query: in the narrowest numbers that hold any sum of products whole."""
    if largest < 2**24:
        return (narrow[at] @ query.astype(np.float32)).astype(np.int64)
    if largest < 2**53:
        return (rows[at].astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if largest < 2**62:
        return rows[at] @ query
    whole = [int(x) for x in query.tolist()]
    sums = [sum(a * b for a, b in zip(row, whole, strict=True)) for row in rows[at].tolist()]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in sums], np.int64)


def threshold_search(index: tuple[np.ndarray, np.ndarray, np.ndarray, float], ids: np.ndarray, matrix: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order, values, narrow, peak = index
    n = len(ids)
    wide = query.astype(np.float64)
    largest = peak * float(np.abs(wide).max(initial=0)) * matrix.shape[1]
    lists = np.flatnonzero(query)
    down = wide[lists] > 0
    met = ids == query_id
    held, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step = 0, STEP
    while not met.all():
        to = min(n, depth + step)
        reached = met.copy()
        if len(lists):
            reached[order[lists[down], depth:to]] = True
            reached[order[lists[~down], n - to : n - depth]] = True
        else:  # all scores are 0
            reached[:] = True
        fresh = np.flatnonzero(reached & ~met)
        met = reached
        held, scores = V.best(ids, np.concatenate([held, fresh]), np.concatenate([scores, exact(matrix, narrow, query, fresh, largest)]), k)
        bound = np.where(down, values[lists, to - 1], values[lists, n - to]) @ wide[lists]
        if len(held) == k and float(scores[-1]) > bound + largest * 1e-13:  # what the bound's sum may have been rounded by
            break
        depth, step = to, step * 2
    return held, scores


def top_k(vectors: DataFrame, k: int = 5, divisor: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, embedding)."""
    whole = V.usable(vectors).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * 256.0).cast("long")))
    return V.search(whole, k, divisor, sorted_lists, threshold_search, "long", "int64")
