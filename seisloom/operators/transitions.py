"""Ordered updates of a transition matrix, as a scan: partitions are folded for every row they could start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import keyed_events
from .graph import WAVES

LEAST = 1e-8  # fixed value: rows of a smaller sum start again as uniform
TINY = 1e-14
THIN = 1e-12  # of a triangle's height
PIECES = 256


def updated(row: np.ndarray, column: int, delta: float) -> np.ndarray:
    """One update of a row: add, not below zero, and scale to 1; a row of nothing becomes uniform."""
    row = row.copy()
    row[column] = max(row[column] + delta, 0.0)
    return row / row.sum() if row.sum() > LEAST else np.full(3, 1 / 3)


class Scan:
    """What a run of updates makes of any row of three shares.

    Up to scale an update is linear, but for the clamp, which folds the part of the triangle of all rows that lies
    beyond a line. So the triangle is cut into smaller ones: `start` has their corners and `end` what becomes of these,
    up to a scale for each triangle. Where sums grow, updates draw rows together, so after some hundreds few cuts are
    left to make; where they shrink, rows are driven apart and cuts go on, see ordered_transitions().
    """

    def __init__(self) -> None:
        self.start = np.eye(3)[None]
        self.end = np.eye(3)[None]

    def update(self, column: int, delta: float) -> None:
        total = self.end.sum(2)
        height = self.end[:, :, column] + delta * total
        if height.min() < 0:
            total, height = self._cut(height, lambda: (self.end.sum(2), self.end[:, :, column] + delta * self.end.sum(2)))
            self.end[:, :, column] = np.maximum(height, 0)
        else:
            self.end[:, :, column] = height
        left = self.end.sum(2) - LEAST * total
        if left.min() <= 0:
            before = total
            kept = np.concatenate([self.end, before[:, :, None]], 2)  # the sum before goes with the corners
            self.end = kept
            (left,) = self._cut(left, lambda: (self.end[:, :, :3].sum(2) - LEAST * self.end[:, :, 3],))
            self.end, before = self.end[:, :, :3].copy(), self.end[:, :, 3]
            gone = left.mean(1) <= 0
            self.end[gone] = before[gone][:, :, None] / 3
        self.end /= self.end.sum((1, 2))[:, None, None]

    def _cut(self, height: np.ndarray, again) -> tuple:
        """Cut the triangles that have corners on both sides of height 0, and give again()."""
        low, high = height < -TINY, height > TINY
        mixed = low.any(1) & high.any(1)
        if mixed.any():
            starts, ends = [self.start[~mixed]], [self.end[~mixed]]
            for s, e, h, under in zip(self.start[mixed], self.end[mixed], height[mixed], low[mixed], strict=True):
                alone = int(np.argmax(under == (under.sum() == 1)))  # the corner that is alone on its side
                a, b, c = alone, (alone + 1) % 3, (alone + 2) % 3
                ab, ac = (np.clip(h[a] / (h[a] - h[x]), 0, 1) for x in (b, c))
                for out, p in ((starts, s), (ends, e)):
                    x, y = p[a] + ab * (p[b] - p[a]), p[a] + ac * (p[c] - p[a])
                    out.append(np.stack([[p[a], x, y], [x, p[b], p[c]], [x, p[c], y]]))
            self.start, self.end = np.concatenate(starts), np.concatenate(ends)
            side = np.linalg.norm(self.start - np.roll(self.start, 1, 1), axis=2).max(1)
            solid = np.abs(np.linalg.det(self.start)) > THIN * side  # others are lines, which their neighbours have too
            self.start, self.end = self.start[solid], self.end[solid]
        return again()


def followed(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What becomes of a row: it lies in one of the triangles (count x 3 x 3)."""
    at = np.linalg.solve(start.transpose(0, 2, 1), np.broadcast_to(row, (len(start), 3))[:, :, None])[:, :, 0]
    own = int(np.argmax(at.min(1)))
    out = np.maximum(np.maximum(at[own], 0) @ end[own], 0)
    return out / out.sum()


def ordered_transitions(updates: DataFrame, order: list[str], delta: str = "delta", parts: int | None = None, pieces: int = PIECES) -> DataFrame:
    """(from_wave, to_wave, p): the matrix after all updates (from_wave, to_wave, delta), one after the other by `order`.

    Each row starts uniform; an update adds delta to a share, not below zero, and scales the row to 1, a row of nothing
    becoming uniform. Waves that are not known, null too, are P. A delta that is null or not finite changes nothing.
    Equal orders follow by wave and delta, a null order comes first, and without updates all is uniform.

    `parts` ranges of the order are folded side by side into runs, each a map (Scan) of at most about `pieces` triangles
    or, where that is less, the updates themselves; then the runs are followed one after the other, for each row of the
    matrix. Where updates draw rows together, or are large, a range is one run. Where they drive rows apart, no short map
    exists, and what is followed is at most the updates once: slower, but nothing is left out.
    """
    spark = updates.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [f"_o{k}" for k in range(len(order))]
    keys = [*named, "_col", "_delta"]
    kinds = ", ".join(f"{n} {updates.schema[c].dataType.simpleString()}" for n, c in zip(named, order, strict=True))

    def place(c: str) -> Column:
        return F.when(F.col(c) == WAVES[1], 1).when(F.col(c) == WAVES[2], 2).otherwise(0)

    rows = updates.select(*[F.col(c).alias(n) for n, c in zip(named, order, strict=True)], place("from_wave").alias("_row"), place("to_wave").alias("_col"), F.col(delta).cast("double").alias("_delta"))
    rows = rows.where((F.abs("_delta") < float("inf")) & (F.col("_delta") != 0))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[int, list] = {}  # for each row of the matrix: the first update's keys, the map, the updates while they are few
        n = 0

        def closed(row: int) -> tuple:
            nonlocal n
            first, scan, own = runs.pop(row)
            n += 1
            if own is not None and len(own) < scan.start.size:
                return (*first, n, row, [c for c, _ in own], [x for _, x in own], [], [])
            return (*first, n, row, [], [], scan.start.ravel(), scan.end.ravel())

        columns = [*keys, "_n", "_row", "columns", "deltas", "start", "end"]
        for batch in batches:
            out = []
            for first, row, column, x in zip(batch[keys].itertuples(index=False, name=None), batch["_row"].tolist(), batch["_col"].tolist(), batch["_delta"].tolist(), strict=True):
                run = runs.setdefault(row, [first, None, []])
                run[1] = run[1] or Scan()
                run[1].update(column, x)
                if run[2] is not None:
                    run[2].append((column, x))
                    if len(run[2]) > 9 * pieces:
                        run[2] = None
                if len(run[1].start) > pieces:
                    out.append(closed(row))
            if out:
                yield pd.DataFrame(out, columns=columns, dtype=object)
        if runs:
            yield pd.DataFrame([closed(row) for row in list(runs)], columns=columns, dtype=object)

    ranged = rows.repartitionByRange(parts, *keys, "_row").sortWithinPartitions(*keys, "_row")
    made = ranged.mapInPandas(maps, f"{kinds}, _col int, _delta double, _n int, _row int, columns array<int>, deltas array<double>, start array<double>, end array<double>")

    def step(state: dict, row: tuple) -> list:
        if len(row.start):
            state["p"] = followed(state["p"], *(np.array(x, dtype=float).reshape(-1, 3, 3) for x in (row.start, row.end)))
        for column, x in zip(row.columns, row.deltas, strict=True):
            state["p"] = updated(state["p"], int(column), float(x))
        return []

    # names that a tuple can have
    made = made.toDF(*[f"o{k}" for k in range(len(order))], "col", "delta", "n", "row", "columns", "deltas", "start", "end")
    ways = [*[f"o{k}" for k in range(len(order))], "col", "delta", "n"]
    last = keyed_events(made, "row", ways, lambda: {"p": np.full(3, 1 / 3)}, step, lambda state, own: [(WAVES[int(own)], WAVES[k], float(state["p"][k])) for k in range(3)], "from_wave string, to_wave string, p double")
    every = spark.createDataFrame([(a, b) for a in WAVES for b in WAVES], "from_wave string, to_wave string")
    return every.join(last, ["from_wave", "to_wave"], "left").withColumn("p", F.coalesce("p", F.lit(1.0 / 3)))
