"""State that follows a key's rows in order."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .framing import earlier_sums, ordinal


def keyed_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], tuple], schema: str) -> DataFrame:
    """One output row for each input row: step(state, row) changes the key's state and returns the row.

    Rows are partitioned by key and sorted within partitions, so they stream through a task batch by batch; only the
    state of the key at hand is held, however many rows it has.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (own := getattr(row, key)) != now:
                    now, state = own, start()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def keyed_events(df: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], list[tuple]], finish: Callable[[dict, object], list[tuple]], schema: str) -> DataFrame:
    """keyed_fold() with any number of rows for each input row, and for the end of a key: finish(state, key)."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if state is None or getattr(row, key) != now:
                    if state is not None:
                        out += finish(state, now)
                    now, state = getattr(row, key), start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names, dtype=object)  # else null ids would make floats of long ones
        if state is not None:
            yield pd.DataFrame(finish(state, now), columns=names, dtype=object)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def last_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by a combining aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def smoothed(df: DataFrame, key: str, order: list[str], value: Column, alpha: float, bucket: Column | None = None) -> DataFrame:
    """(key, ema): the exponential mean that its first value seeds. Weights by rank make it a sum."""
    ranked = ordinal(df.withColumn("_x", value), key, order, bucket, "_i")
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(F.lit(alpha)) * F.pow(F.lit(1 - alpha), F.col("_n") - 1 - F.col("_i"))
    return ranked.join(sizes, key).groupBy(key).agg(F.sum(weight * F.col("_x")).alias("ema"))


def gated_floor(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.1) -> DataFrame:
    """(key, floor): an exponential mean that the first value seeds and only values under twice itself move, or any while it is 0."""

    def step(state: dict, row: tuple) -> list:
        x, floor = getattr(row, value), state["floor"]
        if not state["n"]:
            state["floor"] = x
        elif x < 2 * floor or floor == 0:
            state["floor"] = alpha * x + (1 - alpha) * floor
        state["n"] += 1
        return []

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, *order, *([value] if value not in order else []))
    return keyed_events(rows, key, order, lambda: {"floor": 0.0, "n": 0}, step, lambda state, own: [(own, state["floor"])], f"{key} {kind}, floor double")


def failure_runs(df: DataFrame, key: str, order: list[str], ok: Column, bucket: Column | None = None) -> DataFrame:
    """(key, longest, current): lengths of runs of failures; a success ends a run.

    A run is known by the number of successes before it. With `bucket`, a column that never falls along `order`, those
    are counted within (key, bucket) and moved up by the successes of earlier buckets, and a run over several buckets
    is added up from its parts: a key with most rows has as many tasks as buckets.
    """
    marked = df.withColumns({"_ok": ok.cast("int"), "_bucket": F.lit(0) if bucket is None else bucket})
    before = earlier_sums(marked.groupBy(key, "_bucket").agg(F.sum("_ok").alias("_n")), key)
    own = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = marked.withColumn("_run", F.sum("_ok").over(own)).groupBy(key, "_bucket", "_run").agg(F.sum(1 - F.col("_ok")).alias("_n"))
    runs = parts.join(before, [key, "_bucket"]).groupBy(key, (F.col("_run") + F.col("_before")).alias("_run")).agg(F.sum("_n").alias("_n"))
    return runs.groupBy(key).agg(F.max("_n").alias("longest"), F.max_by("_n", "_run").alias("current"))


def sensor_status(current: Column, observed: Column, expected: Column, most: int = 10, tolerance: float = 0.05) -> Column:
    """Failed beyond `most` failures in a row, Degraded beyond the tolerance; a sensor never registered has failed."""
    off = F.abs(observed - expected) / expected > tolerance
    return F.when(expected.isNull() | (current > most), "Failed").when((expected > 0) & off, "Degraded").otherwise("Active")


def fifo(df: DataFrame, key: str, order: list[str], capacity: int) -> DataFrame:
    """What a queue that drops its oldest still holds: each key's last `capacity` rows, numbered from the oldest."""
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= capacity)
    return kept.withColumn("place", F.count("*").over(Window.partitionBy(key)) - F.col("_r")).drop("_r")


def priority_queue(df: DataFrame, key: str, order: list[str], item: str, urgent: str, capacity: int) -> DataFrame:
    """(key, items): pushes go to the back and evict the front; urgent ones go to the front and evict the back."""

    def step(state: dict, row: tuple) -> list:
        pushed(state["queue"], getattr(row, item), getattr(row, urgent), capacity)
        return []

    kind, items = df.schema[key].dataType.simpleString(), df.schema[item].dataType.simpleString()
    rows = df.select(*dict.fromkeys([key, *order, item, urgent]))
    return keyed_events(rows, key, order, lambda: {"queue": deque()}, step, lambda state, own: [(own, list(state["queue"]))], f"{key} {kind}, items array<{items}>")


def pushed(queue: deque, x: object, urgent: bool, capacity: int) -> list:
    """Push x and return what a full queue loses for it: its back to an urgent item, which goes to the front, else its front."""
    lost = []
    if len(queue) >= capacity:
        lost.append(queue.pop() if urgent else queue.popleft())
    (queue.appendleft if urgent else queue.append)(x)
    return lost


def outbound(ops: DataFrame, key: str, order: list[str], item: str, op: str, capacity: int = 1000) -> DataFrame:
    """(key, item, fate, cause, place): what became of every pushed item of a key's queue.

    `op` is push, urgent or drain; anything else, null too, is a push. A full queue evicts its front, or for an urgent
    item its back (fate evicted, by the item that came); a drain empties it (drained, by the drain's item, in the order
    of place); the rest is held, in the order of place. The log is the queue: running it again gives the same rows, and
    only `capacity` items of a key are in memory.
    """

    def step(state: dict, row: tuple) -> list:
        queue, own, x = state["queue"], getattr(row, key), getattr(row, item)
        if getattr(row, op) == "drain":
            out = [(own, y, "drained", x, place) for place, y in enumerate(queue)]
            queue.clear()
            return out
        return [(own, y, "evicted", x, 0) for y in pushed(queue, x, getattr(row, op) == "urgent", capacity)]

    def finish(state: dict, own: object) -> list:
        return [(own, y, "held", None, place) for place, y in enumerate(state["queue"])]

    kind, items = _kind(ops, key), _kind(ops, item)
    rows = ops.select(*dict.fromkeys([key, *order, item, op]))
    return keyed_events(rows, key, order, lambda: {"queue": deque()}, step, finish, f"{key} {kind}, {item} {items}, fate string, cause {items}, place int")


def registry(rows: DataFrame, key: str, order: list[str], alpha: float = 0.1, most: int = 10, tolerance: float = 0.05) -> DataFrame:
    """The columns of `order` with status and noise_floor of a sensor after each row (key, op, rate, level).

    `register` seeds the observed rate with the nominal one and forgets the rest, also for a sensor that is known; the
    first `success` after it sets rate and floor, later ones are exponential means, the floor's only while quiet;
    `failure` counts. An unregistered sensor has failed and has the floor 0; any other op changes nothing.
    """

    def step(s: dict, row: tuple) -> list:
        if row.op == "register":
            s.update(known=True, expected=row.rate, rate=row.rate, floor=0.0, failures=0, heard=False)
        elif row.op == "success" and s["known"]:
            s["failures"] = 0
            if not s["heard"]:
                s.update(rate=row.rate, floor=row.level, heard=True)
            else:
                s["rate"] = alpha * row.rate + (1 - alpha) * s["rate"]
                if row.level < 2 * s["floor"] or s["floor"] == 0:
                    s["floor"] = alpha * row.level + (1 - alpha) * s["floor"]
        elif row.op == "failure" and s["known"]:
            s["failures"] += 1
        off = s["known"] and s["expected"] > 0 and abs(s["rate"] - s["expected"]) / s["expected"] > tolerance
        status = "Failed" if not s["known"] or s["failures"] > most else "Degraded" if off else "Active"
        return [(getattr(row, key), *(getattr(row, c) for c in order), status, s["floor"])]

    start = lambda: {"known": False, "expected": 0.0, "rate": 0.0, "floor": 0.0, "failures": 0, "heard": False}
    named = ", ".join(f"{c} {_kind(rows, c)}" for c in (key, *order))
    return keyed_events(rows.select(*dict.fromkeys([key, *order, "op", "rate", "level"])), key, order, start, step, lambda state, own: [], f"{named}, status string, noise_floor double")


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
