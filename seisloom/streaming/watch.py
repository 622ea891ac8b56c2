"""Rules on running queries: heartbeats while all of them show progress, and search widths by memory."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.runtime import CRITICAL, WARNING


def memory_share(path: str = "/proc/meminfo") -> float:
    """(total - available) / total of the driver's machine."""
    with open(path) as lines:
        kb = {name: float(rest.split()[0]) for name, rest in (line.split(":") for line in lines)}
    return (kb["MemTotal"] - kb["MemAvailable"]) / kb["MemTotal"]


class Watch(StreamingQueryListener):
    """Watches all streaming queries of a session.

    Start, progress and idleness are a query's signs of life; one that ends well is no longer watched, one that fails
    gives no more of them. tick(), every two seconds, gives a heartbeat only if no query has been silent for more than
    `limit_s`; after the first silence heartbeats stay off, so that whoever waits for them restarts the process. Every
    `check_s` it also checks memory: a change of level calls apply(level, search width). The newest `keep` heartbeats,
    silences and levels are rows().
    """

    def __init__(self, apply: Callable[[str, int], None] = lambda level, width: None, used: Callable[[], float] = memory_share, limit_s: float = 10, check_s: float = 30, normal: int = 64, clock: Callable[[], float] = time.monotonic, keep: int = 10_000):
        self.apply, self.used, self.limit_s, self.check_s, self.normal, self.clock = apply, used, limit_s, check_s, normal, clock
        self.alive: dict[str, float] = {}
        self.level, self.paused, self.checked = "Normal", False, None
        self.kept: deque = deque(maxlen=keep)
        self._lock = threading.Lock()

    def _sign(self, run: object) -> None:
        with self._lock:
            self.alive[str(run)] = self.clock()

    def onQueryStarted(self, event) -> None:
        self._sign(event.runId)

    def onQueryProgress(self, event) -> None:
        self._sign(event.progress.runId)

    def onQueryIdle(self, event) -> None:
        self._sign(event.runId)

    def onQueryTerminated(self, event) -> None:
        if event.exception is None:
            with self._lock:
                self.alive.pop(str(event.runId), None)

    def stale(self) -> list[str]:
        """Runs silent for more than the limit."""
        with self._lock:
            now = self.clock()
            return sorted(run for run, at in self.alive.items() if now - at > self.limit_s)

    def tick(self) -> bool:
        """Apply the rules now; whether there is a heartbeat."""
        now = self.clock()
        if self.checked is None or now - self.checked >= self.check_s:
            self.checked, share = now, self.used()
            level, width = ("Critical", CRITICAL[1]) if share > CRITICAL[0] else ("Warning", WARNING[1]) if share > WARNING[0] else ("Normal", self.normal)
            if level != self.level:
                self.level = level
                self.kept.append((time.time(), "level", level))
                self.apply(level, width)
        if not self.paused:
            silent = self.stale()
            self.paused = bool(silent)
            self.kept.append((time.time(), "silence" if silent else "heartbeat", ",".join(silent)))
        return not self.paused

    def rows(self, spark: SparkSession) -> DataFrame:
        """(at, event, detail): heartbeats, silences with their runs, levels; the newest `keep`."""
        return spark.createDataFrame([(a, b, c) for a, b, c in list(self.kept)], "at double, event string, detail string")


class Watching:
    """with Watching(spark, watch): listens, and ticks every `every_s` seconds."""

    def __init__(self, spark: SparkSession, watch: Watch, every_s: float = 2):
        self.spark, self.watch, self.every_s, self.ended = spark, watch, every_s, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.ended.wait(self.every_s):
            self.watch.tick()

    def __enter__(self) -> Watch:
        self.spark.streams.addListener(self.watch)
        self.thread.start()
        return self.watch

    def __exit__(self, *_: object) -> None:
        self.ended.set()
        self.thread.join()
        self.spark.streams.removeListener(self.watch)
