"""The stateful operators on streams: the same steps as in batch, with state that survives restarts.

Input is event-time ordered per key within a micro-batch; a watermark of a minute bounds what windows wait for.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import alerts as L

WATERMARK = "60 seconds"


class AlertProcessor(StatefulProcessor):
    """Decisions with the cooldown in state."""

    def __init__(self, cooldown: L.Cooldown, mesh: bool):
        self.cooldown, self.mesh = cooldown, mesh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "level string, magnitude double, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = dict(zip(("level", "magnitude", "at"), self.last.get(), strict=True)) if self.last.exists() else L.Cooldown.start()
        batch = pd.concat(list(rows)).sort_values(["us", "id"])
        out = []
        for row in batch.itertuples(index=False):
            name = row.level if isinstance(row.level, str) else None
            out.append((key[0], row.us, row.id, name, self.cooldown.decide(state, row.us, name, row.magnitude, self.mesh)))
        self.last.update((state["level"], float(state["magnitude"]), int(state["at"])))
        yield pd.DataFrame(out, columns=["station", "us", "id", "level", "kind"])

    def close(self) -> None:
        pass


def alert_stream(predictions: DataFrame, cooldown: L.Cooldown, mesh: bool = False) -> DataFrame:
    """(station, us, id, level, kind) of a stream (station, us, id, probability, magnitude)."""
    rows = predictions.select("station", "us", "id", "magnitude", L.level(F.col("probability")).alias("level"))
    return rows.groupBy("station").transformWithStateInPandas(AlertProcessor(cooldown, mesh), "station long, us long, id long, level string, kind string", "Append", "None")


class FrameProcessor(StatefulProcessor):
    """Overlapping frames: the samples of the open frame stay in state."""

    def __init__(self, size: int, step: int):
        self.size, self.step = size, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "k long, samples array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        k, held = self.ring.get() if self.ring.exists() else (0, [0])
        held = [*held[1:], *pd.concat(list(rows)).sort_values("i")["v"].tolist()]
        out, at = [], 0
        while len(held) - at >= self.size:
            out.append((key[0], k, held[at : at + self.size]))
            k, at = k + 1, at + self.step
        self.ring.update((int(k), [0, *map(int, held[at:])]))  # never an empty array, whose type state cannot tell
        yield pd.DataFrame(out, columns=["ch", "k", "samples"])

    def close(self) -> None:
        pass


def frame_stream(samples: DataFrame, size: int = 256, overlap: int = 128) -> DataFrame:
    """(ch, k, samples) of a stream (ch, i, v) whose samples come in order."""
    return samples.groupBy("ch").transformWithStateInPandas(FrameProcessor(size, size - overlap), "ch long, k long, samples array<int>", "Append", "None")


class ClaimProcessor(StatefulProcessor):
    """Claims wait for votes of different stations, whichever they are; a timer ends those that stay without."""

    def __init__(self, timeout_ms: int, least: int = 1):
        self.timeout_ms, self.least = timeout_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "station long, us long, votes array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "kind"])
        out = []
        for row in batch.itertuples(index=False):
            if row.kind == "claim" and not self.claim.exists():
                self.claim.update((int(row.station), int(row.us), [-1]))  # never an empty array, whose type state cannot tell
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout_ms)
            elif row.kind == "vote":
                if not self.claim.exists():
                    out.append((key[0], "UnknownClaim", 0))
                    continue
                station, us, votes = self.claim.get()
                votes = [-1, *sorted({*map(int, votes[1:]), int(row.station)})]
                if len(votes) > self.least:
                    out.append((key[0], "Reached", len(votes)))  # with the claim's own station
                    self.claim.clear()
                else:
                    self.claim.update((int(station), int(us), votes))
                    out.append((key[0], "Pending", len(votes) - 1))
        yield pd.DataFrame(out, columns=["claim_id", "status", "stations"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.claim.exists():
            self.claim.clear()
            yield pd.DataFrame([(key[0], "Expired", 0)], columns=["claim_id", "status", "stations"])

    def close(self) -> None:
        pass


def claim_stream(messages: DataFrame, timeout_ms: int = 10_000, least: int = 1) -> DataFrame:
    """(claim_id, status, stations) of a stream (claim_id, station, us, kind) of claims and votes."""
    return messages.groupBy("claim_id").transformWithStateInPandas(ClaimProcessor(timeout_ms, least), "claim_id long, status string, stations int", "Append", "ProcessingTime")


class ConsensusProcessor(StatefulProcessor):
    """The batch state machine by event time: rows wait in state until the watermark passes them, so that late ones fall into place, and claims end when the watermark passes their window."""

    def __init__(self, cooldown: L.Cooldown, window_us: int, least: int):
        self.machine = L.Consensus(cooldown, window_us, least)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "json string")

    def _state(self) -> dict:
        if not self.kept.exists():
            return {**self.machine.start(), "waiting": []}
        state = json.loads(self.kept.get()[0])
        state["claims"] = {int(c): x for c, x in state["claims"].items()}
        return state

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = self._state()
        plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
        for batch in rows:
            state["waiting"] += [[plain(getattr(r, c)) for c in ("us", "kind", "id", "voter", "magnitude", "level")] for r in batch.itertuples(index=False)]
            for us in set(batch["us"].tolist()):
                self.handle.registerTimer(-(-int(us) // 1000) + 1)
                self.handle.registerTimer(-(-(int(us) + self.machine.window_us) // 1000) + 1)
        self.kept.update((json.dumps(state),))
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state, out = self._state(), []
        # as in batch: by time, predictions before votes, null voters first
        ready = sorted((r for r in state["waiting"] if r[0] < now), key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or 0))
        state["waiting"] = [r for r in state["waiting"] if r[0] >= now]
        for us, kind, claim, voter, magnitude, name in ready:
            out += self.machine.due(state, key[0], us)
            out.append(self.machine.take(state, Row(key[0], us, int(claim), kind, None if voter is None else int(voter), magnitude, name)))
        out += self.machine.due(state, key[0], now - 1)
        self.kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["station", "us", "id", "kind", "level", "outcome", "stations"]
Row = namedtuple("Row", ["station", "us", "id", "kind", "voter", "magnitude", "level"])


def consensus_stream(rows: DataFrame, cooldown: L.Cooldown, window_us: int = 10_000_000, least: int = 1, late: str = WATERMARK) -> DataFrame:
    """consensus_events() of a stream (station, us, id, kind, probability, magnitude, voter) whose rows come at most `late` after later ones."""
    timed = rows.select("station", "us", "id", "kind", "voter", "magnitude", L.level(F.col("probability")).alias("level"), F.timestamp_micros("us").alias("at")).withWatermark("at", late)
    schema = "station long, us long, id long, kind string, level string, outcome string, stations int"
    return timed.groupBy("station").transformWithStateInPandas(ConsensusProcessor(cooldown, window_us, least), schema, "Append", "EventTime")


class PeerProcessor(StatefulProcessor):
    """The registry of a station's peers, one entry of map state for each."""

    def __init__(self, peers: L.Peers):
        self.book = peers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.peers = handle.getMapState("peers", "peer string", "last long, health string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        before = {p[0]: tuple(x) for p, x in self.peers.iterator()}
        known, out = dict(before), []
        for row in pd.concat(list(rows)).sort_values(["us", "id", "op", "peer"]).itertuples(index=False):
            out += [(key[0], row.us, row.id, *n) for n in self.book.take(known, row.op, row.peer, row.us)]
        for peer, (last, health) in known.items():
            if before.get(peer) != (last, health):
                self.peers.updateValue((peer,), (int(last), health))
        yield pd.DataFrame(out, columns=["station", "us", "id", "healthy", "stale", "lost"])

    def close(self) -> None:
        pass


def peer_stream(rows: DataFrame, peers: L.Peers | None = None) -> DataFrame:
    """peer_registry() of a stream whose rows come in order."""
    return L.peer_rows(rows).groupBy("station").transformWithStateInPandas(PeerProcessor(peers or L.Peers()), L.PEER_COUNTS, "Append", "None")


def rates(stream: DataFrame, at: str, width: str = "1 minute") -> DataFrame:
    """Rows in tumbling windows; late rows within the watermark count."""
    return stream.withWatermark(at, WATERMARK).groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
