"""Alert levels, rate-limited decisions, claims that other stations confirm, peers and messages."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import keyed_events, keyed_fold

LEVELS = ("Low", "Medium", "High", "Critical")
#: The least probabilities of the levels.
BOUNDS = (0.3, 0.5, 0.7, 0.9)


def level(probability: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """Null below the first bound. Bounds must rise strictly."""
    if list(bounds) != sorted(set(bounds)) or len(bounds) != 4:
        raise ValueError("thresholds must rise strictly")
    low, medium, high, critical = map(float, bounds)
    return F.when(probability >= critical, "Critical").when(probability >= high, "High").when(probability >= medium, "Medium").when(probability >= low, "Low")


class Cooldown:
    """After an alert, levels no higher are held back for a while, unless the magnitude rises enough."""

    def __init__(self, length_us: int = 30_000_000, override: float = 0.5):
        self.length_us, self.override = length_us, override

    @staticmethod
    def start() -> dict:
        return {"level": None, "magnitude": 0.0, "at": 0}

    def active(self, state: dict, now: int, name: str) -> bool:
        return state["level"] is not None and now - state["at"] < self.length_us and LEVELS.index(state["level"]) >= LEVELS.index(name)

    def decide(self, state: dict, now: int, name: str | None, magnitude: float, mesh: bool) -> str:
        """The kind of decision; the state changes only where an alert goes out from here."""
        if name is None:
            return "NoAlert"
        if self.active(state, now, name) and not magnitude >= state["magnitude"] + self.override:
            return "Suppressed"
        if name in ("High", "Critical"):
            if mesh:
                return "DeferForConsensus"
            state.update(level="Medium", magnitude=magnitude, at=now)
            return "EmitCappedAtMedium"
        state.update(level=name, magnitude=magnitude, at=now)
        return "EmitLocal"


def decisions(predictions: DataFrame, cooldown: Cooldown, mesh: bool = False) -> DataFrame:
    """(station, us, id, level, kind) for predictions (station, us, id, probability, magnitude), in each station's order of time."""
    kinds = {c: predictions.schema[c].dataType.simpleString() for c in ("station", "id")}

    def step(state: dict, row: tuple) -> tuple:
        name = row.level if isinstance(row.level, str) else None
        return row.station, row.us, row.id, name, cooldown.decide(state, row.us, name, row.magnitude, mesh)

    rows = predictions.select("station", "us", "id", "magnitude", level(F.col("probability")).alias("level"))
    return keyed_fold(rows, "station", ["us", "id"], Cooldown.start, step, f"station {kinds['station']}, us long, id {kinds['id']}, level string, kind string")


def resumed(predictions: DataFrame, state: DataFrame, cooldown: Cooldown, mesh: bool = False) -> DataFrame:
    """decisions() that go on from each station's state (station, level, magnitude, at): also last_level, last_magnitude and last_at, the state after each row. A station's old state is a row of its own, without an id."""
    kinds = {c: predictions.schema[c].dataType.simpleString() for c in ("station", "id")}

    def step(now: dict, row: tuple) -> tuple:
        name = row.level if isinstance(row.level, str) else None
        if row.old:
            now.update(level=name, magnitude=row.magnitude, at=int(row.at))
            return row.station, -1, None, name, None, now["level"], now["magnitude"], now["at"]
        kind = cooldown.decide(now, row.us, name, row.magnitude, mesh)
        return row.station, row.us, row.id, name, kind, now["level"], now["magnitude"], now["at"]

    new = predictions.select("station", "us", "id", "magnitude", level(F.col("probability")).alias("level"), F.lit(False).alias("old"), F.lit(0).cast("long").alias("at"))
    kept = state.select("station", F.lit(-1).cast("long").alias("us"), F.lit(-1).cast(kinds["id"]).alias("id"), "magnitude", "level", F.lit(True).alias("old"), "at")
    schema = f"station {kinds['station']}, us long, id {kinds['id']}, level string, kind string, last_level string, last_magnitude double, last_at long"
    return keyed_fold(kept.unionByName(new), "station", ["us", "id"], Cooldown.start, step, schema)


def confirmations(claims: DataFrame, votes: DataFrame, window_us: int, least: int = 1) -> DataFrame:
    """(claim_id, stations, status) of claims (claim_id, us): distinct stations, whichever they are, that voted (station, us) within the window after."""
    return judged(claims, votes, window_us, least).select("claim_id", "stations", "status")


def judged(claims: DataFrame, votes: DataFrame, window_us: int, least: int = 1) -> DataFrame:
    """The columns of claims (claim_id, us, ...) with stations and status, see confirmations(). Rows of one claim_id count together.

    A vote is its station's first after a claim at t, and in time, just where t lies from the station's vote before, and
    after the vote's time less the window, up to the vote. So votes are stretches of time, and a claim's count is the
    number of stretches that hold its time: a running sum of 1 where one begins and -1 where one ends. Claims and votes
    do not meet in pairs. Stretches are shorter than the window, so sums run within buckets of it, from the number of
    stretches that are open as a bucket begins.
    """
    bucket = F.floor(F.col("us") / window_us)
    before = F.lag("us").over(Window.partitionBy("station").orderBy("us"))
    first = votes.where(F.col("station").isNotNull() & F.col("us").isNotNull()).select("us", before.alias("_before"))
    first = first.where("_before IS NULL OR _before < us").select("us", F.greatest(F.col("us") - (window_us - 1), "_before").alias("_begin"))
    ends = first.select(F.explode(F.array(F.struct(F.col("_begin").alias("us"), F.lit(1).cast("long").alias("_n")), F.struct("us", F.lit(-1).cast("long").alias("_n")))).alias("_e")).select("_e.us", "_e._n")
    started = (bucket * window_us).alias("us")
    carried = first.where(F.col("_begin") < bucket * window_us).groupBy(started).agg(F.count("*").alias("_n"))
    asked = claims.select("us", F.lit(0).cast("long").alias("_n"), F.struct(*claims.columns).alias("_claim"))
    every = asked.unionByName(ends.unionByName(carried), allowMissingColumns=True).withColumn("_b", bucket)
    found = every.withColumn("_n", F.sum("_n").over(Window.partitionBy("_b").orderBy("us"))).where("_claim IS NOT NULL")
    n = F.when(F.col("us").isNotNull() & F.col("_claim.claim_id").isNotNull(), F.col("_n")).otherwise(F.lit(0)).alias("stations")
    own = Window.partitionBy("claim_id")
    found = found.select("_claim.*", n).withColumn("_again", F.col("claim_id").isNotNull() & F.coalesce(F.min("us").over(own) < F.max("us").over(own), F.lit(False)))
    repeated = found.where("_again")
    repeated = repeated.drop("stations").join(_met(repeated.select("claim_id", "us"), votes, window_us), "claim_id", "left").withColumn("stations", F.coalesce("stations", F.lit(0)))
    whole = found.where("NOT _again").unionByName(repeated)
    return whole.select(*claims.columns, "stations", F.when(F.col("stations") >= least, "Reached").otherwise("Pending").alias("status"))


def _met(claims: DataFrame, votes: DataFrame, window_us: int) -> DataFrame:
    """(claim_id, stations) of claims that several rows (claim_id, us) make, by pairs of them with votes.

    A claim looks in the bucket of its time and in the next. There, a station's first or last vote decides whether it
    voted in time, so votes come down to one row for each station and bucket before they meet claims.
    """
    bucket = F.floor(F.col("us") / window_us)
    left = claims.select("claim_id", F.col("us").alias("_at"), bucket.alias("_own"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    right = votes.groupBy(F.col("station").alias("_from"), bucket.alias("_b")).agg(F.min("us").alias("_first"), F.max("us").alias("_last"))
    in_time = F.when(F.col("_b") == F.col("_own"), F.col("_last") > F.col("_at")).otherwise(F.col("_first") - F.col("_at") < window_us)
    return left.join(right, "_b").where(in_time).groupBy("claim_id").agg(F.countDistinct("_from").alias("stations"))


def claim_status(claim_ids: DataFrame, claims: DataFrame) -> DataFrame:
    """Unknown claims are told apart by a left join."""
    known = claims.select("claim_id", F.lit(True).alias("_k"))
    return claim_ids.join(known, "claim_id", "left").select("claim_id", F.when(F.col("_k").isNull(), "UnknownClaim").otherwise("Known").alias("status"))


def consensus_alerts(claims: DataFrame, confirmed: DataFrame, least: int = 1) -> DataFrame:
    """(claim_id, station, timestamp_us, consensus_stations, level) of claims (claim_id, station, us, level) that were reached: at their own level and time; a claim ends with the vote that reaches it."""
    return reached(confirmed.join(claims, "claim_id"), least)


def reached(judged: DataFrame, least: int = 1) -> DataFrame:
    """consensus_alerts() of claims with their stations and status."""
    made = judged.where(F.col("status") == "Reached")
    return made.select("claim_id", "station", F.col("us").alias("timestamp_us"), (F.least("stations", F.lit(least)) + 1).alias("consensus_stations"), "level")


def consensus(rows: DataFrame, cooldown: Cooldown, window_us: int = 10_000_000, least: int = 1) -> DataFrame:
    """(station, us, id, kind, level, outcome, stations) of a station's predictions and of the votes for its claims, as one state machine.

    Rows are (station, us, id, kind, probability, magnitude, voter): a prediction's id names its claim, a vote's id the
    claim that it confirms. A deferred prediction makes a claim; the vote of the `least`-th different station reaches
    it: its alert goes out at the level it was made with, and the cooldown runs from the time it was made. Claims as old
    as the window end, and later votes find them unknown. At equal times predictions come before votes.
    """

    machine = Consensus(cooldown, window_us, least)

    def step(state: dict, row: tuple) -> tuple:
        machine.expired(state, row.us)
        return machine.take(state, row)

    return keyed_fold(_known(rows), "station", ORDER, machine.start, step, _consensus_schema(rows))


#: At equal times predictions come before votes.
ORDER = ["us", "kind", "id", "voter"]


def _known(rows: DataFrame) -> DataFrame:
    return rows.select("station", "us", "id", "kind", "magnitude", "voter", level(F.col("probability")).alias("level"))


def _consensus_schema(rows: DataFrame) -> str:
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("station", "id")}
    return f"station {kinds['station']}, us long, id {kinds['id']}, kind string, level string, outcome string, stations int"


class Consensus:
    """One station's predictions and claims; the state is plain data."""

    def __init__(self, cooldown: Cooldown, window_us: int, least: int):
        self.cooldown, self.window_us, self.least = cooldown, window_us, least

    @staticmethod
    def start() -> dict:
        return {**Cooldown.start(), "claims": {}}

    def expired(self, state: dict, now: int) -> list[tuple]:
        """End the claims that are as old as the window by now: (time, id, votes), in the order of time."""
        due = sorted((x["at"] + self.window_us, c, len(x["voters"])) for c, x in state["claims"].items() if now - x["at"] >= self.window_us)
        for _, claim, _ in due:
            del state["claims"][claim]
        return due

    def take(self, state: dict, row: tuple) -> tuple:
        claims, head = state["claims"], (row.station, row.us, row.id, row.kind)
        if row.kind == "prediction":
            name = row.level if isinstance(row.level, str) else None
            outcome = self.cooldown.decide(state, row.us, name, row.magnitude, True)
            if outcome == "DeferForConsensus":
                claims[row.id] = {"at": row.us, "level": name, "magnitude": row.magnitude, "voters": []}
            return *head, name, outcome, 0
        if (claim := claims.get(row.id)) is None:
            return *head, None, "UnknownClaim", 0
        if row.voter not in claim["voters"]:
            claim["voters"].append(row.voter)
        if len(claim["voters"]) < self.least:
            return *head, claim["level"], "Pending", len(claim["voters"])
        del claims[row.id]
        state.update(level=claim["level"], magnitude=claim["magnitude"], at=claim["at"])
        return *head, claim["level"], "Reached", len(claim["voters"]) + 1

    def due(self, state: dict, station: object, now: int) -> list[tuple]:
        """A Medium alert without contents for each claim that has expired by now."""
        return [(station, at, claim, "expiry", "Medium", "Expired", votes) for at, claim, votes in self.expired(state, now)]


def consensus_events(rows: DataFrame, cooldown: Cooldown, window_us: int = 10_000_000, least: int = 1) -> DataFrame:
    """consensus() with a row for each claim that expires: kind expiry, at the time its window ends, level Medium, outcome Expired, stations: the votes it had. Claims whose window ends after the last row of all stay open."""
    machine = Consensus(cooldown, window_us, least)
    kept = _known(rows).join(F.broadcast(rows.agg(F.max("us").alias("end"))))

    def step(state: dict, row: tuple) -> list:
        state["end"] = int(row.end)
        return [*machine.due(state, row.station, row.us), machine.take(state, row)]

    return keyed_events(kept, "station", ORDER, machine.start, step, lambda state, own: machine.due(state, own, state["end"]), _consensus_schema(rows))


def expired(claims: DataFrame, now_us: Column, timeout_us: int) -> DataFrame:
    """Claims as old as the timeout or older end as Medium alerts without contents."""
    return claims.where(now_us - F.col("us") >= timeout_us).select("claim_id", F.lit("Medium").alias("level"), F.lit(0.0).alias("magnitude"))


def peer_health(last_us: Column, now_us: Column, stale_us: int = 60_000_000, lost_us: int = 300_000_000) -> Column:
    gone = F.greatest(now_us - last_us, F.lit(0))
    return F.when(gone <= stale_us, "Healthy").when(gone <= lost_us, "Stale").otherwise("Lost")


class Peers:
    """The peers of a station. `add` registers one as last heard at 0, also one that is known; `seen` marks a known one as heard; `refresh` judges all of them. Added or heard, a peer is healthy until the next refresh."""

    def __init__(self, stale_us: int = 60_000_000, lost_us: int = 300_000_000):
        self.stale_us, self.lost_us = stale_us, lost_us

    def health(self, last: int, now: int) -> str:
        gone = max(now - last, 0)
        return "Healthy" if gone <= self.stale_us else "Stale" if gone <= self.lost_us else "Lost"

    def take(self, known: dict, op: str, peer: str, us: int) -> list[tuple[int, int, int]]:
        """Change `known` (peer: last heard, health) and give, for a refresh, how many are healthy, stale and lost."""
        if op == "add":
            known[peer] = (0, "Healthy")
        elif op == "seen" and peer in known:
            known[peer] = (us, "Healthy")
        elif op == "refresh":
            for p, (last, _) in known.items():
                known[p] = (last, self.health(last, us))
            found = [h for _, h in known.values()]
            return [(found.count("Healthy"), found.count("Stale"), found.count("Lost"))]
        return []


class Roll:
    """Counts of one station's peers as Peers.take() gives them, for rows whose times do not fall.

    A peer turns stale and then lost by the passing of time alone, so peers wait in heaps for that, and a refresh only
    moves those whose time has come: all refreshes together take as long as the rows, not each as long as its peers.
    """

    def __init__(self, peers: Peers):
        self.after = (peers.stale_us, peers.lost_us)
        self.known: dict[str, tuple[int, int]] = {}  # peer: last heard, number of that entry
        self.state: dict[str, int] = {}  # 0 healthy, 1 stale, 2 lost, as of the last refresh
        self.counts, self.waiting, self.entries = [0, 0, 0], ([], []), 0

    def _heard(self, peer: str, us: int) -> None:
        if peer in self.state:
            self.counts[self.state[peer]] -= 1
        self.entries += 1
        self.known[peer], self.state[peer] = (us, self.entries), 0
        self.counts[0] += 1
        heapq.heappush(self.waiting[0], (us, self.entries, peer))
        if sum(map(len, self.waiting)) > 2 * len(self.known) + 1024:  # most are entries that later ones have replaced
            for n, heap in enumerate(self.waiting):
                heap[:] = [x for x in heap if self.known[x[2]][1] == x[1] and self.state[x[2]] == n]
                heapq.heapify(heap)

    def take(self, op: str, peer: str, us: int) -> list[tuple[int, int, int]]:
        if op == "add":
            self._heard(peer, 0)
        elif op == "seen" and peer in self.known:
            self._heard(peer, us)
        elif op == "refresh":
            for n, heap in enumerate(self.waiting):
                while heap and us - heap[0][0] > self.after[n]:
                    entry = heapq.heappop(heap)
                    if self.known[entry[2]][1] == entry[1]:
                        self.state[entry[2]] = n + 1
                        self.counts[n] -= 1
                        self.counts[n + 1] += 1
                        if n == 0:
                            heapq.heappush(self.waiting[1], entry)
            return [tuple(self.counts)]
        return []


def peer_rows(rows: DataFrame) -> DataFrame:
    """What a registry of peers reads of (station, us, id, op, peer): rows with a station, a time and a known op, and for all but refreshes a peer."""
    kept = rows.where(F.col("station").isNotNull() & F.col("us").isNotNull() & (F.col("op").isin("add", "seen") & F.col("peer").isNotNull() | (F.col("op") == "refresh")))
    return kept.select(F.col("station").cast("long").alias("station"), F.col("us").cast("long").alias("us"), F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"), "op", F.coalesce(F.col("peer").cast("string"), F.lit("")).alias("peer"))


def peer_registry(rows: DataFrame, peers: Peers | None = None) -> DataFrame:
    """(station, us, id, healthy, stale, lost) of each station's peers after each refresh, from rows (station, us, id, op, peer) in the order of (us, id).

    See Peers and peer_rows() for what counts. Rows that repeat are taken again, and a null id is -1. A station's rows
    stream through a task, which holds its peers only (see Roll).
    """
    book = peers or Peers()

    def step(roll: Roll, row: tuple) -> list:
        return [(row.station, row.us, row.id, *n) for n in roll.take(row.op, row.peer, row.us)]

    return keyed_events(peer_rows(rows), "station", ["us", "id", "op", "peer"], lambda: Roll(book), step, lambda state, own: [], PEER_COUNTS)


PEER_COUNTS = "station long, us long, id long, healthy int, stale int, lost int"


def received(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, event) of messages (id, station, key_ok, signature_ok, payload_ok, kind), in the order the checks are made."""
    joined = messages.join(registry.select("station", F.lit(True).alias("_known")), "station", "left")
    event = F.when(F.col("_known").isNull(), "UnknownPeer").when(~F.col("key_ok"), "InvalidKey").when(~F.col("signature_ok"), "InvalidSignature").when(~F.col("payload_ok"), "InvalidPayload").otherwise(F.col("kind"))
    return joined.select("id", event.alias("event"))


def pins(alerts: DataFrame) -> DataFrame:
    """(id, pin): the pins that a level raises; Low raises none."""
    wired = F.when(F.col("level") == "Medium", F.array(F.lit(17))).when(F.col("level") == "High", F.array(F.lit(27))).when(F.col("level") == "Critical", F.array(F.lit(27), F.lit(22))).otherwise(F.array().cast("array<int>"))
    return alerts.select("id", F.explode(wired).alias("pin"))


def signed(alerts: DataFrame, seed: bytes) -> DataFrame:
    """Alerts with a signature over the JSON of all their columns."""
    from ..functions.signing import signatures

    message = F.to_json(F.struct(*sorted(alerts.columns)))
    return alerts.withColumn("signature", signatures(seed)(F.encode(message, "UTF-8")))


def genuine(alerts: DataFrame, key: bytes) -> DataFrame:
    """Those whose signature holds."""
    from ..functions.signing import verified

    message = F.to_json(F.struct(*sorted(c for c in alerts.columns if c != "signature")))
    return alerts.where(verified(F.lit(key), F.encode(message, "UTF-8"), F.col("signature")))
