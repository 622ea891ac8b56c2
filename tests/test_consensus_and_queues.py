"""Claims that expire, in batch and on a stream, queues with drain, the sensor registry and probation, each against a loop."""

import random

from pyspark.sql import functions as F

from seisloom.operators import adaptation, alerts, folds
from seisloom.streaming import processors

SECOND = 1_000_000
BASE = 10**15  # a stream takes what lies at the epoch for late


def said(seed=5, n=90):
    random.seed(seed)
    rows = [(k % 3, k * 10 * SECOND, k, "prediction", random.random(), random.random() * 3, None) for k in range(n)]
    rows += [(c % 3, c * 10 * SECOND + random.randrange(0, 90) * SECOND, c, "vote", None, None, random.randrange(3)) for c in random.choices(range(n), k=2 * n)]
    rows = [(r[0], BASE + r[1], *r[2:]) for r in rows]
    return list({(r[1], r[3], r[2], r[6]): r for r in rows}.values()) + [(99, BASE + 10**5 * SECOND, -1, "prediction", 0.0, 0.0, None)]


def brute(rows, window, least):
    """Second by second: claims end first, then predictions, then votes."""
    out, end = [], max(r[1] for r in rows)
    for station in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == station), key=lambda r: (r[1], r[3], r[2], r[6] is not None, r[6] or 0))
        cooldown, state, claims = alerts.Cooldown(30 * SECOND), alerts.Cooldown.start(), {}

        def expire(now, claims=claims, station=station):
            for at, c in sorted((x["at"], c) for c, x in claims.items() if x["at"] + window <= now):
                out.append((station, at + window, c, "expiry", "Medium", "Expired", len(claims.pop(c)["votes"])))

        for _, us, i, kind, p, magnitude, voter in own:
            expire(us)
            if kind == "prediction":
                name = next((x for x, b in zip(alerts.LEVELS[::-1], alerts.BOUNDS[::-1], strict=True) if p >= b), None)
                outcome = cooldown.decide(state, us, name, magnitude, True)
                if outcome == "DeferForConsensus":
                    claims[i] = {"at": us, "votes": set(), "level": name, "magnitude": magnitude}
                out.append((station, us, i, kind, name, outcome, 0))
            elif i not in claims:
                out.append((station, us, i, kind, None, "UnknownClaim", 0))
            else:
                claims[i]["votes"].add(voter)
                if len(claims[i]["votes"]) < least:
                    out.append((station, us, i, kind, claims[i]["level"], "Pending", len(claims[i]["votes"])))
                else:
                    x = claims.pop(i)
                    state.update(level=x["level"], magnitude=x["magnitude"], at=x["at"])
                    out.append((station, us, i, kind, x["level"], "Reached", len(x["votes"]) + 1))
        expire(end)
    return sorted(out, key=repr)


SAID = "station long, us long, id long, kind string, probability double, magnitude double, voter long"


def test_expiries(spark):
    rows = said()
    for least in (1, 2):
        got = alerts.consensus_events(spark.createDataFrame(rows, SAID), alerts.Cooldown(30 * SECOND), 60 * SECOND, least)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 60 * SECOND, least)
    assert {"Expired", "Reached", "Pending", "UnknownClaim"} <= {r["outcome"] for r in got.collect()}
    assert alerts.consensus_events(spark.createDataFrame([], SAID), alerts.Cooldown(), 10).count() == 0


def test_consensus_stream_with_late_rows(spark, tmp_path):
    rows = said(6, 45)
    random.seed(7)
    arrive = [(r[1] + random.randrange(0, 60) * SECOND, r) for r in rows]  # up to a minute late
    arrive.sort(key=lambda x: x[0])
    for part in range(4):
        some = [r for _, r in arrive[len(arrive) * part // 4 : len(arrive) * (part + 1) // 4]]
        spark.createDataFrame(some, SAID).coalesce(1).write.parquet(f"{tmp_path}/in/part-{part}")
        stream = processors.consensus_stream(spark.readStream.schema(SAID).parquet(f"{tmp_path}/in/*"), alerts.Cooldown(30 * SECOND), 60 * SECOND, 2, "70 seconds")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    assert got == [r for r in brute(rows, 60 * SECOND, 2) if r[0] != 99] and any(r[5] == "Expired" for r in got)


def test_outbound(spark):
    random.seed(2)
    rows = [(q, t, 10**17 + q * 10_000 + t, random.choices(["push", "urgent", "drain", None], [60, 30, 1 if q else 0, 9])[0]) for q in range(3) for t in range(2500)]
    expected = []
    for capacity in (1, 3, 1000):
        expected = []
        for q in range(3):
            queue = []
            for _, _, x, op in (r for r in rows if r[0] == q):
                if op == "drain":
                    expected += [(q, y, "drained", x, k) for k, y in enumerate(queue)]
                    queue = []
                    continue
                if len(queue) == capacity:
                    expected.append((q, queue.pop(-1 if op == "urgent" else 0), "evicted", x, 0))
                queue.insert(0 if op == "urgent" else len(queue), x)
            expected += [(q, y, "held", None, k) for k, y in enumerate(queue)]
        got = folds.outbound(spark.createDataFrame(rows, "q int, t int, x long, op string").repartition(5), "q", ["t"], "x", "op", capacity)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert {r[2] for r in expected} == {"drained", "evicted", "held"}


def test_registry(spark):
    ops = [("a", 0, "success", 90.0, 5.0), ("a", 1, "register", 100.0, None), ("a", 2, "success", 80.0, 5.0), ("a", 3, "success", 100.0, 50.0), ("a", 4, "success", 100.0, 6.0), ("a", 5, "register", 100.0, None)]
    ops += [("b", 0, "register", 100.0, None), *[("b", k, "failure", None, None) for k in range(1, 12)], ("b", 12, "success", 100.0, 1.0), ("c", 0, None, None, None)]
    got = {(r["s"], r["t"]): (r["status"], r["noise_floor"]) for r in folds.registry(spark.createDataFrame(ops, "s string, t int, op string, rate double, level double"), "s", ["t"]).collect()}
    assert [got["a", t][0] for t in range(6)] == ["Failed", "Active", "Degraded", "Degraded", "Degraded", "Active"]
    assert [round(got["a", t][1], 9) for t in range(6)] == [0.0, 0.0, 5.0, 5.0, 5.1, 0.0]
    assert [got["b", t][0] for t in range(13)] == ["Active"] * 11 + ["Failed", "Active"] and got["c", 0] == ("Failed", 0.0)


def test_probation_lifecycle(spark):
    hour = 3_600_000_000
    rows = [(0, "evaluate"), (1, "start", 7), (2, "outcome", None, "current", False), (3, "outcome", None, "candidate", True), (hour, "evaluate"), (hour + 1, "evaluate"), (hour + 2, "evaluate"), (hour + 3, "start", 8), (hour + 4, "outcome", None, "current", True), (3 * hour, "evaluate"), (3 * hour + 1, "outcome", None, "current", True), (3 * hour + 2, "start", 9), (9 * hour, "evaluate")]
    df = spark.createDataFrame([(1, r[0], *(list(r[1:]) + [None] * 4)[:4]) for r in rows], "e int, us long, kind string, version long, arm string, ok boolean")
    got = adaptation.probation_lifecycle(df, "e", ["us"]).orderBy("us").collect()
    assert [(r["result"], r["version"]) for r in got] == [("InProgress", 0), ("InProgress", 0), ("Promote", 7), ("InProgress", 7), ("Rollback", 7), ("Promote", 9)]
    assert df.where(F.col("kind") == "evaluate").count() == len(got)
