import random
import threading
import time

from pyspark.sql import functions as F

from seisloom.operators import alerts
from seisloom.streaming import processors
from seisloom.streaming.watch import Watch, Watching, memory_share

SCHEMA = "station int, us long, id long, op string, peer long"


def wait(true, seconds=60):
    end = time.time() + seconds
    while not true():
        assert time.time() < end
        time.sleep(0.05)


def test_stalled_query_stops_heartbeats(spark, tmp_path):
    now, stall, stalled = [0.0], threading.Event(), threading.Event()
    release = threading.Event()

    def write(df, n):
        df.count()
        if stall.is_set():
            stalled.set()
            release.wait(60)

    watch = Watch(clock=lambda: now[0], used=lambda: 0.5)
    spark.streams.addListener(watch)
    query = spark.readStream.format("rate").option("rowsPerSecond", 10).load().writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        wait(lambda: len(query.recentProgress) > 1 and watch.alive)
        run = str(query.runId)
        now[0] = 8.0
        wait(lambda: watch.alive[run] == 8.0)  # progress goes on
        assert watch.tick() and watch.stale() == []
        stall.set()
        assert stalled.wait(60)
        time.sleep(1)  # for signs that are under way
        now[0] = 18.0
        assert watch.tick()  # ten seconds are not over the limit
        now[0] = 18.1
        assert not watch.tick() and watch.stale() == [run]
        release.set()
        wait(lambda: watch.stale() == [])
        assert not watch.tick()  # and stay off
        assert [r["event"] for r in watch.rows(spark).orderBy("at").collect()] == ["heartbeat", "heartbeat", "silence"]
    finally:
        release.set()
        query.stop()
        wait(lambda: run not in watch.alive)  # a query that ends well is not watched
        spark.streams.removeListener(watch)


def test_levels(spark):
    now, share, seen = [0.0], [0.5], []
    watch = Watch(lambda *x: seen.append(x), lambda: share[0], clock=lambda: now[0])
    for at, used in ((0, 0.95), (10, 0.1), (30, 0.85), (60, 0.85), (90, 0.9), (120, 0.1)):
        now[0], share[0] = at, used
        assert watch.tick()  # no query, no silence
    assert seen == [("Critical", 16), ("Warning", 32), ("Normal", 64)] and 0 < memory_share() < 1
    with Watching(spark, Watch(used=lambda: 0.0), 0.05) as own:
        wait(lambda: len(own.kept) > 2)
    assert not own.paused


def said(n):
    random.seed(5)
    return [(s, t * 10**6, s * 10**15 + t, random.choice(["add", "seen", "seen", "seen", "refresh", "other", None]), random.choice([None, 2**60 + 1, 2**60 + 2, 2**60 + 3])) for s in (1, 2) for t in sorted(random.sample(range(3000), n))]


def brute(rows):
    out, known = [], {}
    for s, us, i, op, peer in rows:
        own = known.setdefault(s, {})
        if op == "refresh":
            gone = [us - last for last in own.values()]
            out.append((s, us, i, sum(g <= 60e6 for g in gone), sum(60e6 < g <= 300e6 for g in gone), sum(g > 300e6 for g in gone)))
        elif peer is not None and op == "add":
            own[peer] = 0
        elif peer in own and op == "seen":
            own[peer] = us
    return sorted(out)


def test_peers(spark, tmp_path):
    rows = said(200)
    odd = [(None, 1, 1, "refresh", None), (1, None, 1, "refresh", None)]
    got = alerts.peer_registry(spark.createDataFrame(random.sample(rows + odd, len(rows) + 2), SCHEMA).withColumn("start", F.lit(1)))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert {k for r in brute(rows) for k in (3, 4, 5) if r[k]} == {3, 4, 5}
    assert alerts.peer_registry(spark.createDataFrame([], SCHEMA)).count() == 0
    for part in range(3):  # a restart for each part
        spark.createDataFrame([r for r in rows if part <= r[1] / 10**9 < part + 1], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part-{part}")
        stream = processors.peer_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == brute(rows)


def test_roll_counts_without_going_through_the_peers():
    """As Peers.take() counts, for gaps and limits of all kinds; and 20,000 refreshes of 20,000 peers take seconds."""
    random.seed(9)
    for stale, lost, least in ((5, 20, -300), (0, 0, 0), (9, 4, 0)):
        book, known, now = alerts.Peers(stale, lost), {}, least
        roll = alerts.Roll(book)
        for _ in range(4000):
            now += random.choice([0, 0, 1, 2, 30])
            op, peer = random.choice(["add", "seen", "seen", "refresh"]), str(random.randrange(12))
            assert roll.take(op, peer, now) == book.take(known, op, peer, now)
        assert sum(map(len, roll.waiting)) <= 2 * 12 + 1024
    roll, begin = alerts.Roll(alerts.Peers()), time.process_time()
    for n in range(20_000):
        roll.take("add", str(n), n)
    for n in range(20_000):
        roll.take("seen", str(n), n * 10**5)
        (counts,) = roll.take("refresh", "", n * 10**5)
        assert sum(counts) == 20_000
    assert time.process_time() - begin < 20
